"""Sources mixed to target weights by entropy balancing."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.llm.tokens import DEFAULT_VOCABULARY, Tokens
from mapweave.util import materialize, remove_path, spread

#: The dual is solved when every source's expected tokens are this close to their target, relatively.
PRECISION = 1e-6
BINS = 4096
#: Rows of a target table: mixes are configuration, and their dual variables live on the driver.
MOST_TARGETS = 100_000


def count_tokens(documents: DataFrame, text: str, vocabulary: str = DEFAULT_VOCABULARY) -> DataFrame:
    """documents without `text`, with `tokens` and `text_key`, a digest by which equal texts are known."""
    rest = [c for c in documents.columns if c != text]
    given = documents.select(*rest, F.sha2(text, 256).alias("text_key"), F.col(text))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens.of(vocabulary)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([tokens.count(texts[k].as_py()) for k in range(batch.num_rows)], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], [*batch.schema.names[:-1], "tokens"])

    return spread(given).mapInArrow(count, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.drop(text).schema) + ", tokens long")


def _rate(lam: Column, t: Column, cap: Column) -> Column:
    """Copies expected of a text of t tokens: the tilt exp(lam t) of one copy each, at most cap."""
    return F.exp(F.least(F.log(cap.cast("double")), lam * t))


def mix(documents: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", total_tokens: int | None = None, vocabulary: str = DEFAULT_VOCABULARY) -> tuple[DataFrame, DataFrame]:
    """The documents of each mix with their copies, and the report of the shares reached.

    targets: mix_name, source, target_weight (relative within the mix), max_repeats (so many copies of a text
    at most, the first included). total_tokens: the size each mix is to have; by default the tokens of its
    named sources' texts, each once.

    plan: (mix_name, doc_id, source, tokens, same_text_as, rate, copies), a row for each mix that names the
    document's source, copies 0 included. Equal texts of a source are one text: its smallest doc_id carries
    the copies, the others have none and name it in same_text_as. Rates solve: least relative entropy to one
    copy of each text, subject to every source's expected tokens being its share of the total, and to the
    cap. The dual has one variable per mix and source, rate = min(cap, exp(lambda tokens)); its Newton steps
    need two sums per source, taken over all texts by an aggregate each step and kept safe by bisection.
    Rates become copies: the whole part, and one more for the texts whose fraction exceeds a fixed
    hash of their id by most, as many as bring the source's tokens closest to the target.

    report: per mix and source the target and reached tokens and shares, texts, copies, most copies of one
    text, and status: met (within 1 % or one text), short (cap reached), over (never), empty (no text).
    share_of_total refers to the size asked for, share_reached to the mix as it came out; where a source is
    short, the others keep their targets and the mix is smaller.

    NULL and empty texts, documents without a source and sources no mix names stay out. A repeated target
    row (mix, source) counts once, with its greatest weight and cap; weights NULL, negative or NaN count as 0,
    max_repeats NULL or < 1 as 1. Empty tables give an empty plan, and a report of what is `empty`.
    """
    spark = documents.sparkSession
    w = F.col("target_weight").cast("double")
    goals = targets.where(F.col("mix_name").isNotNull() & F.col("source").isNotNull()).groupBy("mix_name", "source").agg(
        F.max(F.when(w > 0, F.nanvl(w, F.lit(0.0))).otherwise(0.0)).alias("weight"), F.max(F.greatest(F.coalesce("max_repeats", F.lit(1)), F.lit(1))).alias("cap")
    )
    rows = goals.orderBy("mix_name", "source").limit(MOST_TARGETS + 1).collect()
    if len(rows) > MOST_TARGETS:
        raise ValueError(f"more than {MOST_TARGETS} targets")
    named = spark.createDataFrame([(s,) for s in sorted({r.source for r in rows})], "source string")
    # text with no token isn't text
    docs = documents.where(F.col(text).isNotNull() & (F.col(text) != "")).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("text"))
    sized, sized_at = materialize(count_tokens(docs.join(F.broadcast(named), "source", "left_semi"), "text", vocabulary), "sizes")
    texts, texts_at = materialize(sized.groupBy("source", "text_key").agg(F.min("doc_id").alias("first"), F.first("tokens").alias("tokens")), "texts")
    # texts of one source and size tilt alike
    cells, cells_at = materialize(texts.groupBy("source", "tokens").agg(F.count(F.lit(1)).alias("n")), "cells")
    held = {r.source: (r.t, r.n) for r in cells.groupBy("source").agg(F.sum(F.col("tokens") * F.col("n")).alias("t"), F.sum("n").alias("n")).collect()}

    goal: dict[tuple[str, str], float] = {}
    lam: dict[tuple[str, str], float | None] = {}
    cap = {(r.mix_name, r.source): int(r.cap) for r in rows}
    bracket: dict[tuple[str, str], list[float]] = {}
    for name in {r.mix_name for r in rows}:
        mine = [r for r in rows if r.mix_name == name]
        all_of = sum(r.weight for r in mine)
        size = total_tokens if total_tokens is not None else sum(held.get(r.source, (0, 0))[0] for r in mine)
        for r in mine:
            k = (name, r.source)
            goal[k] = size * r.weight / all_of if all_of else 0.0
            have = held.get(r.source, (0, 0))[0]
            if not have or goal[k] <= 0:
                lam[k] = None
            elif goal[k] >= have * cap[k]:
                lam[k] = float("inf")
            else:
                mean = have / held[r.source][1]
                lam[k] = math.log(max(1e-6, goal[k] / have)) / mean
                bracket[k] = [float("-inf"), float("inf")]

    todo, steps = set(bracket), 0
    residual: dict[tuple[str, str], float] = {}
    while todo:
        steps += 1
        at = spark.createDataFrame([(m, s, lam[m, s], cap[m, s]) for m, s in sorted(todo)], "mix_name string, source string, lam double, cap int")
        t = F.col("tokens").cast("double")
        r = _rate(F.col("lam"), t, F.col("cap"))
        free = F.col("lam") * t < F.log(F.col("cap").cast("double"))
        sums = cells.join(F.broadcast(at), "source").groupBy("mix_name", "source").agg(F.sum(r * t * F.col("n")).alias("f"), F.sum(F.when(free, r * t * t * F.col("n")).otherwise(0.0)).alias("g"))
        for x in sums.collect():
            k = (x.mix_name, x.source)
            gap = x.f - goal[k]
            residual[k] = abs(gap) / goal[k]
            if abs(gap) <= PRECISION * goal[k]:
                todo.discard(k)
                continue
            bracket[k][gap > 0] = lam[k]
            lo, hi = bracket[k]
            step = lam[k] - gap / x.g if x.g > 0 else float("nan")
            # every third step halves the bracket, so the end is near however Newton's steps creep
            if not lo < step < hi or (steps % 3 == 0 and not math.isinf(lo) and not math.isinf(hi)):
                if math.isinf(lo):
                    step = hi - max(1e-6, 2 * abs(hi))
                elif math.isinf(hi):
                    step = lo + max(1e-6, 2 * abs(lo))
                else:
                    step = (lo + hi) / 2
            if step == lam[k]:
                todo.discard(k)
            lam[k] = step

    solved = spark.createDataFrame([(m, s, v, cap[m, s]) for (m, s), v in sorted(lam.items(), key=lambda kv: kv[0])], "mix_name string, source string, lam double, cap int")
    t = F.col("tokens").cast("double")
    rate = F.when(F.col("lam").isNull() | (t <= 0), 0.0).when(F.col("lam") == float("inf"), F.col("cap").cast("double")).otherwise(_rate(F.col("lam"), t, F.col("cap")))
    # uniform in [0, 1), fixed per mix and text
    u = F.pmod(F.xxhash64("mix_name", "first"), F.lit(1 << 40)) / F.lit(float(1 << 40))
    rated = texts.join(F.broadcast(solved), "source").withColumn("rate", rate).withColumn("whole", F.floor("rate"))
    rated = rated.withColumn("excess", F.when(F.col("rate") > F.col("whole"), F.col("rate") - F.col("whole") - u))
    rated, rated_at = materialize(rated.select("mix_name", "source", "text_key", "first", "tokens", "rate", "whole", "excess"), "rates")

    # the excess above which one more copy is due, by two rounds of histograms
    sure = {(x.mix_name, x.source): x.t for x in rated.groupBy("mix_name", "source").agg(F.sum(F.col("whole") * F.col("tokens")).alias("t")).collect()}
    want = {k: goal[k] - (sure.get(k) or 0) for k in bracket}
    edge = {k: (-1.0, 1.0) for k in bracket}
    above = dict.fromkeys(bracket, 0.0)
    for _ in range(3):
        if not edge:
            break
        at = spark.createDataFrame([(m, s, lo, hi) for (m, s), (lo, hi) in sorted(edge.items())], "mix_name string, source string, lo double, hi double")
        inside = rated.where(F.col("excess").isNotNull()).join(F.broadcast(at), ["mix_name", "source"]).where((F.col("excess") >= F.col("lo")) & (F.col("excess") < F.col("hi")))
        b = F.least(F.floor((F.col("excess") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1))
        bins: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for x in inside.groupBy("mix_name", "source", b.alias("b")).agg(F.sum("tokens").alias("t")).collect():
            bins.setdefault((x.mix_name, x.source), []).append((x.b, x.t))
        for k, (lo, hi) in list(edge.items()):
            wide = (hi - lo) / BINS
            cut = None
            for i, tokens in sorted(bins.get(k, ()), reverse=True):
                if above[k] + tokens > want[k]:
                    # the last bin goes to the nearer side, the others are looked into
                    cut = (lo + i * wide, lo + (i + 1) * wide, above[k] + tokens - want[k] < want[k] - above[k])
                    break
                above[k] += tokens
            edge[k] = (cut[0], cut[1]) if cut else (lo, lo)
            if cut and _ == 2:
                edge[k] = (cut[0], cut[0]) if cut[2] else (cut[1], cut[1])
    limit = spark.createDataFrame([(m, s, hi) for (m, s), (_, hi) in sorted(edge.items())], "mix_name string, source string, least double")
    more = (F.col("excess") >= F.col("least")).cast("long")
    copies = rated.join(F.broadcast(limit), ["mix_name", "source"], "left").withColumn("copies", F.col("whole") + F.coalesce(more, F.lit(0)))
    copies = copies.select("mix_name", "source", "text_key", "first", F.col("tokens").alias("text_tokens"), "rate", "copies")
    copies, copies_at = materialize(copies, "copies")

    own = F.col("first") == F.col("doc_id")
    plan = sized.join(copies, ["source", "text_key"]).select(
        "mix_name", "doc_id", "source", "tokens", F.when(~own, F.col("first")).alias("same_text_as"),
        F.when(own, F.col("rate")).otherwise(0.0).alias("rate"), F.when(own, F.col("copies")).otherwise(0).cast("int").alias("copies"),
    )

    asked = spark.createDataFrame(
        [(m, s, goal[m, s], cap[m, s], held.get(s, (0, 0))[0], residual.get((m, s))) for m, s in sorted(goal)],
        "mix_name string, source string, target_tokens double, max_repeats int, source_tokens long, residual double",
    )
    got = copies.groupBy("mix_name", "source").agg(
        F.count_if(F.col("copies") > 0).alias("texts"), F.sum("copies").alias("copies"), F.max("copies").alias("most_copies"),
        F.sum(F.col("copies") * F.col("text_tokens")).alias("reached_tokens"), F.max("text_tokens").alias("largest"),
    )
    both = asked.join(got, ["mix_name", "source"], "left").fillna(0, ["texts", "copies", "most_copies", "reached_tokens", "largest"])
    sums = both.groupBy("mix_name").agg(F.sum("target_tokens").alias("_goal"), F.sum("reached_tokens").alias("_got"))
    gap = F.abs(F.col("reached_tokens") - F.col("target_tokens"))
    status = F.when(F.col("source_tokens") == 0, "empty").when(F.col("target_tokens") > F.col("source_tokens") * F.col("max_repeats"), "short")
    report = both.join(sums, "mix_name").select(
        "mix_name", "source", F.round("target_tokens", 3).alias("target_tokens"), "reached_tokens",
        F.round(F.try_divide("target_tokens", "_goal"), 6).alias("target_share"),
        F.round(F.try_divide("reached_tokens", "_goal"), 6).alias("share_of_total"), F.round(F.try_divide("reached_tokens", "_got"), 6).alias("share_reached"),
        "source_tokens", "max_repeats", "texts", "copies", "most_copies", "residual",
        status.when((gap <= 0.01 * F.col("target_tokens")) | (gap <= F.col("largest")), "met").otherwise(F.when(F.col("reached_tokens") > F.col("target_tokens"), "over").otherwise("short")).alias("status"),
    )
    plan, _ = materialize(plan, "plan")
    report, _ = materialize(report, "shares")
    for at in (sized_at, texts_at, cells_at, rated_at, copies_at):
        remove_path(spark, at)
    return plan, report
