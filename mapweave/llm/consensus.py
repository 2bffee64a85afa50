"""Consensus of several annotators by spectral reliability, with sparse joins only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.util import HOT_SHARE, join_by_group, materialize, remove_path, scratch_path

LABELS = ("accept", "reject", "correct")
#: The power iteration ends when no user's weight moves by more than this in a step, or after so many steps.
TOLERANCE = 1e-3
MOST_STEPS = 64
#: Steps of one job, between two looks at how far the weights moved.
STEPS_A_JOB = 4
REFINE_STEPS = 3
#: Weight of the pooled confusion table in each annotator's own, in votes a row.
PRIOR_VOTES = 4.0
#: Users up to which their few numbers each are broadcast (under 200 MB); more are joined by shuffle.
MOST_BROADCAST = 1_000_000


def clean_votes(df: DataFrame, item: str, user: str, label: str, value: str, at: str, tie: str, nobody=("default",)) -> DataFrame:
    """(item, user, label, value): one vote of each named user on each item, the latest by `at`, then `tie`.

    Labels are trimmed and lower-cased; rows with another label, without an item, or of nobody (NULL, blank
    or in `nobody`, in any letter case) drop out. A NULL time counts as the earliest. "" stands for no value;
    only `correct` has one.
    """
    name = F.trim(F.col(user).cast("string"))
    word = F.lower(F.regexp_replace(F.col(label).cast("string"), r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    path = F.trim(F.coalesce(F.col(value).cast("string"), F.lit("")))
    votes = df.select(
        F.col(item).cast("string").alias("item"), name.alias("user"), word.alias("label"),
        F.when(word == "correct", path).otherwise("").alias("value"), F.col(at).alias("_at"), F.col(tie).alias("_tie"),
    )
    votes = votes.where((F.col("item") != "") & (F.col("user") != "") & ~F.lower("user").isin(*nobody) & F.col("label").isin(*LABELS))
    last = F.max_by(F.struct("label", "value"), F.struct("_at", "_tie"))
    return votes.groupBy("item", "user").agg(last.alias("v")).select("item", "user", "v.label", "v.value")


def _is(label: str) -> Column:
    return (F.col("label") == label).cast("double")


class Votes:
    """Clean votes laid out once by item, so that sums over items need no shuffle: a table in buckets of `k`, the
    hash of the item. The votes of an item with HOT_SHARE of all of them or more are spread over buckets by
    user, and its sums added up afterwards."""

    def __init__(self, votes: DataFrame):
        self.spark = spark = votes.sparkSession
        votes, at = materialize(votes, "votes")
        self.total = votes.count()
        shares = votes.groupBy("user").agg(F.count(F.lit(1)).alias("n"), *(F.avg(_is(k)).alias(f"p_{k}") for k in LABELS))
        self.users, self.users_at = materialize(shares.withColumn("uid", F.monotonically_increasing_id()), "users")
        self.few = self.users.count() <= MOST_BROADCAST
        limit = max(1000, int(self.total * HOT_SHARE))
        hot = votes.groupBy("item").agg(F.count(F.lit(1)).alias("_m")).where(F.col("_m") >= limit).select("item", F.lit(True).alias("_hot"))
        named = join_by_group(votes, self.users.select("user", "uid", "n"), "user", "n", self.total).join(F.broadcast(hot), "item", "left")
        k = F.when(F.col("_hot"), F.xxhash64("item", F.pmod(F.xxhash64("user"), F.lit(64)))).otherwise(F.xxhash64("item"))
        laid = named.select(k.alias("k"), "item", F.coalesce("_hot", F.lit(False)).alias("hot"), "uid", "label", "value")
        buckets = max(1, min(spark.sparkContext.defaultParallelism, self.total // 5_000), self.total // 1_000_000)
        self.at = scratch_path(spark, "votes")
        self.name = self.at.rsplit("/", 1)[1].replace("-", "_")
        laid.repartition(buckets, "k").write.bucketBy(buckets, "k").sortBy("k").option("path", self.at).format("parquet").saveAsTable(self.name)
        remove_path(spark, at)
        self.rows = spark.table(self.name)
        self.hot = not self.rows.where("hot").isEmpty()

    def release(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        remove_path(self.spark, self.at)
        remove_path(self.spark, self.users_at)

    def with_users(self, users: DataFrame) -> DataFrame:
        """The votes with columns of their users (uid, n, ...)."""
        if self.few:
            return self.rows.join(F.broadcast(users), "uid")
        return join_by_group(self.rows, users, "uid", "n", self.total)

    def by_item(self, df: DataFrame, more: list[str], **sums: Column) -> DataFrame:
        """Sums over the votes of each item and value of the columns `more`."""
        part = df.groupBy("k", "item", "hot", *more).agg(*(F.sum(c).alias(n) for n, c in sums.items()))
        if not self.hot:
            return part.drop("hot")
        whole = part.where("hot").groupBy("item", *more).agg(*(F.sum(n).alias(n) for n in sums)).withColumn("k", F.lit(0).cast("long"))
        return part.where("NOT hot").drop("hot").unionByName(whole)

    def with_items(self, items: DataFrame) -> DataFrame:
        """The votes with columns of their items (k, item, votes, ...)."""
        if not self.hot:
            return self.rows.join(items, ["k", "item"])
        return join_by_group(self.rows, items.drop("k"), "item", "votes", self.total)


def spectral_weights(votes: Votes, tolerance: float = TOLERANCE, most_steps: int = MOST_STEPS) -> tuple[DataFrame, str]:
    """(uid, n, p_accept, p_reject, p_correct, w, moved), a table, and its path: the leading eigenvector of the
    annotators' agreement matrix, chance-centred and corrected for overlap counts.

    A vote is the indicator of its label less the user's own label shares, so the product of two users'
    votes on an item is their agreement less what their habits give by chance. The rank-one fit to these
    agreements, each weighted by the number of items both judged, is
        w_u <- sum over items of z_u . (S - w_u z_u) / sum over items of (Q - w_u^2),
    with S = sum of w_v z_v and Q = sum of w_v^2 over an item's votes: power iteration over the sparse
    matrix of votes, never over pairs of users. Both sums combine before they are shuffled, so an item or a
    user with a third of all votes is no hot spot. It ends when no weight moves by more than `tolerance` in a
    step; `moved` is how far each did in the last one, and above the tolerance only where most_steps ended it.
    """
    spark = votes.spark
    keep = ["n", *(f"p_{k}" for k in LABELS)]
    per_item = Window.partitionBy("k", "item")

    def step(users: DataFrame) -> DataFrame:
        z = votes.with_users(users).select("k", "item", "hot", "uid", "w", *keep, *((_is(k) - F.col(f"p_{k}")).alias(f"z_{k}") for k in LABELS))
        sums = {f"s_{k}": F.col("w") * F.col(f"z_{k}") for k in LABELS} | {"q": F.col("w") * F.col("w")}
        both = z.select("*", *(F.sum(c).over(per_item).alias(n) for n, c in sums.items()))
        if votes.hot:
            whole = F.broadcast(z.where("hot").groupBy("item").agg(*(F.sum(c).alias(f"_{n}") for n, c in sums.items())))
            both = both.join(whole, "item", "left").select(*z.columns, *(F.coalesce(f"_{n}", n).alias(n) for n in sums))
        up = sum((F.col(f"z_{k}") * (F.col(f"s_{k}") - F.col("w") * F.col(f"z_{k}")) for k in LABELS), F.lit(0.0))
        fit = both.groupBy("uid").agg(F.sum(up).alias("up"), F.sum(F.col("q") - F.col("w") * F.col("w")).alias("down"), F.first("w").alias("_w"), *(F.first(c).alias(c) for c in keep))
        # One co-judged item of weight 1 without agreement keeps rare users from extremes.
        fitted = F.greatest(F.least(F.col("up") / (F.col("down") + 1.0), F.lit(1.0)), F.lit(-1.0))
        # the fit's scale swings between steps, so each goes half way
        moved = fit.select("uid", *keep, ((fitted + F.col("_w")) / 2).alias("w"), "_w")
        return moved.select("uid", *keep, "w", F.abs(F.col("w") - F.col("_w")).alias("moved"))

    users, path = votes.users.select("uid", *keep, F.lit(1.0).alias("w"), F.lit(1.0).alias("moved")), None
    done = 0
    while done < most_steps:
        for _ in range(1 if votes.hot else STEPS_A_JOB):
            users = step(users)
            done += 1
        users, at = materialize(users, "weights")
        if path:
            remove_path(spark, path)
        path = at
        if (users.agg(F.max("moved")).first()[0] or 0.0) <= tolerance:
            break
    return users, path


def _decide(votes: Votes, table: DataFrame, prior: dict[str, float], values: int) -> DataFrame:
    """(k, item, label, value, votes, agreement, posterior) from each user's log-likelihoods: table has, per user,
    for each label voted and each truth, `voted_truth`, and q, the share of the paths that are right among
    those given where one is due. Scores are compared to nine places, so that the order of summation decides
    nothing; equal ones: accept before correct before reject, then paths by byte order."""
    chosen = {t: F.coalesce(*(F.when(F.col("label") == k, F.col(f"{k}_{t}")) for k in LABELS)) for t in LABELS}
    given = F.col("value") != ""
    scored = votes.with_users(table).select(
        "k", "item", "hot", "label", "value", "q", *(chosen[t].alias(f"ll_{t}") for t in LABELS), F.log(F.col("q") * values / (1 - F.col("q"))).alias("match")
    )
    counts = {f"n_{k}": _is(k).cast("long") for k in LABELS}
    miss = F.when(given, F.log(1 - F.col("q"))).otherwise(0.0)
    per_item = votes.by_item(scored, [], accept=F.col("ll_accept"), reject=F.col("ll_reject"), correct=F.col("ll_correct") + miss, **counts)
    per_value = votes.by_item(scored.where(given), ["value"], bonus=F.col("match"))
    best = per_value.groupBy("k", "item").agg(F.min_by("value", F.struct(-F.round("bonus", 9), F.col("value"))).alias("value"), F.max("bonus").alias("bonus"))
    extra = {"accept": F.lit(0.0), "reject": F.lit(0.0), "correct": F.coalesce(F.col("bonus") - F.log(F.lit(float(values))), F.lit(0.0))}
    n = sum((F.col(f"n_{k}") for k in LABELS), F.lit(0))
    same = sum((F.col(f"n_{k}") * (F.col(f"n_{k}") - 1) for k in LABELS), F.lit(0))
    joined = per_item.join(best, ["k", "item"], "left").select(
        "k", "item", "value", n.cast("long").alias("votes"), F.try_divide(same, n * (n - 1)).alias("agreement"),
        *(F.round(F.col(t) + F.lit(prior[t]) + extra[t], 9).alias(t) for t in LABELS),
    )
    top = F.greatest(*LABELS)
    label = F.when(F.col("accept") == top, "accept").when(F.col("correct") == top, "correct").otherwise("reject")
    total = sum((F.exp(F.col(k) - top) for k in LABELS), F.lit(0.0))
    return joined.select(
        "k", "item", label.alias("label"), F.when(label == "correct", F.coalesce("value", F.lit(""))).otherwise("").alias("value"), "votes", "agreement", (1 / total).alias("posterior")
    )


def _seen(votes: Votes, items: DataFrame) -> DataFrame:
    return votes.with_items(items.select("k", "item", F.col("label").alias("truth"), F.col("value").alias("right"), "votes"))


def consensus(votes: DataFrame, tolerance: float = TOLERANCE, refine_steps: int = REFINE_STEPS) -> tuple[DataFrame, DataFrame]:
    """The agreed label and value per item, and the reliability of each user, from clean_votes.

    items: (item, label, value, votes, agreement, posterior); agreement is the share of an item's pairs of
    votes that have the same label (NULL for one vote). users: (user, n, w, moved, accuracy, p_accept, p_reject,
    p_correct); w is the spectral reliability, moved its change in the last step of the iteration, accuracy
    the share of votes equal to the consensus.

    The spectral weights give the first consensus: a user of weight w is taken to be right in a share a of the
    votes, w scaled so that a perfect user has 1, and to vote by habit otherwise. Then each user's confusion table is
    counted against the consensus (smoothed by the pooled table) and the votes weighed by its log-likelihoods,
    refine_steps times; this tells habits (a user who accepts too much, one who swaps two labels)
    from care, which one weight a user can't. The number of passes is part of the estimator, like the smoothing: more
    of them move the tables away from the spectral consensus towards whatever fits itself. Paths of `correct`
    votes are compared as written; the likeliest
    wins, ties by byte order. An item whose only `correct` votes have no path gets "". spectral_vote gives the
    weighted vote without all this.

    Plan: the votes are laid out by item once (Votes); what is shuffled after that is a row for each user. Repeats:
    give votes through clean_votes. Empty input gives two empty results. Both are tables.
    """
    v = Votes(votes)
    weights, weights_at = spectral_weights(v, tolerance)
    pooled = v.rows.agg(*(F.coalesce(F.sum(_is(k)), F.lit(0.0)).alias(k) for k in LABELS), F.countDistinct(F.nullif("value", F.lit(""))).alias("values")).first()
    values = max(2, pooled["values"])
    share = {k: (pooled[k] + 1.0) / (v.total + len(LABELS)) for k in LABELS}

    # first table: a user of weight w is right with share a, else votes by habit
    # two perfect users agree above chance by 1 - sum of squared label shares
    a = F.greatest(F.least(F.col("w") / math.sqrt(1 - sum(x * x for x in share.values())), F.lit(0.97)), F.lit(0.02))
    habit = {k: (F.col(f"p_{k}") * F.col("n") + 1.0) / (F.col("n") + 3.0) for k in LABELS}
    table = weights.select(
        "uid", "n", *(F.log(a * float(k == t) + (1 - a) * habit[k]).alias(f"{k}_{t}") for k in LABELS for t in LABELS), F.greatest(F.lit(0.3), F.least(a, F.lit(0.9))).alias("q")
    )
    items = _decide(v, table, {k: math.log(x) for k, x in share.items()}, values)
    paths = []
    for _ in range(refine_steps):
        hit = (F.col("truth") == "correct") & (F.col("label") == "correct") & (F.col("value") != "")
        cells = [F.count_if((F.col("truth") == t) & (F.col("label") == k)).alias(f"c_{k}_{t}") for t in LABELS for k in LABELS]
        # an item's votes count one item together
        of = [F.sum(F.when(F.col("truth") == t, 1 / F.col("votes")).otherwise(0.0)).alias(f"i_{t}") for t in LABELS]
        counted = _seen(v, items).groupBy("uid").agg(F.count(F.lit(1)).alias("n"), *cells, *of, F.count_if(hit).alias("due"), F.count_if(hit & (F.col("value") == F.col("right"))).alias("hit"))
        counted, at = materialize(counted, "confusion")
        paths.append(at)
        r = counted.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counted.columns if c not in ("uid", "n"))).first()
        rate = {(t, k): (r[f"c_{k}_{t}"] + 0.5) / (sum(r[f"c_{x}_{t}"] for x in LABELS) + 1.5) for t in LABELS for k in LABELS}
        q0 = (r["hit"] + 1.0) / (r["due"] + 2.0)
        every = {t: sum((F.col(f"c_{k}_{t}") for k in LABELS), F.lit(0.0)) for t in LABELS}
        q = (F.col("hit") + PRIOR_VOTES * q0) / (F.col("due") + PRIOR_VOTES)
        table = counted.select(
            "uid", "n", *(F.log((F.col(f"c_{k}_{t}") + PRIOR_VOTES * rate[t, k]) / (every[t] + PRIOR_VOTES)).alias(f"{k}_{t}") for k in LABELS for t in LABELS),
            F.least(F.greatest(q, F.lit(0.05)), F.lit(0.98)).alias("q"),
        )
        whole = {t: round(float(r[f"i_{t}"]), 3) for t in LABELS}
        items = _decide(v, table, {t: math.log((whole[t] + 1.0) / (sum(whole.values()) + 3.0)) for t in LABELS}, values)

    right = _seen(v, items).groupBy("uid").agg(F.avg((F.col("label") == F.col("truth")).cast("double")).alias("accuracy"))
    users = v.users.join(weights.select("uid", "w", "moved"), "uid").join(right, "uid").select("user", "n", "w", "moved", "accuracy", *(f"p_{k}" for k in LABELS))
    users, _ = materialize(users, "reliability")
    items, _ = materialize(items.drop("k").select("item", "label", "value", "votes", "agreement", "posterior"), "consensus")
    v.release()
    for at in (weights_at, *paths):
        remove_path(v.spark, at)
    return items, users


def spectral_vote(votes: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(item, label, value, votes, agreement, posterior) by the vote weighted with the spectral reliabilities alone.

    A label's weight is the sum of its users' weights (to nine places; equal ones: accept before correct before
    reject), posterior its share of the positive weights, NULL where there are none. The value is that of the
    greatest weight among the `correct` votes that have one, ties by byte order.
    """
    v = Votes(votes)
    weights, weights_at = spectral_weights(v, tolerance)
    scored = v.with_users(weights.select("uid", "n", "w"))
    counts = {f"n_{k}": _is(k).cast("long") for k in LABELS}
    per_item = v.by_item(scored, [], **{k: F.when(F.col("label") == k, F.col("w")).otherwise(0.0) for k in LABELS}, **counts)
    per_value = v.by_item(scored.where("value <> ''"), ["value"], bonus=F.col("w"))
    best = per_value.groupBy("k", "item").agg(F.min_by("value", F.struct(-F.round("bonus", 9), F.col("value"))).alias("value"))
    n = sum((F.col(f"n_{k}") for k in LABELS), F.lit(0))
    same = sum((F.col(f"n_{k}") * (F.col(f"n_{k}") - 1) for k in LABELS), F.lit(0))
    weight = {k: F.when(F.col(f"n_{k}") > 0, F.round(k, 9)) for k in LABELS}
    top = F.greatest(*weight.values())
    label = F.when(weight["accept"] == top, "accept").when(weight["correct"] == top, "correct").otherwise("reject")
    positive = sum((F.greatest(F.col(k), F.lit(0.0)) for k in LABELS), F.lit(0.0))
    out = per_item.join(best, ["k", "item"], "left").select(
        "item", label.alias("label"), F.when(label == "correct", F.coalesce("value", F.lit(""))).otherwise("").alias("value"), n.cast("long").alias("votes"),
        F.try_divide(same, n * (n - 1)).alias("agreement"), F.try_divide(F.greatest(top, F.lit(0.0)), positive).alias("posterior"),
    )
    out, _ = materialize(out, "spectral")
    v.release()
    remove_path(v.spark, weights_at)
    return out
