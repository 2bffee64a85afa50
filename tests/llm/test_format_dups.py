import random

import pytest
from pyspark.sql import functions as F

from mapweave.llm import format_dups as fd

SCHEMA = "ord long, text string, tier string, _k string, copies int, m map<string,double>, at timestamp"


def canon(spark, *texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fd.canonical_text(F.col("t"))).collect()]


def test_formats_of_one_name(spark):
    c = canon(spark, "left_gland_stage", "Left Gland  Stage", "leftGlandStage", "(LEFT–GLAND–STAGE)", '"left.gland.stage"', "　left\xa0gland\tstage\r\n", "[left__gland__stage]*", "leftglandstage…")
    assert len(set(c)) == 1


def test_look_alikes_differ(spark):
    c = canon(spark, "left_gland_stage", "gland_left_stage", "left_gland_stage_r1", "left_gland_stage_1", "left_gland_stagé", "", None)
    assert len(set(c)) == 7 and c[-1] is None


def test_fields_in_any_order_keep_their_values(spark):
    same = canon(spark, "tissue: lung; stage: IIA; batch: b1", "STAGE:iia | TISSUE:Lung | batch:B1", "batch = b1, stage = IIA\ntissue = lung.", "tissue:lung;batch:b1;stage:IIA;")
    other = canon(spark, "tissue: IIA; stage: lung; batch: b1", "tissue: lung; stage: IIA", "tissue: lung; stage: IIA; stage: IIA; batch: b1", "tissue lung stage IIA batch b1", "ti: ssuelung; stage: IIA; batch: b1")
    assert len(set(same)) == 1 and len(set(other) | set(same)) == 6


def test_a_comma_within_a_value_is_punctuation(spark):
    a, b, c = canon(spark, "note: lung, left; stage: I", "stage: I; note: lung left", "note: left, lung; stage: I")
    assert a == b != c


def rows_of(rng, n):
    forms = [str.upper, str.title, lambda s: s.replace("_", " "), lambda s: f"({s})", lambda s: s]
    rows = []
    for k in range(n):
        base = "hot_name" if rng.random() < 0.35 else f"name_{rng.randrange(n)}_x"
        rows.append((k, rng.choice(forms)(base) if rng.random() < 0.97 else None, rng.choice(["a", "b", None, ""]), "k", 3, {"a": 1.0} if rng.random() < 0.5 else None, None))
    return rows


def brute(rows):
    groups = {}
    for o, t, tier, k, c, m, _ in rows:
        key = (None if t is None else "".join(ch for ch in t.lower() if ch.isalnum()), tier, k, c, str(m))
        groups.setdefault(key, []).append(o)
    return {(min(g), o, len(g)) for g in groups.values() for o in g}


def test_against_brute_force(spark):
    rows = rows_of(random.Random(3), 3000)
    got = fd.format_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(7), "text", "ord", ["at"])
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_many_shards_of_a_large_filter(spark, monkeypatch):
    monkeypatch.setattr(fd, "BITS_PER_ROW", 16 << 13)
    rows = rows_of(random.Random(4), 400)
    got = fd.format_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3), "text", "ord", ["at"])
    assert {tuple(r) for r in got.collect()} == brute(rows)


def test_filter_reports_every_repeat_and_few_others(spark):
    df = spark.range(40_000).withColumn("h", F.xxhash64(F.when(F.col("id") < 500, F.col("id") % 250).otherwise(F.col("id")))).repartition(6)
    marked, total, _ = fd.mark_possible_repeats(df, "h")
    assert total == 40_000 == marked.count()
    assert marked.where("id < 500 and not _repeat").count() == 0
    assert marked.where("id >= 500 and _repeat").count() < 800


def test_collapse_keeps_the_first_row_as_written(spark):
    rows = [(2, "A_b", "t", None, 9, None, None), (1, "a b", "t", None, 9, None, None), (3, "other" * 5000, None, None, None, None, None)]
    got = fd.collapse_format_duplicates(spark.createDataFrame(rows, SCHEMA), "text", "ord", ["at"]).orderBy("ord").collect()
    assert [(r.ord, r.text[:5], r.copies, r["copies_"]) for r in got] == [(1, "a b", 9, 2), (3, "other", None, 1)]


@pytest.mark.parametrize("rows", [[], [(1, None, None, None, None, None, None)]])
def test_empty_and_single(spark, rows):
    assert fd.format_duplicates(spark.createDataFrame(rows, SCHEMA), "text", "ord", []).count() == len(rows)


def test_found_gives_the_copies_and_not_the_record_kept(spark, tmp_path):
    from mapweave.llm import queries

    for table, text in queries.FORMATTED:
        rows = [(1, "a_b", "x"), (2, "A B", "x"), (3, "a-b", "x"), (4, "a_b", "y"), (5, None, None)]
        spark.createDataFrame(rows, f"ord long, {text} string, tier string").write.parquet(str(tmp_path / f"{table}.parquet"))
    got = {tuple(r) for r in queries.p3_found(spark, str(tmp_path)).collect()}
    assert got == {(t, 1, o) for t, _ in queries.FORMATTED for o in (2, 3)}
    kept = {tuple(r) for r in queries.p3_records(spark, str(tmp_path)).collect()}
    assert kept == {(t, o, n) for t, _ in queries.FORMATTED for o, n in ((1, 3), (4, 1), (5, 1))}
