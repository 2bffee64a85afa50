import math
import random

import pytest

from mapweave.llm import topn

SCHEMA = "g string, i string, s double, _g string, rank int"


def brute(rows, n):
    best = {}
    for g, i, s, *_ in rows:
        if g and i is not None and s is not None and not math.isnan(s):
            best[g, i] = max(s, best.get((g, i), -math.inf))
    by = {}
    for (g, i), s in best.items():
        by.setdefault(g, []).append((-s, i.encode(), i))
    return {(g, i) for g, v in by.items() for _, _, i in sorted(v)[:n]}


def test_against_brute_force_with_ties_repeats_and_gaps(spark):
    rng = random.Random(1)
    rows = []
    for k in range(6000):
        g = "hot" if rng.random() < 0.35 else f"g{rng.randrange(300)}"
        s = rng.choice([rng.randrange(20) / 10, None, math.nan, rng.random(), math.inf if rng.random() < 0.01 else 0.0, -0.0])
        rows.append((rng.choice([g, g, g, None, ""]) if rng.random() < 0.05 else g, f"i{k}", s, "x", 1))
        if rng.random() < 0.2:
            rows.append(rows[-1])
    rows += [("g1", None, 9.0, None, None), ("ü", "é", 1.0, None, None), ("ü", "z", 1.0, None, None)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topn.top_n_per_group(df, "g", "i", "s", 5).collect()
    assert {(r.g, r.i) for r in got} == brute(rows, 5)
    assert len(got) == len({(r.g, r.i) for r in got})


def test_row_groups_are_skipped_and_nothing_is_lost(spark, tmp_path):
    rng = random.Random(2)
    rows = [("hot", f"{k:07d}", rng.random(), None, None) for k in range(60_000)] + [(f"c{k % 50}", f"{k}", rng.random(), None, None) for k in range(2_000)]
    df = spark.createDataFrame(rows, SCHEMA)
    path = topn.cluster_by_group(df, "g", "i", "s", str(tmp_path / "t"), file_rows=9_000, group_rows=1_000, level_rows=50)
    for n in (1, 3, 40):  # one layout for any N
        got = [(r._g, r._i) for r in topn.top_n(spark, path, n).collect()]
        assert set(got) == brute(rows, n) and len(got) == len(set(got))
    stats = topn.skip_report(spark, path, 3).first()
    assert stats.rg_skipped > stats.rg_read and stats.by_score > 0 and stats.by_count > 0


def test_equal_scores_across_row_groups_and_a_hot_item(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", *(f"c{k}" for k in range(200))]), f"{rng.randrange(5000):04d}", rng.randrange(4) / 4, None, None) for _ in range(12_000)]
    rows += [("hot", "again", 0.75, None, None)] * 9_000
    path = topn.cluster_by_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", str(tmp_path / "t"), file_rows=3_000, group_rows=400, level_rows=30)
    for n in (1, 5, 17):
        assert {(r._g, r._i) for r in topn.top_n(spark, path, n).collect()} == brute(rows, n)


def test_one_item_with_two_scores_and_an_item_in_two_groups(spark):
    rows = [("a", "x", 1.0, None, None), ("a", "x", 3.0, None, None), ("a", "y", 2.0, None, None), ("b", "x", 0.5, None, None)]
    got = topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", 1).collect()
    assert {(r.g, r.i, r.score) for r in got} == {("a", "x", 3.0), ("b", "x", 0.5)}


def test_an_item_with_scores_around_another_takes_one_place(spark, tmp_path):
    rows = [("a", i, s, None, None) for i, s in (("x", 3.0), ("y", 2.0), ("x", 1.0), ("z", 0.5))]
    got = topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", 3).collect()
    assert {(r.i, r.score, r["rank"]) for r in got} == {("x", 3.0, 1), ("y", 2.0, 2), ("z", 0.5, 3)}
    # ten items with ever lower scores fill the first row groups; others of the twelve best come far below
    rows = [("hot", f"h{k % 10}", 10_000.0 - k / 10, None, None) for k in range(30_000)] + [("hot", f"{k:05d}", k / 10_000, None, None) for k in range(10_000)]
    path = topn.cluster_by_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", str(tmp_path / "t"), file_rows=5_000, group_rows=1_000)
    assert {(r._g, r._i) for r in topn.top_n(spark, path, 12).collect()} == brute(rows, 12)


@pytest.mark.parametrize("rows", [[], [(None, "a", 1.0, None, None)], [("", "a", 1.0, None, None)], [("g", "a", None, None, None)]])
def test_nothing_takes_part(spark, rows):
    assert topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", 5).count() == 0


def test_very_long_names(spark):
    rows = [("g" * 20_000, "i" * 9_000, 1.0, None, None), ("g" * 20_000, "j", 1.0, None, None)]
    assert topn.top_n_per_group(spark.createDataFrame(rows, SCHEMA), "g", "i", "s", 1).first().i == "i" * 9_000
