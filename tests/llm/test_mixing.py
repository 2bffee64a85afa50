import random

import pytest

from mapweave.llm import mixing

DOCS = "doc_id long, text string, source string, tokens int, copies string"
GOALS = "mix_name string, source string, target_weight double, max_repeats int, rate double"


def documents(spark, seed=1):
    rng = random.Random(seed)
    rows, k = [], 0
    for source, n in (("big", 400), ("mid", 120), ("small", 12), ("outside", 30)):
        for _ in range(n):
            k += 1
            rows.append((k, " ".join(rng.choice(("alpha", "beta", "gamma", "delta")) + str(rng.randrange(999)) for _ in range(rng.randrange(3, 60))), source, None, None))
    rows += [(k + 1, rows[0][1], "big", None, None), (k + 2, None, "big", None, None), (k + 3, "", "mid", None, None), (k + 4, "text", None, None, None)]
    return spark.createDataFrame(rows, DOCS)


def run(spark, goals, docs=None, **kw):
    plan, report = mixing.mix(docs if docs is not None else documents(spark), spark.createDataFrame(goals, GOALS), **kw)
    return plan.collect(), {(r.mix_name, r.source): r for r in report.collect()}


def test_shares_are_met_within_a_text(spark):
    goals = [("m", "big", 0.5, 2, 0.0), ("m", "mid", 0.3, 3, 0.0), ("m", "small", 0.02, 4, 0.0)]
    plan, report = run(spark, goals, total_tokens=20_000)
    for (_, s), r in report.items():
        assert r.status == "met" and abs(r.reached_tokens - r.target_tokens) <= 400, (s, r)
    assert all(p.copies <= {"big": 2, "mid": 3, "small": 4}[p.source] for p in plan)
    assert "outside" not in {p.source for p in plan}
    for s in ("big", "mid", "small"):
        assert sum(p.copies * p.tokens for p in plan if p.source == s) == report["m", s].reached_tokens


def test_equal_texts_are_one_text(spark):
    plan, _ = run(spark, [("m", "big", 1.0, 1, 0.0)])
    same = [p for p in plan if p.same_text_as is not None]
    assert [(p.same_text_as, p.copies) for p in same] == [(1, 0)]


def test_too_little_text_is_short_and_capped(spark):
    plan, report = run(spark, [("m", "small", 0.9, 3, 0.0), ("m", "big", 0.1, 1, 0.0), ("m", "nowhere", 0.5, 2, 0.0)], total_tokens=100_000)
    assert report["m", "small"].status == "short" and {p.copies for p in plan if p.source == "small"} == {3}
    assert report["m", "nowhere"].status == "empty" and report["m", "nowhere"].reached_tokens == 0
    assert abs(sum(r.share_reached for r in report.values()) - 1) < 1e-5


def test_mixes_are_independent_and_the_same_on_every_run(spark):
    goals = [("a", "big", 1.0, 1, 0.0), ("a", "mid", 3.0, 9, 0.0), ("b", "big", 2.0, 5, 0.0), ("b", "big", 1.0, 2, 0.0)]
    first, second = run(spark, goals)[0], run(spark, goals)[0]
    assert sorted(map(str, first)) == sorted(map(str, second))
    only_a = run(spark, goals[:2])[0]
    assert sorted(map(str, only_a)) == sorted(str(p) for p in first if p.mix_name == "a")


def test_rates_are_an_exponential_tilt(spark):
    import math

    plan, _ = run(spark, [("m", "big", 1.0, 3, 0.0), ("m", "mid", 1.0, 3, 0.0)])
    for s in ("big", "mid"):
        lam = [math.log(p.rate) / p.tokens for p in plan if p.source == s and 0 < p.rate < 2.999]
        assert max(lam) - min(lam) < 1e-9


@pytest.mark.parametrize("goals", [[], [("m", "big", None, None, 0.0)], [("m", "big", -1.0, 0, 0.0)], [(None, "big", 1.0, 1, 0.0)]])
def test_odd_targets(spark, goals):
    plan, _ = run(spark, goals)
    assert all(p.copies == 0 for p in plan)


def test_no_documents(spark):
    plan, report = run(spark, [("m", "big", 1.0, 2, 0.0)], documents(spark).limit(0))
    assert plan == [] and report["m", "big"].status == "empty"


def test_the_dual_is_solved_to_its_precision(spark, tmp_path):
    rows = [(k, "word " * (1 + k % 37), "a" if k % 3 else "b") for k in range(300)]
    targets = [("m", "a", 0.2, 3), ("m", "b", 0.8, 4), ("m", "c", 0.1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    report = {r.source: r for r in mixing.mix(docs, spark.createDataFrame(targets, "mix_name string, source string, target_weight double, max_repeats int"))[1].collect()}
    assert report["a"].residual <= mixing.PRECISION and report["c"].residual is None
