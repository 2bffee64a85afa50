"""The vector index, whole calibrations, SQL functions, and small record functions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import calibrate, cascade, match, profile, vectors
from mapweave.plans import tools
from tests.test_operators import kb, terms  # noqa: F401


def test_index_is_built_changed_cleared_and_rebuilt(spark, kb, tmp_path):  # noqa: F811
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    assert index.entries().count() == 0 and index.search(terms(spark, "sex", name="query")).count() == 0
    index.build(kb)
    assert {r.id for r in index.entries().collect()} == {"kb_sex_Patient.gender", "kb_sex_Patient.sex", "kb_stage_Condition.stage", "kb_stage_Condition.stage.summary", "kb_sample_Specimen"}
    new = spark.createDataFrame([("stage of tumor", "Condition.stage"), ("stage of tumor", "Condition.stage"), ("", "x"), (None, "x"), ("x", None), ("n" * 100, "Y")], "source string, target string")
    index.upsert(new)
    index.upsert(new)
    ids = [r.id for r in index.entries().collect()]
    assert len(ids) == len(set(ids)) == 7 and max(map(len, ids)) == 63
    got = index.search(terms(spark, "stages", "sex", None, "", name="query"), 2).collect()
    assert [(r["query"], r.id) for r in sorted(got, key=lambda r: (r["query"], r["rank"]))] == [("sex", "kb_sex_Patient.gender"), ("sex", "kb_sex_Patient.sex"), ("stages", "kb_stage_Condition.stage"), ("stages", "kb_stage_Condition.stage.summary")]
    index.clear()
    assert index.entries().count() == 0
    index.reindex(kb)
    assert index.entries().count() == 5


def test_index_search_equals_all_pairs_in_blocks(spark, kb, tmp_path, monkeypatch):  # noqa: F811
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.upsert(spark.createDataFrame([(f"name {k % 7} of {k}", f"P.{k % 3}") for k in range(200)], "source string, target string"))
    asked = terms(spark, *(f"name {k}" for k in range(9)), name="query")
    pairs = asked.crossJoin(index.entries()).select("query", "id", F.round(match.cosine(match.hash_embedding(F.col("query")), F.col("vec")), 9).alias("s")).collect()
    want = {}
    for r in pairs:
        want.setdefault(r["query"], []).append((-r.s, r.id.encode(), r.id))
    want = {(q, i, k) for q, v in want.items() for k, (_, _, i) in enumerate(sorted(v)[:4], 1)}
    assert {(r["query"], r.id, r["rank"]) for r in index.search(asked, 4).collect()} == want
    monkeypatch.setattr(match, "QUERY_BLOCK", 2)
    assert {(r["query"], r.id, r["rank"]) for r in index.search(asked, 4).collect()} == want


def test_index_hashes_grams_once_and_compares_in_one_pass(spark, kb, tmp_path, monkeypatch):  # noqa: F811
    names = ["sex", "a", "Größe ÄÖ", "İstanbul", "  x  ", "aaaaaa", "treatment: retina; code: 7", "日本語の名前"]
    pairs = spark.createDataFrame([(n, f"P.{k}") for n in names for k in range(3)], "source string, target string")
    want = {r.source: r.v for r in pairs.select("source", match.hash_embedding(F.col("source")).alias("v")).collect()}
    monkeypatch.setattr(match, "hash_embedding", None)  # it hashes each gram for every place of the vector
    monkeypatch.setattr(match, "QUERY_BLOCK", 2)
    index = vectors.VectorIndex(spark, str(tmp_path / "index"))
    index.build(kb)
    index.upsert(pairs)
    entries = {(r.source, r.target): r.vec for r in index.entries().collect()}
    assert len(entries) == 5 + 24 and all(entries[n, f"P.{k}"] == want[n] for n in names for k in range(3))
    found = index.search(terms(spark, *names, name="query"), 2)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    got = {(r["query"], r["rank"]): r.target for r in found.collect()}
    assert [got[n, k] for n in names[1:] for k in (1, 2)] == ["P.0", "P.1"] * 7


@pytest.mark.parametrize("batch, step", [(1, 1), (3, 4), (50, 7), (400, 64)])
def test_best_entries_equal_all_pairs_with_ties(batch, step):
    random = np.random.default_rng(5)
    v, q = (random.poisson(0.3, (n, 6)).astype(np.float64) + np.eye(6)[random.integers(0, 6, n)] for n in (400, 40))
    best = vectors._Best(q, 5)
    for a in range(0, 400, batch):
        used = best.add(v[a : a + batch], step)
        assert set(best.at[best.at >= a].tolist()) == set(used.tolist())
    s = np.round(q @ v.T / (np.sqrt((q * q).sum(axis=1))[:, None] * np.sqrt((v * v).sum(axis=1))), 9)
    want = np.argsort(-s, axis=1, kind="stable")[:, :5]
    assert (best.at == want).all() and (best.score == np.take_along_axis(s, want, 1)).all()


def test_calibrators_are_built_saved_and_opened(spark, tmp_path):
    p = spark.createDataFrame(
        [("a", "field", "x", "P.b", 0.95, 1), ("a", "field", "x", "P.c", 0.5, 2), ("a", "field", "y", "P.c", 0.85, 3), ("a", "entity", "x", "P", 1.0, 4), ("b", "field", "x", "P.c", 0.25, 5)],
        "matcher string, tier string, id string, target string, score double, ord long",
    )
    truth = spark.createDataFrame([("field", "x", "p.B"), ("field", "y", "P.d"), ("entity", "x", "P")], "tier string, id string, target string")
    outcomes, curves, summary = calibrate.build(p, truth)
    assert {(r.matcher, r.tier, r.id, r.correct) for r in outcomes.collect()} == {("a", "field", "x", True), ("a", "field", "y", False), ("a", "entity", "x", True), ("b", "field", "x", False)}
    calibrate.save_curves(curves, summary, str(tmp_path / "c"))
    again, summary = calibrate.open_curves(spark, str(tmp_path / "c"))
    got = {(r.matcher, r.tier): (r.n, round(r.accuracy, 6), round(r.ece, 6)) for r in summary.collect()}
    assert got == {("a", "field"): (2, 0.5, 0.45), ("a", "entity"): (1, 1.0, 0.0), ("a", "global"): (3, 0.666667, 0.3), ("b", "field"): (1, 0.0, 0.25), ("b", "global"): (1, 0.0, 0.25)}
    assert again.where("key = 'a' AND n > 0").count() == 2  # 0.95 and 1.0 share the last bin
    assert calibrate.build(p.limit(0), truth)[2].count() == 0


def test_sql_functions_over_the_base(spark, kb):  # noqa: F811
    names = tools.register(kb, "t")
    assert [r.destination for r in spark.sql("SELECT * FROM t_lookup_mapping('sex') ORDER BY destination").collect()] == ["Patient.gender", "Patient.sex"]
    assert spark.sql("SELECT * FROM t_lookup_path('patient.GENDER')").first().source == "sex"
    got = tools.ask(spark, "t_lookup_content", terms(spark, "LUNG", "skin", "none", None, name="value"), "value").collect()
    assert {(r.value, r.id, r.fhir_path) for r in got} == {("LUNG", 1, "Specimen.type"), ("LUNG", 1, "Condition.bodySite"), ("skin", 2, None)}
    assert len(names) == 5 and spark.sql("SELECT * FROM t_tier_paths('entity')").count() == 1 and spark.sql("SELECT * FROM t_search_terms('TAG')").count() == 2


def test_counts_of_a_run_and_largest_keys(spark):
    rows = [("field", "high", False, True), ("field", "medium", True, False), ("field", "low", True, None), (None, "high", None, True)]
    got = {r.tier: tuple(r)[1:] for r in cascade.learn_metrics(spark.createDataFrame(rows, "tier string, level string, requires_review boolean, user_feedback boolean")).collect()}
    assert got == {"field": (3, 1, 1, 1, 2, 1, 1), None: (1, 1, 0, 0, 0, 1, 0)}
    keyed = spark.createDataFrame([("a:x", 0.5, 1)] * 3 + [("a", 0.5, 1)] * 4 + [("b", 0.1, 0)] * 2, "key string, confidence double, correct int")
    assert [(r.key, r.matcher, r["rank"]) for r in calibrate.report(keyed, 2).collect()] == [("a", "a", 1), ("a:x", "a", 2)]


def test_compounds_by_two_left_joins(spark, kb):  # noqa: F811
    entities = spark.createDataFrame([(1, "C1"), (2, "C2"), (3, "C3")], "key int, code string")
    details = spark.createDataFrame([(1, "i1"), (1, "i1"), (1, "i2")], "key int, inchi string")
    records = spark.createDataFrame([(1, "aspirin"), (2, "other"), (3, "aspirin"), (None, "aspirin"), (9, "aspirin")], "key int, name string")
    got = {(r.name, r.code, r.inchi) for r in kb.lookup_records(terms(spark, "aspirin", "aspirin", None, name="name"), entities, details, records).collect()}
    assert got == {("aspirin", "C1", "i1"), ("aspirin", "C1", "i2"), ("aspirin", "C3", None)}


@pytest.mark.parametrize("text, plain, participant", [("a b", True, None), (" a", False, None), ("a  b", False, None), ("", False, None), (None, False, None), ("HTA1_203_001_0000", True, "HTA1_203"), ("HTA1_203", True, "HTA1_203")])
def test_strings_and_center_ids(spark, text, plain, participant):
    r = spark.createDataFrame([(text,)], "t string").select(tx.is_plain_string(F.col("t")).alias("p"), tx.split_center_id(F.col("t")).alias("c")).first()
    assert r.p == plain and (r.c.participant_id if r.c else None) == participant
    assert participant is None or r.c.subsets == text.split("_")[2:]


def test_targets_within_resources_and_nearest_names(spark):
    goals = spark.createDataFrame([("f", "Patient.gender", 1), ("f", "Patient", 2), ("f", "Patience.x", 3), ("g", "Specimen.type", 4)], "tier string, target string, ord long")
    assert {r.target for r in match.within_resources(goals, ["Patient"]).collect()} == {"Patient.gender", "Patient"}
    names = spark.createDataFrame([("f", "gender of patient"), ("g", "x"), ("h", "y"), ("f", "")], "tier string, id string")
    got = {(r.tier, r.id): r.target for r in match.nearest_names(names, goals).collect()}
    assert got["f", "gender of patient"] == "Patient.gender" and got["g", "x"] == "Specimen.type" and ("h", "y") not in got
    assert profile.header_scan(spark.createDataFrame([], "a string, b int, o int"), "o").count() == 2
