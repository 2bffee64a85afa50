import json
import random

import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import calibrate, cascade, feedback, fhir, match, normalize, profile, rules
from mapweave.operators.kb import KnowledgeBase

S = "id string, source string, source_schema string, tier string, source_context string, ord long"
D = "source_id string, destination string, entity string, dest_system string, dest_code string, dest_display string, unit string, unit_system string, unit_code string, subject_ref string, focus_ref string, specimen_ref string, ord long"
V = "id int, source_value string, source_category string, code string, code_system string, display string, is_primary boolean, ord long"
P = "content_value_id int, fhir_path string, fhir_resource string, context string, is_primary boolean, ord long"


@pytest.fixture(scope="module")
def kb(spark):
    s = [("g:1", "sex", "gdc", "field", "case", 1), ("h:1", "sex", "htan", "field", "case", 2), ("g:2", "stage", "gdc", "field", "diag", 3), ("g:3", "sample", "gdc", "entity", "", 4), ("g:9", "lost", "gdc", "field", "", 5)]
    d = [("g:1", "Patient.gender"), ("h:1", "Patient.sex"), ("g:2", "Condition.stage"), ("g:2", "Condition.stage.summary"), ("g:3", "Specimen")]
    v = [(1, "Lung", "site", "c1", "", "", True, 1), (2, "Skin", "site", "c2", "", "", True, 2)]
    p = [(1, "Specimen.type", "Specimen", "", True, 1), (1, "Condition.bodySite", "Condition", "", False, 2)]
    return KnowledgeBase(
        spark.createDataFrame(s, S), spark.createDataFrame([(a, b, b.split(".")[0], *[""] * 9, k) for k, (a, b) in enumerate(d)], D), spark.createDataFrame(v, V), spark.createDataFrame(p, P)
    )


def terms(spark, *t, name="term"):
    return spark.createDataFrame([(x,) for x in t], f"{name} string")


def test_lookups(spark, kb):
    assert {r.id for r in kb.lookup(terms(spark, "sex", "sex", "Sex")).collect()} == {"g:1", "h:1"}
    ctx = spark.createDataFrame([("sex", "case", ""), ("sex", "case", "gdc"), ("sex", "case", "htan")], "term string, context string, schema string")
    assert {(r.schema, r.id) for r in kb.lookup_context(ctx).collect()} == {("", "h:1"), ("htan", "h:1")}
    assert [r.source for r in kb.lookup_reverse(terms(spark, "PATIENT.GENDER", name="path")).collect()] == ["sex"]
    assert {(r.value, tuple(r.paths)) for r in kb.lookup_content(terms(spark, "LUNG", "skin", name="value")).collect()} == {("LUNG", ("Specimen.type", "Condition.bodySite")), ("skin", ())}
    assert [r.id for r in kb.without_destination().collect()] == ["g:9"]


def test_repairs_and_saving(spark, kb, tmp_path):
    rules_ = spark.createDataFrame([("Patient.sex", "Patient.gender", "update"), ("Specimen", None, "update")], "old_destination string, new_destination string, action string")
    fixed, kept = kb.apply_path_fixes(rules_)
    assert fixed.where("destination = 'Patient.gender'").count() == 2 and {r.id for r in kept.collect()} == {"g:1", "h:1", "g:2"}
    more = kb.add_mapping("os", "lab", "case", "Patient.deceasedBoolean")
    more.save(str(tmp_path / "kb"))
    again = KnowledgeBase.open(spark, str(tmp_path / "kb"))
    assert [r.destination for r in again.lookup(terms(spark, "os")).collect()] == ["Patient.deceasedBoolean"]
    new = spark.createDataFrame([("sex", "gdc", None, "patient.GENDER", "field", 1), ("sex", "gdc", None, "Patient.x", "field", 2), ("sex", "gdc", None, "patient.X", "field", 3)], "source_term string, source_schema string, source_context string, destination string, tier string, ord long")
    assert [(r.destination, r.n) for r in kb.merge(new).collect()] == [("Patient.x", 2)]
    assert kb.merge(new, case_sensitive=True).count() == 3


def test_rule_match(spark, kb):
    goals = spark.createDataFrame([("Patient", 0), ("Patient.id", 1), ("Patient.gender", 2), ("Specimen.type", 3)], "target string, ord long")
    got = [(r.target, r.score) for r in match.rule_match(kb, terms(spark, "sex"), goals, 3).orderBy("rank").collect()]
    assert got == [("Patient.gender", 1.0), ("Patient", 0.5), ("Patient.id", 0.0)]
    got = [(r.target, r.score) for r in match.rule_match(kb, terms(spark, "lung"), goals, 2).orderBy("rank").collect()]
    assert got == [("Specimen.type", 1.0), ("Patient", 0.0)]


def test_fuzzy_lookup_equals_all_pairs(spark):
    rng = random.Random(3)
    parts = ["tumor", "grade", "grading", "stage", "stages", "os", "time", "a", "sample", "identifier", "age", "ing"]
    names = list({"_".join(rng.sample(parts, rng.randrange(1, 4))) for _ in range(150)} | {"x", "", "TumorGrade", "ab"})
    q, s = terms(spark, *names[:80], name="query"), terms(spark, *names, name="source")
    got = {(r.query, r.source) for r in match.fuzzy_lookup(q, s).collect()}
    every = q.crossJoin(s).where((tx.fuzzy_score(F.col("query"), F.col("source"), ratio=False) >= 0.55))
    assert got == {(r.query, r.source) for r in every.collect()}
    low = match.fuzzy_lookup_block(["gendr"], terms(spark, "gender", "other", name="source")).collect()
    assert [(r.source, r.score > 0.4) for r in low] == [("gender", True)]


def test_fuzzy_lookup_by_shuffle_and_search_by_all_rules(spark, monkeypatch):
    rng = random.Random(5)
    parts = ["tumor", "grade", "grading", "Stage", "stages", "os", "time", "a", "sampleType", "identifier", "identifer", "gendr", "gender", "ing", "é"]
    names = sorted({"_".join(rng.sample(parts, rng.randrange(1, 4))) for _ in range(150)} | {"x", "", "TumorGrade", "ab", "n" * 300})
    q, s = terms(spark, *names[:60], None, name="query"), terms(spark, *names, None, "ab", name="source")
    every = q.crossJoin(s.distinct()).where("query <> ''").withColumn("score", tx.fuzzy_score(F.col("query"), F.col("source"))).cache()
    want = {(r.query, r.source): round(r.score, 9) for r in every.where("score >= 0.3").collect()}
    got = {(r.query, r.source): round(r.score, 9) for r in match.fuzzy_search(q, s, None).collect()}
    assert got == want and any(x in (0.35, 0.36, 0.38, 0.4, 0.42, 0.43) for x in got.values())
    three = match.fuzzy_search(q, s, 3).collect()
    best = {}
    for (a, b), x in want.items():
        best.setdefault(a, []).append((-x, b.encode(), b))
    assert {(r.query, r.source, r["rank"]) for r in three} == {(a, b, k) for a, v in best.items() for k, (_, _, b) in enumerate(sorted(v)[:3], 1)}
    monkeypatch.setattr(match, "MOST_HEADS", 5)
    monkeypatch.setattr(match, "QUERY_BLOCK", 20)
    assert {(r.query, r.source) for r in match.fuzzy_lookup(q, s).collect()} == {(r.query, r.source) for r in every.where("score >= 0.55").collect()}
    assert {(r.query, r.source, r["rank"]) for r in match.fuzzy_search(q, s, 3).collect()} == {(r.query, r.source, r["rank"]) for r in three}
    assert match.fuzzy_search(q.limit(0), s).count() == match.fuzzy_search(q, s.limit(0)).count() == 0


def test_matchers_hold_one_contract(spark, kb):
    names = terms(spark, "sex", "sex", "stages", "lung", "nothing", None, name="source")
    goals = terms(spark, "Patient.gender", "Patient", "Condition.stage", "Specimen.type", name="target")

    def model(batches):
        for texts in batches:
            yield [[float(len(t)), 1.0] for t in texts]

    every = {}
    for m in (match.RuleMatcher(kb), match.FuzzyMatcher(kb), match.ExpertMatcher(kb, match.VectorMatcher()), match.VectorMatcher(), match.VectorMatcher(model)):
        rows = m.score(names, goals).collect()
        assert all(0 <= r.score <= 1 for r in rows) and len(rows) == len({(r.source, r.target) for r in rows})
        assert m.score(names.limit(0), goals).count() == m.score(names, goals.limit(0)).count() == 0
        every[type(m).__name__] = {(r.source, r.target): r.score for r in rows}
    assert every["RuleMatcher"]["sex", "Patient.gender"] == 1.0 and every["RuleMatcher"]["sex", "Patient"] == 0.5
    assert every["FuzzyMatcher"]["stages", "Condition.stage"] == 5 / 6 * 0.8 and every["ExpertMatcher"]["lung", "Specimen.type"] == 1.0
    assert ("nothing", "Patient") in every["ExpertMatcher"] and len(every["VectorMatcher"]) == 16
    with pytest.raises(ValueError):
        match.VectorMatcher(targets_at_most=3).score(names, goals)


def test_fuzzy_lookup_finds_camel_case_twins(spark):
    names = ("serialDischargeTimepoint", "serial_discharge_timepoint", "MeasuredDosageDepth", "measured_dosage_depth", "depthMeasured_dosage", "measureddosagedepth")
    q, s = terms(spark, *names, name="query"), terms(spark, *names, name="source")
    got = {(r.query, r.source): r.score for r in match.fuzzy_lookup(q, s).collect()}
    every = q.crossJoin(s).withColumn("score", tx.fuzzy_score(F.col("query"), F.col("source"), ratio=False)).where("score >= 0.55")
    assert got == {(r.query, r.source): r.score for r in every.collect()}
    assert got["serialDischargeTimepoint", "serial_discharge_timepoint"] == got["measured_dosage_depth", "MeasuredDosageDepth"] == 0.6


def test_nearest_against_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    m = rng.normal(size=(300, 8)).astype(np.float32)
    rows = [(k, [float(x) for x in v]) for k, v in enumerate(m)] + [(900, None), (901, [0.0] * 8), (902, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = match.nearest(df, df.where("vec_id % 100 = 0"), 4).collect()
    u = m / np.linalg.norm(m, axis=1)[:, None]
    for q in (0, 100, 200):
        order = [int(i) for i in np.argsort(-(u @ u[q])) if i != q][:4]
        assert [r.id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == order
    assert {r.query_id for r in got} == {0, 100, 200}


def test_bins(spark):
    df = spark.createDataFrame([(x,) for x in (0.3, 0.6, 0.7, 1.0, -0.05, -0.15)], "c double")
    got = df.select("c", calibrate.build_bin(F.col("c"), True).alias("built"), calibrate.bin_of(F.col("c")).alias("read"), calibrate.build_bin(F.col("c")).alias("own")).collect()
    assert [(r.built, r.read, r.own) for r in got] == [(2, 3, 3), (5, 6, 6), (6, 7, 7), (9, 9, 9), (None, 0, None), (None, None, None)]


def test_key_chain(spark):
    df = spark.createDataFrame([("m", "field", "gdc", "sample"), ("m", None, None, None)], "m string, t string, s string, c string")
    full, least = (r.k for r in df.select(calibrate.key_chain(*(F.col(x) for x in "mtsc")).alias("k")).collect())
    assert full == ["m:field:gdc:sample", "m:field:gdc:*", "m:field:*:sample", "m:field:*:*", "m:*:*:*", "m:field", "m"] and least == ["m:*:*:*", "m"]


def test_backoff_and_ece(spark):
    rows = [("m", "field", "", "a", 0.85, k % 2 == 0) for k in range(400)] + [("m", "field", "", "b", 0.85, True) for k in range(50)]
    keyed = calibrate.explode_keys(spark.createDataFrame(rows, "matcher string, tier string, schema string, context string, confidence double, correct boolean"))
    scores = spark.createDataFrame([(1, "m", "field", "", "a", 0.85), (2, "m", "field", "", "b", 0.85), (3, "n", "field", "", "a", 0.85), (4, "m", "field", "", "a", 1.7)], "id int, matcher string, tier string, schema string, context string, confidence double")
    got = {r.id: (r.key_used, round(r.calibrated, 4)) for r in calibrate.calibrate_scores(scores, keyed).collect()}
    assert got == {1: ("m:field:*:a", 0.5), 2: ("m:field:*:*", round(250 / 450, 4)), 3: (None, 0.85), 4: ("m:field:*:a", 1.7)}
    e = {r.key: r for r in calibrate.ece(keyed).collect()}
    assert e["m:field:*:a"].ece == pytest.approx(0.35) and e["m:field:*:a"].verdict == "poorly calibrated"
    assert calibrate.curves(keyed).where("key = 'm' and bin = 0").first()[2:] == (0.0, 0.1, 0.05, 0.0, 0)


def test_conflicts(spark, kb):
    m = kb.mappings()
    assert [(r.term, r.schemas) for r in normalize.schema_conflicts(m).collect()] == [("sex", 2)]
    assert [r.destination for r in normalize.resolve(m, "priority").collect()] == ["Patient.gender"]
    assert [r.destination for r in normalize.auto_resolve(m, [("Patient.sex", "Patient.gender")]).collect()] == ["Patient.sex"]
    fields = spark.createDataFrame([("Patient", "gender"), ("Condition", "stage")], "class string, slot string")
    v = {r.path: (r.valid, r.issue) for r in normalize.validate_path(terms(spark, "Patient.gender.x", "patient.gender", "Patient.Gender", "Patient.nci_x", "Foo.bar", "Patient", "Patient.zz", name="path"), fields).collect()}
    assert v["Patient.gender.x"] == (True, "") and v["Foo.bar"][1] == "no class Foo" and v["Patient"][1] == "no field" and v["Patient.zz"][1] == "no slot zz"
    assert v["patient.gender"][1] == "class spelled Patient" and v["Patient.Gender"][1] == "slot spelled gender" and v["Patient.nci_x"][1] == "local slot nci_x"


TYPES = [
    ("x", ["51.1", "412", "3.5"], "continuous", "chromosome"), ("x", ["5", "77"], "integer", "chromosome"), ("stage_n", ["1", "2"], "cancer_stage", "cancer_stage"), ("x", ["1", "2"], "integer", "cancer_stage"),
    ("x", ["chr7", "chrX"], "chromosome", "free_text"), ("os_event", ["0", "1"], "binary_event", "binary_event"), ("v", ["Alive", "dead"], "vital_status", "vital_status"), ("sex", ["M", "F"], "sex", "sex"),
    ("sample_id", ["a"], "identifier", "identifier"), ("geo_accession", ["GSM12"], "geo_accession", "identifier"), ("t", ["T1", "T2a"], "tnm_category", "tnm_category"), ("x", ["-5", "2.5"], "continuous", "continuous"),
    ("c", ["a"] * 5 + ["b"] * 5, "enumerated", "enumerated"), ("c", ["some text", "more text"], "free_text", "free_text"), ("c", ["NA", ""], None, None), ("g", ["G1", "G3"], "tumor_grade", "tumor_grade"), ("m", ["c.76A>T"], "hgvs", "hgvs"),
]


def test_content_types(spark):
    df = spark.createDataFrame([(k, n, s) for k, (n, s, _, _) in enumerate(TYPES)], "k int, column_name string, samples array<string>")
    for compat in (False, True):
        got = {r.k: r.pattern for r in profile.content_types(df, compat).collect()}
        assert got == {k: t[3 if compat else 2] for k, t in enumerate(TYPES)}


def test_relations(spark):
    cols = ["os_time", "os_event", "t_stage", "n_stage", "start", "end", "race"]
    df = spark.createDataFrame([("t", c, k) for k, c in enumerate(cols)], "entity string, column_name string, position int")
    got = {r.column_name: r.relation for r in profile.relationships(df).collect()}
    assert got == {"os_time": "survival_pair:os_event", "os_event": "survival_pair:os_time", "t_stage": "tnm_group:t_stage,n_stage", "n_stage": "tnm_group:t_stage,n_stage", "start": "genomic_location_group:start,end", "end": "genomic_location_group:start,end"}


def test_nested_records(spark):
    rec = {"identifier": [{"system": "https://gdc.cancer.gov/sample_id", "value": "1"}], "type": {"coding": [{"system": "http://x.invalid/kind", "code": "c", "display": "Blood"}]}, "subject": {"reference": "Patient/9"}, "n": [1, 2]}
    lines = spark.createDataFrame([(1, "Specimen", "GDC", json.dumps(rec)), (2, "Specimen", "GDC", "not json"), (3, "Specimen", "GDC", None), (4, "Specimen", "GDC", "{}")], "ord long, resource string, source string, json string")
    nodes = fhir.walk(fhir.parse_records(lines), ("ord", "resource", "source"))
    usage = {r.path: (r.n, r.samples) for r in fhir.field_usage(nodes).collect()}
    assert usage["n"] == (2, ["1", "2"]) and usage["type.coding.code"] == (1, ["c"])
    assert [(r.system, r.display, r.path) for r in fhir.coding_usage(fhir.codings(nodes)).collect()] == [("http://x.invalid/kind", "Blood", "Specimen.type.coding")]
    assert [tuple(r) for r in fhir.reference_usage(fhir.references(nodes)).collect()] == [("Specimen", "subject", "Patient", 1)]
    pairs = {(r.term, r.path, r.tier) for r in fhir.pair_usage(fhir.mapping_pairs(nodes, F.col("source"))).collect()}
    assert pairs == {("sample_id", "Specimen.identifier", "field"), ("kind", "Specimen.type.coding", "field"), ("Blood", "Specimen.type.coding", "content")}


def test_cascade_and_verdicts(spark, kb):
    got = {r.name: (r.target, r.stage) for r in cascade.map_columns(kb, terms(spark, "sex", "stages", "zzz", None, name="name")).collect()}
    assert got["sex"] == ("Patient.gender", "exact") and got["zzz"] == (None, "unmapped") and got["stages"][1] == "fuzzy" and len(got) == 3
    c = spark.createDataFrame([("sex", ["Patient.sex"]), ("stages", ["Nope.x"])], "name string, candidates array<string>")
    assert {r.name: r.stage for r in cascade.map_columns_constrained(kb, c).collect()} == {"sex": "exact", "stages": "needs_review"}
    j = spark.createDataFrame([("a", "Condition.code", ["Condition.code.coding"]), ("a", "Patient.id", ["Patient.identifier"]), ("b", None, ["x"]), ("b", "A.b", ["A.b"])], "stratum string, p string, accept array<string>")
    j = j.withColumn("verdict", cascade.verdict(F.col("p"), F.col("accept")))
    assert [r.verdict for r in j.collect()] == ["FAMILY", "WRONG", "UNMAPPED", "EXACT"]
    assert {(r.stratum, r.usable) for r in cascade.eval_report(j).collect()} == {("a", 0.5), ("b", 0.5), ("ALL", 0.5)}


def test_vector_stage_is_calibrated(spark, kb):
    names = terms(spark, "patient.gendr", name="name")
    raw = cascade.vector_stage(kb, names).first()
    assert (raw.target, raw.stage) == ("Patient.gender", "vector") and raw.confidence >= 0.5
    kind = "matcher string, tier string, schema string, context string, confidence double, correct boolean"
    for right, got in ((3, [("Patient.gender", 0.75, "vector")]), (1, [])):
        rows = [("biobert", "field", "", "", raw.confidence, k % 4 < right) for k in range(400)]
        keyed = calibrate.explode_keys(spark.createDataFrame(rows, kind))
        assert [(r.target, r.confidence, r.stage) for r in cascade.vector_stage(kb, names, keyed=keyed).collect()] == got
        assert cascade.map_columns(kb, names.union(terms(spark, "sex")), vectors=True, keyed=keyed).count() == 2


def test_match_tables_sees_values_of_all_rows(spark):
    left = spark.createDataFrame([(str(k % 7), "Adenocarcinoma" if k > 900 else None) for k in range(1000)], "a string, b string").coalesce(1)
    right = spark.createDataFrame([("Adenocarcinoma", str(k % 7)) for k in range(10)], "c string, d string")
    got = {(r.source, r.target) for r in match.match_tables(left, right).collect()}
    assert got == {("a", "d"), ("b", "c")}
    alike = {(r.source, r.target): r.score for r in match.match_tables(left, right, one_to_one=False).collect()}
    assert alike["b", "c"] > 0.75


def test_dedupe_and_ensemble(spark):
    m = spark.createDataFrame([("a", "b", "field", 0.99, 1), ("a", "b", "content", 0.86, 2), ("a", "b", "content", 0.86, 3)], "s string, t string, tier string, score double, ord long")
    assert [(r.tier, r.ord) for r in match.dedupe_matches(m, ["s", "t"]).collect()] == [("content", 2)]
    e = spark.createDataFrame([({"x": 1.0, "y": 0.5},), ({},), (None,)], "e map<string,double>").select(match.ensemble(F.col("e"), {"x": 3.0}).alias("s"))
    assert [r.s for r in e.collect()] == [0.875, None, None]


def test_rules(spark):
    rows = [("r1", "tumor_stage", "Condition", [("Patient", "subject")], ["Clinical"], [], 0.9, False, 1), ("r1", "stage2", "Condition", [], [], [], 0.4, False, 2)]
    df = spark.createDataFrame(rows, rules.RULE_SCHEMA)
    assert rules.find_by_source(df, "TUMOR").count() == 1 and rules.find_by_id(df, "r1").first().source_node == "stage2"
    assert rules.filter_rules(df, target_resource="cond", has_reference_to="patient", category="clinical", min_confidence=0.5).count() == 1
    assert tuple(rules.rule_stats(df).first()) == (2, 1, 1)


def test_feedback(spark, tmp_path):
    row = (1, "m", "s", "c", "A.b", None, "accept", "rule", "field", 0.9, None, "u", "")
    df = spark.createDataFrame([row], feedback.FEEDBACK_SCHEMA)
    feedback.record(df, str(tmp_path / "f"))
    feedback.record(df, str(tmp_path / "f"))
    assert spark.read.parquet(str(tmp_path / "f")).count() == 2
    with pytest.raises(Exception):
        feedback.record(df.withColumn("decision", F.lit("maybe")), str(tmp_path / "f"))
    got = {(r.grouping, r.matcher, r.n) for r in feedback.stats(spark.read.parquet(str(tmp_path / "f"))).collect()}
    assert got == {("total", None, 2), ("decision", None, 2), ("matcher", "rule", 2), ("tier", None, 2)}


def test_walk_keeps_the_leaves_of_any_depth_and_shape(spark):
    deep = "x"
    for k in range(60):
        deep = {"a": deep} if k % 2 else [deep]
    texts = [json.dumps(deep), "[1, 2.50, true, null, \"é\"]", "7", "{}", "[]", "no json", None, json.dumps({"a": {"b": "y" * 50_000}})]
    lines = spark.createDataFrame([(k, "R", t) for k, t in enumerate(texts)], "ord int, resource string, json string")
    nodes = fhir.walk(fhir.parse_records(lines), ("ord", "resource")).collect()
    leaves = {o: [r.value for r in sorted(nodes, key=lambda r: r.seq) if r.ord == o and r.kind == "leaf"] for o in range(8)}
    assert leaves[0] == ["x"] and leaves[1] == ["1", "2.5", "true", None, "é"] and leaves[2] == ["7"] and leaves[7] == ["y" * 50_000]
    assert [leaves[k] for k in (3, 4, 5, 6)] == [[], [], [], []]
    assert max(r.seq.count("/") for r in nodes) == 60
    assert fhir.walk(fhir.parse_records(lines.where("ord = 99")), ("ord",)).count() == 0


def test_codings_and_references_within_others_are_passed_over(spark):
    inner = {"system": "s2", "code": "c2", "reference": "Patient/2"}
    rec = {"a": {"system": "s1", "code": "c1", "ext": [inner]}, "b": [inner, {"reference": "Group/1", "x": {"reference": "Patient/3"}}]}
    nodes = fhir.walk(fhir.parse_records(spark.createDataFrame([(1, "R", json.dumps(rec))], "ord int, resource string, json string")), ("ord", "resource"))
    assert sorted((r.system, r.path) for r in fhir.codings(nodes).collect()) == [("s1", "R.a"), ("s2", "R.b")]
    assert sorted((r.field, r.target) for r in fhir.references(nodes).collect()) == [("b", "Group"), ("b", "Patient"), ("ext", "Patient")]
