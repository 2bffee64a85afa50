import difflib
import uuid

import pytest
from pyspark.sql import functions as F

from mapweave.functions import text as tx


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


@pytest.mark.parametrize("word, want", [("grading", "grad"), ("stages", "stag"), ("class", "clas"), ("ing", "ing"), ("Ties", "tie")])
def test_stem(spark, word, want):
    assert one(spark, tx.stem(F.col("a")), a=word) == want


@pytest.mark.parametrize("name, want", [("TumorGrade", {"tumor", "grade"}), ("os_time", {"time"}), ("", set())])
def test_tokens(spark, name, want):
    assert set(one(spark, tx.tokens(F.col("a")), a=name)) == want


@pytest.mark.parametrize("q, s, want", [("race", "Race", 1.0), ("grade", "tumor_grade", 5 / 11), ("tumor_grade", "grade", 5 / 11 * 0.8), ("alpha_grade", "tumor_grade", 0.3), ("grading", "grades", 0.7), ("zzz", "ab", 0.0), ("", "abc", 0.0)])
def test_fuzzy(spark, q, s, want):
    assert one(spark, tx.fuzzy_score(F.col("a"), F.col("b")), a=q, b=s) == pytest.approx(want)


def test_ratio_branch(spark):
    r = one(spark, tx.lcs_ratio(F.col("a"), F.col("b")), a="gendr", b="gender")
    assert r == pytest.approx(round(difflib.SequenceMatcher(None, "gendr", "gender").ratio(), 2))


@pytest.mark.parametrize("url, want", [("https://gdc.cancer.gov/sample_id", ("sample_id", "gdc")), ("http://snomed.info/sct", ("", "snomed")), ("http://loinc.org", ("loinc.org", "loinc")), ("https://abc.example/x/y/", ("y", "abc")), ("", ("", ""))])
def test_url(spark, url, want):
    assert (one(spark, tx.url_term(F.col("a")), a=url), one(spark, tx.url_schema(F.col("a")), a=url)) == want


def test_uuid5(spark):
    ns = uuid.uuid3(uuid.NAMESPACE_DNS, "example.org")
    for name in ("Patient/p|abc", "", "é"):
        assert one(spark, tx.uuid5(str(ns), F.col("a")), a=name) == str(uuid.uuid5(ns, name))


def test_characteristics_last_key_wins(spark):
    assert one(spark, tx.characteristics(F.col("a")), a="tissue: Tumor; Stage: IIA; stage: IIB; Time Point: 1:2; bad") == {"tissue": "Tumor", "stage": "IIB", "time_point": "1:2"}


def test_small_texts(spark):
    assert one(spark, tx.normalize_path(F.col("a")), a="code.coding.0.system") == "code.coding.system"
    assert one(spark, tx.safe_id(F.col("a")), a="A b-C" + "x" * 60) == "a_b_c" + "x" * 45
    assert one(spark, tx.split_list(F.col("a")), a=" a, b\n,c,") == ["a", "b", "c"]
    assert one(spark, tx.query_variants(F.col("a")), a="staging") == ["staging", "stage", "stag"]
    assert [tuple(r) for r in one(spark, tx.body_structures(F.col("a")), a="1:lung, kidney,")] == [("1", "lung"), ("", "kidney")]
    assert one(spark, tx.lookup_code(F.col("a"), tx.GENDERS), a=" M ") == "male"
    assert one(spark, tx.lookup_code(F.col("a"), tx.DECEASED), a="Expired") is True
    assert one(spark, tx.column_unit(F.col("a")), a="age_years") == "a"
    assert one(spark, tx.subject_reference(F.col("s"), F.col("p")), s=["2", "1"], p=["x"]) == "Group/1+2"
    assert one(spark, tx.subject_reference(F.col("s"), F.col("p")), s=[], p=["x"]) == "Patient/x"
    assert one(spark, tx.embed_text(F.col("a"), F.col("v")), a="n", v=["NA", " ", None]) == "n"
    assert '"valueInteger":5' in one(spark, tx.component(F.lit("k"), F.col("a"), "Integer", F.lit("s")), a="5")


def test_answers(spark):
    text = "CHOSEN TARGET: **`Condition.code`**\nCONFIDENCE: 0.8\nREASONING: because\nof it"
    assert tuple(one(spark, tx.parse_answer(F.col("a")), a=text)) == ("Condition.code", 0.8, "because\nof it")
    assert one(spark, tx.parse_answer(F.col("a"), F.col("c")), a="I take B.c", c=["A.b", "B.c"]).target == "B.c"
    assert one(spark, tx.parse_answer(F.col("a"), F.col("c")), a="no idea", c=["A.b"]).target == "A.b"
    assert tuple(one(spark, tx.parse_answer(F.col("a")), a="maybe Patient.birth_date?"))[:2] == ("Patient.birth_date", 0.5)
    assert one(spark, tx.parse_answer(F.col("a")), a="none").target == "unknown"


def test_rules_section(spark):
    text = "intro\n### A one\nx\n#### sub\n### B two\ny\n"
    assert one(spark, tx.rules_section(F.col("a"), "a ONE"), a=text) == "### A one\nx\n#### sub\n"
    assert one(spark, tx.rules_section(F.col("a"), "zzz"), a=text) == "" and one(spark, tx.rules_section(F.col("a"), ""), a=text) == text
