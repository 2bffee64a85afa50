import json
from datetime import datetime
from types import SimpleNamespace

import pytest

from mapweave import util
from mapweave.operators import calibrate, fhir, normalize
from mapweave.sources import files
from mapweave.streaming import feedback as st


def test_csv_and_ndjson(spark, tmp_path):
    (tmp_path / "case.csv").write_text('id,note\n1,"a, b"\n2,\n')
    good, bad = files.read_csvs(spark, {"case": str(tmp_path / "case.csv"), "gone": str(tmp_path / "gone.csv")})
    assert [tuple(r) for r in good["case"].collect()] == [("1", "a, b"), ("2", None)] and set(bad) == {"gone"}
    (tmp_path / "p").mkdir()
    (tmp_path / "p/cases.ndjson").write_text('{"a": {"b": 1, "c": {"d": "x"}}, "e": [1]}\n')
    assert set(files.load_project(spark, str(tmp_path / "p"))["cases"].columns) == {"a.b", "a.c.d", "e"}
    (tmp_path / "h/raw/files").mkdir(parents=True)
    (tmp_path / "h/raw/files/table_data.tsv").write_text("x\ty\n1\t2\n")
    assert files.load_project(spark, str(tmp_path / "h"))["files"].columns == ["x", "y"]


def test_lines_are_numbered_and_sampled(spark, tmp_path):
    d = tmp_path / "GDC/META"
    d.mkdir(parents=True)
    (d / "Patient.ndjson").write_text("".join(f'{{"n": {k}}}\n' if k % 4 else "\n" for k in range(1, 21)))
    lines = files.read_lines(spark, str(d / "*.ndjson"))
    assert [tuple(r) for r in files.list_resources(lines).collect()] == [("GDC", "Patient")]
    assert files.count_records(lines).first().n == 20
    assert [r.line_no for r in fhir.sample_lines(lines, every=2, limit=3).orderBy("line_no").collect()] == [2, 6, 10]


def test_mapping_files(spark, tmp_path):
    case = {"obj_mapping": {"source": {"name": "case"}, "destination": {"name": "ResearchSubject"}}, "mappings": [{"source": {"name": "samples.sample_type", "enums": [{"enum": ["A", "B"]}]}, "destination": {"name": "Specimen.type"}}]}
    (tmp_path / "case.json").write_text(json.dumps(case))
    m, values = files.read_entity_mappings(spark, str(tmp_path / "case.json"), "gdc")
    assert {(r.id, r.source, r.source_context, r.destination, r.specimen_ref) for r in m.collect()} == {("gdc:case", "case", "", "ResearchSubject", ""), ("gdc:case.samples.sample_type", "sample_type", "samples", "Specimen.type", "Specimen")}
    assert {r.code for r in values.collect()} == {"A", "B"}
    node = [{"node": "Lung", "fhir:resourceType": "Condition", "fhir:fieldMapping": [{"fhir:field": "code", "fhir:code": "12"}], "fhir:reference": [{"fhir:resourceType": "Patient", "fhir:field": "subject"}]}, {"node": None}]
    (tmp_path / "nodes.json").write_text(json.dumps(node))
    m, values, nodes = files.read_node_mappings(spark, str(tmp_path / "nodes.json"), "htan")
    assert {(r.id, r.destination, r.subject_ref) for r in m.collect()} == {("htan:Lung", "Condition", "Patient"), ("htan:Lung.code", "Condition.code", "Patient")}
    assert values.first().code == "12" and nodes.count() == 1


def test_yaml(spark, tmp_path):
    (tmp_path / "grade.yaml").write_text('"#x": [1]\nG1:\n  - code: a\n  - code: b\nG2:\n  grade: [c]\n')
    got = {(r.source_category, r.source_value, r.key, r.code, r.is_primary) for r in files.read_terminology(spark, [str(tmp_path / "grade.yaml")]).collect()}
    assert got == {("grade", "G1", "", "a", True), ("grade", "G1", "", "b", False), ("grade", "G2", "grade", "c", True)}
    (tmp_path / "model.yaml").write_text("classes:\n  Patient:\n    slots: [name, id]\nslots:\n  id: {range: string, required: true}\n")
    model = files.read_model(spark, str(tmp_path / "model.yaml"))
    assert [r.slot for r in fhir.resource_fields(model, "patient").collect()] == ["id", "name"]
    assert [r.path for r in fhir.field_paths(model, 1).collect()] == ["Patient.name"] and fhir.search_fields(model, "NA").count() == 1


def test_streams(spark, tmp_path):
    rows = [("rule", "field", d, datetime(2024, 1, k)) for k, d in ((1, " Accept"), (1, "reject"), (9, "accept"), (20, "accept"))]
    df = spark.createDataFrame(rows, "matcher string, tier string, decision string, decided_at timestamp_ntz")
    df.write.parquet(str(tmp_path / "in"))
    s = st.read_stream(spark, str(tmp_path / "in"), df.schema)
    assert {(r.decision, r.n) for r in st.run_available(st.stream_stats(s), "t_stats").collect()} == {("accept", 3), ("reject", 1)}
    got = st.run_available(st.windowed_decisions(s, width="1 day", late="2 days"), "t_win", "append").collect()
    assert {(str(r.start)[:10], r.decision) for r in got} == {("2024-01-01", "accept"), ("2024-01-01", "reject"), ("2024-01-09", "accept")}


def test_calibration_state_counts_a_batch_once(spark, tmp_path):
    p = spark.createDataFrame([("m", "field", "", "", 0.85, True), ("m", "field", "", "", 0.85, False)], "matcher string, tier string, schema string, context string, confidence double, correct boolean")
    merge = st.merge_state(str(tmp_path / "state"))
    for number in (0, 0, 1):
        merge(p, number)
    r = st.read_state(spark, str(tmp_path / "state")).where("key = 'm'").first()
    assert (r.n, r.accuracy) == (4, 0.5)


def test_usage_and_summaries(spark, tmp_path):
    lines = spark.createDataFrame([(1, "R", '{"a": {"b": 1}}'), (2, "R", '{"a": {"b": 2}, "c": 3}')], "ord long, resource string, json string")
    merge = st.merge_usage(str(tmp_path / "u"))
    for number in (0, 0, 1):
        merge(lines, number)
    assert {tuple(r) for r in st.read_usage(spark, str(tmp_path / "u")).collect()} == {("a.b", 4), ("c", 2)}
    usage = spark.createDataFrame([("s", "t", "A.b", 7), ("s", "u", "A.c", 2)], "schema string, term string, path string, n long")
    fhir.export_summary(usage, str(tmp_path / "summary"))
    assert [r.term for r in spark.read.json(str(tmp_path / "summary")).collect()] == ["t"]
    entries = spark.createDataFrame([("t", "s", "A.b"), (None, "s", "A.b")], "source_term string, source_schema string, destination string")
    assert {tuple(r) for r in normalize.ground_truth(entries, usage, 2).collect()} == {("t", "s", "A.b", "curated"), ("u", "s", "A.c", "mined")}
    a = spark.createDataFrame([("m", "field", 0.5, 0.2)], "matcher string, tier string, accuracy double, ece double")
    r = calibrate.compare_runs(a, a.selectExpr("matcher", "tier", "accuracy + 0.25 AS accuracy", "ece")).first()
    assert (r.accuracy_delta, r.ece_delta) == (0.25, 0.0)


def test_lines_are_numbered_over_the_splits_of_a_file(spark, tmp_path):
    for name, n in (("a", 5000), ("b", 3), ("c", 0)):
        (tmp_path / f"{name}.ndjson").write_text("".join(f'{{"k": {k}}}\n' if k % 7 else "\n" for k in range(n)), encoding="utf-8")
    (tmp_path / "d.ndjson").write_text("x\ny", encoding="utf-8")
    kept = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        got = files.read_lines(spark, str(tmp_path))
        assert got.rdd.getNumPartitions() >= 1
        rows = {(r.file.rsplit("/", 1)[1][0], r.line_no): r.json for r in got.collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    assert len(rows) == 5005 and all(rows["a", k + 1] == (f'{{"k": {k}}}' if k % 7 else "") for k in range(5000))
    assert rows["d", 1] == "x" and rows["d", 2] == "y" and ("b", 3) in rows


def test_a_csv_is_scanned_from_its_head(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("﻿id,note,empty\n" + "".join(f"{k},{'x' * 80 if k == 1 else ''},\n" for k in range(10)), encoding="utf-8")
    got = {r.column_name: (r.position, r.samples) for r in files.scan_csv(spark, str(path), rows=5, values=3).collect()}
    assert got == {"id": (0, ["0", "1", "2"]), "note": (1, ["x" * 60]), "empty": (2, [])}
    assert [r.column_name for r in files.scan_csv(spark, str(path), limit=1).collect()] == ["id"]


def test_a_shared_folder_must_be_named_on_a_cluster(spark):
    conf = SimpleNamespace(get=lambda *_: None)
    none = SimpleNamespace(isDefined=lambda: False)
    jsc = SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))
    for master in ("spark://h:7077", "yarn", "local-cluster[3,2,1000]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            util.shared_dir(SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, _jsc=jsc)))


def test_results_tables_can_be_released(spark):
    table, path = util.materialize(spark.range(3), "kept")
    assert table.count() == 3 and util.release(spark) >= 1
    assert path not in util._KEPT and util.release(spark) == 0
