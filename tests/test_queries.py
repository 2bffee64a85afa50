"""Queries of the entry file against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

DATA = "/root/testdata/sf0.001"
NAMES = (
    "p5_found p5_periods kb_lookup kb_lookup_context kb_training_pairs kb_merge conflicts_schema resolve_priority path_validation rule_match_topk fuzzy_lookup dedupe_matches "
    "fuzzy_pairs cascade_constrained vector_search flat_calibration tool_lookup mined_merge content_types column_relations hitl_export ground_truth_rows minted_ids match_tables_all "
    "tier_run calib_curve calib_scores profile_columns json_coding_usage json_pair_usage feedback_stats consensus_vote stream_feedback_stats cascade_map eval_report"
).split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW \"{os.path.basename(p)[:-8]}\" AS SELECT * FROM '{p}'")
    return con


def canon(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    form = lambda v: f"{v:.6g}" if isinstance(v, float) else str(v)
    return sorted(tuple(form(r[k]) for k in order) for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, sql, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, DATA)
    cur = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(columns) == sorted(df.columns)
    assert canon([tuple(r) for r in df.collect()], df.columns) == canon(cur.fetchall(), columns)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_stream_windows_have_every_decision(spark, sql):
    import __spark_entry__ as entry

    df = entry.queries()["stream_windows"](spark, DATA)
    rows = sql.execute(entry.oracle_sql()["stream_windows"]).fetchall()
    assert canon([tuple(r) for r in df.select("start", "decision", "n").collect()], ["start", "decision", "n"]) == canon(rows, ["start", "decision", "n"])
    assert sum(r[2] for r in rows) == sql.execute("SELECT count(decided_at) FROM feedback").fetchone()[0]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_reverse_lookup_asks_the_paths_of_every_matcher(spark, sql):
    import __spark_entry__ as entry

    got = {r.path for r in entry.queries()["kb_reverse_lookup"](spark, DATA).select("path").distinct().collect()}
    known = {r.destination.lower() for r in entry.queries()["kb_top_destinations"](spark, DATA).collect()}
    asked = {r[0] for r in sql.execute("SELECT DISTINCT lower(proposed_target) FROM feedback WHERE source IS NOT NULL AND proposed_target IS NOT NULL").fetchall()}
    assert known & asked <= got <= asked


def test_every_sql_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
