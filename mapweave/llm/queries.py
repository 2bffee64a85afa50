"""The pN_ queries of the llm problems over the project's tables, and SQL for those it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.llm import canonical_map, consensus, format_dups, leakage, mixing, splitting, topn
from mapweave.util import read_table, scratch_path

#: The tables of problem 3: (table, text column).
FORMATTED = (("sources", "source"), ("mapping_entries", "source_term"), ("feedback", "source"))
#: Columns that don't count when records are compared.
UNCOMPARED = ("ord", "id", "loaded_at", "deleted_at", "decided_at", "ingested_at", "notes")
TOP = 5
#: Rows of split_settings at most.
SETTINGS = 1000


def _votes(spark: SparkSession, d: str) -> DataFrame:
    return consensus.clean_votes(read_table(spark, d, "feedback"), "match_id", "user_id", "decision", "ground_truth", "decided_at", "ord")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.consensus(_votes(spark, d))
    return items.where(F.col("votes") >= 3).select(F.col("item").alias("match_id"), F.col("label").alias("decision"), F.col("value").alias("ground_truth"))


def p1_agreement(spark: SparkSession, d: str) -> DataFrame:
    items, _ = consensus.consensus(_votes(spark, d))
    return items.select(F.col("item").alias("match_id"), F.col("label").alias("decision"), F.col("value").alias("ground_truth"), "votes", "agreement", "posterior")


def p1_reliability(spark: SparkSession, d: str) -> DataFrame:
    _, users = consensus.consensus(_votes(spark, d))
    return users.select(F.col("user").alias("user_id"), "n", F.col("w").alias("reliability"), "moved", "accuracy", "p_accept", "p_reject", "p_correct")


def p1_spectral(spark: SparkSession, d: str) -> DataFrame:
    """The vote weighted with the spectral reliabilities alone."""
    items = consensus.spectral_vote(_votes(spark, d)).where(F.col("votes") >= 3)
    return items.select(F.col("item").alias("match_id"), F.col("label").alias("decision"), F.col("value").alias("ground_truth"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    best = topn.top_n_per_group(read_table(spark, d, "match_candidates"), "source_field", "match_id", "score", TOP)
    return best.select("source_field", "match_id")


def p2_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(read_table(spark, d, "match_candidates"), "source_field", "match_id", "score", TOP)


def p2_skipped(spark: SparkSession, d: str) -> DataFrame:
    """How many row groups the best are found without."""
    path = topn.cluster_by_group(read_table(spark, d, "match_candidates"), "source_field", "match_id", "score", scratch_path(spark, "clustered"))
    return topn.skip_report(spark, path, TOP)


def _copies(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for table, text in FORMATTED:
        df = read_table(spark, d, table)
        got = format_dups.format_duplicates(df, text, "ord", [c for c in UNCOMPARED if c in df.columns and c != "ord"])
        got = got.select(F.lit(table).alias("table_name"), F.col("first_id").alias("first_ord"), F.col("row_id").alias("ord"), "copies")
        out = got if out is None else out.unionByName(got)
    return out


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """The copies of each record: every row but the first, which is the record kept. p3_records has those."""
    return _copies(spark, d).where(F.col("first_ord") != F.col("ord")).select("table_name", "first_ord", "ord")


def p3_records(spark: SparkSession, d: str) -> DataFrame:
    return _copies(spark, d).where(F.col("first_ord") == F.col("ord")).select("table_name", "first_ord", "copies")


def _typed(spark: SparkSession, d: str) -> DataFrame:
    contents, cases = read_table(spark, d, "content_values"), read_table(spark, d, "cases")
    parts = [contents.select(F.lit("content_values.source_value").alias("field_name"), "ord", F.col("source_category").alias("category"), F.col("source_value").alias("value"))]
    parts += [cases.select(F.lit(f"cases.{c}").alias("field_name"), "ord", F.lit(c).alias("category"), F.col(c).alias("value")) for c in ("primary_diagnosis", "race")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    typed = _typed(spark, d)
    mapped = canonical_map.map_values(typed, read_table(spark, d, "canonical_terms"))
    return canonical_map.lead_rows(typed, mapped, typed.count()).select("field_name", "ord", "term_id")


def p4_misses(spark: SparkSession, d: str) -> DataFrame:
    return canonical_map.misses(canonical_map.map_values(_typed(spark, d), read_table(spark, d, "canonical_terms")))


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(read_table(spark, d, "documents"), read_table(spark, d, "eval_items"), "doc_id", "text", "item_id", "text")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).select("doc_id", "item_id")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d).groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("words").alias("longest_passage"))


def _mix(spark: SparkSession, d: str):
    return mixing.mix(read_table(spark, d, "documents"), read_table(spark, d, "mix_targets"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[0]


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return _mix(spark, d)[1]


def _pieces(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "split_settings").orderBy("setting").limit(SETTINGS + 1).collect()
    if len(rows) > SETTINGS:
        raise ValueError(f"split_settings: more than {SETTINGS} rows")
    settings = [(r.setting, r.max_tokens, r.overlap_tokens) for r in rows]
    return splitting.split_texts(read_table(spark, d, "documents"), settings)


def p8_pieces(spark: SparkSession, d: str) -> DataFrame:
    return _pieces(spark, d)


def p8_cuts(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_report(_pieces(spark, d))


def queries() -> dict:
    found = (p1_found, p1_agreement, p1_reliability, p1_spectral, p2_found, p2_ranked, p2_skipped, p3_found, p3_records, p4_found, p4_misses, p6_found, p6_items, p7_mix, p7_shares, p8_pieces, p8_cuts)
    return {f.__name__: f for f in found}


_RANKED = f"""
WITH items AS (
  SELECT source_field, match_id, max(score) AS score FROM match_candidates
  WHERE source_field IS NOT NULL AND source_field <> '' AND match_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
  GROUP BY source_field, match_id),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_field ORDER BY score DESC, match_id) AS r FROM items)
SELECT source_field, match_id{{more}} FROM ranked WHERE r <= {TOP}
"""

_STRIP = r"regexp_replace({0}, '[^\p{{L}}\p{{N}}]+', '', 'g')"


def _canonical_sql(c: str) -> str:
    folded = f"lower(upper({c}))"
    key = _STRIP.format(r"regexp_extract(f, '^([^:=]*)', 1)")
    value = _STRIP.format(r"regexp_replace(f, '^[^:=]*[:=]?', '')")
    fields = f"list_sort(list_filter(list_transform(regexp_split_to_array({folded}, '[;|,\\n\\r]+'), lambda f: {key} || chr(2) || {value}), lambda x: x <> chr(2)))"
    return f"CASE WHEN regexp_matches({c}, '[:=]') THEN chr(1) || array_to_string({fields}, chr(1)) ELSE {_STRIP.format(folded)} END"


def _copies_sql() -> str:
    columns = {
        "sources": "source_schema, tier, source_context",
        "mapping_entries": "source_schema, source_context, destination, destination_resource, dest_system, tier, relation, description, parent",
        "feedback": "match_id, source_context, proposed_target, ground_truth, decision, matcher, tier, confidence, user_id",
    }
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, min(ord) OVER w AS first_ord, ord, count(*) OVER w AS copies FROM (SELECT *, {_canonical_sql(c)} AS canon FROM {t}) AS x "
        f"WINDOW w AS (PARTITION BY canon, {columns[t]})"
        for t, c in FORMATTED
    )


def oracle_sql() -> dict[str, str]:
    copies = _copies_sql()
    return {
        "p2_found": _RANKED.format(more=""),
        "p2_ranked": _RANKED.format(more=", score, CAST(r AS INTEGER) AS rank"),
        "p3_found": f"SELECT table_name, first_ord, ord FROM ({copies}) AS c WHERE first_ord <> ord",
        "p3_records": f"SELECT table_name, first_ord, copies FROM ({copies}) AS c WHERE first_ord = ord",
    }
