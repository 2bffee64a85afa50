"""The knowledge base as SQL: views of its tables, and table functions over them for use in any query."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mapweave.operators.kb import KnowledgeBase

#: (name, parameters, columns, query)
_FUNCTIONS = (
    ("lookup_mapping", "asked STRING", "id STRING, source_schema STRING, tier STRING, destination STRING",
     "SELECT id, source_schema, tier, destination FROM {kb}_mappings WHERE source = asked"),
    ("lookup_path", "asked STRING", "id STRING, source STRING, destination STRING",
     "SELECT id, source, destination FROM {kb}_mappings WHERE lower(destination) = lower(asked)"),
    ("lookup_content", "asked STRING", "id INT, source_category STRING, code STRING, fhir_path STRING",
     "SELECT v.id, v.source_category, v.code, t.fhir_path FROM {kb}_values v LEFT JOIN {kb}_targets t ON v.id = t.content_value_id WHERE lower(v.source_value) = lower(asked)"),
    ("tier_paths", "asked STRING", "destination STRING", "SELECT DISTINCT destination FROM {kb}_mappings WHERE tier = asked"),
    ("search_terms", "asked STRING", "source STRING, destination STRING", "SELECT DISTINCT source, destination FROM {kb}_mappings WHERE contains(lower(source), lower(asked))"),
)


def register(kb: KnowledgeBase, prefix: str = "kb") -> list[str]:
    """Temporary views `{prefix}_sources`, `_destinations`, `_values`, `_targets`, `_mappings` and functions `{prefix}_lookup_mapping(name)`,
    `_lookup_path(path)`, `_lookup_content(value)`, `_tier_paths(tier)`, `_search_terms(text)`, each giving a table: call them in
    FROM, or LATERAL with a column, which plans as a join. A name registered before is replaced. Returns the functions' names."""
    spark = kb.sources.sparkSession
    for name, df in (("sources", kb.sources), ("destinations", kb.destinations), ("values", kb.values), ("targets", kb.targets), ("mappings", kb.mappings())):
        df.createOrReplaceTempView(f"{prefix}_{name}")
    for name, parameters, columns, query in _FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}_{name}({parameters}) RETURNS TABLE ({columns}) RETURN {query.format(kb=prefix)}")
    return [f"{prefix}_{name}" for name, *_ in _FUNCTIONS]


def ask(spark: SparkSession, function: str, questions: DataFrame, column: str) -> DataFrame:
    """The rows of a registered function for each distinct value of the column."""
    questions.select(column).distinct().createOrReplaceTempView("_mapweave_questions")
    return spark.sql(f"SELECT q.`{column}`, f.* FROM _mapweave_questions q, LATERAL {function}(q.`{column}`) f")
