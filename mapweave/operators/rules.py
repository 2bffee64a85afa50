"""Nested mapping rules: one row per rule with arrays of references, categories and field mappings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RULE_SCHEMA = (
    "rule_id string, source_node string, target_resource string, references array<struct<resource:string,field:string>>, category array<string>, "
    "field_mappings array<struct<field:string,type:string,system:string,code:string,category:string>>, confidence double, missing_in_schematic boolean, ord long"
)


def explode_rules(entries: DataFrame) -> DataFrame:
    """Rules from the node entries of a mapping file (node, resource_type, fields, references, category, ord);
    entries without a node are skipped."""
    given = entries.where(F.coalesce("node", F.lit("")) != "")
    return given.select(
        F.col("node").alias("rule_id"), F.col("node").alias("source_node"), F.col("resource_type").alias("target_resource"),
        F.coalesce("references", F.array().cast("array<struct<resource:string,field:string>>")).alias("references"),
        F.coalesce("category", F.array().cast("array<string>")).alias("category"),
        F.coalesce("fields", F.array().cast("array<struct<field:string,type:string,system:string,code:string,category:string>>")).alias("field_mappings"),
        F.lit(1.0).alias("confidence"), F.coalesce("missing_in_schematic", F.lit(False)).alias("missing_in_schematic"), "ord",
    )


def find_by_source(rules: DataFrame, text: str) -> DataFrame:
    return rules.where(F.lower("source_node").contains(text.lower()))


def find_by_target(rules: DataFrame, resource: str) -> DataFrame:
    return rules.where(F.lower("target_resource") == resource.lower())


def find_by_category(rules: DataFrame, category: str) -> DataFrame:
    return rules.where(F.exists("category", lambda c: F.lower(c) == category.lower()))


def find_by_reference(rules: DataFrame, resource: str) -> DataFrame:
    return rules.where(F.exists("references", lambda r: F.lower(r["resource"]) == resource.lower()))


def find_by_id(rules: DataFrame, rule_id: str) -> DataFrame:
    """The last rule of that id."""
    return rules.where(F.col("rule_id") == rule_id).orderBy(F.desc("ord")).limit(1)


def filter_rules(rules: DataFrame, source: str | None = None, target_resource: str | None = None, category: str | None = None, has_reference_to: str | None = None, min_confidence: float | None = None) -> DataFrame:
    """All conditions that are given; the target is a substring here."""
    if source:
        rules = find_by_source(rules, source)
    if target_resource:
        rules = rules.where(F.lower("target_resource").contains(target_resource.lower()))
    if category:
        rules = find_by_category(rules, category)
    if has_reference_to:
        rules = find_by_reference(rules, has_reference_to)
    return rules.where(F.col("confidence") >= min_confidence) if min_confidence is not None else rules


def rule_stats(rules: DataFrame) -> DataFrame:
    categories = rules.select(F.explode("category").alias("c")).agg(F.countDistinct("c").alias("categories"))
    return rules.agg(F.count(F.lit(1)).alias("total"), F.countDistinct("target_resource").alias("targets")).crossJoin(categories)
