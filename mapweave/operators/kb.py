"""The knowledge base: sources, destinations, coded values and their targets, and lookups over them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.util import read_table

DESTINATION_PARTS = ("destination", "entity", "dest_system", "dest_code", "dest_display", "unit", "unit_system", "unit_code", "subject_ref", "focus_ref", "specimen_ref")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the given order. Combines before its shuffle, so hot keys are harmless."""
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*order))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


@dataclass(frozen=True)
class KnowledgeBase:
    """Four tables; "" stands for an absent text."""

    sources: DataFrame
    destinations: DataFrame
    values: DataFrame
    targets: DataFrame

    @classmethod
    def from_tables(cls, spark: SparkSession, d: str) -> KnowledgeBase:
        """Live rows; of one id the last delivered; of equal destinations of a source the first."""
        s = read_table(spark, d, "sources").where(F.col("deleted_at").isNull() & F.col("id").isNotNull())
        s = first_rows(s.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source", "source_schema", "tier", "source_context")), "ord"), ["id"], [-F.col("ord")])
        t = read_table(spark, d, "destinations").where(~(F.coalesce("source_id", F.lit("")) == "") & F.col("destination").isNotNull())
        t = t.select("source_id", *(F.coalesce(c, F.lit("")).alias(c) for c in DESTINATION_PARTS), "ord")
        t = first_rows(t, ["source_id", "destination"], [F.col("ord")])
        v = read_table(spark, d, "content_values").where(F.col("deleted_at").isNull() & F.col("id").isNotNull())
        v = first_rows(v.select("id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("source_value", "source_category", "code", "code_system", "display")), "is_primary", "ord"), ["id"], [-F.col("ord")])
        p = read_table(spark, d, "content_fhir_targets").where(F.col("content_value_id").isNotNull() & F.col("fhir_path").isNotNull())
        p = first_rows(p.select("content_value_id", *(F.coalesce(c, F.lit("")).alias(c) for c in ("fhir_path", "fhir_resource", "context")), "is_primary", "ord"), ["content_value_id", "fhir_path"], [F.col("ord")])
        return cls(s, t, v, p)

    @classmethod
    def open(cls, spark: SparkSession, path: str) -> KnowledgeBase:
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in ("sources", "destinations", "values", "targets")))

    def save(self, path: str) -> None:
        """Parquet, sorted by what lookups filter on, so that row groups can be skipped."""
        for name, df, key in (("sources", self.sources, "source"), ("destinations", self.destinations, "source_id"), ("values", self.values, "source_value"), ("targets", self.targets, "content_value_id")):
            df.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}")

    def mappings(self) -> DataFrame:
        """Each source with each of its destinations."""
        d = self.destinations.withColumnRenamed("ord", "dest_ord")
        return self.sources.join(d, self.sources["id"] == d["source_id"]).drop("source_id")

    def lookup(self, terms: DataFrame) -> DataFrame:
        """terms (term) -> (term, id, source_schema, tier, source_context, destination, dest_ord): every source
        named exactly so. Repeated terms are asked once."""
        return terms.select("term").distinct().join(self.mappings(), F.col("term") == F.col("source")).select("term", "id", "source_schema", "tier", "source_context", "destination", "dest_ord")

    def lookup_context(self, terms: DataFrame) -> DataFrame:
        """terms (term, context, schema): the last source of that term and context; a schema given and not
        its own leaves nothing, even if another schema has the pair."""
        last = self.sources.groupBy("source", "source_context").agg(F.max_by(F.struct("id", "source_schema"), "ord").alias("l"))
        asked = terms.select("term", "context", "schema").distinct()
        hit = asked.join(last, (F.col("term") == F.col("source")) & (F.col("context") == F.col("source_context")))
        hit = hit.where((F.coalesce("schema", F.lit("")) == "") | (F.col("schema") == F.col("l.source_schema")))
        hit = hit.select("term", "context", "schema", F.col("l.id").alias("id"))
        return hit.join(self.destinations, F.col("id") == F.col("source_id")).select("term", "context", "schema", "id", "destination")

    def lookup_reverse(self, paths: DataFrame) -> DataFrame:
        """paths (path) -> (path, destination, id, source): letter case aside."""
        asked = paths.select("path", F.lower("path").alias("_p")).distinct()
        return asked.join(self.mappings(), F.col("_p") == F.lower("destination")).select("path", "destination", "id", "source")

    def lookup_content(self, values: DataFrame, category: bool = False) -> DataFrame:
        """values (value[, category]) -> (value, id, code, paths): coded values of that name, letter case aside,
        with their paths in order; values without targets have none."""
        on = F.lower("value") == F.lower("source_value")
        asked = values.select("value", *(["category"] if category else [])).distinct()
        if category:
            on = on & (F.col("category") == F.col("source_category"))
        paths = self.targets.groupBy("content_value_id").agg(F.array_sort(F.collect_list(F.struct("ord", "fhir_path"))).alias("p"))
        hit = asked.join(self.values, on).join(paths, F.col("id") == F.col("content_value_id"), "left")
        return hit.select("value", *(["category"] if category else []), "id", "code", F.coalesce(F.transform("p", lambda x: x["fhir_path"]), F.array().cast("array<string>")).alias("paths"))

    def content_by_path(self, paths: DataFrame) -> DataFrame:
        asked = paths.select("path", F.lower("path").alias("_p")).distinct()
        hit = asked.join(self.targets, F.col("_p") == F.lower("fhir_path"))
        return hit.join(self.values, F.col("content_value_id") == F.col("id")).select("path", "id", "source_value", "source_category", "code")

    @staticmethod
    def lookup_records(names: DataFrame, entities: DataFrame, details: DataFrame, records: DataFrame) -> DataFrame:
        """entities (key, ...) with their details (key, ...) and records (key, name, ...) by two left joins, for the records named
        exactly so in names (name), distinct: an entity without details comes with NULLs, one without such a record doesn't.
        Records are cut down to the names before the joins, so no side is read for others."""
        asked = records.join(names.select("name").where(F.col("name").isNotNull()).distinct(), "name", "left_semi")
        return asked.join(entities, "key").join(details, "key", "left").drop("key").distinct()

    def filter_tier(self, tier: str) -> DataFrame:
        return self.mappings().where(F.col("tier") == tier)

    def filter_schema(self, schema: str) -> DataFrame:
        return self.mappings().where(F.col("source_schema") == schema)

    def tier_candidates(self, tier: str) -> DataFrame:
        return self.filter_tier(tier).select("destination").distinct()

    def stats(self) -> DataFrame:
        s = self.sources.agg(
            F.count(F.lit(1)).alias("sources"), F.array_join(F.array_sort(F.collect_set("source_schema")), ",").alias("schemas"), F.array_join(F.array_sort(F.collect_set("tier")), ",").alias("tiers")
        )
        others = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in (("destinations", self.destinations), ("content_values", self.values), ("content_targets", self.targets))]
        for o in others:
            s = s.crossJoin(o)  # one row each
        return s

    def training_pairs(self) -> DataFrame:
        m = self.mappings()
        return m.select(tx.training_key(F.col("source_context"), F.col("source")).alias("key"), tx.training_value({c: F.col(c) for c in m.columns}).alias("value"))

    def training_csv(self, path: str) -> None:
        self.training_pairs().select(F.col("key").alias("source"), F.col("value").alias("destination")).write.mode("overwrite").option("header", True).csv(path)

    def expertise(self) -> DataFrame:
        """(term, paths): every term, names and coded values, with the distinct paths it leads to, in order."""
        a = self.mappings().select(F.lower("source").alias("term"), F.col("destination").alias("path"), F.struct(F.lit(0).alias("a"), F.col("dest_ord").alias("b")).alias("o"))
        b = self.values.join(self.targets.select("content_value_id", "fhir_path", F.col("ord").alias("t_ord")), F.col("id") == F.col("content_value_id"))
        b = b.select(F.lower("source_value").alias("term"), F.col("fhir_path").alias("path"), F.struct(F.lit(1).alias("a"), F.col("t_ord").alias("b")).alias("o"))
        first = a.unionByName(b).groupBy("term", "path").agg(F.min("o").alias("o"))
        return first.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "path"))), lambda x: x["path"]).alias("paths"))

    def merge(self, entries: DataFrame, case_sensitive: bool = False, min_count: int = 1) -> DataFrame:
        """entries (source_term, source_schema, source_context, destination, tier, ord) -> the rows to insert:
        pairs of term and destination the base doesn't have for that schema, the first of equal ones."""
        fold = (lambda c: F.col(c)) if case_sensitive else (lambda c: F.lower(c))
        new = entries.select("source_term", "source_schema", F.coalesce("source_context", F.lit("")).alias("source_context"), "destination", "tier", "ord", fold("destination").alias("_d"))
        counted = new.groupBy("source_schema", "source_term", "_d").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("source_context", "destination", "tier", "ord"), "ord").alias("r"))
        have = self.mappings().select("source_schema", F.col("source").alias("source_term"), fold("destination").alias("_d")).distinct()
        out = counted.where(F.col("n") >= min_count).join(have, ["source_schema", "source_term", "_d"], "left_anti")
        return out.select(F.concat_ws(":", "source_schema", "source_term").alias("id"), "source_term", "source_schema", "r.source_context", "r.destination", "r.tier", "n")

    def without_destination(self) -> DataFrame:
        return self.sources.join(self.destinations.select(F.col("source_id").alias("id")).distinct(), "id", "left_anti")

    def multi_destination_audit(self) -> DataFrame:
        """Terms of a schema and tier with more than one destination."""
        g = self.mappings().groupBy("source_schema", "tier", "source").agg(F.countDistinct("destination").alias("n"), F.array_join(F.array_sort(F.collect_set("destination")), ", ").alias("destinations"))
        return g.where(F.col("n") > 1)

    def counts(self) -> DataFrame:
        return self.mappings().groupBy("source_schema", "tier").agg(F.countDistinct("id").alias("sources"), F.count(F.lit(1)).alias("destinations"))

    def top_destinations(self, n: int = 15) -> DataFrame:
        return self.destinations.groupBy("destination").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "destination").limit(n)

    # repairs: each gives the destinations or sources as they would be
    def apply_path_fixes(self, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
        """rules (old_destination, new_destination, action): update or delete; an update without a new value
        deletes. Returns the destinations, and the sources that still have one."""
        r = rules.select(
            F.col("old_destination").alias("_o"), F.col("new_destination").alias("_n"),
            ((F.col("action") == "delete") | (F.coalesce("new_destination", F.lit("")) == "")).alias("_del"),
        )
        fixed = self.destinations.join(r, F.col("destination") == F.col("_o"), "left").where(~F.coalesce("_del", F.lit(False)))
        fixed = fixed.withColumn("destination", F.coalesce("_n", "destination")).drop("_o", "_n", "_del")
        kept = self.sources.join(fixed.select(F.col("source_id").alias("id")).distinct(), "id", "left_semi")
        return fixed, kept

    def delete_like(self, pattern: str) -> DataFrame:
        return self.destinations.where(~F.col("destination").ilike(pattern))

    def delete_schema(self, schema: str) -> DataFrame:
        return self.sources.where(F.col("source_schema") != schema)

    def add_mapping(self, term: str, schema: str, context: str, destination: str, tier: str = "field") -> KnowledgeBase:
        spark = self.sources.sparkSession
        key = f"{schema}:{context}.{term}" if context else f"{schema}:{term}"
        s = spark.createDataFrame([(key, term, schema, tier, context)], "id string, source string, source_schema string, tier string, source_context string")
        s = s.crossJoin(self.sources.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord")))
        d = spark.createDataFrame([(key, destination, destination.split(".")[0])], "source_id string, destination string, entity string")
        d = d.crossJoin(self.destinations.agg((F.coalesce(F.max("ord"), F.lit(0)) + 1).alias("ord")))
        return KnowledgeBase(self.sources.unionByName(s), self.destinations.unionByName(d, allowMissingColumns=True).fillna(""), self.values, self.targets)

    def repair_counts(self) -> DataFrame:
        """What each clean-up would change: mappings to themselves, content rows without a path, entity rows
        with one, sources without destination."""
        m = self.mappings()
        a = m.agg(
            F.count_if(F.lower("source") == F.lower("destination")).alias("self_mappings"),
            F.count_if((F.col("tier") == "content") & ~F.col("destination").contains(".")).alias("content_without_path"),
            F.count_if((F.col("tier") == "entity") & F.col("destination").contains(".")).alias("entity_with_path"),
        )
        return a.crossJoin(self.without_destination().agg(F.count(F.lit(1)).alias("without_destination")))


def row_rank(df: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
