"""Profiles of the columns of any table: statistics, content types, groups, relations, recommendations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mapweave.functions.text import first_of, has_any

# Name parts of identifier columns and of columns of the domain.
ID_WORDS = ("id", "identifier", "code", "key", "uuid", "guid", "number")
DOMAIN_WORDS = (
    "patient", "specimen", "tissue", "sample", "diagnosis", "disease",
    "anatomy", "pathology", "medical", "clinical", "treatment", "therapy",
    "biospecimen", "histology", "morphology", "grade", "stage",
)
# Targets for which candidate columns are sought.
TARGETS = (
    "Patient.identifier", "Patient.birthDate", "Patient.deceasedBoolean",
    "Specimen.type", "Specimen.collection.method", "Specimen.collection.collectedDateTime",
    "Observation.code", "Observation.valueString", "Observation.valueQuantity",
    "Condition.code", "Condition.stage.summary", "Condition.onsetDateTime",
    "DocumentReference.content.attachment.url", "DocumentReference.type",
)
# Vocabularies of two-valued columns.
BOOLEAN_VALUES = ("0", "1", "true", "false", "yes", "no", "y", "n", "alive", "dead", "positive", "negative", "pos", "neg", "male", "female", "m", "f")
VITAL_VALUES = ("alive", "dead", "living", "deceased", "censored")
# Name parts that tell uses and origins of a table; on equal scores the first use wins.
USE_CASES = (
    ("survival_analysis", ("survival", "os_time", "os_event", "vital_status", "days_to_death", "survival_months", "death_event", "censor", "overall_survival")),
    ("variant_tracking", ("variant", "mutation", "gene", "chromosome", "hgvs", "position", "variant_type", "allele", "frequency", "vaf", "snp", "cnv", "pathogenic", "clinical_significance")),
    ("lab_results", ("result", "value", "unit", "reference_range", "analyte", "concentration", "measurement", "test_name", "panel")),
    ("staging_grading", ("stage", "grade", "tnm", "t_stage", "n_stage", "m_stage", "pathologic", "clinical", "ajcc", "grading")),
    ("sample_metadata", ("sample", "specimen", "tissue", "tumor", "normal", "ffpe", "collection", "preservation", "biopsy")),
    ("clinical_phenotyping", ("diagnosis", "phenotype", "symptom", "finding", "condition", "disease", "histology", "morphology")),
)
PROVENANCES = (
    ("geo_repository", ("gsm", "gse", "gpl")),
    ("sequencing_lab", ("panel_name", "run", "flowcell", "lane", "barcode")),
    ("clinical_registry", ("mrn", "encounter", "visit", "admission")),
    ("research_study", ("participant", "subject", "cohort", "arm")),
)
# What a use is described as.
PURPOSES = (
    ("survival_analysis", "outcomes of a cohort over time"),
    ("variant_tracking", "variants found in samples"),
    ("lab_results", "results of tests"),
    ("staging_grading", "extent and grade of tumors"),
    ("sample_metadata", "what samples are and where they come from"),
    ("clinical_phenotyping", "findings and diagnoses"),
)


def unpivot(df: DataFrame, order: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """(column_name, position, ord, value): a row per cell, values as strings. One pass over the table."""
    columns = columns or [c for c in df.columns if c != order]
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("position"), F.col(f"`{c}`").cast("string").alias("value")) for k, c in enumerate(columns)))
    at = F.col(order) if order else F.monotonically_increasing_id()
    return df.select(at.alias("ord"), F.explode(cells).alias("c")).select("c.column_name", "c.position", "ord", "c.value")


def first_samples(cells: DataFrame, n: int = 3) -> DataFrame:
    """The first n non-null values of each column, by ord. The limit of the window is applied below its shuffle
    too, so each partition sends n values a column."""
    given = cells.where(F.col("value").isNotNull())
    w = Window.partitionBy("column_name").orderBy("ord", "value")
    ranked = given.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n)
    return ranked.groupBy("column_name").agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "value"))), lambda x: x["value"]).alias("samples"))


def header_scan(df: DataFrame, order: str, rows: int = 200, values: int = 3, width: int = 60, limit: int | None = None) -> DataFrame:
    """(column_name, position, samples) of a table's head: of the first `rows` rows by `order`, each column's first `values` texts that
    aren't empty, cut to `width` letters; the first `limit` columns. A byte order mark before the first name is no part of
    it. A column without values has none."""
    columns = [c for c in df.columns if c != order][:limit]
    head = df.orderBy(order).limit(rows)
    cells = unpivot(head, order, columns)
    found = first_samples(cells.where(F.col("value") != "").withColumn("value", F.left("value", F.lit(width))), values)
    names = cells.sparkSession.createDataFrame([(c, k) for k, c in enumerate(columns)], "column_name string, position int")
    named = names.join(found, "column_name", "left")
    return named.select(F.ltrim("column_name", F.lit("\ufeff")).alias("column_name"), "position", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def column_stats(cells: DataFrame, approximate: bool = False) -> DataFrame:
    """(column_name, position, row_count, null_count, distinct_count)."""
    distinct = F.approx_count_distinct("value") if approximate else F.countDistinct("value")
    return cells.groupBy("column_name", "position").agg(F.count(F.lit(1)).alias("row_count"), F.count_if(F.col("value").isNull()).alias("null_count"), distinct.alias("distinct_count"))


def is_identifier(name: Column, samples: Column) -> Column:
    """By name, or if the first ten values are longer than five characters on average and look like codes."""
    ten = F.slice(samples, 1, 10)
    n = F.size(ten)
    length = F.aggregate(ten, F.lit(0.0), lambda a, v: a + F.length(v)) / n
    codes = F.size(F.filter(ten, lambda v: v.rlike("^[A-Z0-9_-]+$"))) / n
    return has_any(F.lower(name), ID_WORDS) | F.coalesce((n > 0) & (length > 5) & (codes > 0.7), F.lit(False))


def is_domain_field(name: Column) -> Column:
    return has_any(F.lower(name), DOMAIN_WORDS)


def target_candidates(columns: DataFrame) -> DataFrame:
    """columns (entity, column_name, samples, is_identifier) -> (target, entity, column_name)."""
    targets = F.array(*(F.lit(t) for t in TARGETS))
    c = columns.select("entity", "column_name", "samples", "is_identifier", F.explode(targets).alias("target"))
    f, t = F.lower("column_name"), F.lower("target")
    hit = (
        (t.contains("identifier") & F.col("is_identifier"))
        | (t.contains("specimen") & has_any(f, ("specimen", "tissue", "sample")))
        | (t.contains("date") & has_any(f, ("date", "time", "collected", "onset")))
        | (t.contains("url") & F.exists("samples", lambda s: s.contains("http") | s.contains("ftp")))
    )
    return c.where(hit).select("target", "entity", "column_name")


def _matches(values: Column, pattern: str) -> Column:
    return F.forall(values, lambda v: v.rlike(pattern))


def content_types(columns: DataFrame, compat: bool = False) -> DataFrame:
    """columns (column_name, samples) -> plus (dtype, pattern, vocabulary, nullable), by the first rule that
    holds. compat takes the published patterns literally, by which any value that starts with a digit or an
    x is a chromosome and the numbers 1 to 4 are stages; by default these need the whole value, and single
    digits a hint in the name."""
    values = F.filter(F.transform("samples", lambda v: F.lower(F.trim(v))), lambda v: v.isNotNull() & ~v.isin("", "na", "nan", "null"))
    d = columns.withColumn("_v", values).withColumn("_u", F.array_distinct("_v"))
    v, u, name = F.col("_v"), F.col("_u"), F.lower("column_name")

    def within(words: tuple[str, ...]) -> Column:
        return F.size(F.array_except(u, F.array(*(F.lit(w) for w in words)))) == 0

    def kind(dtype: str, pattern: str | None, vocabulary: str | None = None) -> Column:
        return F.struct(F.lit(dtype).alias("dtype"), F.lit(pattern).cast("string").alias("pattern"), F.lit(vocabulary).cast("string").alias("vocabulary"))

    # The published patterns, where compat is set.
    stage = r"(?i)^(stage\s*)?(I{1,3}V?|[1-4])[ABC]?$" if compat else r"(?i)^((stage\s*)(I{1,3}V?|[1-4])|I{1,3}V?)[ABC]?$"
    grade = r"(?i)^G[1-4X]$|^(grade\s*)?[1-4]$" if compat else r"^(g|grade\s*)[1-4]$|^gx$"
    chromosome = r"(?i)^(?:(chr)?\d{1,2}|X|Y$)" if compat else r"(?i)^(chr(\d{1,2}|X|Y)|X|Y)$"
    number = r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"
    numeric = _matches(v, number)
    whole = F.forall(v, lambda x: F.coalesce(F.floor(x.try_cast("double")) == x.try_cast("double"), F.lit(False)))
    rules = [
        (F.coalesce(F.size(v), F.lit(0)) <= 0, kind("unknown", None)),
        (has_any(name, ("_id", "identifier", "accession")) & _matches(v, r"^GSM\d+$" if compat else r"(?i)^GSM\d+$"), kind("id", "geo_accession")),
        (has_any(name, ("_id", "identifier", "accession")) & _matches(v, r"(?i)^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$"), kind("id", "uuid")),
        (has_any(name, ("_id", "identifier", "accession")), kind("id", "identifier")),
        (within(("0", "1")) & has_any(name, ("death", "deceased", "dead", "event", "censor", "status")), kind("boolean", "binary_event", "survival_event")),
        (within(("0", "1")), kind("boolean", "binary")),
        (within(("alive", "dead", "living", "deceased")) & within(BOOLEAN_VALUES), kind("boolean", "vital_status", "vital_status")),
        (within(("male", "female", "m", "f")), kind("categorical", "sex", "administrative_gender")),
        (within(BOOLEAN_VALUES), kind("boolean", "binary")),
        (has_any(name, ("vital", "status")) & F.arrays_overlap(u, F.array(*(F.lit(w) for w in VITAL_VALUES))), kind("boolean", "vital_status", "vital_status")),
        (has_any(name, ("t_stage", "n_stage", "m_stage", "tnm", "pathologic_t", "pathologic_n", "pathologic_m", "clinical_t", "clinical_n", "clinical_m")), kind("coded", "tnm_category", "ajcc_tnm")),
        (_matches(v, r"(?i)^[pcy]?[TNM][0-4X]?[abc]?$"), kind("coded", "tnm_category", "ajcc_tnm")),
        (name.contains("stage"), kind("coded", "cancer_stage", "ajcc_stage")),
        (_matches(v, stage), kind("coded", "cancer_stage", "ajcc_stage")),
        (has_any(name, ("grade", "grading")), kind("coded", "tumor_grade", "histologic_grade")),
        (_matches(v, grade), kind("coded", "tumor_grade", "histologic_grade")),
        (_matches(v, r"(?i)^[cgnmpr]\.[\d\-+*]+"), kind("coded", "hgvs", "hgvs_nomenclature")),
        (name.contains("chr"), kind("coded", "chromosome", "chromosome")),
        (_matches(v, chromosome), kind("coded", "chromosome", "chromosome")),
        (numeric & whole & has_any(name, ("position", "start", "end", "stop")), kind("numeric", "genomic_position")),
        (numeric & whole & name.contains("day"), kind("numeric", "duration_days")),
        (numeric & whole, kind("numeric", "integer")),
        (numeric & has_any(name, ("survival", "time", "month")), kind("numeric", "duration_time")),
        (numeric & has_any(name, ("frequency", "freq", "vaf", "percent", "pct")), kind("numeric", "frequency")),
        (numeric, kind("numeric", "continuous")),
        ((F.size(u) <= 10) & (F.size(v) > F.size(u) * 2), kind("categorical", "enumerated")),
    ]
    out = d.withColumn("_k", first_of(rules, kind("text", "free_text"))).withColumn("nullable", F.size("_v") < F.greatest(F.size("samples"), F.lit(1)))
    return out.drop("_v", "_u").select("*", "_k.dtype", "_k.pattern", "_k.vocabulary").drop("_k")


def column_group(name: Column, dtype: Column, pattern: Column, vocabulary: Column) -> Column:
    low = F.lower(name)
    vocabulary = F.coalesce(vocabulary, F.lit(""))
    return first_of(
        [
            (dtype == "id", "identifiers"),
            ((vocabulary == "survival_event") | has_any(low, ("survival", "os_time", "os_event", "death", "vital", "censor")), "survival"),
            (vocabulary.isin("ajcc_tnm", "ajcc_stage", "histologic_grade") | has_any(low, ("stage", "grade")), "staging"),
            (has_any(low, ("chromosome", "position", "start", "end", "stop", "genome_build")), "genomic_location"),
            (has_any(low, ("gene", "variant", "mutation", "hgvs", "allele", "frequency", "vaf")), "variant_details"),
            (has_any(low, ("sample", "tissue", "tumor", "specimen", "biopsy")), "sample_info"),
            (has_any(low, ("diagnosis", "disease", "condition", "phenotype")), "clinical"),
        ],
        "other",
    )


def recommendation(name: Column, dtype: Column, pattern: Column, vocabulary: Column) -> Column:
    """Path advised for a column, NULL for none."""
    low, p, v = F.lower(name), F.coalesce(pattern, F.lit("")), F.coalesce(vocabulary, F.lit(""))
    return first_of(
        [
            ((v == "survival_event") | ((dtype == "boolean") & has_any(low, ("death", "deceased", "dead", "vital"))), "Patient.deceasedBoolean"),
            ((p == "duration_time") | has_any(low, ("survival_month", "os_time", "survival_time")), "Observation.valueQuantity"),
            ((v == "ajcc_stage") | (p == "cancer_stage"), "Condition.stage.summary"),
            (v == "ajcc_tnm", "Observation.valueCodeableConcept under a staging Observation"),
            (v == "histologic_grade", "Observation.valueCodeableConcept"),
            ((dtype == "id") & has_any(low, ("patient", "participant")), "Patient.identifier"),
            ((dtype == "id") & has_any(low, ("sample", "specimen")), "Specimen.identifier"),
            (dtype == "id", "identifier of the fitting resource"),
            (p == "genomic_position", "Observation.component"),
            (has_any(low, ("gene", "chromosome", "variant", "hgvs")), "Observation.component about a Specimen"),
        ],
        F.lit(None).cast("string"),
    )


def table_profile(columns: DataFrame) -> DataFrame:
    """columns (entity, column_name, position, samples, dtype) -> one row a table: use case, provenance, purpose,
    primary entity."""
    g = columns.groupBy("entity").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.lower("column_name").alias("n")))), lambda x: x["n"]), " ").alias("_t"),
        F.bool_or(F.exists(F.slice("samples", 1, 3), lambda s: s.rlike(r"^GSM\d+$"))).alias("_gsm"),
    )
    t = F.col("_t")
    scores = F.array(*(F.struct(sum((t.contains(w).cast("int") for w in words), F.lit(0)).alias("s"), F.lit(-k).alias("k"), F.lit(u).alias("u")) for k, (u, words) in enumerate(USE_CASES)))
    top = F.array_max(scores)
    use = F.when(top["s"] > 0, top["u"]).otherwise("unknown")
    origin = first_of([(F.coalesce("_gsm", F.lit(False)), "geo_repository")] + [(has_any(t, w), p) for p, w in PROVENANCES], "unknown")
    g = g.withColumn("use_case", use).withColumn("provenance", origin)
    purpose = first_of([(F.col("use_case") == u, p) for u, p in PURPOSES], "observations")
    suffix = first_of([(F.col("provenance") == "geo_repository", " from geo repository"), (F.col("provenance") == "sequencing_lab", " from sequencing laboratory")], "")
    entity = first_of(
        [
            (F.col("use_case").contains("variant") | has_any(t, ("gene", "variant", "mutation", "hgvs")), "variant_observation"),
            (F.col("use_case").contains("lab"), "lab_observation"),
            (has_any(t, ("sample_id", "specimen", "biopsy")), "sample"),
        ],
        "patient",
    )
    return g.select("entity", "use_case", "provenance", F.concat(purpose, suffix).alias("purpose"), entity.alias("primary_entity"))


def relationships(columns: DataFrame) -> DataFrame:
    """columns (entity, column_name, position) -> (entity, column_name, relation): survival pairs of a time
    and an event column, then groups of location and of TNM columns where there are several."""
    low = F.lower("column_name")
    c = columns.select("entity", "column_name", "position", low.alias("low"))
    time = c.where(has_any(F.col("low"), ("survival", "os_time", "_time", "_months"))).select("entity", F.col("column_name").alias("t"), F.col("position").alias("tp"), F.regexp_replace("low", "(time|months?|_time|survival)", "").alias("tb"), F.col("low").alias("tl"))
    event = c.where(has_any(F.col("low"), ("event", "death", "vital", "censor", "status"))).select("entity", F.col("column_name").alias("e"), F.col("position").alias("ep"), F.regexp_replace("low", "(event|death|status|vital|censor)", "").alias("eb"))
    pair = time.join(event, "entity").where(((F.col("tb") != "") & F.col("eb").contains(F.col("tb"))) | ((F.col("eb") != "") & F.col("tb").contains(F.col("eb"))) | F.col("tl").contains("survival"))
    a = pair.groupBy("entity", F.col("t").alias("column_name")).agg(F.max_by("e", F.struct("tp", "ep")).alias("o"))
    b = pair.groupBy("entity", F.col("e").alias("column_name")).agg(F.max_by("t", F.struct("tp", "ep")).alias("o"))
    pairs = a.unionByName(b).select("entity", "column_name", F.concat(F.lit("survival_pair:"), "o").alias("relation"), F.lit(1).alias("step"))

    def group(label: str, words: tuple[str, ...], step: int) -> DataFrame:
        mine = c.where(has_any(F.col("low"), words))
        every = mine.groupBy("entity").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "column_name"))), lambda x: x["column_name"]), ",").alias("all"))
        return mine.join(every.where(F.col("n") > 1), "entity").select("entity", "column_name", F.concat(F.lit(label), "all").alias("relation"), F.lit(step).alias("step"))

    found = [pairs, group("genomic_location_group:", ("chromosome", "position", "start", "end", "stop"), 2), group("tnm_group:", ("t_stage", "n_stage", "m_stage"), 3)]
    every = reduce(DataFrame.unionByName, found)
    return every.groupBy("entity", "column_name").agg(F.max_by("relation", "step").alias("relation"))


def summary(columns: DataFrame) -> DataFrame:
    """columns (entity, column_name, position, is_identifier, is_domain, row_count) -> per table and in total
    (entity NULL): fields, identifiers, domain fields, rows, and the first five key fields."""
    key = F.when(F.col("is_identifier") | F.col("is_domain"), F.struct("position", "column_name"))
    g = columns.rollup("entity").agg(
        F.count(F.lit(1)).alias("fields"), F.count_if("is_identifier").alias("identifiers"), F.count_if("is_domain").alias("domain_fields"),
        F.slice(F.array_sort(F.collect_list(key)), 1, 5).alias("k"),
    )
    return g.select("entity", "fields", "identifiers", "domain_fields", F.when(F.col("entity").isNotNull(), F.array_join(F.transform("k", lambda x: x["column_name"]), ",")).alias("key_fields"))


def schema_summary(tables: dict[str, DataFrame], columns: int = 10) -> DataFrame:
    """(entity, row_count, field_count, first_columns) per table, and the totals in a row with entity NULL."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("entity"), "row_count", F.lit(len(df.columns)).alias("field_count"), F.lit(", ".join(df.columns[:columns])).alias("first_columns"))
        out = row if out is None else out.unionByName(row)
    return out.rollup("entity").agg(F.sum("row_count").alias("row_count"), F.sum("field_count").alias("field_count"), F.max(F.when(F.col("entity").isNotNull(), F.col("first_columns"))).alias("f")).select(
        "entity", "row_count", "field_count", F.when(F.col("entity").isNotNull(), F.col("f")).alias("first_columns")
    )
