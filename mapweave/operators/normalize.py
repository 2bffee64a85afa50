"""Conflicts between schemas, their resolution, and the checks of destination paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.functions.text import first_of, has_any

# Resource names a valid path may start with.
RESOURCES = (
    "Patient", "Specimen", "Condition", "Observation", "DocumentReference",
    "ResearchStudy", "ResearchSubject", "MedicationAdministration", "ServiceRequest",
    "Device", "Identifier", "Extension", "Group", "ImagingStudy", "Organization",
    "Attachment", "Medication", "DiagnosticReport", "ResearchStudyRecruitment",
    "ResearchStudyProgressStatus", "Encounter", "Procedure", "Task", "Practitioner",
    "CodeableConcept", "Coding", "Reference", "Period", "Quantity", "Range",
)
# Contexts by what an observation in them is about, compared in this order.
FOCUS_CONTEXTS = (
    ("Patient", ("patient", "demographic", "demographics", "case", "cases", "subject", "participant", "followup", "follow_up", "exposure", "familyhistory", "family_history")),
    ("Specimen", ("specimen", "sample", "samples", "biospecimen", "biospecimens", "portion", "portions", "aliquot", "aliquots", "analyte", "analytes", "slide", "slides")),
    ("DocumentReference", ("file", "files", "document", "attachment")),
    ("Condition", ("diagnosis", "diagnoses", "condition")),
    ("MedicationAdministration", ("treatment", "treatments", "therapy")),
)
# Words of a term that tell the focus, groups in this order.
FOCUS_TERMS = (
    ("Specimen", ("specimen", "sample", "tissue", "tumor", "biopsy")),
    ("DocumentReference", ("file", "document", "data_", "format")),
    ("Patient", ("patient", "age", "gender", "race", "ethnicity")),
)
# Schema priorities of the default resolution, the highest first.
PRIORITY = ("gdc", "htan", "bts", "cohortx", "openpath", "regis", "geo", "labnative")


def is_valid_path(dest: Column) -> Column:
    """Starts with a known resource, or is an extension. False for NULL and ""."""
    head = F.split_part(F.split_part(dest, F.lit("."), F.lit(1)), F.lit(":"), F.lit(1))
    ok = head.isin(*RESOURCES) | dest.startswith("Extension") | F.lower(dest).contains(":extension")
    return F.coalesce(ok, F.lit(False)) & (F.coalesce(dest, F.lit("")) != "")


def focus_ref(context: Column, term: Column) -> Column:
    c, t = F.lower(F.coalesce(context, F.lit(""))), F.lower(F.coalesce(term, F.lit("")))
    exact = [(c.isin(*words), focus) for focus, words in FOCUS_CONTEXTS]
    inside = [(has_any(c, words), focus) for focus, words in FOCUS_CONTEXTS]
    return first_of(exact + inside + [(has_any(t, words), focus) for focus, words in FOCUS_TERMS], "Specimen")


def passthrough_reason(dest: Column, term: Column) -> Column:
    """Why a destination is no path: itself the term, short, a number, a concept code, without letters."""
    digits = F.translate(dest, "-_", "")
    return first_of(
        [
            (is_valid_path(dest), F.lit(None).cast("string")),
            (F.lower(dest) == F.lower(term), "term"),
            (F.length(dest) < 3, "short"),
            (digits.rlike("^[0-9]+$"), "number"),
            (dest.startswith("NCIT_"), "concept"),
            (~dest.rlike(r"\p{L}"), "no letters"),
        ],
        "unknown",
    )


def fix_passthrough(mappings: DataFrame) -> DataFrame:
    """Destinations that are no paths become Observation.component about the focus of their context."""
    bad = ~is_valid_path(F.col("destination"))
    out = mappings.withColumn("reason", passthrough_reason(F.col("destination"), F.col("source")))
    out = out.withColumn("focus_ref", F.when(bad, focus_ref(F.col("source_context"), F.col("source"))).otherwise(F.col("focus_ref")))
    return out.withColumn("old_destination", F.col("destination")).withColumn("destination", F.when(bad, "Observation.component").otherwise(F.col("destination")))


def validate_path(paths: DataFrame, fields: DataFrame) -> DataFrame:
    """paths (path) against the catalog fields (class, slot): (path, valid, resource, field, issue)."""
    p = paths.select("path").distinct().withColumn("_r", F.split_part("path", F.lit("."), F.lit(1))).withColumn("_f", F.split_part("path", F.lit("."), F.lit(2)))
    classes = fields.select("class").distinct()
    exact = classes.select(F.col("class").alias("_r"), F.col("class").alias("_exact"))
    loose = classes.groupBy(F.lower("class").alias("_low")).agg(F.min("class").alias("_loose"))
    f_exact = fields.select(F.col("class").alias("_r"), F.col("slot").alias("_f"), F.lit(True).alias("_known")).distinct()
    f_loose = fields.groupBy(F.col("class").alias("_r"), F.lower("slot").alias("_flow")).agg(F.min("slot").alias("_floose"))
    j = p.join(exact, "_r", "left").withColumn("_low", F.lower("_r")).join(loose, "_low", "left")
    j = j.join(f_exact, ["_r", "_f"], "left").withColumn("_flow", F.lower("_f")).join(f_loose, ["_r", "_flow"], "left")
    dotted = F.col("path").contains(".")
    issue = first_of(
        [
            (~dotted, "no field"),
            (F.col("_exact").isNull() & F.col("_loose").isNotNull(), F.concat(F.lit("class spelled "), F.col("_loose"))),
            (F.col("_exact").isNull(), F.concat(F.lit("no class "), F.col("_r"))),
            (F.coalesce(F.col("_known"), F.lit(False)), ""),
            (F.col("_f").rlike("^(nci_|gdc_|htan_)"), F.concat(F.lit("local slot "), F.col("_f"))),
            (F.col("_floose").isNotNull(), F.concat(F.lit("slot spelled "), F.col("_floose"))),
        ],
        F.concat(F.lit("no slot "), F.col("_f")),
    )
    valid = dotted & F.col("_exact").isNotNull() & F.coalesce("_known", F.lit(False))
    resource = F.when(dotted, F.coalesce("_exact", "_loose", F.lit(""))).otherwise("")
    return j.select("path", valid.alias("valid"), resource.alias("resource"), F.when(valid, F.col("_f")).otherwise("").alias("field"), issue.alias("issue"))


def destination_conflicts(mappings: DataFrame, tier: str | None = None) -> DataFrame:
    """Destinations (letter case aside) that several terms lead to, with each term's schemas, contexts and
    count: (destination, term, schemas, contexts, n, terms, total). Groups are cut down per term before they
    are put side by side, so a destination of very many terms is no hot spot."""
    m = mappings.where(F.col("tier") == tier) if tier else mappings
    per = m.groupBy(F.lower("destination").alias("destination"), F.lower("source").alias("term")).agg(
        F.array_join(F.array_sort(F.collect_set("source_schema")), ",").alias("schemas"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("source_context") != "", F.col("source_context")))), ",").alias("contexts"),
        F.count(F.lit(1)).alias("n"),
    )
    many = per.groupBy("destination").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("total")).where(F.col("terms") > 1)
    return per.join(many, "destination")


def multi_destinations(mappings: DataFrame, tier: str | None = None) -> DataFrame:
    """Sources with several destinations, in order."""
    m = mappings.where(F.col("tier") == tier) if tier else mappings
    g = m.groupBy("id", "source", "source_schema").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.struct("dest_ord", "destination"))).alias("d"))
    return g.where(F.col("n") > 1).select("id", "source", "source_schema", "n", F.array_join(F.transform("d", lambda x: x["destination"]), " | ").alias("destinations"))


def _per_destination(mappings: DataFrame, tier: str | None) -> DataFrame:
    m = mappings.where(F.col("tier") == tier) if tier else mappings
    return m.withColumn("term", F.lower("source"))


def schema_conflicts(mappings: DataFrame, tier: str | None = None) -> DataFrame:
    """Terms (letter case aside) that several schemas map to different destinations: (term, schemas,
    destinations, n, tier), tier that of the last source."""
    g = _per_destination(mappings, tier).groupBy("term").agg(
        F.countDistinct("source_schema").alias("schemas"), F.countDistinct(F.lower("destination")).alias("destinations"), F.count(F.lit(1)).alias("n"), F.max_by("tier", F.struct("ord", "dest_ord")).alias("tier")
    )
    return g.where((F.col("schemas") > 1) & (F.col("destinations") > 1))


def resolve(mappings: DataFrame, method: str = "priority", priority: tuple[str, ...] = PRIORITY, tier: str | None = None) -> DataFrame:
    """(term, destination, method) for each conflict. frequency: the destination most schemas use;
    priority: the destination of the schema named first, schemas not named last; ties by the destination."""
    m = _per_destination(mappings, tier).join(schema_conflicts(mappings, tier).select("term"), "term")
    per = m.groupBy("term", "destination").agg(F.countDistinct("source_schema").alias("schemas"), F.max(first_of([(F.col("source_schema") == s, len(priority) - k) for k, s in enumerate(priority)], 0)).alias("prio"))
    weight = "schemas" if method == "frequency" else "prio"
    best = per.groupBy("term").agg(F.min_by("destination", F.struct(-F.col(weight), F.col("destination"))).alias("destination"))
    return best.withColumn("method", F.lit(method))


def equivalent(mappings: DataFrame, groups: list[tuple[str, ...]], tier: str | None = None) -> DataFrame:
    """Conflicts all of whose destinations lie in one group of equivalent paths: (term, destination), the
    group's first."""
    out = None
    m = _per_destination(mappings, tier).join(schema_conflicts(mappings, tier).select("term"), "term")
    for g in groups:
        inside = m.groupBy("term").agg(F.bool_and(F.col("destination").isin(*g)).alias("ok")).where("ok").select("term", F.lit(g[0]).alias("destination"), F.lit("equivalence").alias("method"))
        out = inside if out is None else out.unionByName(inside)
    return out


def auto_resolve(mappings: DataFrame, groups: list[tuple[str, ...]], method: str = "priority", tier: str | None = None) -> DataFrame:
    """Equivalence first, then the method."""
    first = equivalent(mappings, groups, tier).dropDuplicates(["term"])
    rest = resolve(mappings, method, tier=tier).join(first.select("term"), "term", "left_anti")
    return first.unionByName(rest)


def report(mappings: DataFrame, resolved: DataFrame, tier: str | None = None) -> DataFrame:
    """(terms, conflicts, resolved, conflict_rate, resolution_rate): the rate is 1 without conflicts."""
    terms = _per_destination(mappings, tier).agg(F.countDistinct("term").alias("terms"))
    found = schema_conflicts(mappings, tier).agg(F.count(F.lit(1)).alias("conflicts"))
    done = resolved.agg(F.count(F.lit(1)).alias("resolved"))
    r = terms.crossJoin(found).crossJoin(done)  # one row each
    return r.withColumn("conflict_rate", F.coalesce(F.round(F.try_divide("conflicts", "terms"), 6), F.lit(0.0))).withColumn("resolution_rate", F.coalesce(F.round(F.try_divide("resolved", "conflicts"), 6), F.lit(1.0)))


def canonical_rows(resolved: DataFrame) -> DataFrame:
    """Sources and destinations to append for resolved conflicts."""
    return resolved.select(F.concat(F.lit("canonical:"), "term").alias("id"), F.col("term").alias("source"), F.lit("canonical").alias("source_schema"), "destination")


def hitl_export(mappings: DataFrame, resolved: DataFrame, tier: str | None = None) -> DataFrame:
    """Conflicts for review: (term, options, status), options a JSON list with the suggested one marked."""
    m = _per_destination(mappings, tier).join(schema_conflicts(mappings, tier).select("term"), "term")
    per = m.groupBy("term", "destination").agg(F.array_sort(F.collect_set("source_schema")).alias("schemas"))
    s = per.join(resolved.select("term", F.col("destination").alias("_s")), "term", "left")
    options = F.to_json(F.array_sort(F.collect_list(F.struct("destination", "schemas", (F.col("destination") == F.col("_s")).alias("suggested")))))
    return s.groupBy("term").agg(options.alias("options"), F.lit("pending").alias("status"))


def ground_truth_metrics(mappings: DataFrame, truth: DataFrame) -> DataFrame:
    """truth (term, schema, destination) looked up with its schema, else without: counts of exact, resource,
    mismatch and no_match."""
    m = mappings.select(F.col("source").alias("term"), F.col("source_schema").alias("schema"), "destination")
    own = m.groupBy("term", "schema").agg(F.collect_set(F.lower("destination")).alias("own"))
    loose = m.groupBy("term").agg(F.collect_set(F.lower("destination")).alias("any"))
    j = truth.join(own, ["term", "schema"], "left").join(loose, "term", "left").withColumn("d", F.coalesce("own", "any"))
    low = F.lower("destination")
    res = F.split_part(low, F.lit("."), F.lit(1))
    verdict = first_of(
        [(F.col("d").isNull(), "no_match"), (F.array_contains("d", low), "exact"), (F.exists("d", lambda x: F.split_part(x, F.lit("."), F.lit(1)) == res), "resource")], "mismatch"
    )
    return j.groupBy(verdict.alias("verdict")).agg(F.count(F.lit(1)).alias("n"))


def ground_truth(entries: DataFrame, usage: DataFrame, min_count: int = 3) -> DataFrame:
    """(term, schema, destination, origin): curated entries (source_term, source_schema, destination), and mined
    pairs (term, schema, path, n) seen often enough, each once."""
    a = entries.where("source_term IS NOT NULL AND destination IS NOT NULL").select(F.col("source_term").alias("term"), F.col("source_schema").alias("schema"), "destination", F.lit("curated").alias("origin"))
    b = usage.where(F.col("n") >= min_count).select("term", "schema", F.col("path").alias("destination"), F.lit("mined").alias("origin"))
    return a.unionByName(b).groupBy("term", "schema", "destination").agg(F.min("origin").alias("origin"))
