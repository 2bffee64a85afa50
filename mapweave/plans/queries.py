"""Queries over the project's tables, one or more for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mapweave.functions import text as tx
from mapweave.operators import calibrate, cascade, feedback, fhir, match, normalize, orphans, profile, rules, vectors
from mapweave.operators.kb import KnowledgeBase, row_rank
from mapweave.plans import tools
from mapweave.streaming import feedback as streaming
from mapweave.util import cut, read_table, scratch_path

WEIGHTS = {"biobert": 0.4, "magneto": 0.6}
EQUIVALENT = [("Condition.code", "Condition.bodySite"), ("Patient.gender", "Patient.extension.race")]
#: Paths of what was found or done, for a review that takes them as one.
CLINICAL = (
    "Condition.bodySite", "Condition.clinicalStatus", "Condition.code", "Condition.onsetAge", "Condition.onsetDateTime", "Condition.recordedDate", "Condition.severity",
    "Condition.stage.summary", "Observation.bodySite", "Observation.code", "Observation.component.valueInteger", "Observation.effectiveDateTime", "Observation.interpretation",
    "Observation.method", "Observation.valueCodeableConcept", "Observation.valueQuantity", "Procedure.bodySite", "Procedure.code", "Procedure.occurrenceDateTime", "Procedure.outcome",
)
# Resources an entity's columns may go to.
ENTITY_RESOURCES = {"patient": ["Patient", "Condition", "Observation"], "sample": ["Specimen", "Observation"], "file": ["DocumentReference", "Observation"]}
#: Columns of tables as they are delivered, in their order.
COHORT = {
    "cohort": ("patient_id", "OS_Time", "os_event", "survival_months", "vital_status", "t_stage", "n_stage", "M_Stage"),
    "variants": ("gene", "Chromosome", "start", "end", "vaf"),
    "plain": ("chromosome", "note"),
}
FIXES = [("Observation.valueQuantity", "Observation.component.valueQuantity", "update"), ("Procedure.code", "", "update"), ("Specimen.parent", "", "delete")]


def _names(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "feedback").where(F.col("source").isNotNull())


def _kb(spark: SparkSession, d: str) -> KnowledgeBase:
    return KnowledgeBase.from_tables(spark, d)


# foreign keys
def _references(spark: SparkSession, d: str):
    tables = {
        "sources": orphans.Table(read_table(spark, d, "sources"), "ord", "id", "deleted_at", "loaded_at"),
        "content_values": orphans.Table(read_table(spark, d, "content_values"), "ord", "id", "deleted_at", "loaded_at"),
        "destinations": orphans.Table(read_table(spark, d, "destinations"), "ord", "id", None, "loaded_at"),
        "content_fhir_targets": orphans.Table(read_table(spark, d, "content_fhir_targets"), "ord", "id", None, "loaded_at"),
    }
    refs = [orphans.Reference("destinations", "source_id", "sources"), orphans.Reference("content_fhir_targets", "content_value_id", "content_values")]
    return tables, refs


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = orphans.orphan_references(*_references(spark, d))
    return found.where(F.col("kind") == "direct").select("table_name", F.col("row_id").cast("long").alias("ord"))


def p5_periods(spark: SparkSession, d: str) -> DataFrame:
    tables, refs = _references(spark, d)
    return orphans.orphan_report(tables, refs, orphans.orphan_references(tables, refs))


# knowledge base
def kb_lookup(spark, d):
    return _kb(spark, d).lookup(_names(spark, d).select(F.col("source").alias("term")))


def kb_lookup_context(spark, d):
    terms = _names(spark, d).select(F.col("source").alias("term"), F.coalesce("source_context", F.lit("")).alias("context"), F.when(F.col("tier") == "content", "geo").otherwise("").alias("schema"))
    return _kb(spark, d).lookup_context(terms)


def kb_reverse_lookup(spark, d):
    return _kb(spark, d).lookup_reverse(_names(spark, d).select(F.lower("proposed_target").alias("path")).where("path IS NOT NULL"))


def kb_filter_tier(spark, d):
    return _kb(spark, d).filter_tier("entity").select("id", "source", "destination")


def kb_filter_schema(spark, d):
    return _kb(spark, d).filter_schema("geo").select("id", "source", "destination")


def kb_tier_candidates(spark, d):
    return _kb(spark, d).tier_candidates("content")


def kb_stats(spark, d):
    return _kb(spark, d).stats()


def kb_training_pairs(spark, d):
    return _kb(spark, d).training_pairs()


def kb_expertise(spark, d):
    return _kb(spark, d).expertise().select("term", F.array_join("paths", " | ").alias("paths"))


def content_lookup(spark, d):
    values = read_table(spark, d, "cases").select(F.col("primary_diagnosis").alias("value"), F.lit("primary_diagnosis").alias("category")).where("value IS NOT NULL")
    return _kb(spark, d).lookup_content(values, category=True).select("value", "id", "code", F.array_join("paths", " | ").alias("paths"))


def content_by_path(spark, d):
    return _kb(spark, d).content_by_path(read_table(spark, d, "mapping_entries").select(F.col("destination").alias("path")).where("path IS NOT NULL"))


def kb_merge(spark, d):
    return _kb(spark, d).merge(read_table(spark, d, "mapping_entries").where("source_term IS NOT NULL AND destination IS NOT NULL")).select("id", "destination", "tier", "n")


def kb_merge_counted(spark, d):
    entries = read_table(spark, d, "mapping_entries").where("source_term IS NOT NULL AND destination IS NOT NULL")
    return _kb(spark, d).merge(entries, case_sensitive=True, min_count=2).select("id", "destination", "n")


def kb_without_destination(spark, d):
    return _kb(spark, d).without_destination().select("id", "source")


def kb_multi_destination(spark, d):
    return _kb(spark, d).multi_destination_audit()


def kb_counts(spark, d):
    return _kb(spark, d).counts()


def kb_top_destinations(spark, d):
    return _kb(spark, d).top_destinations()


def kb_repair_counts(spark, d):
    return _kb(spark, d).repair_counts()


def kb_path_fixes(spark, d):
    rules = spark.createDataFrame(FIXES, "old_destination string, new_destination string, action string")
    fixed, kept = _kb(spark, d).apply_path_fixes(rules)
    return fixed.join(kept.select(F.col("id").alias("source_id")), "source_id").groupBy("destination").agg(F.count(F.lit(1)).alias("n"))


def kb_delete_like(spark, d):
    return _kb(spark, d).delete_like("%SPECIMEN%").groupBy("destination").agg(F.count(F.lit(1)).alias("n"))


# conflicts and paths
def conflicts_destination(spark, d):
    return normalize.destination_conflicts(_kb(spark, d).mappings())


def conflicts_schema(spark, d):
    return normalize.schema_conflicts(_kb(spark, d).mappings())


def multi_destinations(spark, d):
    return normalize.multi_destinations(_kb(spark, d).mappings())


def resolve_priority(spark, d):
    return normalize.resolve(_kb(spark, d).mappings(), "priority")


def resolve_frequency(spark, d):
    return normalize.resolve(_kb(spark, d).mappings(), "frequency")


def resolve_equivalent(spark, d):
    return normalize.equivalent(_kb(spark, d).mappings(), EQUIVALENT)


def resolve_clinical(spark, d):
    return normalize.equivalent(_kb(spark, d).mappings(), [CLINICAL])


def canonical_rows(spark, d):
    m = _kb(spark, d).mappings()
    return normalize.canonical_rows(normalize.auto_resolve(m, EQUIVALENT))


def normalization_report(spark, d):
    m = _kb(spark, d).mappings()
    return normalize.report(m, normalize.auto_resolve(m, EQUIVALENT))


def hitl_export(spark, d):
    m = _kb(spark, d).mappings()
    return normalize.hitl_export(m, normalize.resolve(m, "priority"))


def ground_truth_metrics(spark, d):
    truth = read_table(spark, d, "mapping_entries").where("source_term IS NOT NULL AND destination IS NOT NULL")
    truth = truth.select(F.regexp_replace("source_term", "_r1$", "").alias("term"), F.col("source_schema").alias("schema"), "destination")
    return normalize.ground_truth_metrics(_kb(spark, d).mappings(), truth)


def valid_paths(spark, d):
    p = read_table(spark, d, "destinations").select("destination").distinct()
    return p.select("destination", normalize.is_valid_path(F.col("destination")).alias("valid"))


def passthrough_fix(spark, d):
    fixed = normalize.fix_passthrough(_kb(spark, d).mappings())
    return fixed.groupBy(F.col("reason").isNotNull().alias("changed"), "focus_ref").agg(F.count(F.lit(1)).alias("n"))


def focus_refs(spark, d):
    s = read_table(spark, d, "sources").select("source_context", "source").distinct()
    return s.select("source_context", "source", normalize.focus_ref(F.col("source_context"), F.col("source")).alias("focus"))


def path_validation(spark, d):
    have = read_table(spark, d, "destinations").where(F.col("destination").contains(".")).select(F.split_part("destination", F.lit("."), F.lit(1)).alias("class"), F.split_part("destination", F.lit("."), F.lit(2)).alias("slot"))
    fields = have.where(~F.col("class").isin("Procedure")).where(F.col("slot") != "identifier").distinct()
    return normalize.validate_path(read_table(spark, d, "mapping_entries").select(F.col("destination").alias("path")).where("path IS NOT NULL"), fields)


# matching
def _targets(spark, d):
    return _names(spark, d).where("proposed_target IS NOT NULL").groupBy(F.col("proposed_target").alias("target")).agg(F.min("ord").alias("ord"))


def rule_match_topk(spark, d):
    return match.rule_match(_kb(spark, d), _names(spark, d).select(F.col("source").alias("term")), _targets(spark, d))


def rule_match_metadata(spark, d):
    return match.rule_match_metadata(_kb(spark, d), _names(spark, d).select(F.col("source").alias("term")), _targets(spark, d))


def fuzzy_pairs(spark, d):
    """All names against all, from the acceptance of a fuzzy match on."""
    found = match.fuzzy_lookup(_names(spark, d).select(F.col("source").alias("query")), read_table(spark, d, "sources").where("source IS NOT NULL").select("source"))
    return found.select("query", "source", F.round("score", 6).alias("score"))


def fuzzy_lookup(spark, d):
    """The ten best known names and their destinations for each name of a row whose id is divisible by 100, by all
    rules from 0.3 on."""
    kb = _kb(spark, d)
    asked = _names(spark, d).where("id % 100 = 0").select(F.col("source").alias("query"))
    hits = match.fuzzy_search(asked, kb.mappings().select("source"), 10)
    found = row_rank(match.fuzzy_destinations(hits, kb), ["query"], [F.desc("score"), F.col("source"), F.col("target")])
    return found.where("rank <= 10").select("query", "source", "target", F.round("score", 6).alias("score"), "rank")


def expert_match(spark, d):
    return match.expert_match(_kb(spark, d), _names(spark, d).select(F.col("source").alias("term")), _targets(spark, d))


def _candidates(spark, d):
    m = read_table(spark, d, "match_candidates").where("source_field IS NOT NULL")
    return m.withColumn("target", F.concat_ws(".", "target_entity", "target_field"))


def ensemble_scores(spark, d):
    return _candidates(spark, d).select("ord", F.round(match.ensemble(F.col("embedder_scores"), WEIGHTS), 6).alias("score"))


def confidence_levels(spark, d):
    m = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score)")
    return m.groupBy("tier", match.confidence_level(F.col("score")).alias("level"), match.route(F.col("score")).alias("route")).agg(F.count(F.lit(1)).alias("n"))


def dedupe_matches(spark, d):
    m = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score)").select("source_entity", "source_field", "target_entity", "target_field", "tier", "score", "ord")
    return match.dedupe_matches(m, ["source_entity", "source_field", "target_entity", "target_field"])


def tier_run(spark, d):
    m = _candidates(spark, d).select("source_entity", "source_field", "target_entity", "target_field", "tier", "embedder_scores", "ord")
    acted, _ = cascade.run_tiers(m, WEIGHTS)
    return acted.select("source_entity", "source_field", "target_entity", "target_field", "tier", F.round("score", 6).alias("score"), "level", "requires_review", "rank")


def nearest_vectors(spark, d):
    e = read_table(spark, d, "embeddings")
    return match.nearest(e, e.where(F.col("vec_id") % 100 == 0)).select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


def match_tables(spark, d):
    return match.match_tables(read_table(spark, d, "sources"), read_table(spark, d, "mapping_entries")).select("source", "target", F.round("score", 6).alias("score"))


def match_tables_all(spark, d):
    """Every pair of columns, before one is chosen for each."""
    found = match.match_tables(read_table(spark, d, "cases"), read_table(spark, d, "content_values"), one_to_one=False)
    return found.select("source", "target", F.round("score", 6).alias("score"))


def rank_metrics(spark, d):
    m = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score)")
    best = m.groupBy("tier", "source_field", "target").agg(F.max("score").alias("score"), F.min("ord").alias("ord"), F.bool_or(F.coalesce("user_feedback", F.lit(False))).alias("hit"))
    ranked = row_rank(best, ["tier", "source_field"], [F.desc("score"), F.col("ord")])
    q = ranked.groupBy("tier", "source_field").agg(F.min(F.when(F.col("hit"), F.col("rank"))).alias("rank"))
    r = calibrate.rank_metrics(q, ["tier"])
    return r.select("tier", "n", *(F.round(c, 6).alias(c) for c in ("p_at_1", "r_at_k", "mrr", "f1")))


def top1_outcomes(spark, d):
    p = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score)").select(F.col("source_field").alias("id"), "target", "score", "ord")
    f = feedback.clean(read_table(spark, d, "feedback")).where("decision = 'accept' AND proposed_target IS NOT NULL")
    return calibrate.top1_outcomes(p, f.select(F.col("source").alias("id"), F.col("proposed_target").alias("target"))).select("id", "target", "score", "correct")


# calibration
def _keyed(spark, d):
    return calibrate.explode_keys(feedback.to_calibration(feedback.clean(read_table(spark, d, "feedback"))))


def calib_keys(spark, d):
    return calibrate.key_stats(_keyed(spark, d))


def _curve(df):
    return df.select("key", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), F.round("mean_conf", 9).alias("mean_conf"), F.round("accuracy", 9).alias("accuracy"), "n")


def calib_curve(spark, d):
    return _curve(calibrate.curves(_keyed(spark, d)))


def calib_curve_compat(spark, d):
    return _curve(calibrate.curves(_keyed(spark, d), compat=True))


def calib_ece(spark, d):
    return calibrate.ece(_keyed(spark, d)).select("key", "n", *(F.round(c, 9).alias(c) for c in ("accuracy", "mean_conf", "ece")), "verdict")


def calib_scores(spark, d):
    f = feedback.clean(read_table(spark, d, "feedback")).where("confidence IS NOT NULL AND NOT isnan(confidence) AND matcher IS NOT NULL")
    scores = f.select("id", "matcher", "tier", F.lit("").alias("schema"), F.coalesce("source_context", F.lit("")).alias("context"), "confidence")
    return calibrate.calibrate_scores(scores, _keyed(spark, d)).select("id", "confidence", "key_used", F.round("calibrated", 6).alias("calibrated"))


def calib_top_keys(spark, d):
    return calibrate.report(_keyed(spark, d), 15)


def tier_metrics(spark, d):
    m = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score)")
    return cascade.learn_metrics(m.select("tier", match.confidence_level(F.col("score")).alias("level"), F.coalesce("requires_hitl", F.lit(False)).alias("requires_review"), "user_feedback"))


def _calibrated(spark, d, compat=False):
    """Rule, and two embedders by hashed letters, against the base's own mappings on each tier."""
    m = _kb(spark, d).mappings().where("source <> '' AND tier IN ('entity', 'field', 'content')").select("tier", F.col("source").alias("id"), F.col("destination").alias("target"), "dest_ord")
    m = cut(m.groupBy("tier", "id", "target").agg(F.min("dest_ord").alias("ord")), "truth")
    goals = m.groupBy("tier", "target").agg(F.min("ord").alias("ord"))
    known = m.groupBy("tier", "id").agg(F.min_by("target", "ord").alias("target"), F.min("ord").alias("ord")).withColumn("score", F.lit(1.0)).withColumn("matcher", F.lit("rule"))
    out = known.select("matcher", "tier", "id", "target", "score", "ord")
    for matcher, n in (("pairs", 2), ("triples", 3)):
        out = out.unionByName(match.nearest_names(m.select("tier", "id").distinct(), goals, n).withColumn("matcher", F.lit(matcher)))
    return calibrate.build(out, m, compat)


def flat_calibration(spark, d):
    _, _, summary = _calibrated(spark, d)
    return summary.select("matcher", "tier", "n", *(F.round(c, 6).alias(c) for c in ("accuracy", "mean_conf", "ece")))


def calib_compare(spark, d):
    """The calibration with bins as they are read, beside that with bins as they are published."""
    a, b = (_calibrated(spark, d, compat)[2] for compat in (False, True))
    return calibrate.compare_runs(a, b).select("matcher", "tier", *((F.round(c, 6) + 0.0).alias(c) for c in ("accuracy_no", "ece_no", "accuracy_yes", "ece_yes", "accuracy_delta", "ece_delta")))


def common_destinations(spark, d):
    return cascade.common_destinations(_kb(spark, d))


# profiling
def _cells(spark, d, table="cases"):
    return profile.unpivot(read_table(spark, d, table), "ord")


def profile_columns(spark, d):
    return profile.column_stats(_cells(spark, d))


def profile_samples(spark, d):
    return profile.first_samples(_cells(spark, d)).select("column_name", F.array_join("samples", " | ").alias("samples"))


def _columns(spark, d):
    out = None
    for t in ("cases", "content_values", "sources", "destinations"):
        cells = _cells(spark, d, t)
        c = profile.column_stats(cells).join(profile.first_samples(cells, 10), "column_name", "left").withColumn("entity", F.lit(t))
        out = c if out is None else out.unionByName(c)
    c = out.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))
    return c.withColumn("is_identifier", profile.is_identifier(F.col("column_name"), F.col("samples"))).withColumn("is_domain", profile.is_domain_field(F.col("column_name")))


def content_types(spark, d):
    c = profile.content_types(_columns(spark, d))
    k = [F.col(x) for x in ("column_name", "dtype", "pattern", "vocabulary")]
    return c.select("entity", "column_name", "dtype", "pattern", "vocabulary", profile.column_group(*k).alias("column_group"), profile.recommendation(*k).alias("advice"), tx.archetype(k[0], k[1]).alias("archetype"), tx.column_unit(k[0]).alias("unit"))


def content_types_compat(spark, d):
    return profile.content_types(_columns(spark, d), compat=True).select("entity", "column_name", "dtype", "pattern", "vocabulary")


def target_candidates(spark, d):
    return profile.target_candidates(_columns(spark, d))


def table_profiles(spark, d):
    return profile.table_profile(profile.content_types(_columns(spark, d)))


def column_relations(spark, d):
    """Over the columns of the profiled tables, and of a clinical and a variant table as they come."""
    own = _columns(spark, d).select("entity", "column_name", "position")
    return profile.relationships(own.unionByName(spark.createDataFrame([(e, c, k) for e, columns in COHORT.items() for k, c in enumerate(columns)], "entity string, column_name string, position int")))


def profile_summary(spark, d):
    return profile.summary(_columns(spark, d))


def schema_summary(spark, d):
    return profile.schema_summary({t: read_table(spark, d, t) for t in ("cases", "sources", "destinations")})


# nested records and texts
def _records(spark, d):
    v = read_table(spark, d, "content_values")
    coding = F.array(F.struct(F.coalesce("code_system", F.lit("")).alias("system"), F.coalesce("code", F.lit("")).alias("code"), F.coalesce("source_value", F.lit("")).alias("display")))
    body = F.to_json(F.struct(
        F.lit("Observation").alias("resourceType"), F.array(F.struct(coding.alias("coding"))).alias("category"),
        F.array(F.struct(F.lit("https://gdc.cancer.gov/value_id").alias("system"), F.col("id").cast("string").alias("value"))).alias("identifier"),
        F.struct(F.concat(F.lit("Patient/"), "id").alias("reference")).alias("subject"),
    ))
    return fhir.parse_records(v.select("ord", F.lit("Observation").alias("resource"), F.lit("GDC").alias("source"), body.alias("json")))


def _nodes(spark, d):
    return fhir.walk(_records(spark, d), ("ord", "resource", "source"))


def json_field_usage(spark, d):
    events = read_table(spark, d, "events").select(F.col("event_id").alias("ord"), F.lit("Event").alias("resource"), F.col("props").alias("json"))
    nodes = fhir.walk(fhir.parse_records(events), ("ord", "resource"))
    return fhir.field_usage(nodes).select("path", "n", "resource", F.array_join("samples", "|").alias("samples"))


def ground_truth_rows(spark, d):
    usage = fhir.pair_usage(fhir.mapping_pairs(_nodes(spark, d), F.col("source")))
    return normalize.ground_truth(read_table(spark, d, "mapping_entries"), usage)


def json_coding_usage(spark, d):
    return fhir.coding_usage(fhir.codings(_nodes(spark, d)))


def json_coding_systems(spark, d):
    return fhir.coding_systems(fhir.coding_usage(fhir.codings(_nodes(spark, d))))


def json_reference_usage(spark, d):
    return fhir.reference_usage(fhir.references(_nodes(spark, d)))


def json_pair_usage(spark, d):
    return fhir.pair_usage(fhir.mapping_pairs(_nodes(spark, d), F.col("source"))).select("schema", "term", "path", "n", "pair_type", "tier")


def url_terms(spark, d):
    u = read_table(spark, d, "destinations").select(F.col("dest_system").alias("url")).where("url IS NOT NULL").distinct()
    return u.select("url", tx.url_schema(F.col("url")).alias("schema"), tx.url_term(F.col("url")).alias("term"))


def name_parts(spark, d):
    s = read_table(spark, d, "sources").where("source IS NOT NULL").select("source").distinct()
    return s.select("source", tx.stem(F.col("source")).alias("stem"), F.array_join(F.array_sort(tx.tokens(F.col("source"))), ",").alias("tokens"), tx.safe_id(F.col("source")).alias("safe_id"))


def name_variants(spark, d):
    s = read_table(spark, d, "sources").where("source IS NOT NULL").select("source").distinct()
    return s.select("source", F.explode(tx.query_variants(F.col("source"))).alias("variant"))


def characteristics(spark, d):
    s = read_table(spark, d, "sources").where(F.col("source").contains(": ")).select("ord", F.explode(tx.characteristics(F.col("source"))).alias("key", "value"))
    return s


def minted_ids(spark, d):
    s = read_table(spark, d, "sources").where("id IS NOT NULL").select("id").distinct()
    return s.select("id", tx.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("id")).alias("uuid"))


def category_paths(spark, d):
    c = read_table(spark, d, "content_values").select("source_category").where("source_category IS NOT NULL").distinct()
    return c.select("source_category", fhir.infer_path(F.col("source_category")).alias("path"))


# heads of tables, targets, records
def csv_header_scan(spark, d):
    found = profile.header_scan(read_table(spark, d, "cases"), "ord", rows=200, limit=6)
    return found.select("column_name", "position", F.array_join("samples", " | ").alias("samples"))


def entity_targets(spark, d):
    return match.within_resources(_targets(spark, d), ENTITY_RESOURCES["sample"])


def compound_lookup(spark, d):
    kb = _kb(spark, d)
    entities = kb.values.select(F.col("id").alias("key"), "code")
    details = kb.targets.select(F.col("content_value_id").alias("key"), "fhir_path", "fhir_resource")
    records = kb.values.select(F.col("id").alias("key"), F.col("source_value").alias("name"))
    return kb.lookup_records(read_table(spark, d, "cases").select(F.col("primary_diagnosis").alias("name")), entities, details, records)


def tool_lookup(spark, d):
    tools.register(_kb(spark, d), "mapweave")
    return tools.ask(spark, "mapweave_lookup_content", read_table(spark, d, "cases").select(F.col("race").alias("value")).where("value IS NOT NULL"), "value")


def vector_search(spark, d):
    """An index of the base with the reviewers' corrections, asked for each name of a row whose id is divisible by 100."""
    index = vectors.VectorIndex(spark, scratch_path(spark, "index"))
    index.build(_kb(spark, d))
    reviews = read_table(spark, d, "feedback").select("id", "ord", "ingested_at", "decision", "source", "ground_truth")
    fixed = feedback.clean(reviews).where("decision = 'correct' AND ground_truth <> ''")
    index.upsert(fixed.select("source", F.col("ground_truth").alias("target")))
    asked = _names(spark, d).where("id % 100 = 0").select(F.col("source").alias("query"))
    return index.search(asked, 5).select("query", "id", "source", "target", F.round("score", 6).alias("score"), "rank")


def _fields(spark, d):
    """A catalog as the destinations tell it: a class and its slots, named first and second."""
    t = read_table(spark, d, "destinations").where(F.col("destination").contains("."))
    t = t.groupBy(F.split_part("destination", F.lit("."), F.lit(1)).alias("class"), F.split_part("destination", F.lit("."), F.lit(2)).alias("slot"))
    t = t.agg(F.min("ord").alias("slot_ord"), (F.count(F.lit(1)) > 20).alias("required"))
    return t.withColumn("class_ord", F.ascii("class"))


def catalog_search(spark, d):
    return fhir.search_fields(_fields(spark, d), "TYPE").select("class", "slot")


def catalog_fields(spark, d):
    return fhir.resource_fields(_fields(spark, d), "specimen").select("class", "slot", "required")


def catalog_paths(spark, d):
    return fhir.field_paths(_fields(spark, d))


def record_codes(spark, d):
    c = read_table(spark, d, "cases")
    return c.select("ord", tx.lookup_code(F.col("gender"), tx.GENDERS, "unknown").alias("gender"), tx.lookup_code(F.col("vital_status"), tx.DECEASED).alias("deceased"))


def id_checks(spark, d):
    c = read_table(spark, d, "cases").select("ord", "participant_id")
    center = tx.split_center_id(F.translate("participant_id", "-", "_"))
    return c.select("ord", tx.is_submitter_id(F.col("participant_id")).alias("submitter"), tx.is_plain_string(F.col("participant_id")).alias("plain"), center["participant_id"].alias("participant"), F.array_join(center["subsets"], ",").alias("subsets"))


def typed_structures(spark, d):
    v = read_table(spark, d, "content_values").select("ord", F.explode(tx.body_structures(F.concat_ws(",", F.concat_ws(":", "code", "source_value"), "source_category"))).alias("s"))
    return v.select("ord", "s.code", "s.display")


def subject_refs(spark, d):
    t = read_table(spark, d, "destinations").where("source_id <> ''").groupBy("source_id")
    t = t.agg(F.collect_set(F.nullif("specimen_ref", F.lit(""))).alias("s"), F.collect_set(F.nullif("subject_ref", F.lit(""))).alias("p"))
    return t.select("source_id", tx.subject_reference(F.col("s"), F.col("p")).alias("subject"))


def value_components(spark, d):
    c = read_table(spark, d, "cases").where("age_at_diagnosis IS NOT NULL")
    return c.select("ord", tx.component(F.lit("age"), F.col("age_at_diagnosis").cast("string"), "Integer", F.lit("http://x.invalid")).alias("component"))


def stored_answers(spark, d):
    """Answers written as the agents store them, and read back."""
    m = _candidates(spark, d).where("score IS NOT NULL AND NOT isnan(score) AND target <> ''")
    said = F.concat(F.lit("CHOSEN TARGET: **"), "target", F.lit("**\nCONFIDENCE: "), F.format_number("score", 4), F.lit("\nREASONING: because of "), "tier")
    a = tx.parse_answer(said)
    return m.select("ord", a["target"].alias("target"), F.round(a["confidence"], 4).alias("confidence"), a["reasoning"].alias("reasoning"))


def _rules(spark, d):
    m = read_table(spark, d, "mapping_entries").where("source_term IS NOT NULL AND destination IS NOT NULL")
    ref = F.array(F.struct(F.split_part("destination", F.lit("."), F.lit(1)).alias("resource"), F.lit("subject").alias("field")))
    none = F.lit(None).cast("array<struct<field:string,type:string,system:string,code:string,category:string>>")
    return rules.explode_rules(m.select(F.col("source_term").alias("node"), F.col("destination_resource").alias("resource_type"), none.alias("fields"), ref.alias("references"), F.array(F.coalesce("tier", F.lit(""))).alias("category"), F.lit(None).cast("boolean").alias("missing_in_schematic"), "ord"))


def rules_found(spark, d):
    return rules.filter_rules(_rules(spark, d), source="A", category="Field", has_reference_to="observation", min_confidence=0.5).select("ord", "rule_id", "target_resource")


def rules_stats(spark, d):
    return rules.rule_stats(_rules(spark, d))


def tier_summary(spark, d):
    return fhir.tier_summary(fhir.pair_usage(fhir.mapping_pairs(_nodes(spark, d), F.col("source"))))


def resource_counts(spark, d):
    return fhir.resource_counts(_records(spark, d))


def mined_merge(spark, d):
    """Records walked, pairs counted, and those the base lacks: what the loader inserts."""
    usage = fhir.pair_usage(fhir.mapping_pairs(_nodes(spark, d), F.col("source")))
    return fhir.merge_pairs(_kb(spark, d), usage).select("id", "source_term", "destination", "tier")


# feedback
def feedback_stats(spark, d):
    return feedback.stats(feedback.clean(read_table(spark, d, "feedback")))


def feedback_recent(spark, d):
    return feedback.recent(feedback.clean(read_table(spark, d, "feedback")), 50).select("id", "match_id", "decision")


def feedback_new_mappings(spark, d):
    return feedback.new_mappings(feedback.clean(read_table(spark, d, "feedback")))


def consensus_vote(spark, d):
    f = feedback.clean(read_table(spark, d, "feedback")).where("user_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence)")
    target = F.when(F.col("decision") == "correct", F.col("ground_truth")).otherwise(F.col("proposed_target"))
    p = f.where("decision <> 'reject'").select(F.col("match_id").alias("item"), target.alias("target"), F.col("user_id").alias("voter"), "confidence").where("target IS NOT NULL AND target <> ''")
    return feedback.consensus_vote(p).select("item", "target", "votes", "mean_confidence", "rank")


def stream_feedback_stats(spark, d):
    f = read_table(spark, d, "feedback")
    stream = streaming.stream_stats(streaming.read_stream(spark, f"{d}/feedback.parquet*", f.schema))
    return streaming.run_available(stream, "mapweave_stream_stats")


def stream_windows(spark, d):
    f = read_table(spark, d, "feedback")
    stream = streaming.windowed_decisions(streaming.read_stream(spark, f"{d}/feedback.parquet*", f.schema), width="7 days", late="400 days")
    # the table as it stands is run to its end: append mode would keep back the windows the watermark hasn't passed
    return streaming.run_available(stream, "mapweave_stream_windows")


# cascades
def _mapped(spark, d):
    """All stages: exact, fuzzy, calibrated vectors, unmapped."""
    return cascade.map_columns(_kb(spark, d), _names(spark, d).select(F.col("source").alias("name")), vectors=True, keyed=_keyed(spark, d))


def cascade_map(spark, d):
    return _mapped(spark, d)


def cascade_constrained(spark, d):
    c = _names(spark, d).groupBy(F.col("source").alias("name")).agg(F.array_sort(F.collect_set("proposed_target")).alias("candidates"))
    return cascade.map_columns_constrained(_kb(spark, d), c)


def cascade_coverage(spark, d):
    return cascade.coverage(_mapped(spark, d))


def _judged(spark, d):
    f = feedback.clean(read_table(spark, d, "feedback")).where("source IS NOT NULL")
    path = F.when(F.col("decision") == "correct", F.col("ground_truth")).when(F.col("decision") == "accept", F.col("proposed_target"))
    gold = f.groupBy(F.col("source").alias("name")).agg(F.array_compact(F.array_sort(F.collect_set(path))).alias("accept"), F.min("tier").alias("stratum")).where(F.size("accept") > 0)
    return gold.join(_mapped(spark, d), "name").select("name", "stratum", cascade.verdict(F.col("target"), F.col("accept")).alias("verdict"))


def eval_verdicts(spark, d):
    return _judged(spark, d)


def eval_report(spark, d):
    return cascade.eval_report(_judged(spark, d))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Map the reviewed columns: exact, then fuzzy, then by calibrated vectors, else unmapped."""
    return cascade_map(spark, d)


_ALL = (
    p5_found, p5_periods,
    kb_lookup, kb_lookup_context, kb_reverse_lookup, kb_filter_tier, kb_filter_schema, kb_tier_candidates, kb_stats, kb_training_pairs, kb_expertise, content_lookup,
    content_by_path, kb_merge, kb_merge_counted, kb_without_destination, kb_multi_destination, kb_counts, kb_top_destinations, kb_repair_counts, kb_path_fixes, kb_delete_like,
    conflicts_destination, conflicts_schema, multi_destinations, resolve_priority, resolve_frequency, resolve_equivalent, resolve_clinical, canonical_rows, normalization_report, hitl_export,
    ground_truth_metrics, valid_paths, passthrough_fix, focus_refs, path_validation,
    rule_match_topk, rule_match_metadata, fuzzy_pairs, fuzzy_lookup, expert_match, ensemble_scores, confidence_levels, dedupe_matches, tier_run, nearest_vectors, match_tables, match_tables_all, rank_metrics, top1_outcomes,
    calib_keys, calib_curve, calib_curve_compat, calib_ece, calib_scores, calib_top_keys, tier_metrics, flat_calibration, calib_compare, common_destinations,
    csv_header_scan, entity_targets, compound_lookup, tool_lookup, vector_search, catalog_search, catalog_fields, catalog_paths, record_codes, id_checks, typed_structures, subject_refs,
    value_components, stored_answers, rules_found, rules_stats, tier_summary, resource_counts, mined_merge,
    profile_columns, profile_samples, content_types, content_types_compat, target_candidates, table_profiles, column_relations, profile_summary, schema_summary,
    json_field_usage, json_coding_usage, json_coding_systems, json_reference_usage, json_pair_usage, ground_truth_rows, url_terms, name_parts, name_variants, characteristics, minted_ids, category_paths,
    feedback_stats, feedback_recent, feedback_new_mappings, consensus_vote, stream_feedback_stats, stream_windows,
    cascade_map, cascade_constrained, cascade_coverage, eval_verdicts, eval_report,
)


def queries() -> dict:
    return {f.__name__: f for f in _ALL}
