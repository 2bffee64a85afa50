"""SQL for the queries over column profiles, in the order of the rules they compare with."""

from __future__ import annotations

from mapweave.operators import profile as pr

#: Columns of the profiled tables, in their order.
TABLES = {
    "cases": ("participant_id", "age_at_diagnosis", "primary_diagnosis", "vital_status", "gender", "race", "ethnicity", "loaded_at"),
    "content_values": ("id", "source_value", "source_category", "code", "code_system", "display", "is_primary", "loaded_at", "deleted_at"),
    "sources": ("id", "source", "source_schema", "tier", "source_context", "loaded_at", "deleted_at"),
    "destinations": ("id", "source_id", "destination", "entity", "dest_system", "dest_code", "dest_display", "unit", "unit_system", "unit_code", "subject_ref", "focus_ref", "specimen_ref", "loaded_at"),
}


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _in(words: tuple[str, ...]) -> str:
    return ", ".join(f"'{w}'" for w in words)


_CELLS = " UNION ALL ".join(f"SELECT '{t}' AS entity, '{c}' AS column_name, {k} AS position, ord, CAST({c} AS VARCHAR) AS value FROM {t}" for t, columns in TABLES.items() for k, c in enumerate(columns))
_COLUMNS = f"""
cells AS ({_CELLS}),
ten AS (SELECT entity, column_name, list(value ORDER BY rn) AS samples FROM (
  SELECT *, row_number() OVER (PARTITION BY entity, column_name ORDER BY ord, value) AS rn FROM cells WHERE value IS NOT NULL) AS x WHERE rn <= 10 GROUP BY ALL),
plain AS (SELECT entity, column_name, position, count(*) AS row_count FROM cells GROUP BY ALL),
cols AS (SELECT p.*, coalesce(t.samples, []) AS samples, lower(p.column_name) AS low,
  {_any("lower(p.column_name)", pr.ID_WORDS)} OR coalesce(len(t.samples) > 0 AND list_avg(list_transform(t.samples, lambda x: length(x))) > 5
    AND len(list_filter(t.samples, lambda x: regexp_matches(x, '^[A-Z0-9_-]+$'))) / len(t.samples) > 0.7, false) AS is_identifier,
  {_any("lower(p.column_name)", pr.DOMAIN_WORDS)} AS is_domain
  FROM plain p LEFT JOIN ten t USING (entity, column_name)),
given AS (SELECT *, list_filter(list_transform(samples, lambda x: lower(trim(x))), lambda x: x NOT IN ('', 'na', 'nan', 'null')) AS v FROM cols)
"""


def _all(pattern: str) -> str:
    return f"len(list_filter(v, lambda x: NOT regexp_matches(x, '{pattern}'))) = 0"


def _within(words: tuple[str, ...]) -> str:
    return f"len(list_filter(v, lambda x: x NOT IN ({_in(words)}))) = 0"


def _kind(dtype: str, pattern: str | None, vocabulary: str | None = None) -> str:
    text = lambda x: "NULL" if x is None else f"'{x}'"
    return f"[{text(dtype)}, {text(pattern)}, {text(vocabulary)}]"


def _types(compat: bool) -> str:
    stage = r"(?i)^(stage\s*)?(I{1,3}V?|[1-4])[ABC]?$" if compat else r"(?i)^((stage\s*)(I{1,3}V?|[1-4])|I{1,3}V?)[ABC]?$"
    grade = r"(?i)^G[1-4X]$|^(grade\s*)?[1-4]$" if compat else r"^(g|grade\s*)[1-4]$|^gx$"
    chromosome = r"(?i)^(?:(chr)?\d{1,2}|X|Y$)" if compat else r"(?i)^(chr(\d{1,2}|X|Y)|X|Y)$"
    is_id = _any("low", ("_id", "identifier", "accession"))
    numeric = _all(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$")
    whole = numeric + " AND len(list_filter(v, lambda x: NOT coalesce(floor(TRY_CAST(x AS DOUBLE)) = TRY_CAST(x AS DOUBLE), false))) = 0"
    tnm = ("t_stage", "n_stage", "m_stage", "tnm", "pathologic_t", "pathologic_n", "pathologic_m", "clinical_t", "clinical_n", "clinical_m")
    rules = [
        ("len(v) = 0", _kind("unknown", None)),
        (f"{is_id} AND {_all('^GSM[0-9]+$' if compat else '(?i)^GSM[0-9]+$')}", _kind("id", "geo_accession")),
        (f"{is_id} AND {_all('^[a-f0-9]{8}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{4}-[a-f0-9]{12}$')}", _kind("id", "uuid")),
        (is_id, _kind("id", "identifier")),
        (f"{_within(('0', '1'))} AND {_any('low', ('death', 'deceased', 'dead', 'event', 'censor', 'status'))}", _kind("boolean", "binary_event", "survival_event")),
        (_within(("0", "1")), _kind("boolean", "binary")),
        (_within(("alive", "dead", "living", "deceased")) + " AND " + _within(pr.BOOLEAN_VALUES), _kind("boolean", "vital_status", "vital_status")),
        (_within(("male", "female", "m", "f")), _kind("categorical", "sex", "administrative_gender")),
        (_within(pr.BOOLEAN_VALUES), _kind("boolean", "binary")),
        (f"{_any('low', ('vital', 'status'))} AND len(list_filter(v, lambda x: x IN ({_in(pr.VITAL_VALUES)}))) > 0", _kind("boolean", "vital_status", "vital_status")),
        (_any("low", tnm), _kind("coded", "tnm_category", "ajcc_tnm")),
        (_all("(?i)^[pcy]?[TNM][0-4X]?[abc]?$"), _kind("coded", "tnm_category", "ajcc_tnm")),
        ("contains(low, 'stage')", _kind("coded", "cancer_stage", "ajcc_stage")),
        (_all(stage), _kind("coded", "cancer_stage", "ajcc_stage")),
        (_any("low", ("grade", "grading")), _kind("coded", "tumor_grade", "histologic_grade")),
        (_all(grade), _kind("coded", "tumor_grade", "histologic_grade")),
        (_all(r"(?i)^[cgnmpr]\.[\d\-+*]+"), _kind("coded", "hgvs", "hgvs_nomenclature")),
        ("contains(low, 'chr')", _kind("coded", "chromosome", "chromosome")),
        (_all(chromosome), _kind("coded", "chromosome", "chromosome")),
        (f"{whole} AND {_any('low', ('position', 'start', 'end', 'stop'))}", _kind("numeric", "genomic_position")),
        (f"{whole} AND contains(low, 'day')", _kind("numeric", "duration_days")),
        (whole, _kind("numeric", "integer")),
        (f"{numeric} AND {_any('low', ('survival', 'time', 'month'))}", _kind("numeric", "duration_time")),
        (f"{numeric} AND {_any('low', ('frequency', 'freq', 'vaf', 'percent', 'pct'))}", _kind("numeric", "frequency")),
        (numeric, _kind("numeric", "continuous")),
        ("len(list_distinct(v)) <= 10 AND len(v) > len(list_distinct(v)) * 2", _kind("categorical", "enumerated")),
    ]
    cases = " ".join(f"WHEN {test} THEN {kind}" for test, kind in rules)
    return f"typed AS (SELECT * EXCLUDE (k), k[1] AS dtype, k[2] AS pattern, k[3] AS vocabulary FROM (SELECT *, CASE {cases} ELSE {_kind('text', 'free_text')} END AS k FROM given) AS x)"


_GROUP = f"""CASE WHEN dtype = 'id' THEN 'identifiers'
  WHEN coalesce(vocabulary, '') = 'survival_event' OR {_any("low", ("survival", "os_time", "os_event", "death", "vital", "censor"))} THEN 'survival'
  WHEN coalesce(vocabulary, '') IN ('ajcc_tnm', 'ajcc_stage', 'histologic_grade') OR {_any("low", ("stage", "grade"))} THEN 'staging'
  WHEN {_any("low", ("chromosome", "position", "start", "end", "stop", "genome_build"))} THEN 'genomic_location'
  WHEN {_any("low", ("gene", "variant", "mutation", "hgvs", "allele", "frequency", "vaf"))} THEN 'variant_details'
  WHEN {_any("low", ("sample", "tissue", "tumor", "specimen", "biopsy"))} THEN 'sample_info'
  WHEN {_any("low", ("diagnosis", "disease", "condition", "phenotype"))} THEN 'clinical' ELSE 'other' END"""
_ADVICE = f"""CASE WHEN coalesce(vocabulary, '') = 'survival_event' OR (dtype = 'boolean' AND {_any("low", ("death", "deceased", "dead", "vital"))}) THEN 'Patient.deceasedBoolean'
  WHEN coalesce(pattern, '') = 'duration_time' OR {_any("low", ("survival_month", "os_time", "survival_time"))} THEN 'Observation.valueQuantity'
  WHEN coalesce(vocabulary, '') = 'ajcc_stage' OR coalesce(pattern, '') = 'cancer_stage' THEN 'Condition.stage.summary'
  WHEN coalesce(vocabulary, '') = 'ajcc_tnm' THEN 'Observation.valueCodeableConcept under a staging Observation'
  WHEN coalesce(vocabulary, '') = 'histologic_grade' THEN 'Observation.valueCodeableConcept'
  WHEN dtype = 'id' AND {_any("low", ("patient", "participant"))} THEN 'Patient.identifier'
  WHEN dtype = 'id' AND {_any("low", ("sample", "specimen"))} THEN 'Specimen.identifier'
  WHEN dtype = 'id' THEN 'identifier of the fitting resource'
  WHEN coalesce(pattern, '') = 'genomic_position' THEN 'Observation.component'
  WHEN {_any("low", ("gene", "chromosome", "variant", "hgvs"))} THEN 'Observation.component about a Specimen' END"""


def _unit(units: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN ends_with(low, '{s}') THEN '{u}'" for s, u in units) + " END"


def _archetype(units: tuple[tuple[str, str], ...]) -> str:
    return f"""CASE WHEN dtype = 'id' OR ends_with(low, '_id') OR ends_with(low, 'identifier') THEN 'identifier' WHEN {_any("low", ("date", "datetime", "timestamp"))} THEN 'date'
  WHEN {_unit(units)} IS NOT NULL OR dtype = 'numeric' THEN 'quantity' WHEN dtype = 'boolean' THEN 'flag' WHEN dtype IN ('categorical', 'coded') THEN 'vocabulary' ELSE 'text' END"""


def _uses() -> str:
    scores = ", ".join("{'s': " + " + ".join(f"CAST(contains(t, '{w}') AS INT)" for w in words) + f", 'k': {-k}, 'u': '{u}'}}" for k, (u, words) in enumerate(pr.USE_CASES))
    return f"list_reverse_sort([{scores}])[1]"


def _cases(column: str, pairs: tuple[tuple[str, str], ...], default: str) -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in pairs) + f" ELSE '{default}' END"


_PROFILES = (
    "words AS (SELECT entity, string_agg(low, ' ' ORDER BY position, low) AS t, bool_or(len(list_filter(samples[1:3], lambda x: regexp_matches(x, '^GSM[0-9]+$'))) > 0) AS gsm FROM typed GROUP BY entity)",
    f"""uses AS (SELECT entity, t, CASE WHEN top.s > 0 THEN top.u ELSE 'unknown' END AS use_case, CASE WHEN gsm THEN 'geo_repository' {" ".join(f"WHEN {_any('t', w)} THEN '{p}'" for p, w in pr.PROVENANCES)} ELSE 'unknown' END AS provenance
      FROM (SELECT *, {_uses()} AS top FROM words) AS x)""",
)
_PROFILE_OUT = f"""SELECT entity, use_case, provenance, {_cases("use_case", pr.PURPOSES, "observations")} || CASE provenance WHEN 'geo_repository' THEN ' from geo repository' WHEN 'sequencing_lab' THEN ' from sequencing laboratory' ELSE '' END AS purpose,
  CASE WHEN contains(use_case, 'variant') OR {_any("t", ("gene", "variant", "mutation", "hgvs"))} THEN 'variant_observation' WHEN contains(use_case, 'lab') THEN 'lab_observation'
    WHEN {_any("t", ("sample_id", "specimen", "biopsy"))} THEN 'sample' ELSE 'patient' END AS primary_entity FROM uses"""

_TARGETS = " UNION ALL ".join(f"SELECT '{t}' AS target, '{t.lower()}' AS g" for t in pr.TARGETS)
_CANDIDATES = f"""SELECT target, entity, column_name FROM cols, ({_TARGETS}) AS t WHERE (contains(g, 'identifier') AND is_identifier) OR (contains(g, 'specimen') AND {_any("low", ("specimen", "tissue", "sample"))})
  OR (contains(g, 'date') AND {_any("low", ("date", "time", "collected", "onset"))}) OR (contains(g, 'url') AND len(list_filter(samples, lambda x: contains(x, 'http') OR contains(x, 'ftp'))) > 0)"""
_SUMMARY = """SELECT entity, count(*) AS fields, count(*) FILTER (is_identifier) AS identifiers, count(*) FILTER (is_domain) AS domain_fields,
  CASE WHEN entity IS NOT NULL THEN coalesce(array_to_string(list(column_name ORDER BY position, column_name) FILTER (is_identifier OR is_domain)[1:5], ','), '') END AS key_fields FROM cols GROUP BY ROLLUP (entity)"""


def _relations(columns: tuple[tuple[str, str, int], ...]) -> str:
    rows = ", ".join(f"('{e}', '{c}', {k})" for e, c, k in columns)

    def group(label: str, words: tuple[str, ...], step: int) -> str:
        return f"""SELECT entity, column_name, '{label}' || every AS relation, {step} AS step FROM (SELECT *, count(*) OVER (PARTITION BY entity) AS n,
          string_agg(column_name, ',' ORDER BY position, column_name) OVER (PARTITION BY entity ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS every FROM c WHERE {_any("low", words)}) AS x WHERE n > 1"""

    return f"""WITH c AS (SELECT *, lower(column_name) AS low FROM (VALUES {rows}) AS v(entity, column_name, position)),
    times AS (SELECT entity, column_name AS t, position AS tp, regexp_replace(low, '(time|months?|_time|survival)', '', 'g') AS tb, low AS tl FROM c WHERE {_any("low", ("survival", "os_time", "_time", "_months"))}),
    ends AS (SELECT entity, column_name AS e, position AS ep, regexp_replace(low, '(event|death|status|vital|censor)', '', 'g') AS eb FROM c WHERE {_any("low", ("event", "death", "vital", "censor", "status"))}),
    linked AS (SELECT * FROM times JOIN ends USING (entity) WHERE (tb <> '' AND contains(eb, tb)) OR (eb <> '' AND contains(tb, eb)) OR contains(tl, 'survival')),
    found AS (SELECT entity, t AS column_name, 'survival_pair:' || arg_max(e, (tp, ep)) AS relation, 1 AS step FROM linked GROUP BY entity, t
      UNION ALL SELECT entity, e, 'survival_pair:' || arg_max(t, (tp, ep)), 1 FROM linked GROUP BY entity, e
      UNION ALL {group("genomic_location_group:", ("chromosome", "position", "start", "end", "stop"), 2)}
      UNION ALL {group("tnm_group:", ("t_stage", "n_stage", "m_stage"), 3)})
    SELECT entity, column_name, arg_max(relation, step) AS relation FROM found GROUP BY ALL"""


def oracle_sql(units: tuple[tuple[str, str], ...], related: tuple[tuple[str, str, int], ...]) -> dict[str, str]:
    """units: of text.UNIT_SUFFIXES; related: the columns column_relations is asked for."""

    def over(sql: str, *more: str) -> str:
        return "WITH " + ",\n".join([_COLUMNS, *more]) + "\n" + sql

    return {
        "content_types": over(
            f"SELECT entity, column_name, dtype, pattern, vocabulary, {_GROUP} AS column_group, {_ADVICE} AS advice, {_archetype(units)} AS archetype, {_unit(units)} AS unit FROM typed", _types(False)
        ),
        "content_types_compat": over("SELECT entity, column_name, dtype, pattern, vocabulary FROM typed", _types(True)),
        "target_candidates": over(_CANDIDATES),
        "table_profiles": over(_PROFILE_OUT, _types(False), *_PROFILES),
        "profile_summary": over(_SUMMARY),
        "column_relations": _relations(related),
    }
