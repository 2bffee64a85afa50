"""SQL for the queries over heads of tables, catalogs, records, indexes and calibrations of whole matchers."""

from __future__ import annotations

from mapweave.functions import text as tx
from mapweave.plans.oracle import _BIN, _BIN_COMPAT, _CODED, _LEVEL, _PAIRS_MINED, _PRED, _in, _kb, _vector
from mapweave.plans.oracle_profile import TABLES
from mapweave.plans.queries import ENTITY_RESOURCES

_HEAD = ("participant_id", "age_at_diagnosis", "primary_diagnosis", "vital_status", "gender", "race")
_FIELDS = """fields AS (SELECT split_part(destination, '.', 1) AS class, split_part(destination, '.', 2) AS slot, min(ord) AS slot_ord, count(*) > 20 AS required
  FROM destinations WHERE contains(destination, '.') GROUP BY ALL)"""
_ENTRY = "left(replace({0} || '_' || {1} || '_' || {2}, ' ', '_'), 63)"


def _lookup(c: str, table: dict, default: str) -> str:
    value = lambda v: str(v).lower() if isinstance(v, bool) else f"'{v}'"
    return f"CASE lower(trim({c})) " + " ".join(f"WHEN '{k}' THEN {value(v)}" for k, v in table.items()) + f" ELSE {default} END"


def _calibrated(bins: str, summary: str = "summary") -> tuple[str, ...]:
    """The summary of the three matchers, under the given name."""
    return (
        f"keyed_{summary} AS (SELECT confidence, correct, unnest([matcher || ':' || tier, matcher]) AS key FROM outcomes)",
        f"bins_{summary} AS (SELECT key, {bins} AS bin, count(*) AS n, avg(confidence) AS c, avg(correct) AS a FROM keyed_{summary} WHERE {bins} IS NOT NULL GROUP BY ALL)",
        f"""{summary} AS (SELECT split_part(t.key, ':', 1) AS matcher, CASE WHEN contains(t.key, ':') THEN split_part(t.key, ':', 2) ELSE 'global' END AS tier, t.n, t.accuracy, t.mean_conf, g.gap / t.n AS ece
          FROM (SELECT key, count(*) AS n, avg(correct) AS accuracy, avg(confidence) AS mean_conf FROM keyed_{summary} GROUP BY key) AS t
          JOIN (SELECT key, sum(n * abs(c - a)) AS gap FROM bins_{summary} GROUP BY key) AS g USING (key))""",
    )


def _nearest(matcher: str, n: int) -> str:
    return f"""SELECT '{matcher}' AS matcher, tier, id, target, score FROM (SELECT *, row_number() OVER (PARTITION BY tier, id ORDER BY score DESC, ord, target) AS rn FROM (
      SELECT a.tier, a.id, b.target, b.ord, least(round(list_cosine_similarity(a.v, b.v), 9), 1.0) AS score FROM (SELECT tier, id, {_vector("id", n)} AS v FROM (SELECT DISTINCT tier, id FROM truth) AS i) AS a
      JOIN (SELECT tier, target, ord, {_vector("target", n)} AS v FROM (SELECT tier, target, min(ord) AS ord FROM truth GROUP BY ALL) AS g) AS b ON a.tier = b.tier) AS x) AS y WHERE rn = 1"""


_OUTCOMES = (
    "truth AS (SELECT tier, source AS id, destination AS target, min(dest_ord) AS ord FROM m WHERE source <> '' AND tier IN ('entity', 'field', 'content') GROUP BY ALL)",
    f"""best AS (SELECT 'rule' AS matcher, tier, id, arg_min(target, ord) AS target, 1.0 AS score FROM truth GROUP BY tier, id UNION ALL {_nearest("pairs", 2)} UNION ALL {_nearest("triples", 3)})""",
    "outcomes AS (SELECT matcher, tier, CAST(score AS DOUBLE) AS confidence, CAST(EXISTS (SELECT 1 FROM truth t WHERE t.tier = best.tier AND t.id = best.id AND lower(t.target) = lower(best.target)) AS INT) AS correct FROM best)",
)


def _column_texts(name: str, table: str, columns: tuple[str, ...]) -> str:
    """A text for each column: its name twice and the ten values that sort first."""
    cells = " UNION ".join(f"SELECT '{c}' AS c, CAST({c} AS VARCHAR) AS value FROM {table}" for c in columns)
    names = ", ".join(f"('{c}')" for c in columns)
    return f"""{name} AS (SELECT c, c || ' ' || c || ': ' || coalesce(string_agg(value, ', ' ORDER BY value) FILTER (rn <= 10), '') AS text FROM (VALUES {names}) AS n(c) LEFT JOIN (
      SELECT *, row_number() OVER (PARTITION BY c ORDER BY value) AS rn FROM ({cells}) AS x WHERE value <> '') AS y USING (c) GROUP BY c)"""


def oracle_sql() -> dict[str, str]:
    heads = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {k} AS position, ord, CAST({c} AS VARCHAR) AS value FROM (SELECT * FROM cases ORDER BY ord LIMIT 200) AS h" for k, c in enumerate(_HEAD))
    names = ", ".join(f"('{c}', {k})" for k, c in enumerate(_HEAD))
    return {
        "csv_header_scan": f"""SELECT column_name, position, coalesce(samples, '') AS samples FROM (VALUES {names}) AS n(column_name, position) LEFT JOIN (
            SELECT column_name, string_agg(left(value, 60), ' | ' ORDER BY rn) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY ord, left(value, 60)) AS rn FROM ({heads}) AS c WHERE value <> '') AS x WHERE rn <= 3 GROUP BY 1) AS s USING (column_name)""",
        "entity_targets": _kb(f"SELECT target, t_ord AS ord FROM goals WHERE split_part(target, '.', 1) IN ({_in(ENTITY_RESOURCES['sample'])})"),
        "compound_lookup": _kb("SELECT DISTINCT source_value AS name, code, fhir_path, fhir_resource FROM v LEFT JOIN (SELECT p.*, t.fhir_resource FROM p JOIN (SELECT ord, coalesce(fhir_resource, '') AS fhir_resource FROM content_fhir_targets) AS t ON t.ord = p.t_ord) AS q ON v.id = q.content_value_id WHERE source_value IN (SELECT primary_diagnosis FROM cases WHERE primary_diagnosis IS NOT NULL)"),
        "tool_lookup": _kb("SELECT a.value, v.id, source_category, code, fhir_path FROM (SELECT DISTINCT race AS value FROM cases WHERE race IS NOT NULL) AS a JOIN v ON lower(source_value) = lower(a.value) LEFT JOIN p ON p.content_value_id = v.id"),
        "vector_search": _kb(
            f"""SELECT query, id, source, target, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM (
            SELECT query, e.id, e.source, e.target, round(list_cosine_similarity(a.v, {_vector("e.source")}), 9) AS score FROM (SELECT query, {_vector("query")} AS v FROM (SELECT DISTINCT source AS query FROM names WHERE id % 100 = 0 AND source <> '') AS q) AS a, held e) AS x) AS y WHERE rank <= 5""",
            f"""ided AS (SELECT DISTINCT {_ENTRY.format("'kb'", "source", "destination")} AS id, source, destination AS target FROM m WHERE source <> ''
              UNION SELECT {_ENTRY.format("'user'", "source", "ground_truth")}, source, ground_truth FROM fb WHERE decision = 'correct' AND ground_truth <> '' AND source <> '')""",
            "held AS (SELECT id, p.s AS source, p.t AS target FROM (SELECT id, min({'s': source, 't': target}) AS p FROM ided GROUP BY id) AS x)",
        ),
        "catalog_search": f"WITH {_FIELDS} SELECT class, slot FROM fields WHERE contains(lower(slot), 'type')",
        "catalog_fields": f"WITH {_FIELDS} SELECT class, slot, required FROM fields WHERE class = 'Specimen'",
        "catalog_paths": f"WITH {_FIELDS} SELECT class || '.' || slot AS path FROM fields",
        "record_codes": f"SELECT ord, {_lookup('gender', tx.GENDERS, chr(39) + 'unknown' + chr(39))} AS gender, {_lookup('vital_status', tx.DECEASED, 'NULL')} AS deceased FROM cases",
        "id_checks": r"""SELECT ord, coalesce(regexp_matches(participant_id, '^[A-Za-z0-9\-.]+$'), false) AS submitter, coalesce(regexp_matches(participant_id, '^[^\s]+(\s[^\s]+)*$'), false) AS plain,
            CASE WHEN len(k) > 1 THEN k[1] || '_' || k[2] END AS participant, CASE WHEN len(k) > 1 THEN array_to_string(k[3:], ',') END AS subsets FROM (SELECT *, string_split(replace(participant_id, '-', '_'), '_') AS k FROM cases) AS x""",
        "typed_structures": """SELECT ord, trim(CASE WHEN contains(x, ':') THEN left(x, instr(x, ':') - 1) ELSE '' END) AS code, trim(CASE WHEN contains(x, ':') THEN substr(x, instr(x, ':') + 1) ELSE x END) AS display FROM (
            SELECT ord, trim(unnest(string_split(concat_ws(',', concat_ws(':', code, source_value), source_category), ','))) AS x FROM content_values) AS y WHERE trim(CASE WHEN contains(x, ':') THEN substr(x, instr(x, ':') + 1) ELSE x END) <> ''""",
        "subject_refs": """SELECT source_id, CASE WHEN len(s) = 1 THEN 'Specimen/' || s[1] WHEN len(s) > 1 THEN 'Group/' || array_to_string(s, '+') WHEN len(p) = 1 THEN 'Patient/' || p[1] WHEN len(p) > 1 THEN 'Group/' || array_to_string(p, '+') END AS subject FROM (
            SELECT source_id, list_sort(list(DISTINCT specimen_ref) FILTER (specimen_ref <> '')) AS s, list_sort(list(DISTINCT subject_ref) FILTER (subject_ref <> '')) AS p FROM destinations WHERE source_id <> '' GROUP BY 1) AS x""",
        "value_components": """SELECT ord, '{"code":{"coding":[{"system":"http://x.invalid","code":"age","display":"age"}]},"valueInteger":' || age_at_diagnosis || '}' AS component FROM cases WHERE age_at_diagnosis IS NOT NULL""",
        "stored_answers": _kb("SELECT ord, target, round(score, 4) AS confidence, 'because of ' || tier AS reasoning FROM scored WHERE target <> '' AND tier IS NOT NULL"),
        "rules_found": "SELECT ord, source_term AS rule_id, destination_resource AS target_resource FROM mapping_entries WHERE source_term <> '' AND destination IS NOT NULL AND contains(lower(source_term), 'a') AND lower(coalesce(tier, '')) = 'field' AND lower(split_part(destination, '.', 1)) = 'observation'",
        "rules_stats": "SELECT count(*) AS total, count(DISTINCT destination_resource) AS targets, count(DISTINCT coalesce(tier, '')) AS categories FROM mapping_entries WHERE source_term <> '' AND destination IS NOT NULL",
        "tier_summary": f"""WITH {_CODED}, {_PAIRS_MINED}, tiers AS (SELECT CASE WHEN arg_min(pair_type, (ord, k, pair_type)) = 'content' THEN 'content' ELSE 'field' END AS tier FROM pairs GROUP BY term, path)
            SELECT count(*) FILTER (tier = 'entity') AS entity, count(*) FILTER (tier = 'field') AS field, count(*) FILTER (tier = 'content') AS content FROM tiers""",
        "resource_counts": "SELECT 'GDC' AS source, 'Observation' AS resource, count(*) AS n FROM content_values",
        "mined_merge": _kb(
            """SELECT 'gdc:' || term AS id, term AS source_term, path AS destination, tier FROM mined WHERE n >= 2 AND NOT EXISTS (SELECT 1 FROM m WHERE m.source_schema = 'gdc' AND m.source = mined.term AND m.destination = mined.path)""",
            _CODED, _PAIRS_MINED,
            "mined AS (SELECT term, path, count(*) AS n, CASE WHEN arg_min(pair_type, (ord, k, pair_type)) = 'content' THEN 'content' ELSE 'field' END AS tier FROM pairs GROUP BY term, path)",
        ),
        "match_tables_all": f"""WITH {_column_texts("a", "cases", ("ord", *TABLES["cases"]))}, {_column_texts("b", "content_values", ("ord", *TABLES["content_values"]))}
            SELECT a.c AS source, b.c AS target, round(list_cosine_similarity({_vector("a.text")}, {_vector("b.text")}), 6) AS score FROM a, b""",
        "calib_top_keys": _kb("SELECT * FROM (SELECT *, split_part(key, ':', 1) AS matcher, CAST(row_number() OVER (PARTITION BY split_part(key, ':', 1) ORDER BY n_total DESC, key) AS INT) AS rank FROM stats) AS x ORDER BY n_total DESC, key LIMIT 15", _PRED),
        "tier_metrics": _kb(
            f"""SELECT tier, count(*) AS total, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, count(*) FILTER (coalesce(requires_hitl, false)) AS review,
            count(*) FILTER (user_feedback) AS feedback_true, count(*) FILTER (NOT user_feedback) AS feedback_false FROM (SELECT *, {_LEVEL} AS level FROM scored) AS x GROUP BY tier"""
        ),
        "flat_calibration": _kb("SELECT matcher, tier, n, round(accuracy, 6) AS accuracy, round(mean_conf, 6) AS mean_conf, round(ece, 6) AS ece FROM summary", *_OUTCOMES, *_calibrated(_BIN)),
        "calib_compare": _kb(
            """SELECT matcher, tier, round(a.accuracy, 6) AS accuracy_no, round(a.ece, 6) AS ece_no, round(b.accuracy, 6) AS accuracy_yes, round(b.ece, 6) AS ece_yes, round(b.accuracy - a.accuracy, 6) + 0.0 AS accuracy_delta, round(b.ece - a.ece, 6) + 0.0 AS ece_delta
            FROM own a JOIN published b USING (matcher, tier)""",
            *_OUTCOMES, *_calibrated(_BIN, "own"), *_calibrated(_BIN_COMPAT, "published"),
        ),
        "common_destinations": _kb("SELECT destination, count(*) AS n FROM d WHERE contains(destination, '.') GROUP BY 1 ORDER BY n DESC, destination LIMIT 400"),
    }
