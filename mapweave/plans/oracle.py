"""SQL for the queries of mapweave.plans.queries, over the same tables."""

from __future__ import annotations

from mapweave.functions.text import DOMAINS, UNIT_SUFFIXES
from mapweave.operators import normalize
from mapweave.plans import oracle_profile
from mapweave.plans.queries import CLINICAL, COHORT, EQUIVALENT, FIXES, WEIGHTS

_ORPHANS = """
SELECT 'destinations' AS table_name, ord, loaded_at FROM destinations
WHERE source_id IS NOT NULL AND source_id <> '' AND source_id NOT IN (SELECT id FROM sources WHERE deleted_at IS NULL AND id IS NOT NULL)
UNION ALL
SELECT 'content_fhir_targets', ord, loaded_at FROM content_fhir_targets
WHERE content_value_id IS NOT NULL AND content_value_id NOT IN (SELECT id FROM content_values WHERE deleted_at IS NULL AND id IS NOT NULL)
"""

_PERIODS = f"""
WITH orphans AS (SELECT table_name, strftime(loaded_at, '%Y-%m') AS period, count(*) AS c FROM ({_ORPHANS}) AS o GROUP BY ALL),
refs AS (
  SELECT 'destinations' AS table_name, 'source_id' AS column_name, strftime(loaded_at, '%Y-%m') AS period, count(*) AS row_count, count(*) FILTER (source_id <> '') AS ref_count
  FROM destinations GROUP BY ALL
  UNION ALL
  SELECT 'content_fhir_targets', 'content_value_id', strftime(loaded_at, '%Y-%m'), count(*), count(content_value_id) FROM content_fhir_targets GROUP BY ALL)
SELECT r.table_name, r.column_name, r.period, r.row_count, r.ref_count, coalesce(c, 0) AS direct_count, CAST(0 AS BIGINT) AS inherited_count,
  round(coalesce(c, 0) / nullif(r.ref_count, 0), 6) AS orphan_share
FROM refs r LEFT JOIN orphans o ON r.table_name = o.table_name AND r.period IS NOT DISTINCT FROM o.period
"""

_PARTS = ("entity", "dest_system", "dest_code", "dest_display", "unit", "unit_system", "unit_code", "subject_ref", "focus_ref", "specimen_ref")


def _blank(*names: str) -> str:
    return ", ".join(f"coalesce({n}, '') AS {n}" for n in names)


_KB = f"""
s AS (SELECT * EXCLUDE (rn) FROM (SELECT id, {_blank("source", "source_schema", "tier", "source_context")}, ord, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn
      FROM sources WHERE deleted_at IS NULL AND id IS NOT NULL) AS x WHERE rn = 1),
d AS (SELECT * EXCLUDE (rn) FROM (SELECT source_id, destination, {_blank(*_PARTS)}, ord AS dest_ord, row_number() OVER (PARTITION BY source_id, destination ORDER BY ord) AS rn
      FROM destinations WHERE coalesce(source_id, '') <> '' AND destination IS NOT NULL) AS x WHERE rn = 1),
v AS (SELECT * EXCLUDE (rn) FROM (SELECT id, {_blank("source_value", "source_category", "code")}, ord, row_number() OVER (PARTITION BY id ORDER BY ord DESC) AS rn
      FROM content_values WHERE deleted_at IS NULL AND id IS NOT NULL) AS x WHERE rn = 1),
p AS (SELECT * EXCLUDE (rn) FROM (SELECT content_value_id, fhir_path, ord AS t_ord, row_number() OVER (PARTITION BY content_value_id, fhir_path ORDER BY ord) AS rn
      FROM content_fhir_targets WHERE content_value_id IS NOT NULL AND fhir_path IS NOT NULL) AS x WHERE rn = 1),
m AS (SELECT s.*, d.* EXCLUDE (source_id) FROM s JOIN d ON s.id = d.source_id),
names AS (SELECT * FROM feedback WHERE source IS NOT NULL),
entries AS (SELECT *, coalesce(source_context, '') AS ctx FROM mapping_entries WHERE source_term IS NOT NULL AND destination IS NOT NULL),
goals AS (SELECT proposed_target AS target, min(ord) AS t_ord FROM names WHERE proposed_target IS NOT NULL GROUP BY 1),
terms AS (SELECT DISTINCT source AS term FROM names),
cand AS (SELECT *, concat_ws('.', target_entity, target_field) AS target FROM match_candidates WHERE source_field IS NOT NULL),
scored AS (SELECT * FROM cand WHERE score IS NOT NULL AND NOT isnan(score)),
fb AS (SELECT * EXCLUDE (rn, decision), word AS decision FROM (SELECT *, lower(trim(decision)) AS word, row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, ord DESC) AS rn
       FROM feedback WHERE lower(trim(decision)) IN ('accept', 'reject', 'correct') AND id IS NOT NULL) AS x WHERE rn = 1)
"""


def _kb(sql: str, *more: str) -> str:
    return "WITH " + ",\n".join([_KB, *more]) + "\n" + sql


def _any(c: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


def _in(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


# conflicts
_TERMS = "t AS (SELECT *, lower(source) AS term FROM m)"
_CONFLICTS = (
    _TERMS,
    """conflicts AS (SELECT term, count(DISTINCT source_schema) AS schemas, count(DISTINCT lower(destination)) AS destinations, count(*) AS n, arg_max(tier, (ord, dest_ord)) AS tier
       FROM t GROUP BY term HAVING count(DISTINCT source_schema) > 1 AND count(DISTINCT lower(destination)) > 1)""",
    "mine AS (SELECT t.* FROM t JOIN conflicts USING (term))",
)
_PRIO = "CASE source_schema " + " ".join(f"WHEN '{s}' THEN {len(normalize.PRIORITY) - k}" for k, s in enumerate(normalize.PRIORITY)) + " ELSE 0 END"
_BEST = (
    f"""per AS (SELECT term, destination, count(DISTINCT source_schema) AS schemas, max({_PRIO}) AS prio FROM mine GROUP BY ALL)""",
    "by_prio AS (SELECT term, destination FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY prio DESC, destination) AS rn FROM per) AS x WHERE rn = 1)",
    "by_freq AS (SELECT term, destination FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY schemas DESC, destination) AS rn FROM per) AS x WHERE rn = 1)",
    "equal AS (" + " UNION ALL ".join(f"SELECT term, '{g[0]}' AS destination FROM mine GROUP BY term HAVING bool_and(destination IN ({_in(g)}))" for g in EQUIVALENT) + ")",
    "auto AS (SELECT term, destination FROM equal UNION ALL SELECT term, destination FROM by_prio WHERE term NOT IN (SELECT term FROM equal))",
)

_VALID = f"coalesce(split_part(split_part({{0}}, '.', 1), ':', 1) IN ({_in(normalize.RESOURCES)}) OR starts_with({{0}}, 'Extension') OR contains(lower({{0}}), ':extension'), false) AND coalesce({{0}}, '') <> ''"


def _focus(context: str, term: str) -> str:
    c, t = f"lower(coalesce({context}, ''))", f"lower(coalesce({term}, ''))"
    cases = [f"WHEN {c} IN ({_in(w)}) THEN '{f}'" for f, w in normalize.FOCUS_CONTEXTS]
    cases += [f"WHEN {_any(c, w)} THEN '{f}'" for f, w in normalize.FOCUS_CONTEXTS]
    cases += [f"WHEN {_any(t, w)} THEN '{f}'" for f, w in normalize.FOCUS_TERMS]
    return f"CASE {' '.join(cases)} ELSE 'Specimen' END"


# names
def _stem(c: str) -> str:
    cases = " ".join(f"WHEN ends_with(lower({c}), '{s}') AND length({c}) > {len(s) + 2} THEN left(lower({c}), length({c}) - {len(s)})" for s in ("ing", "tion", "ment", "ness", "ity", "ies", "es", "s"))
    return f"CASE {cases} ELSE lower({c}) END"


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(string_split(lower(regexp_replace({c}, '([a-z])([A-Z])', '\\1_\\2', 'g')), '_'), lambda t: length(t) >= 3))"


def _sides(query: str, asked: str, source: str, names: str, q: str = "a", s: str = "b") -> tuple[str, str]:
    """Names put side by side, each split into words as it is written."""
    return (
        f"{q} AS (SELECT {query} AS query, lower({query}) AS q, {_stem(query)} AS qs, {_tokens(query)} AS qt FROM {asked} WHERE length({query}) > 0)",
        f"{s} AS (SELECT {source} AS source, lower({source}) AS s_, {_stem(source)} AS ss, {_tokens(source)} AS st FROM (SELECT DISTINCT {source} FROM {names} WHERE length({source}) >= 3) AS x)",
    )


_SCORE = """CASE WHEN q = s_ THEN 1.0 WHEN contains(s_, q) THEN length(q) / length(s_) WHEN contains(q, s_) THEN length(s_) / length(q) * 0.8
    WHEN contains(ss, qs) THEN 0.7 WHEN contains(qs, ss) THEN 0.65
    WHEN len(list_intersect(qt, st)) > 0 THEN 0.6 * len(list_intersect(qt, st)) / greatest(len(qt), len(st)) ELSE 0.0 END"""
_FUZZY = _kb(f"SELECT query, source, round(score, 6) AS score FROM (SELECT query, source, {_SCORE} AS score FROM a, b) AS x WHERE score >= 0.55", *_sides("term", "terms", "source", "sources"))

# The longest common subsequence by bits (names up to 120 letters): a zero bit of v is a place where it grows.
_MASKS = "list_transform(string_split(s_, ''), lambda ch: list_sum(list_transform(range(length(q)), lambda i: CASE WHEN q[i + 1] = ch THEN CAST(1 AS HUGEINT) << CAST(i AS INT) ELSE CAST(0 AS HUGEINT) END)))"
_FULL = "((CAST(1 AS HUGEINT) << CAST(length(q) AS INT)) - 1)"
_COMMON = f"length(q) - bit_count(list_reduce({_MASKS}, lambda v, m: ((v + (v & m)) | (v - (v & m))) & {_FULL}, {_FULL}))"
_SEARCH = _kb(
    """SELECT query, source, target, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, source, target) AS rank FROM (
      SELECT DISTINCT h.query, h.source, m.destination AS target, h.score FROM hits h JOIN m ON m.source = h.source) AS x) AS y WHERE rank <= 10""",
    "asked AS (SELECT DISTINCT source AS term FROM names WHERE id % 100 = 0)",
    *_sides("term", "asked", "source", "m"),
    f"pairs AS (SELECT *, {_SCORE} AS score FROM a, b)",
    f"""ratios AS (SELECT query, source, round(200.0 * ({_COMMON}) / (length(q) + length(s_))) / 100 AS r FROM pairs WHERE score = 0 AND 2.0 * least(length(q), length(s_)) / (length(q) + length(s_)) >= 0.69)""",
    "hits AS (SELECT query, source, round(score, 9) AS score FROM pairs WHERE round(score, 9) >= 0.3 UNION ALL SELECT query, source, round(r * 0.5, 9) FROM ratios WHERE r >= 0.7)",
)

# calibration
_PRED = """
pred AS (SELECT id, matcher, coalesce(nullif(tier, ''), '*') AS t, '*' AS sc, coalesce(nullif(source_context, ''), '*') AS cx, confidence, CAST(decision = 'accept' AS INT) AS correct
  FROM fb WHERE confidence IS NOT NULL AND NOT isnan(confidence) AND matcher IS NOT NULL),
chain AS (SELECT id, confidence, correct, list_filter([concat_ws(':', matcher, t, sc, cx), concat_ws(':', matcher, t, sc, '*'), concat_ws(':', matcher, t, '*', cx), concat_ws(':', matcher, t, '*', '*'),
  concat_ws(':', matcher, '*', '*', '*'), CASE WHEN t <> '*' THEN concat_ws(':', matcher, t) END, matcher], lambda k: k IS NOT NULL) AS ks FROM pred),
keyed AS (SELECT id, confidence, correct, unnest(list_distinct(ks)) AS key FROM chain),
stats AS (SELECT key, count(*) AS n_total, CAST(sum(correct) AS BIGINT) AS n_pos, sum(correct) >= 100 AND count(*) >= 300 AS eligible FROM keyed GROUP BY key)
"""
_BIN = "CASE WHEN confidence >= 0 AND confidence <= 1 THEN least(CAST(trunc(confidence * 10) AS INT), 9) END"
_BIN_COMPAT = "CASE " + " ".join(f"WHEN confidence >= CAST({i * 0.1!r} AS DOUBLE) AND confidence {'<' if i < 9 else '<='} CAST({(i + 1) * 0.1 if i < 9 else 1.0!r} AS DOUBLE) THEN {i}" for i in range(10)) + " END"


def _curve(b: str) -> str:
    return f"""got AS (SELECT key, {b} AS bin, avg(confidence) AS mean_conf, avg(correct) AS accuracy, count(*) AS n FROM keyed WHERE {b} IS NOT NULL GROUP BY ALL),
curve AS (SELECT k.key, CAST(i AS INT) AS bin, i / 10 AS lo, (i + 1) / 10 AS hi, coalesce(mean_conf, (i / 10 + (i + 1) / 10) / 2) AS mean_conf, coalesce(accuracy, 0.0) AS accuracy, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT key FROM keyed) AS k CROSS JOIN range(10) AS r(i) LEFT JOIN got g ON g.key = k.key AND g.bin = i)"""


_CURVE_OUT = "SELECT key, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, round(mean_conf, 9) AS mean_conf, round(accuracy, 9) AS accuracy, n FROM curve"
_SCORES = """SELECT c.id, c.confidence, h.key AS key_used, round(coalesce(h.value, c.confidence), 6) AS calibrated FROM pred c LEFT JOIN (
  SELECT id, coalesce(arg_min(key, level) FILTER (eligible), arg_max(key, level)) AS key, CASE WHEN bool_or(eligible) THEN arg_min(value, level) FILTER (eligible) ELSE arg_max(value, level) END AS value
  FROM (SELECT l.id, l.level, l.key, st.eligible, cu.accuracy AS value FROM (
      SELECT id, confidence, unnest(list_distinct(ks)) AS key FROM chain) AS l0 JOIN (
      SELECT id, x.k AS key, x.level FROM (SELECT id, unnest(list_transform(ks, lambda k, i: {'k': k, 'level': i})) AS x FROM chain) AS y
      QUALIFY row_number() OVER (PARTITION BY id, x.k ORDER BY x.level) = 1) AS l ON l.id = l0.id AND l.key = l0.key
    JOIN stats st ON st.key = l.key JOIN curve cu ON cu.key = l.key AND cu.bin = least(CAST(trunc(l0.confidence * 10) AS INT), 9)) AS z GROUP BY id) AS h ON h.id = c.id"""

# profiling
_CASE_COLUMNS = ("participant_id", "age_at_diagnosis", "primary_diagnosis", "vital_status", "gender", "race", "ethnicity", "loaded_at")


def _cells(columns: tuple[str, ...]) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {k} AS position, ord, CAST({c} AS VARCHAR) AS value FROM cases" for k, c in enumerate(columns))


_ENSEMBLE = (
    "list_sum(list_transform(map_entries(embedder_scores), lambda e: e.value * CASE e.key " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " ELSE 1.0 END)) / "
    "nullif(list_sum(list_transform(map_entries(embedder_scores), lambda e: CASE e.key " + " ".join(f"WHEN '{k}' THEN {w}" for k, w in WEIGHTS.items()) + " ELSE 1.0 END)), 0)"
)
_LEVEL = "CASE WHEN score >= 0.95 THEN 'high' WHEN score >= 0.85 THEN 'medium' ELSE 'low' END"
_TIER_PRIO = "CASE tier WHEN 'content' THEN 0 WHEN 'field' THEN 1 WHEN 'entity' THEN 2 ELSE 3 END"
_PAIR = "source_entity, source_field, target_entity, target_field"

_RULE_PATHS = (
    "by_rule AS (SELECT DISTINCT term, lower(destination) AS path FROM terms JOIN m ON terms.term = m.source)",
    """paths AS (SELECT * FROM by_rule UNION SELECT term, lower(fhir_path) FROM terms JOIN v ON lower(term) = lower(source_value) JOIN p ON v.id = p.content_value_id
       WHERE term NOT IN (SELECT term FROM by_rule))""",
    "res AS (SELECT DISTINCT term, split_part(path, '.', 1) AS res FROM paths)",
    "hits AS (SELECT term, target, t_ord, 1.0 AS score FROM paths JOIN goals ON path = lower(target) UNION ALL SELECT term, target, t_ord, 0.5 FROM res JOIN goals ON res = lower(target) WHERE NOT contains(target, '.'))",
    """ranked AS (SELECT *, row_number() OVER (PARTITION BY term ORDER BY score DESC, t_ord) AS rank FROM (
       SELECT terms.term, goals.target, goals.t_ord, coalesce(max(h.score), 0.0) AS score FROM terms CROSS JOIN goals LEFT JOIN hits h ON h.term = terms.term AND h.target = goals.target GROUP BY ALL) AS x)""",
)

_FOUND_DEST = "SELECT term, m.id, m.source_schema, m.tier, m.source_context, m.destination, m.dest_ord FROM terms JOIN m ON terms.term = m.source"
_LOOKED = _kb("SELECT DISTINCT term, id, source_schema, tier, source_context, destination, dest_ord FROM (" + _FOUND_DEST + ") AS x")

_CODED = "coded AS (SELECT coalesce(code_system, '') AS system, coalesce(code, '') AS code, coalesce(source_value, '') AS display, ord, id FROM content_values)"

_PAIRS_MINED = """pairs AS (
            SELECT 'value_id' AS term, 'Observation.identifier' AS path, 'field' AS pair_type, ord, 1 AS k FROM coded WHERE id IS NOT NULL
            UNION ALL SELECT string_split(rtrim(system, '/'), '/')[-1], 'Observation.category.coding', 'field', ord, 0 FROM coded WHERE contains(system, '/') AND string_split(rtrim(system, '/'), '/')[-1] NOT IN ('sct', 'CodeSystem', 'ValueSet', '')
            UNION ALL SELECT display, 'Observation.category.coding', 'content', ord, 0 FROM coded WHERE display <> '')"""

# cascade
_EXACT = ("exact AS (SELECT term AS name, arg_min(destination, dest_ord) AS target, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS stage FROM (" + _FOUND_DEST + ") AS x GROUP BY term)",)


def _fuzzy_best(hits: str, name: str, cap: float) -> str:
    return f"""SELECT {name} AS name, target, round(least(score, {cap}), 3) AS confidence, 'fuzzy' AS stage FROM (
            SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY score DESC, source, target) AS rn FROM (
              SELECT DISTINCT {name}, h.source, m.destination AS target, h.score FROM {hits} h JOIN m ON m.source = h.source WHERE h.score >= 0.55 AND contains(m.destination, '.')) AS x) AS y WHERE rn = 1"""


def _vector(c: str, n: int = 3) -> str:
    """Hashed groups of n letters of a name, in 64 places."""
    p = f"('#' || lower({c}) || '#')"
    places = f"list_transform(range(1, greatest(length({p}) - {n - 1}, 1) + 1), lambda i: CAST(('0x' || left(md5(substr({p}, i, {n})), 8)) AS BIGINT) % 64)"
    return f"list_transform(range(64), lambda d: CAST(len(list_filter({places}, lambda x: x = d)) AS DOUBLE))"


_MAPPED = (
    *_EXACT,
    "open1 AS (SELECT term FROM terms WHERE term NOT IN (SELECT name FROM exact))",
    *_sides("term", "open1", "source", "s", "fa", "fbk"),
    f"fz AS (SELECT query, source, {_SCORE} AS score FROM fa, fbk)",
    f"second AS ({_fuzzy_best('fz', 'query', 1.0)})",
    "open2 AS (SELECT term FROM open1 WHERE term NOT IN (SELECT name FROM second))",
    f"goal AS (SELECT destination, {_vector('destination')} AS w FROM (SELECT destination, count(*) AS n FROM d WHERE contains(destination, '.') GROUP BY 1 ORDER BY n DESC, destination LIMIT 400) AS x)",
    f"vec AS (SELECT term, {_vector('term')} AS v FROM open2)",
    """near AS (SELECT term, destination, raw FROM (SELECT *, row_number() OVER (PARTITION BY term ORDER BY raw DESC, destination) AS rn FROM (
        SELECT term, destination, least(round(list_cosine_similarity(v, w), 9), 1.0) AS raw FROM vec, goal) AS x WHERE raw IS NOT NULL AND NOT isnan(raw)) AS y WHERE rn = 1)""",
    """used AS (SELECT coalesce(arg_min(key, level) FILTER (eligible), arg_max(key, level)) AS key FROM (VALUES (0, 'biobert:field:*:*'), (1, 'biobert:*:*:*'), (2, 'biobert:field'), (3, 'biobert')) AS k(level, key) JOIN stats USING (key))""",
    """third AS (SELECT * FROM (SELECT term AS name, destination AS target, coalesce((SELECT accuracy FROM curve JOIN used USING (key) WHERE bin = least(CAST(trunc(raw * 10) AS INT), 9)), raw) AS confidence FROM near) AS x WHERE confidence >= 0.5)""",
    """mapped AS (SELECT * FROM exact UNION ALL SELECT * FROM second UNION ALL SELECT name, target, round(confidence, 3), 'vector' FROM third UNION ALL
        SELECT term, NULL, 0.0, 'unmapped' FROM open2 WHERE term NOT IN (SELECT name FROM third))""",
)
_CONSTRAINED = (
    "c AS (SELECT source AS name, coalesce(list_sort(list_distinct(list(proposed_target) FILTER (proposed_target IS NOT NULL))), []) AS candidates FROM names GROUP BY 1)",
    """exact AS (SELECT c.name, arg_min(destination, dest_ord) AS target, CAST(1.0 AS DOUBLE) AS confidence, 'exact' AS stage FROM c JOIN m ON c.name = m.source
        WHERE len(candidates) = 0 OR list_contains(candidates, destination) GROUP BY c.name)""",
    """forms AS (SELECT name, unnest(list_distinct(list_filter([name, CASE WHEN ends_with(name, 'ing') THEN left(name, length(name) - 3) || 'e' END, CASE WHEN ends_with(name, 'ing') THEN left(name, length(name) - 3) END,
        CASE WHEN ends_with(name, 's') THEN left(name, length(name) - 1) END], lambda x: x IS NOT NULL))) AS form FROM c WHERE name NOT IN (SELECT name FROM exact))""",
    *_sides("form", "(SELECT DISTINCT form FROM forms)", "source", "s", "fa", "fbk"),
    f"fz AS (SELECT name, source, {_SCORE} AS score FROM fa JOIN forms ON form = query, fbk)",
    f"tried AS ({_fuzzy_best('fz', 'name', 0.9)})",
    "second AS (SELECT t.* FROM tried t JOIN c USING (name) WHERE len(candidates) = 0 OR list_contains(candidates, target))",
)
_VERDICT = """
gold AS (SELECT source AS name, list_sort(list_distinct(list(CASE decision WHEN 'correct' THEN ground_truth WHEN 'accept' THEN proposed_target END) FILTER (
    CASE decision WHEN 'correct' THEN ground_truth WHEN 'accept' THEN proposed_target END IS NOT NULL))) AS accept, min(tier) AS stratum FROM fb WHERE source IS NOT NULL GROUP BY 1),
judged AS (SELECT g.name, g.stratum, CASE WHEN target IS NULL OR target IN ('', '—', 'None') THEN 'UNMAPPED' WHEN list_contains(accept, target) THEN 'EXACT'
    WHEN len(list_filter(accept, lambda a: split_part(a, '.', 1) = split_part(target, '.', 1) AND (starts_with(target, a || '.') OR starts_with(a, target || '.') OR
      string_split(target, '.')[1:2] = string_split(a, '.')[1:2]))) > 0 THEN 'FAMILY' ELSE 'WRONG' END AS verdict
  FROM gold g JOIN mapped USING (name) WHERE len(accept) > 0)
"""


def _part(label: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{label}' || {c} END"


def _ref(label: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' THEN '{label}->Reference(' || {c} || ')' END"


_PAIR_VALUE = f"""concat_ws(' | ', destination, CASE WHEN dest_system <> '' THEN 'system=' || dest_system || '|code=' || dest_code END, {_part("display=", "dest_display")}, {_part("unit=", "unit")},
  {_ref("subject", "subject_ref")}, {_ref("focus", "focus_ref")}, {_ref("specimen", "specimen_ref")})"""

_FIX_CASE = "CASE destination " + " ".join(f"WHEN '{o}' THEN '{n}'" for o, n, a in FIXES if n and a == "update") + " ELSE destination END"
_FIX_GONE = _in(o for o, n, a in FIXES if not n or a == "delete")


def _merge_sql(fold: str, least: int, columns: str) -> str:
    d = f"{fold}(destination)" if fold else "destination"
    return _kb(
        f"SELECT source_schema || ':' || source_term AS id, {columns} FROM (SELECT source_schema, source_term, {d} AS dk, arg_min(destination, ord) AS destination, arg_min(tier, ord) AS tier, count(*) AS n FROM entries "
        f"WHERE source_schema IS NOT NULL GROUP BY ALL) AS e WHERE n >= {least} AND NOT EXISTS (SELECT 1 FROM have h WHERE h.source_schema = e.source_schema AND h.term = e.source_term AND h.dk = e.dk)",
        f"have AS (SELECT DISTINCT source_schema, source AS term, {d} AS dk FROM m)",
    )


def oracle_sql() -> dict[str, str]:
    rank = "row_number() OVER (PARTITION BY tier, source_field ORDER BY score DESC, ord)"
    return {
        "p5_found": f"SELECT table_name, ord FROM ({_ORPHANS}) AS o",
        "p5_periods": _PERIODS,
        "kb_lookup": _LOOKED,
        "kb_lookup_context": _kb(
            """SELECT a.term, a.context, a.schema, l.id, d.destination FROM (SELECT DISTINCT source AS term, coalesce(source_context, '') AS context, CASE WHEN tier = 'content' THEN 'geo' ELSE '' END AS schema FROM names) AS a
            JOIN (SELECT source, source_context, arg_max(id, ord) AS id, arg_max(source_schema, ord) AS source_schema FROM s GROUP BY ALL) AS l ON a.term = l.source AND a.context = l.source_context
            JOIN d ON d.source_id = l.id WHERE a.schema = '' OR a.schema = l.source_schema"""
        ),
        "kb_reverse_lookup": _kb("SELECT path, destination, id, source FROM (SELECT DISTINCT lower(proposed_target) AS path FROM names WHERE proposed_target IS NOT NULL) AS a JOIN m ON path = lower(destination)"),
        "kb_filter_tier": _kb("SELECT id, source, destination FROM m WHERE tier = 'entity'"),
        "kb_filter_schema": _kb("SELECT id, source, destination FROM m WHERE source_schema = 'geo'"),
        "kb_tier_candidates": _kb("SELECT DISTINCT destination FROM m WHERE tier = 'content'"),
        "kb_stats": _kb(
            """SELECT (SELECT count(*) FROM s) AS sources, (SELECT string_agg(DISTINCT source_schema, ',' ORDER BY source_schema) FROM s) AS schemas, (SELECT string_agg(DISTINCT tier, ',' ORDER BY tier) FROM s) AS tiers,
            (SELECT count(*) FROM d) AS destinations, (SELECT count(*) FROM v) AS content_values, (SELECT count(*) FROM p) AS content_targets"""
        ),
        "kb_training_pairs": _kb(f"SELECT CASE WHEN source_context <> '' THEN source_context || '.' || source ELSE source END AS key, {_PAIR_VALUE} AS value FROM m"),
        "kb_expertise": _kb(
            """SELECT term, string_agg(path, ' | ' ORDER BY a, b, path) AS paths FROM (SELECT term, path, min((a, b)) AS o, o[1] AS a, o[2] AS b FROM (
            SELECT lower(source) AS term, destination AS path, 0 AS a, dest_ord AS b FROM m UNION ALL
            SELECT lower(source_value), fhir_path, 1, t_ord FROM v JOIN p ON v.id = p.content_value_id) AS x GROUP BY term, path) AS y GROUP BY term"""
        ),
        "content_lookup": _kb(
            """SELECT c.value, v.id, v.code, coalesce((SELECT string_agg(fhir_path, ' | ' ORDER BY t_ord) FROM p WHERE p.content_value_id = v.id), '') AS paths
            FROM (SELECT DISTINCT primary_diagnosis AS value FROM cases WHERE primary_diagnosis IS NOT NULL) AS c JOIN v ON lower(c.value) = lower(v.source_value) AND v.source_category = 'primary_diagnosis'"""
        ),
        "content_by_path": _kb("SELECT path, v.id, source_value, source_category, code FROM (SELECT DISTINCT destination AS path FROM mapping_entries WHERE destination IS NOT NULL) AS a JOIN p ON lower(path) = lower(fhir_path) JOIN v ON v.id = p.content_value_id"),
        "kb_merge": _merge_sql("lower", 1, "destination, tier, n"),
        "kb_merge_counted": _merge_sql("", 2, "destination, n"),
        "kb_without_destination": _kb("SELECT id, source FROM s WHERE id NOT IN (SELECT source_id FROM d)"),
        "kb_multi_destination": _kb("SELECT source_schema, tier, source, count(DISTINCT destination) AS n, string_agg(DISTINCT destination, ', ' ORDER BY destination) AS destinations FROM m GROUP BY ALL HAVING count(DISTINCT destination) > 1"),
        "kb_counts": _kb("SELECT source_schema, tier, count(DISTINCT id) AS sources, count(*) AS destinations FROM m GROUP BY ALL"),
        "kb_top_destinations": _kb("SELECT destination, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, destination LIMIT 15"),
        "kb_repair_counts": _kb(
            """SELECT count(*) FILTER (lower(source) = lower(destination)) AS self_mappings, count(*) FILTER (tier = 'content' AND NOT contains(destination, '.')) AS content_without_path,
            count(*) FILTER (tier = 'entity' AND contains(destination, '.')) AS entity_with_path, (SELECT count(*) FROM s WHERE id NOT IN (SELECT source_id FROM d)) AS without_destination FROM m"""
        ),
        "kb_path_fixes": _kb(f"SELECT {_FIX_CASE} AS destination, count(*) AS n FROM d WHERE destination NOT IN ({_FIX_GONE}) AND source_id IN (SELECT id FROM s) GROUP BY 1"),
        "kb_delete_like": _kb("SELECT destination, count(*) AS n FROM d WHERE destination NOT ILIKE '%SPECIMEN%' GROUP BY 1"),
        "conflicts_destination": _kb(
            """SELECT destination, term, schemas, contexts, n, terms, total FROM (SELECT *, count(*) OVER (PARTITION BY destination) AS terms, CAST(sum(n) OVER (PARTITION BY destination) AS BIGINT) AS total FROM (
            SELECT lower(destination) AS destination, lower(source) AS term, string_agg(DISTINCT source_schema, ',' ORDER BY source_schema) AS schemas,
            coalesce(string_agg(DISTINCT nullif(source_context, ''), ',' ORDER BY nullif(source_context, '')), '') AS contexts, count(*) AS n FROM m GROUP BY 1, 2) AS x) AS y WHERE terms > 1"""
        ),
        "conflicts_schema": _kb("SELECT * FROM conflicts", *_CONFLICTS),
        "multi_destinations": _kb("SELECT id, source, source_schema, count(*) AS n, string_agg(destination, ' | ' ORDER BY dest_ord) AS destinations FROM m GROUP BY ALL HAVING count(*) > 1"),
        "resolve_priority": _kb("SELECT term, destination, 'priority' AS method FROM by_prio", *_CONFLICTS, *_BEST),
        "resolve_frequency": _kb("SELECT term, destination, 'frequency' AS method FROM by_freq", *_CONFLICTS, *_BEST),
        "resolve_equivalent": _kb("SELECT term, destination, 'equivalence' AS method FROM equal", *_CONFLICTS, *_BEST),
        "resolve_clinical": _kb(f"SELECT term, '{CLINICAL[0]}' AS destination, 'equivalence' AS method FROM mine GROUP BY term HAVING bool_and(destination IN ({_in(CLINICAL)}))", *_CONFLICTS),
        "canonical_rows": _kb("SELECT 'canonical:' || term AS id, term AS source, 'canonical' AS source_schema, destination FROM auto", *_CONFLICTS, *_BEST),
        "normalization_report": _kb(
            """SELECT terms, conflicts, resolved, coalesce(round(conflicts / nullif(terms, 0), 6), 0.0) AS conflict_rate, coalesce(round(resolved / nullif(conflicts, 0), 6), 1.0) AS resolution_rate FROM (
            SELECT (SELECT count(DISTINCT term) FROM t) AS terms, (SELECT count(*) FROM conflicts) AS conflicts, (SELECT count(*) FROM auto) AS resolved) AS x""",
            *_CONFLICTS, *_BEST,
        ),
        "ground_truth_metrics": _kb(
            """SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN d_ IS NULL THEN 'no_match' WHEN list_contains(d_, lower(destination)) THEN 'exact'
              WHEN len(list_filter(d_, lambda x: split_part(x, '.', 1) = split_part(lower(destination), '.', 1))) > 0 THEN 'resource' ELSE 'mismatch' END AS verdict FROM (
              SELECT g.destination, coalesce(o.ds, l.ds) AS d_ FROM (SELECT regexp_replace(source_term, '_r1$', '') AS term, source_schema, destination FROM entries) AS g
              LEFT JOIN (SELECT source, source_schema, list(lower(destination)) AS ds FROM m GROUP BY ALL) AS o ON o.source = g.term AND o.source_schema = g.source_schema
              LEFT JOIN (SELECT source, list(lower(destination)) AS ds FROM m GROUP BY ALL) AS l ON l.source = g.term) AS x) AS y GROUP BY 1"""
        ),
        "valid_paths": f"SELECT DISTINCT destination, {_VALID.format('destination')} AS valid FROM destinations",
        "passthrough_fix": _kb(f"SELECT NOT ({_VALID.format('destination')}) AS changed, CASE WHEN {_VALID.format('destination')} THEN focus_ref ELSE {_focus('source_context', 'source')} END AS focus_ref, count(*) AS n FROM m GROUP BY ALL"),
        "focus_refs": f"SELECT DISTINCT source_context, source, {_focus('source_context', 'source')} AS focus FROM sources",
        "path_validation": _kb(
            """SELECT path, dotted AND ex IS NOT NULL AND known AS valid, CASE WHEN dotted THEN coalesce(ex, lo, '') ELSE '' END AS resource, CASE WHEN dotted AND ex IS NOT NULL AND known THEN f ELSE '' END AS field,
            CASE WHEN NOT dotted THEN 'no field' WHEN ex IS NULL AND lo IS NOT NULL THEN 'class spelled ' || lo WHEN ex IS NULL THEN 'no class ' || r WHEN known THEN ''
              WHEN regexp_matches(f, '^(nci_|gdc_|htan_)') THEN 'local slot ' || f WHEN fl IS NOT NULL THEN 'slot spelled ' || fl ELSE 'no slot ' || f END AS issue
            FROM (SELECT a.*, contains(path, '.') AS dotted, (SELECT min(class) FROM fields WHERE class = r) AS ex, (SELECT min(class) FROM fields WHERE lower(class) = lower(r)) AS lo,
              EXISTS (SELECT 1 FROM fields WHERE class = r AND slot = f) AS known, (SELECT min(slot) FROM fields WHERE class = r AND lower(slot) = lower(f)) AS fl
              FROM (SELECT DISTINCT destination AS path, split_part(destination, '.', 1) AS r, split_part(destination, '.', 2) AS f FROM mapping_entries WHERE destination IS NOT NULL) AS a) AS x""",
            "fields AS (SELECT DISTINCT split_part(destination, '.', 1) AS class, split_part(destination, '.', 2) AS slot FROM destinations WHERE contains(destination, '.') AND split_part(destination, '.', 1) <> 'Procedure' AND split_part(destination, '.', 2) <> 'identifier')",
        ),
        "rule_match_topk": _kb("SELECT term, target, CAST(score AS DOUBLE) AS score, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5", *_RULE_PATHS),
        "rule_match_metadata": _kb(
            """SELECT x.term, g.target, CAST(1.0 AS DOUBLE) AS score, x.dest_system, x.dest_code, x.subject_ref, x.focus_ref FROM (
            SELECT terms.term, m.*, row_number() OVER (PARTITION BY terms.term, lower(destination) ORDER BY dest_ord) AS rn FROM terms JOIN m ON terms.term = m.source) AS x JOIN goals g ON lower(x.destination) = lower(g.target) WHERE rn = 1"""
        ),
        "fuzzy_pairs": _FUZZY,
        "fuzzy_lookup": _SEARCH,
        "expert_match": _kb(
            """SELECT DISTINCT a.term, g.target, CASE WHEN g.target IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS score FROM terms a LEFT JOIN (
            SELECT lower(source) AS t, destination AS path FROM m UNION SELECT lower(source_value), fhir_path FROM v JOIN p ON v.id = p.content_value_id) AS e ON lower(a.term) = e.t
            LEFT JOIN goals g ON e.path = g.target WHERE e.path IS NULL OR g.target IS NOT NULL"""
        ),
        "ensemble_scores": _kb(f"SELECT ord, round({_ENSEMBLE}, 6) AS score FROM cand"),
        "confidence_levels": _kb(f"SELECT tier, {_LEVEL} AS level, CASE WHEN score >= 0.95 THEN 'AUTO-ACCEPT' WHEN score >= 0.85 THEN 'HITL REVIEW' ELSE 'REJECT' END AS route, count(*) AS n FROM scored GROUP BY ALL"),
        "dedupe_matches": _kb(f"SELECT {_PAIR}, tier, score, ord FROM (SELECT *, row_number() OVER (PARTITION BY {_PAIR} ORDER BY {_TIER_PRIO}, score DESC, ord) AS rn FROM scored) AS x WHERE rn = 1"),
        "tier_run": _kb(
            f"""SELECT {_PAIR}, tier, round(score, 6) AS score, level, level = 'medium' AS requires_review, CAST(rank AS INT) AS rank FROM (
            SELECT *, row_number() OVER (PARTITION BY source_entity, source_field ORDER BY score DESC, ord) AS rank FROM (
              SELECT *, row_number() OVER (PARTITION BY {_PAIR} ORDER BY {_TIER_PRIO}, score DESC, ord) AS rn FROM (
                SELECT *, {_LEVEL} AS level FROM (SELECT * EXCLUDE (score), {_ENSEMBLE} AS score FROM cand) AS a WHERE score IS NOT NULL) AS b WHERE level <> 'low') AS c WHERE rn = 1) AS e WHERE rank <= 5"""
        ),
        "nearest_vectors": """SELECT query_id, id, round(similarity, 6) AS similarity, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM (
            SELECT q.vec_id AS query_id, e.vec_id AS id, list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])) AS similarity FROM embeddings q JOIN embeddings e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0) AS x) AS y WHERE rank <= 5""",
        "rank_metrics": _kb(
            f"""SELECT tier, n, round(p, 6) AS p_at_1, round(r, 6) AS r_at_k, round(mrr, 6) AS mrr, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 6) AS f1 FROM (
            SELECT tier, count(*) AS n, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS p, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS r, avg(CASE WHEN rank <= 5 THEN CAST(1 AS DOUBLE) / rank ELSE 0.0 END) AS mrr FROM (
            SELECT tier, source_field, min(rk) FILTER (hit) AS rank FROM (SELECT *, {rank} AS rk FROM (SELECT tier, source_field, target, max(score) AS score, min(ord) AS ord, bool_or(coalesce(user_feedback, false)) AS hit FROM scored GROUP BY ALL) AS a) AS b GROUP BY ALL) AS c GROUP BY tier) AS e"""
        ),
        "top1_outcomes": _kb(
            """SELECT id, target, score, EXISTS (SELECT 1 FROM fb AS f WHERE f.decision = 'accept' AND f.source = x.id AND lower(f.proposed_target) = lower(x.target)) AS correct FROM (
            SELECT source_field AS id, target, score, row_number() OVER (PARTITION BY source_field ORDER BY score DESC, ord) AS rn FROM scored) AS x WHERE rn = 1"""
        ),
        "calib_keys": _kb("SELECT * FROM stats", _PRED),
        "calib_curve": _kb(_CURVE_OUT, _PRED, _curve(_BIN)),
        "calib_curve_compat": _kb(_CURVE_OUT, _PRED, _curve(_BIN_COMPAT)),
        "calib_ece": _kb(
            """SELECT key, n, round(accuracy, 9) AS accuracy, round(mean_conf, 9) AS mean_conf, round(e, 9) AS ece, CASE WHEN e < 0.05 THEN 'well calibrated' WHEN e < 0.15 THEN 'moderately calibrated' ELSE 'poorly calibrated' END AS verdict FROM (
            SELECT a.key, a.n, a.accuracy, a.mean_conf, g.gap / a.n AS e FROM (SELECT key, count(*) AS n, avg(correct) AS accuracy, avg(confidence) AS mean_conf FROM keyed GROUP BY key) AS a
            JOIN (SELECT key, sum(n * abs(mean_conf - accuracy)) AS gap FROM curve GROUP BY key) AS g USING (key)) AS x""",
            _PRED, _curve(_BIN),
        ),
        "calib_scores": _kb(_SCORES, _PRED, _curve(_BIN)),
        "profile_columns": f"SELECT column_name, CAST(position AS INT) AS position, count(*) AS row_count, count(*) FILTER (value IS NULL) AS null_count, count(DISTINCT value) AS distinct_count FROM ({_cells(_CASE_COLUMNS)}) AS x GROUP BY ALL",
        "profile_samples": f"SELECT column_name, string_agg(value, ' | ' ORDER BY rn) AS samples FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY ord, value) AS rn FROM ({_cells(_CASE_COLUMNS)}) AS x WHERE value IS NOT NULL) AS y WHERE rn <= 3 GROUP BY 1",
        "schema_summary": f"""SELECT entity, CAST(sum(c) AS BIGINT) AS row_count, CAST(sum(k) AS BIGINT) AS field_count, CASE WHEN entity IS NOT NULL THEN max(f) END AS first_columns FROM (
            SELECT 'cases' AS entity, (SELECT count(*) FROM cases) AS c, 9 AS k, 'ord, {", ".join(_CASE_COLUMNS)}' AS f
            UNION ALL SELECT 'sources', (SELECT count(*) FROM sources), 8, 'ord, id, source, source_schema, tier, source_context, loaded_at, deleted_at'
            UNION ALL SELECT 'destinations', (SELECT count(*) FROM destinations), 15, 'ord, id, source_id, destination, entity, dest_system, dest_code, dest_display, unit, unit_system') AS x GROUP BY ROLLUP (entity)""",
        "json_field_usage": """SELECT 'k' AS path, count(*) AS n, 'Event' AS resource, (SELECT string_agg(value, '|' ORDER BY o, value) FROM (
            SELECT left(json_extract_string(props, '$.k'), 100) AS value, min(event_id) AS o FROM events GROUP BY 1 ORDER BY o, value LIMIT 10) AS x) AS samples FROM events WHERE json_exists(props, '$.k')""",
        "json_coding_usage": f"WITH {_CODED} SELECT system, code, count(*) AS n, arg_min(display, ord) AS display, 'Observation.category.coding' AS path FROM coded GROUP BY system, code",
        "json_coding_systems": f"WITH {_CODED} SELECT system, count(*) AS n FROM coded GROUP BY system",
        "json_reference_usage": "SELECT 'Observation' AS resource, 'subject' AS field, 'Patient' AS target, count(*) AS n FROM content_values WHERE id IS NOT NULL",
        "json_pair_usage": f"""WITH {_CODED}, {_PAIRS_MINED}
            SELECT 'gdc' AS schema, term, path, count(*) AS n, arg_min(pair_type, (ord, k, pair_type)) AS pair_type, CASE WHEN arg_min(pair_type, (ord, k, pair_type)) = 'content' THEN 'content' ELSE 'field' END AS tier FROM pairs GROUP BY term, path""",
        "url_terms": """SELECT DISTINCT dest_system AS url, CASE WHEN dest_system = '' THEN '' """
        + " ".join(f"WHEN contains(dest_system, '{dom}') THEN '{s}'" for dom, s in DOMAINS)
        + """ ELSE split_part(split_part(replace(replace(dest_system, 'https://', ''), 'http://', ''), '/', 1), '.', 1) END AS schema,
            CASE WHEN contains(dest_system, '/') AND string_split(rtrim(dest_system, '/'), '/')[-1] NOT IN ('sct', 'CodeSystem', 'ValueSet', '') THEN string_split(rtrim(dest_system, '/'), '/')[-1] ELSE '' END AS term
            FROM destinations WHERE dest_system IS NOT NULL""",
        **oracle_profile.oracle_sql(UNIT_SUFFIXES, tuple((e, c, k) for e, columns in (oracle_profile.TABLES | COHORT).items() for k, c in enumerate(columns))),
        "minted_ids": """SELECT id, lower(left(h, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', CAST(('0x' || substr(h, 17, 1)) AS INT) % 4 + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)) AS uuid
            FROM (SELECT DISTINCT id, sha1(unhex('6ba7b8109dad11d180b400c04fd430c8') || encode(id)) AS h FROM sources WHERE id IS NOT NULL) AS x""",
        "hitl_export": _kb(
            """SELECT term, CAST(to_json(list_sort(list({'destination': destination, 'schemas': schemas, 'suggested': destination = chosen}))) AS VARCHAR) AS options, 'pending' AS status FROM (
            SELECT p.term, p.destination, list_sort(list(DISTINCT p.source_schema)) AS schemas, any_value(b.destination) AS chosen FROM mine p JOIN by_prio b USING (term) GROUP BY ALL) AS x GROUP BY term""",
            *_CONFLICTS, *_BEST,
        ),
        "ground_truth_rows": f"""WITH {_CODED}, {_PAIRS_MINED}, mined AS (SELECT term, 'gdc' AS schema, path AS destination FROM pairs GROUP BY term, path HAVING count(*) >= 3)
            SELECT term, schema, destination, min(origin) AS origin FROM (
              SELECT source_term AS term, source_schema AS schema, destination, 'curated' AS origin FROM mapping_entries WHERE source_term IS NOT NULL AND destination IS NOT NULL
              UNION ALL SELECT term, schema, destination, 'mined' FROM mined) AS x GROUP BY term, schema, destination""",
        "name_parts": f"SELECT DISTINCT source, {_stem('source')} AS stem, array_to_string(list_sort({_tokens('source')}), ',') AS tokens, left(translate(lower(source), ' -', '__'), 50) AS safe_id FROM sources WHERE source IS NOT NULL",
        "name_variants": """SELECT source, unnest(list_distinct(list_filter([source, CASE WHEN ends_with(source, 'ing') THEN left(source, length(source) - 3) || 'e' END, CASE WHEN ends_with(source, 'ing') THEN left(source, length(source) - 3) END,
            CASE WHEN ends_with(source, 's') THEN left(source, length(source) - 1) END], lambda x: x IS NOT NULL))) AS variant FROM (SELECT DISTINCT source FROM sources WHERE source IS NOT NULL) AS x""",
        "characteristics": r"""SELECT ord, key, arg_max(value, i) AS value FROM (
            SELECT ord, x.i, replace(lower(regexp_replace(split_part(x.p, ':', 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g')), ' ', '_') AS key, regexp_replace(substr(x.p, instr(x.p, ':') + 1), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS value FROM (
            SELECT ord, unnest(list_transform(string_split(source, ';'), lambda p, i: {'p': p, 'i': i})) AS x FROM sources WHERE contains(source, ': ')) AS y WHERE contains(x.p, ':')) AS z GROUP BY ord, key""",
        "category_paths": """SELECT DISTINCT source_category, CASE WHEN regexp_matches(lower(source_category), 'condition|diagnosis|histology') THEN 'Condition.code' WHEN regexp_matches(lower(source_category), 'staging|grade|stage') THEN 'Observation.valueCodeableConcept'
            WHEN regexp_matches(lower(source_category), 'tissue|specimen|sample') THEN 'Specimen.type' WHEN regexp_matches(lower(source_category), 'anatomical|location|site|metastasis') THEN 'Specimen.collection.bodySite'
            WHEN contains(lower(source_category), 'procedure') THEN 'Procedure.code' ELSE 'Observation.valueCodeableConcept' END AS path FROM content_values WHERE source_category IS NOT NULL""",
        "feedback_stats": _kb(
            """SELECT CASE grouping(matcher, tier, decision) WHEN 7 THEN 'total' WHEN 6 THEN 'decision' WHEN 2 THEN 'matcher' ELSE 'tier' END AS grouping, matcher, tier, decision, count(*) AS n
            FROM fb GROUP BY GROUPING SETS ((decision), (matcher, decision), (tier, decision), ())"""
        ),
        "feedback_recent": _kb("SELECT id, match_id, decision FROM fb ORDER BY decided_at DESC, id DESC LIMIT 50"),
        "feedback_new_mappings": _kb(
            """SELECT source, source_context, dest AS destination, tier, count(*) AS n FROM (SELECT *, CASE decision WHEN 'accept' THEN coalesce(nullif(ground_truth, ''), proposed_target) WHEN 'correct' THEN nullif(ground_truth, '') END AS dest FROM fb) AS x
            WHERE dest IS NOT NULL GROUP BY ALL"""
        ),
        "consensus_vote": _kb(
            """SELECT item, target, votes, mc AS mean_confidence, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY votes DESC, mc DESC, target) AS rank FROM (
            SELECT match_id AS item, CASE WHEN decision = 'correct' THEN ground_truth ELSE proposed_target END AS target, count(DISTINCT user_id) AS votes, round(avg(confidence), 9) AS mc FROM fb
            WHERE user_id IS NOT NULL AND confidence IS NOT NULL AND NOT isnan(confidence) AND decision <> 'reject' GROUP BY 1, 2) AS x WHERE target IS NOT NULL AND target <> '') AS y WHERE rank <= 3"""
        ),
        "stream_feedback_stats": "SELECT matcher, tier, lower(trim(decision)) AS decision, count(*) AS n FROM feedback WHERE lower(trim(decision)) IN ('accept', 'reject', 'correct') GROUP BY ALL",
        "stream_windows": "SELECT time_bucket(INTERVAL 7 DAY, decided_at, TIMESTAMP '1970-01-01') AS start, lower(trim(decision)) AS decision, count(*) AS n FROM feedback WHERE decided_at IS NOT NULL GROUP BY ALL",
        "cascade_map": _kb("SELECT * FROM mapped", _PRED, _curve(_BIN), *_MAPPED),
        "cascade_constrained": _kb(
            """SELECT * FROM exact UNION ALL SELECT * FROM second UNION ALL SELECT name, NULL, 0.0, 'needs_review' FROM c WHERE name NOT IN (SELECT name FROM exact) AND name NOT IN (SELECT name FROM second)""",
            *_CONSTRAINED,
        ),
        "cascade_coverage": _kb(
            """SELECT stage, count(*) AS n, round(count(*) / (SELECT count(*) FROM mapped), 6) AS share FROM mapped GROUP BY stage
            UNION ALL SELECT 'mapped', count(target), round(count(target) / count(*), 6) FROM mapped""",
            _PRED, _curve(_BIN), *_MAPPED,
        ),
        "eval_verdicts": _kb("SELECT * FROM judged", _PRED, _curve(_BIN), *_MAPPED, _VERDICT),
        "eval_report": _kb(
            """SELECT coalesce(stratum, 'ALL') AS stratum, count(*) AS n, count(*) FILTER (verdict = 'EXACT') AS exact, count(*) FILTER (verdict = 'FAMILY') AS family, count(*) FILTER (verdict = 'WRONG') AS wrong,
            count(*) FILTER (verdict = 'UNMAPPED') AS unmapped, round(count(*) FILTER (verdict IN ('EXACT', 'FAMILY')) / count(*), 6) AS usable FROM judged GROUP BY ROLLUP (stratum)""",
            _PRED, _curve(_BIN), *_MAPPED, _VERDICT,
        ),
    }
