"""Column expressions over names, paths, URLs and small texts. Pure functions Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes tried in this order by stem().
SUFFIXES = ("ing", "tion", "ment", "ness", "ity", "ies", "es", "s")
# Schema names by the domain a system URL contains, tried in this order.
DOMAINS = (
    ("gdc.cancer.gov", "gdc"), ("cadsr.cancer.gov", "cadsr"), ("ncit.nci.nih.gov", "ncit"), ("snomed.info", "snomed"),
    ("loinc.org", "loinc"), ("hl7.org", "hl7"), ("unitsofmeasure.org", "ucum"),
)
# Last URL segments that name no term.
NO_TERM = ("sct", "CodeSystem", "ValueSet", "")


def first_of(cases: list[tuple[Column, object]], default: object) -> Column:
    """CASE with the cases in order."""
    out = None
    for test, value in cases:
        value = value if isinstance(value, Column) else F.lit(value)
        out = F.when(test, value) if out is None else out.when(test, value)
    default = default if isinstance(default, Column) else F.lit(default)
    return out.otherwise(default) if out is not None else default


def has_any(c: Column, words: tuple[str, ...] | list[str]) -> Column:
    """Whether the text contains any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def stem(c: Column) -> Column:
    """Lower case without the first suffix that leaves more than two letters."""
    low = F.lower(c)
    return first_of([(low.endswith(s) & (F.length(low) > len(s) + 2), F.left(low, F.length(low) - len(s))) for s in SUFFIXES], low)


def tokens(c: Column) -> Column:
    """Distinct words of three letters or more; words part at `_` and at a change from small to capital."""
    parts = F.split(F.lower(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2")), "_")
    return F.array_distinct(F.filter(parts, lambda t: F.length(t) >= 3))


def lcs_ratio(a: Column, b: Column) -> Column:
    """2 * longest common subsequence / total length, rounded to whole percent, as a fraction."""
    right = F.split(b, "")

    def step(row: Column, ch: Column) -> Column:
        def cell(new: Column, j: Column) -> Column:
            here = F.when(F.element_at(right, j) == ch, F.element_at(row, j) + 1).otherwise(F.greatest(F.element_at(row, j + 1), F.element_at(new, -1)))
            return F.array_append(new, here)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.length(b), F.lit(1))), F.array(F.lit(0)), cell)

    last = F.aggregate(F.split(a, ""), F.transform(F.sequence(F.lit(0), F.length(b)), lambda _: F.lit(0)), step)
    total = F.length(a) + F.length(b)
    return F.when((F.length(a) == 0) | (F.length(b) == 0), 0.0).otherwise(F.round(2.0 * F.element_at(last, -1) / total * 100) / 100.0)


def fuzzy_score(query: Column, source: Column, ratio: bool = True) -> Column:
    """Likeness of two names in 0..1, the first rule that applies: equal; one contains the other; one stem
    contains the other; shared words; with `ratio`, common subsequence. Names are compared in lower case."""
    q, s = F.lower(query), F.lower(source)
    qs, ss = stem(q), stem(s)
    n, m = F.length(q).cast("double"), F.length(s).cast("double")
    qt, st = tokens(query), tokens(source)
    both = F.size(F.array_intersect(qt, st)).cast("double")
    most = F.greatest(F.size(qt), F.size(st)).cast("double")
    by_ratio = F.lit(0.0)
    if ratio:
        r = lcs_ratio(q, s)
        by_ratio = F.when(r >= F.lit(0.7), r * F.lit(0.5)).otherwise(0.0)
    cases = [
        (q == s, 1.0),
        (s.contains(q), n / m),
        (q.contains(s), m / n * F.lit(0.8)),
        (ss.contains(qs), 0.7),
        (qs.contains(ss), 0.65),
        (both > 0, F.lit(0.6) * both / most),
    ]
    return F.when((F.length(q) == 0) | (F.length(s) < 3), 0.0).otherwise(first_of(cases, by_ratio))


def query_variants(c: Column) -> Column:
    """The name; if it ends in `ing`, with `e` instead and bare; if in `s`, without."""
    low = c
    stemmed = F.when(low.endswith("ing"), F.left(low, F.length(low) - 3))
    return F.array_distinct(F.array_compact(F.array(low, F.concat(stemmed, F.lit("e")), stemmed, F.when(low.endswith("s"), F.left(low, F.length(low) - 1)))))


def normalize_path(c: Column) -> Column:
    """A dotted path without its index segments."""
    return F.array_join(F.filter(F.split(c, "[.]"), lambda x: ~x.rlike("^[0-9]+$")), ".")


def url_schema(url: Column) -> Column:
    host = F.split_part(F.regexp_replace(F.regexp_replace(url, "https://", ""), "http://", ""), F.lit("/"), F.lit(1))
    return first_of([(F.coalesce(url, F.lit("")) == "", "")] + [(url.contains(d), s) for d, s in DOMAINS], F.split_part(host, F.lit("."), F.lit(1)))


def url_term(url: Column) -> Column:
    last = F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)
    return F.when(F.coalesce(url, F.lit("")).contains("/") & ~last.isin(*NO_TERM), last).otherwise("")


def safe_id(c: Column) -> Column:
    return F.left(F.translate(F.lower(c), " -", "__"), F.lit(50))


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of the name in a namespace UUID."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.conv((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))) + 8, 10, 16)
    parts = [F.substring(h, 1, 8), F.lit("-"), F.substring(h, 9, 4), F.lit("-5"), F.substring(h, 14, 3), F.lit("-"), F.lower(variant), F.substring(h, 18, 3), F.lit("-"), F.substring(h, 21, 12)]
    return F.concat(*parts)


def split_list(c: Column) -> Column:
    """Entries parted by commas and line breaks, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, "[,\n]"), lambda x: F.trim(x)), lambda x: x != "")


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def characteristics(c: Column) -> Column:
    """`key: value; key: value` as a map; keys in lower case with `_` for spaces, the last of equal keys wins."""
    pairs = F.filter(F.split(c, ";"), lambda x: x.contains(":"))
    entries = F.transform(
        pairs,
        lambda x: F.struct(
            F.translate(F.lower(strip(F.split_part(x, F.lit(":"), F.lit(1)))), " ", "_").alias("key"),
            strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))).alias("value"),
        ),
    )
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    return F.map_from_entries(F.transform(keys, lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)))


def training_key(context: Column, source: Column) -> Column:
    return F.when(F.coalesce(context, F.lit("")) != "", F.concat_ws(".", context, source)).otherwise(source)


def training_value(row: dict[str, Column]) -> Column:
    """The parts of a destination that are present, joined by ` | `."""

    def part(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(label), c))

    def ref(label: str, c: Column) -> Column:
        return F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{label}->Reference("), c, F.lit(")")))

    coding = F.when(F.coalesce(row["dest_system"], F.lit("")) != "", F.concat(F.lit("system="), row["dest_system"], F.lit("|code="), F.coalesce(row["dest_code"], F.lit(""))))
    return F.concat_ws(
        " | ", row["destination"], coding, part("display=", row["dest_display"]), part("unit=", row["unit"]),
        ref("subject", row["subject_ref"]), ref("focus", row["focus_ref"]), ref("specimen", row["specimen_ref"]),
    )


def embed_text(name: Column, values: Column, n: int = 10) -> Column:
    """`name: v1, v2, ...` of up to n values, the same ones on every run (by hash)."""
    good = F.filter(F.array_distinct(values), lambda v: v.isNotNull() & (F.trim(v) != "") & ~F.lower(F.trim(v)).isin("na", "nan", "null", "none", "n/a"))
    ordered = F.transform(F.array_sort(F.transform(good, lambda v: F.struct(F.xxhash64(v).alias("h"), v.alias("v")))), lambda s: s["v"])
    return F.concat(name, F.when(F.size(good) > 0, F.concat(F.lit(": "), F.array_join(F.slice(ordered, 1, n), ", "))).otherwise(""))


# Units by the ending of a column name.
UNIT_SUFFIXES = (
    ("_years", "a"), ("_months", "mo"), ("_weeks", "wk"), ("_days", "d"), ("_hours", "h"), ("_minutes", "min"), ("_kg", "kg"), ("_mg", "mg"),
    ("_cm", "cm"), ("_mm", "mm"), ("_ml", "mL"), ("_percent", "%"), ("_pct", "%"),
)


def column_unit(name: Column) -> Column:
    """Unit code a column name ends in, NULL without one."""
    low = F.lower(name)
    return first_of([(low.endswith(s), u) for s, u in UNIT_SUFFIXES], F.lit(None).cast("string"))


def archetype(name: Column, dtype: Column) -> Column:
    """Kind of column by its name and content type: identifier, date, quantity, flag, vocabulary, text."""
    low = F.lower(name)
    return first_of(
        [
            ((dtype == "id") | low.endswith("_id") | low.endswith("identifier"), "identifier"),
            (has_any(low, ("date", "datetime", "timestamp")), "date"),
            (column_unit(name).isNotNull() | (dtype == "numeric"), "quantity"),
            (dtype == "boolean", "flag"),
            (dtype.isin("categorical", "coded"), "vocabulary"),
        ],
        "text",
    )


# Code lookups of the record builders.
GENDERS = {"male": "male", "m": "male", "female": "female", "f": "female", "other": "other", "unknown": "unknown"}
DECEASED = {"dead": True, "deceased": True, "expired": True, "1": True, "true": True, "alive": False, "living": False, "0": False, "false": False}


def lookup_code(c: Column, table: dict, default: object = None) -> Column:
    """Value of a small fixed table by the trimmed lower-case key."""
    kind = "boolean" if all(isinstance(v, bool) for v in table.values()) else "string"
    return first_of([(F.lower(F.trim(c)) == k, v) for k, v in table.items()], F.lit(default).cast(kind))


def is_submitter_id(c: Column) -> Column:
    return F.coalesce(c.rlike(r"^[A-Za-z0-9\-.]+$"), F.lit(False))


def is_plain_string(c: Column) -> Column:
    """No white space at the ends, and one at a time within."""
    return F.coalesce(c.rlike(r"^[^\s]+(\s[^\s]+)*$"), F.lit(False))


def split_center_id(c: Column) -> Column:
    """`center_number[_part...]` as (participant_id, subsets): the center with the first part, and the parts after it. NULL
    without a part."""
    parts = F.split(c, "_")
    whole = F.concat_ws("_", F.try_element_at(parts, F.lit(1)), F.try_element_at(parts, F.lit(2)))
    return F.when(F.size(parts) > 1, F.struct(whole.alias("participant_id"), F.slice(parts, F.lit(3), F.greatest(F.size(parts) - 2, F.lit(0))).alias("subsets")))


def body_structures(c: Column) -> Column:
    """`code:display, code:display` or plain text as an array of (code, display)."""

    def one(x: Column) -> Column:
        x = F.trim(x)
        at = F.instr(x, ":")
        return F.struct(
            F.when(at > 0, F.trim(F.substring(x, F.lit(1), at - 1))).otherwise("").alias("code"), F.trim(F.when(at > 0, F.substring(x, at + 1, F.length(x))).otherwise(x)).alias("display")
        )

    return F.filter(F.transform(F.split(c, ","), one), lambda s: s["display"] != "")


def subject_reference(specimens: Column, patients: Column) -> Column:
    """Subject of an observation over these ids: the one specimen or patient, else a group of them."""
    s, p = F.array_sort(F.array_distinct(specimens)), F.array_sort(F.array_distinct(patients))
    return first_of(
        [
            (F.size(s) == 1, F.concat(F.lit("Specimen/"), F.try_element_at(s, F.lit(1)))),
            (F.size(s) > 1, F.concat(F.lit("Group/"), F.array_join(s, "+"))),
            (F.size(p) == 1, F.concat(F.lit("Patient/"), F.try_element_at(p, F.lit(1)))),
            (F.size(p) > 1, F.concat(F.lit("Group/"), F.array_join(p, "+"))),
        ],
        F.lit(None).cast("string"),
    )


def component(key: Column, value: Column, kind: str, system: Column) -> Column:
    """JSON of an observation component whose value has the given type (String, Integer, Boolean, Decimal)."""
    typed = {"Integer": value.cast("bigint"), "Boolean": value.cast("boolean"), "Decimal": value.cast("double")}.get(kind, value.cast("string"))
    coding = F.array(F.struct(system.alias("system"), key.alias("code"), key.alias("display")))
    return F.to_json(F.struct(F.struct(coding.alias("coding")).alias("code"), typed.alias(f"value{kind}")))


def parse_answer(content: Column, candidates: Column | None = None) -> Column:
    """(target, confidence, reasoning) of a stored model answer. Without a named target: the first candidate
    standing in the text, else the first candidate, else the first path-like word, else `unknown`."""
    raw = F.trim(F.regexp_extract(content, r"(?i)CHOSEN TARGET:\s*(.+?)(?:\n|$)", 1))
    named = F.trim(F.regexp_replace(raw, "^[*`\"']+|[*`\"']+$", ""))
    path = F.regexp_extract(content, r"\b[A-Z][A-Za-z]*(?:\.[a-z][A-Za-z_]*)+", 0)
    cases = [(named != "", named)]
    if candidates is not None:
        inside = F.filter(candidates, lambda t: content.contains(t))
        cases += [(F.size(inside) > 0, F.try_element_at(inside, F.lit(1))), (F.size(candidates) > 0, F.try_element_at(candidates, F.lit(1)))]
    cases.append((path != "", path))
    number = F.try_to_number(F.regexp_extract(content, r"(?i)CONFIDENCE:\s*([\d.]+)", 1), F.lit("999999999D999999999")).cast("double")
    why = F.regexp_extract(content, r"(?is)REASONING:\s*(.+)", 1)
    return F.struct(first_of(cases, "unknown").alias("target"), F.coalesce(number, F.lit(0.5)).alias("confidence"), F.when(why != "", F.trim(why)).otherwise(content).alias("reasoning"))


def rules_section(c: Column, title: str) -> Column:
    """The parts of a markdown text under `### ` headers that name the title, letter case aside; the whole
    text for an empty title."""
    if not title:
        return c
    parts = F.split(c, r"(?m)^(?=### )")
    named = F.filter(parts, lambda p: p.startswith("### ") & F.lower(F.split_part(p, F.lit("\n"), F.lit(1))).contains(title.lower()))
    return F.array_join(named, "")
