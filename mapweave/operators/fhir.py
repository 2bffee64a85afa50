"""Nested JSON records: walking them, counting what they use, mining pairs of terms and paths; the catalog of
the target model."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from mapweave.functions import text as tx
from mapweave.operators.kb import KnowledgeBase

#: Nodes of an Arrow batch given out at a time.
NODE_BATCH = 20_000


def parse_records(lines: DataFrame, resource: str = "resource", raw: str = "json") -> DataFrame:
    """lines (resource, json, ...) with `v`, the record as VARIANT; text that is no JSON drops out."""
    return lines.withColumn("v", F.try_parse_json(raw)).where(F.col("v").isNotNull())


def sample_lines(lines: DataFrame, every: int = 1, limit: int | None = None, by: str = "file") -> DataFrame:
    """lines (file, line_no, json): every k-th line of a file, counted before blank and invalid ones drop
    out, and of those the first `limit` valid ones."""
    kept = lines.where(F.pmod("line_no", F.lit(every)) == 0).where(F.try_parse_json("json").isNotNull())
    if limit is None:
        return kept
    from mapweave.operators.kb import row_rank

    return row_rank(kept, [by], [F.col("line_no")], "_n").where(F.col("_n") <= limit).drop("_n")


def _member(name: str) -> Column:
    return F.try_element_at("members", F.lit(name))


class _Number(str):
    """A number as it is written."""


def _scalar(v: object) -> str | None:
    if v is None or isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, separators=(",", ":"), ensure_ascii=False)


def _nodes(v: object, indices: bool) -> Iterator[tuple]:
    """(path, key, kind, seq, value, members, in_coding, in_reference) of a parsed record, parents before children."""
    todo = [(v, "", "", "", False, False)]
    while todo:
        v, path, key, seq, in_coding, in_reference = todo.pop()
        if isinstance(v, dict):
            members = {k: s for k, x in v.items() if (s := _scalar(x)) is not None}
            yield path, key, "object", seq, None, members, in_coding, in_reference
            in_coding = in_coding or ("system" in members and "code" in members)
            in_reference = in_reference or "/" in members.get("reference", "")
            dot = path + "." if path else ""
            inner = [(x, dot + k, k, f"{seq}/{n:06d}", in_coding, in_reference) for n, (k, x) in enumerate(v.items())]
        elif isinstance(v, list):
            yield path, key, "array", seq, None, None, in_coding, in_reference
            dot = path + "." if path else ""
            inner = [(x, dot + str(n) if indices else path, key, f"{seq}/{n:06d}", in_coding, in_reference) for n, x in enumerate(v)]
        else:
            yield path, key, "leaf", seq, _scalar(v), None, in_coding, in_reference
            continue
        todo.extend(reversed(inner))


def walk(records: DataFrame, keep: tuple[str, ...] = ("resource",), indices: bool = True) -> DataFrame:
    """records (keep..., v) -> every node: (keep..., path, key, kind, seq, value, members, in_coding,
    in_reference): kind object, array or leaf; seq its place in document order; value the text of a leaf (NULL
    for null); members an object's members that aren't null, as text; in_coding and in_reference whether an
    object above it has system and code, or a `Type/id` reference.

    One pass over the records where they lie, to any depth; nothing is shuffled or collected.
    """
    base = list(keep)
    flat = records.select(*base, F.to_json("v").alias("_json"))
    schema = f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in flat.schema[:-1])}, path string, key string, kind string, seq string, value string, members map<string,string>, in_coding boolean, in_reference boolean"
    kinds = [to_arrow_type(f.dataType) for f in flat.schema[:-1]]
    names = [*base, "path", "key", "kind", "seq", "value", "members", "in_coding", "in_reference"]
    kinds += [pa.string()] * 5 + [pa.map_(pa.string(), pa.string()), pa.bool_(), pa.bool_()]

    def spread_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = json.JSONDecoder(parse_int=_Number, parse_float=_Number, parse_constant=_Number).decode
        at, rows = [], []

        def out(batch: pa.RecordBatch) -> pa.RecordBatch:
            kept = batch.take(pa.array(at, pa.int64()))
            columns = [kept.column(k).cast(kinds[k]) for k in range(len(base))]
            for k in range(8):
                column = [r[k] for r in rows]
                if k == 5:
                    column = [None if m is None else list(m.items()) for m in column]
                columns.append(pa.array(column, kinds[len(base) + k]))
            at.clear()
            rows.clear()
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            for k, text in enumerate(batch.column(len(base)).to_pylist()):
                if text is None:
                    continue
                for node in _nodes(read(text), indices):
                    rows.append(node)
                    at.append(k)
                    if len(rows) >= NODE_BATCH:
                        yield out(batch)
            if rows:
                yield out(batch)

    return flat.mapInArrow(spread_out, schema)


def field_usage(nodes: DataFrame, samples: int = 10) -> DataFrame:
    """(path, n, resource, samples): leaves by path without indices; how often each occurs, the first
    resource it stood in, and the first distinct values, cut to 100 characters."""
    leaf = nodes.where((F.col("kind") == "leaf") & (F.col("path") != "")).select(
        tx.normalize_path(F.col("path")).alias("path"), "resource", "ord", "seq", F.left("value", F.lit(100)).alias("value")
    )
    counted = leaf.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min_by("resource", F.struct("ord", "seq")).alias("resource"))
    firsts = leaf.where(F.col("value").isNotNull()).groupBy("path", "value").agg(F.min(F.struct("ord", "seq")).alias("o"))
    from mapweave.operators.kb import row_rank

    ten = row_rank(firsts, ["path"], [F.col("o"), F.col("value")], "r").where(F.col("r") <= samples)
    ten = ten.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "value"))), lambda x: x["value"]).alias("samples"))
    return counted.join(ten, "path", "left")


def codings(nodes: DataFrame) -> DataFrame:
    """(ord, seq, resource, path, system, code, display) of objects with system and code, none of them within another."""
    system, code = _member("system"), _member("code")
    found = nodes.where((F.col("kind") == "object") & system.isNotNull() & code.isNotNull() & ~F.col("in_coding"))
    path = F.concat_ws(".", F.col("resource"), F.when(F.col("path") != "", tx.normalize_path(F.col("path"))))
    return found.select("ord", "seq", "resource", path.alias("path"), system.alias("system"), code.alias("code"), F.coalesce(_member("display"), F.lit("")).alias("display"))


def coding_usage(found: DataFrame) -> DataFrame:
    """(system, code, n, display, path): the display and path of the first."""
    return found.groupBy("system", "code").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("display", "path"), F.struct("ord", "seq")).alias("f")).select("system", "code", "n", "f.display", "f.path")


def coding_systems(usage: DataFrame) -> DataFrame:
    return usage.groupBy("system").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "system")


def references(nodes: DataFrame) -> DataFrame:
    """(ord, seq, resource, field, target) of objects with a `Type/id` reference, none of them within another."""
    ref = _member("reference")
    found = nodes.where((F.col("kind") == "object") & ref.contains("/") & ~F.col("in_reference"))
    return found.select("ord", "seq", "resource", F.col("key").alias("field"), F.split_part(ref, F.lit("/"), F.lit(1)).alias("target"))


def reference_usage(found: DataFrame) -> DataFrame:
    return found.groupBy("resource", "field", "target").agg(F.count(F.lit(1)).alias("n"))


def mapping_pairs(nodes: DataFrame, schema: Column) -> DataFrame:
    """(term, schema, path, resource, pair_type, system, code, ord, seq): identifiers and codings give field
    pairs by the term in their system URL, displays give content pairs."""
    # what lies below the keys system, code, display and value is passed over
    obj = nodes.where((F.col("kind") == "object") & ~F.col("path").rlike(r"(^|\.)(system|code|display|value)(\.[0-9]+)*(\.|$)"))
    system, value, code, display = (_member(x) for x in ("system", "value", "code", "display"))
    path = F.concat_ws(".", F.col("resource"), F.when(F.col("path") != "", tx.normalize_path(F.col("path"))))
    rows = obj.select("ord", "seq", "resource", schema.alias("schema"), path.alias("path"), system.alias("system"), value.alias("value"), code.alias("code"), display.alias("display"), tx.url_term(system).alias("term"))
    ident = rows.where(F.col("system").isNotNull() & F.col("value").isNotNull() & ~F.lower("path").contains("coding") & (F.col("term") != ""))
    coded = rows.where(F.col("system").isNotNull() & F.col("code").isNotNull())

    def pairs(df: DataFrame, term: Column, kind: str, sys: Column, cd: Column) -> DataFrame:
        return df.select(term.alias("term"), F.lower("schema").alias("schema"), "path", "resource", F.lit(kind).alias("pair_type"), sys.alias("system"), cd.alias("code"), "ord", "seq")

    none = F.lit("")
    return (
        pairs(ident, F.col("term"), "field", none, none)
        .unionByName(pairs(coded.where(F.col("term") != ""), F.col("term"), "field", F.col("system"), none))
        .unionByName(pairs(coded.where(F.coalesce("display", F.lit("")) != ""), F.col("display"), "content", F.col("system"), F.col("code")))
    )


def pair_tier(pair_type: Column, path: Column, resource: Column) -> Column:
    return F.when(pair_type == "content", "content").when(~path.contains(".") | (path == resource), "entity").otherwise("field")


def pair_usage(pairs: DataFrame) -> DataFrame:
    """(schema, term, path, n, pair_type, resource, system, code, tier): the attributes of the first; pairs of
    both types with one term and path count together."""
    g = pairs.groupBy("schema", "term", "path").agg(F.count(F.lit(1)).alias("n"), F.min_by(F.struct("pair_type", "resource", "system", "code"), F.struct("ord", "seq", "pair_type")).alias("f"))
    g = g.select("schema", "term", "path", "n", "f.*")
    return g.withColumn("tier", pair_tier(F.col("pair_type"), F.col("path"), F.col("resource")))


def tier_summary(usage: DataFrame) -> DataFrame:
    return usage.agg(*(F.count_if(F.col("tier") == t).alias(t) for t in ("entity", "field", "content")))


def resource_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("source", "resource").agg(F.count(F.lit(1)).alias("n"))


def merge_pairs(kb: KnowledgeBase, usage: DataFrame, min_count: int = 2) -> DataFrame:
    """Pairs seen often enough that the base doesn't have, compared as written."""
    new = usage.where(F.col("n") >= min_count).select(
        F.col("term").alias("source_term"), F.col("schema").alias("source_schema"), F.lit("").alias("source_context"), F.col("path").alias("destination"), "tier", F.xxhash64("term", "path").alias("ord")
    )
    return kb.merge(new, case_sensitive=True)


# Catalog of the target model: fields (class, slot, range, multivalued, required, class_ord, slot_ord)
def search_fields(fields: DataFrame, term: str, resource: str | None = None) -> DataFrame:
    hit = fields.where(F.lower("slot").contains(term.lower()))
    return hit.where(F.lower("class") == resource.lower()) if resource else hit


def resource_fields(fields: DataFrame, resource: str, required_only: bool = False) -> DataFrame:
    """Slots of a class, the required ones first; a class of that very case is preferred."""
    loose = fields.where(F.lower("class") == resource.lower())
    best = loose.agg(F.coalesce(F.max(F.when(F.col("class") == resource, F.col("class"))), F.min("class")).alias("_b"))
    out = loose.join(F.broadcast(best), F.col("class") == F.col("_b")).drop("_b")
    out = out.where("required") if required_only else out
    return out.orderBy(F.desc("required"), "slot_ord")


def field_paths(fields: DataFrame, limit: int | None = None) -> DataFrame:
    p = fields.select(F.concat_ws(".", "class", "slot").alias("path"), "class_ord", "slot_ord").orderBy("class_ord", "slot_ord").select("path")
    return p.limit(limit) if limit is not None else p


# Coded-value categories
def infer_path(category: Column) -> Column:
    c = F.lower(category)
    return tx.first_of(
        [
            (tx.has_any(c, ("condition", "diagnosis", "histology")), "Condition.code"),
            (tx.has_any(c, ("staging", "grade", "stage")), "Observation.valueCodeableConcept"),
            (tx.has_any(c, ("tissue", "specimen", "sample")), "Specimen.type"),
            (tx.has_any(c, ("anatomical", "location", "site", "metastasis")), "Specimen.collection.bodySite"),
            (c.contains("procedure"), "Procedure.code"),
        ],
        "Observation.valueCodeableConcept",
    )


def key_path(key: Column, category: Column) -> Column:
    """Path a terminology key stands for: itself if dotted, a known one, else that of the category."""
    k = F.lower(key)
    return tx.first_of(
        [
            (key.contains("."), key),
            (k == "body_structure", "Specimen.collection.bodySite"),
            (k == "grade", "Observation.valueCodeableConcept"),
            (k.isin("procedure", "procedure_code"), "Procedure.code"),
        ],
        infer_path(category),
    )


def summary_rows(usage: DataFrame, min_count: int = 5) -> DataFrame:
    """Pairs seen at least min_count times, the commonest first."""
    return usage.where(F.col("n") >= min_count).orderBy(F.desc("n"), "schema", "term", "path")


def export_summary(usage: DataFrame, path: str, min_count: int = 5) -> None:
    summary_rows(usage, min_count).write.mode("overwrite").json(path)
