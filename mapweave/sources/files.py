"""Readers and writers of the file formats mappings and data come in."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_csvs(spark: SparkSession, sources: str | dict[str, str], sep: str = ",") -> tuple[dict[str, DataFrame], dict[str, str]]:
    """Named tables from one or several CSV files with a header (the name of a single one is its stem), and
    the failures by name; a failure doesn't stop the others. All columns are strings."""
    named = {Path(sources).stem: sources} if isinstance(sources, str) else sources
    good, bad = {}, {}
    for name, path in named.items():
        try:
            good[name] = spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", sep).csv(path)
        except Exception as e:  # the reader's own exceptions differ by source
            bad[name] = str(e).splitlines()[0]
    return good, bad


def scan_csv(spark: SparkSession, path: str, rows: int = 200, values: int = 3, width: int = 60, limit: int | None = None) -> DataFrame:
    """profile.header_scan of a CSV file, in the order of its lines."""
    from mapweave.operators.profile import header_scan

    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).limit(rows)
    return header_scan(df.withColumn("_line", F.monotonically_increasing_id()), "_line", rows, values, width, limit)


def flatten(df: DataFrame) -> DataFrame:
    """Nested structs as dotted columns; arrays stay."""

    def leaves(fields: list[T.StructField], prefix: list[str]) -> list[list[str]]:
        out = []
        for f in fields:
            path = [*prefix, f.name]
            out += leaves(f.dataType.fields, path) if isinstance(f.dataType, T.StructType) else [path]
        return out

    return df.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(".".join(path)) for path in leaves(df.schema.fields, [])))


def read_ndjson(spark: SparkSession, path: str, flat: bool = True) -> DataFrame:
    df = spark.read.json(path)
    return flatten(df) if flat else df


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, json): the lines of text files with their numbers from 1.

    Files are read in splits, however large they are: a line's place in its split is added to the lines of the
    splits before it, which are counted first. Lines end with a line feed only.
    """
    lines = spark.read.option("lineSep", "\n").text(path)
    lines = lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id"), F.col("value").alias("json"))
    splits = lines.groupBy("file", "_start").agg(F.count(F.lit(1)).alias("_lines"), F.min("_id").alias("_first"))
    before = F.coalesce(F.sum("_lines").over(Window.partitionBy("file").orderBy("_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select("file", "_start", (before + 1 - F.col("_first")).alias("_shift"))
    return lines.join(splits, ["file", "_start"]).select("file", (F.col("_id") + F.col("_shift")).alias("line_no"), "json")


def count_records(lines: DataFrame) -> DataFrame:
    """Lines per file, blank ones included."""
    return lines.groupBy("file").agg(F.count(F.lit(1)).alias("n"))


def resource_of(file: str = "file") -> Column:
    """Stem of a file's name."""
    return F.regexp_extract(file, r"([^/]+?)(\.[^./]*)?$", 1)


def source_of(file: str = "file") -> Column:
    """The directory two levels up: `{source}/META/{Resource}.ndjson`."""
    return F.regexp_extract(file, r"([^/]+)/META/[^/]+$", 1)


def list_resources(lines: DataFrame) -> DataFrame:
    s = source_of()
    return lines.where((s != "") & ~s.startswith(".")).select(s.alias("source"), resource_of().alias("resource")).distinct().orderBy("source", "resource")


def load_project(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables of a project folder: `raw/*/table_data.tsv`, or `cases.ndjson` and `files.ndjson`; else
    ValueError. Local or mounted folders."""
    root = Path(path)
    if (root / "raw").is_dir():
        tables = {p.parent.name: str(p) for p in sorted((root / "raw").glob("*/table_data.tsv"))}
        return read_csvs(spark, tables, sep="\t")[0]
    found = {n: root / f"{n}.ndjson" for n in ("cases", "files") if (root / f"{n}.ndjson").exists()}
    if not found:
        raise ValueError(f"no known project layout in {path}")
    return {n: read_ndjson(spark, str(p)) for n, p in found.items()}


_ENTITY_SCHEMA = (
    "obj_mapping struct<source:struct<name:string,description:string>,destination:struct<name:string>>, "
    "mappings array<struct<source:struct<name:string,description:string,enums:array<struct<enum:array<string>>>>,destination:struct<name:string,type:string,reference:string>>>"
)


def read_entity_mappings(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(sources and destinations, coded values) of entity mapping files: one JSON object a file, an entity
    row for the object and a field row for each mapping; enumerated values become coded values.

    The context of a field is its name up to the last dot, else the entity; observations are about the
    Patient; a field named after a specimen or sample refers to one if its destination is a path.
    """
    raw = spark.read.schema(_ENTITY_SCHEMA).option("multiLine", True).json(path).withColumn("entity", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))
    entity = raw.where(F.coalesce("obj_mapping.destination.name", F.lit("")) != "").select(
        F.concat_ws(":", F.lit(schema), "entity").alias("id"), F.col("entity").alias("source"), F.lit("entity").alias("tier"), F.lit("").alias("source_context"),
        F.col("obj_mapping.destination.name").alias("destination"), F.lit("").alias("subject_ref"), F.lit("").alias("specimen_ref"),
    )
    m = raw.select("entity", F.explode("mappings").alias("m")).select("entity", F.col("m.source.name").alias("name"), F.col("m.destination.name").alias("destination"), F.col("m.source.enums").alias("enums"))
    m = m.where((F.coalesce("name", F.lit("")) != "") & (F.coalesce("destination", F.lit("")) != ""))
    dotted = F.col("name").contains(".")
    field = m.select(
        F.concat(F.lit(f"{schema}:"), "entity", F.lit("."), "name").alias("id"),
        F.element_at(F.split("name", "[.]"), -1).alias("source"),
        F.lit("field").alias("tier"),
        F.when(dotted, F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.col("entity")).alias("source_context"),
        "destination",
        F.when(F.col("destination").startswith("Observation."), "Patient").otherwise("").alias("subject_ref"),
        F.when(F.col("destination").contains(".") & F.lower("name").rlike("specimen|sample"), "Specimen").otherwise("").alias("specimen_ref"),
    )
    values = m.select("name", F.explode("enums").alias("e")).select(F.col("name").alias("source_category"), F.explode("e.enum").alias("source_value")).withColumn("code", F.col("source_value"))
    return entity.unionByName(field).withColumn("source_schema", F.lit(schema)), values


_NODE_SCHEMA = (
    "node string, `fhir:resourceType` string, `fhir:fieldMapping` array<struct<`fhir:field`:string,`fhir:type`:string,`fhir:code`:string,`fhir:system`:string,`fhir:category`:string>>, "
    "`fhir:reference` array<struct<`fhir:resourceType`:string,`fhir:field`:string>>, category array<string>, missing_in_schematic boolean"
)


def read_node_mappings(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sources and destinations, coded values, rule nodes) of a node mapping file: a JSON array of nodes with
    field mappings and references. The last reference of each role counts."""
    raw = spark.read.schema(_NODE_SCHEMA).option("multiLine", True).json(path).where(F.coalesce("node", F.lit("")) != "").withColumn("ord", F.monotonically_increasing_id())
    fields = F.transform("`fhir:fieldMapping`", lambda f: F.struct(f["fhir:field"].alias("field"), f["fhir:type"].alias("type"), f["fhir:system"].alias("system"), f["fhir:code"].alias("code"), f["fhir:category"].alias("category")))
    refs = F.transform("`fhir:reference`", lambda r: F.struct(r["fhir:resourceType"].alias("resource"), r["fhir:field"].alias("field")))
    nodes = raw.select("node", F.col("`fhir:resourceType`").alias("resource_type"), fields.alias("fields"), refs.alias("references"), "category", "missing_in_schematic", "ord")

    def role(name: str) -> Column:
        return F.coalesce(F.try_element_at(F.filter("references", lambda r: r["field"] == name), F.lit(-1))["resource"], F.lit(""))

    roles = [role(r).alias(f"{r}_ref") for r in ("subject", "focus", "specimen")]
    entity = nodes.where(F.coalesce("resource_type", F.lit("")) != "").select(F.concat_ws(":", F.lit(schema), "node").alias("id"), F.col("node").alias("source"), F.lit("entity").alias("tier"), F.lit("").alias("source_context"), F.col("resource_type").alias("destination"), *roles)
    f = nodes.select("node", "resource_type", "references", F.explode("fields").alias("f")).where(F.coalesce("f.field", F.lit("")) != "")
    path_ = F.when(F.col("f.field").startswith(F.concat(F.col("resource_type"), F.lit("."))), F.col("f.field")).otherwise(F.concat_ws(".", "resource_type", "f.field"))
    field = f.select(F.concat(F.lit(f"{schema}:"), "node", F.lit("."), "f.field").alias("id"), F.col("node").alias("source"), F.lit("field").alias("tier"), F.lit("").alias("source_context"), path_.alias("destination"), *roles)
    values = f.where(F.coalesce("f.code", F.lit("")) != "").select(F.col("node").alias("source_value"), F.col("f.field").alias("source_category"), F.col("f.code").alias("code"), F.col("f.system").alias("code_system"))
    return entity.unionByName(field).withColumn("source_schema", F.lit(schema)), values, nodes


def read_terminology(spark: SparkSession, files: list[str]) -> DataFrame:
    """(source_category, source_value, key, code, is_primary, position) of YAML files `{value: [codes]}` or
    `{value: {key: [codes]}}`; keys that start with # are passed over. The files are hand-kept lists read on
    the driver."""
    import yaml

    rows = []
    for name in sorted(files):
        with open(name, encoding="utf-8") as f:
            data = yaml.safe_load(f) or {}
        for value, codes in data.items():
            if str(value).startswith("#"):
                continue
            groups = codes if isinstance(codes, dict) and "code" not in codes else {"": codes}
            for k, (key, entries) in enumerate(groups.items()):
                for i, e in enumerate(entries if isinstance(entries, list) else [entries]):
                    code = (e.get("code") or e.get("body_structure_code")) if isinstance(e, dict) else e
                    if code is not None:
                        rows.append((Path(name).stem, str(value), str(key), str(code), i == 0 and k == 0, i))
    return spark.createDataFrame(rows, "source_category string, source_value string, key string, code string, is_primary boolean, position int")


def read_model(spark: SparkSession, path: str) -> DataFrame:
    """Catalog of a LinkML model: (class, slot, range, multivalued, required, class_ord, slot_ord)."""
    import yaml

    with open(path, encoding="utf-8") as f:
        model = yaml.load(f, Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    slots = model.get("slots") or {}
    rows = []
    for i, (name, body) in enumerate((model.get("classes") or {}).items()):
        for j, slot in enumerate((body or {}).get("slots") or []):
            s = slots.get(slot) or {}
            rows.append((name, slot, s.get("range") or "string", bool(s.get("multivalued")), bool(s.get("required")), i, j))
    return spark.createDataFrame(rows, "class string, slot string, range string, multivalued boolean, required boolean, class_ord int, slot_ord int")


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(column, stratum, samples, accept) of a JSON file with a list `columns`."""
    raw = spark.read.schema("columns array<struct<column:string,stratum:string,samples:array<string>,accept:array<string>>>").option("multiLine", True).json(path)
    return raw.select(F.explode("columns").alias("c")).select("c.*")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_exports(mapped: DataFrame, path: str) -> None:
    """Mappings as JSON lines and as CSV, reasoning cut to 200 characters where there is one."""
    if "reasoning" in mapped.columns:
        mapped = mapped.withColumn("reasoning", F.left("reasoning", F.lit(200)))
    write_json(mapped, f"{path}/mappings.json")
    write_csv(mapped, f"{path}/mappings.csv")
