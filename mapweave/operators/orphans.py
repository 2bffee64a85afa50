"""References to records that do not exist: a fixpoint cascade down a graph of foreign keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mapweave.util import absent, join_by_group, materialize, remove_path


@dataclass(frozen=True)
class Table:
    """A table of the graph. row_id: a column unique within it; key: what children refer to (None: nobody
    does); deleted: a column that is NULL while the row lives (None: rows are never deleted); at: the
    timestamp whose month is reported (None: no period)."""

    df: DataFrame
    row_id: str
    key: str | None = None
    deleted: str | None = None
    at: str | None = None


@dataclass(frozen=True)
class Reference:
    child: str
    column: str
    parent: str


def _given(df: DataFrame, column: str):
    kind = dict(df.dtypes)[column]
    return ~absent(F.col(column)) if kind == "string" else F.col(column).isNotNull()


def _dangling(rows: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """Ids of the rows of (_id, _ref) whose _ref is none of the distinct keys. The references are counted
    first, so that a hot one crosses the network once and not once per row."""
    wanted = rows.groupBy("_ref").agg(F.count(F.lit(1)).alias("_n"))
    missing = wanted.join(keys, "_ref", "left_anti")
    return join_by_group(rows, missing, "_ref", "_n", total).select("_id")


def orphan_references(tables: dict[str, Table], references: list[Reference]) -> DataFrame:
    """One row per orphan reference: (table_name, column_name, row_id, ref, kind, period).

    kind `direct`: the reference is given but no live row of the parent has that key, compared exactly as
    written. kind `inherited`: such rows exist, but every one of them is itself an orphan (direct or
    inherited); found by semi-joins repeated down the graph until nothing changes, so cycles end too, and a
    cycle without an outside orphan is sound. A row with several references gives a row for each that fails.
    Deleted children are judged like live ones: a reference is a fact about the row as stored.

    NULL and "" references are no references. Several rows with one key are one parent, alive if any is.
    Repeated child rows are kept (each has its own row_id). A NULL timestamp gives a NULL period. Empty
    tables give no orphans as children and only orphans as parents. Further columns, of whatever name, are
    ignored. Row ids and references come out as strings. The result is a table.

    Plan: references are pre-aggregated per value before the anti-join; a hot value is joined back by
    broadcast, of which there are at most a thousand; nothing is collected but counts.
    """
    state: dict[int, DataFrame] = {}
    totals: dict[int, int] = {}
    rows: dict[int, DataFrame] = {}
    for i, r in enumerate(references):
        child, parent = tables[r.child], tables[r.parent]
        if parent.key is None:
            raise ValueError(f"{r.parent} has no key")
        kind = dict(parent.df.dtypes)[parent.key]
        rows[i] = child.df.where(_given(child.df, r.column)).select(
            F.col(child.row_id).cast("string").alias("_id"),
            F.col(r.column).alias("_ref"),
            (F.date_format(child.at, "yyyy-MM") if child.at else F.lit(None).cast("string")).alias("period"),
        )
        if dict(rows[i].dtypes)["_ref"] != kind:
            rows[i] = rows[i].withColumn("_ref", F.col("_ref").cast("string"))
        totals[i] = child.df.count()

    def keys(name: str, ref_type: str, without: list[DataFrame]) -> DataFrame:
        t = tables[name]
        live = t.df.where(F.col(t.deleted).isNull()) if t.deleted else t.df
        live = live.where(_given(t.df, t.key)).select(F.col(t.row_id).cast("string").alias("_id"), F.col(t.key).alias("_ref"))
        for orphans in without:
            live = live.join(orphans, "_id", "left_anti")
        live = live.select(F.col("_ref").cast(ref_type)) if dict(live.dtypes)["_ref"] != ref_type else live.select("_ref")
        return live.distinct()

    direct: dict[int, DataFrame] = {}
    sizes: dict[int, int] = {}
    direct_paths: list[str] = []
    for i, r in enumerate(references):
        ids = _dangling(rows[i].select("_id", "_ref"), keys(r.parent, dict(rows[i].dtypes)["_ref"], []), totals[i])
        direct[i], at = materialize(ids, "orphans")
        direct_paths.append(at)
        state[i], sizes[i] = direct[i], direct[i].count()

    paths: dict[int, str] = {}
    changed = {r.child for i, r in enumerate(references) if sizes[i]}
    while changed:
        again = set()
        for i, r in enumerate(references):
            if r.parent not in changed:
                continue
            without = [state[j] for j, other in enumerate(references) if other.child == r.parent]
            ids = _dangling(rows[i].select("_id", "_ref"), keys(r.parent, dict(rows[i].dtypes)["_ref"], without), totals[i])
            grown, path = materialize(ids, "orphans")
            n = grown.count()
            if n > sizes[i]:
                again.add(r.child)
                state[i], sizes[i] = grown, n
                if i in paths:
                    remove_path(grown.sparkSession, paths[i])
                paths[i] = path
            else:
                remove_path(grown.sparkSession, path)
        changed = again

    out = None
    for i, r in enumerate(references):
        found = rows[i].join(state[i], "_id", "left_semi") if sizes[i] else rows[i].where(F.lit(False))
        if state[i] is not direct[i]:
            found = found.join(direct[i].withColumn("_direct", F.lit(True)), "_id", "left")
        else:
            found = found.withColumn("_direct", F.lit(True))
        found = found.select(
            F.lit(r.child).alias("table_name"),
            F.lit(r.column).alias("column_name"),
            F.col("_id").alias("row_id"),
            F.col("_ref").cast("string").alias("ref"),
            F.when(F.col("_direct"), "direct").otherwise("inherited").alias("kind"),
            "period",
        )
        out = found if out is None else out.unionByName(found)
    if out is None:
        raise ValueError("no references")
    out, _ = materialize(out, "orphans-found")
    for path in {*direct_paths, *paths.values()}:
        remove_path(out.sparkSession, path)
    return out


def orphan_report(tables: dict[str, Table], references: list[Reference], orphans: DataFrame) -> DataFrame:
    """Per table, column and month: rows, references given, direct and inherited orphans, and their share."""
    out = None
    for r in references:
        child = tables[r.child]
        period = F.date_format(child.at, "yyyy-MM") if child.at else F.lit(None).cast("string")
        counted = child.df.groupBy(period.alias("period")).agg(
            F.count(F.lit(1)).alias("row_count"), F.count_if(_given(child.df, r.column)).alias("ref_count")
        )
        counted = counted.select(F.lit(r.child).alias("table_name"), F.lit(r.column).alias("column_name"), "period", "row_count", "ref_count")
        out = counted if out is None else out.unionByName(counted)
    per = orphans.groupBy("table_name", "column_name", "period").agg(
        F.count_if(F.col("kind") == "direct").alias("direct_count"), F.count_if(F.col("kind") == "inherited").alias("inherited_count")
    )
    on = [out[c].eqNullSafe(per[c]) for c in ("table_name", "column_name", "period")]
    joined = out.join(per, on, "left").select(*(out[c] for c in out.columns), "direct_count", "inherited_count")
    return joined.fillna(0, ["direct_count", "inherited_count"]).withColumn(
        "orphan_share", F.round(F.try_divide(F.col("direct_count") + F.col("inherited_count"), F.col("ref_count")), 6)
    )
