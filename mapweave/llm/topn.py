"""The N best items of every group by statistics-guided skipping over a clustered table.

cluster_by_group lays the items out once; top_n then answers for any N, reading row groups in descending
order of their maximum score and skipping those that cannot change the answer.
"""

from __future__ import annotations

import heapq
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.util import materialize, remove_path, scratch_path

#: Items of a file, about: what one task writes and reads.
FILE_ROWS = 250_000
#: Items of a row group at most (in small files a sixteenth of the file), and from how many on one ends where
#: the next level begins.
GROUP_ROWS = 8_192
LEVEL_ROWS = 1_000
#: A group with a quarter of a file's items is split, unless it holds less than this share of all: so at most
#: 100,000 groups are split, and only their hashes are broadcast.
SPLIT_SHARE = 1e-5

_ITEMS = pa.schema([("_g", pa.string()), ("_i", pa.string()), ("_s", pa.float64())])
_MANIFEST = "file string, rg int, n long, g string, smin double, smax double, above long"


def valid_items(df: DataFrame, group: str, item: str, score: str) -> DataFrame:
    """(_g, _i, _s) of the rows that take part: group neither NULL nor "", item not NULL, score neither NULL
    nor NaN."""
    g = F.col(group)
    given = g.isNotNull() & (g != "") if dict(df.dtypes)[group] == "string" else g.isNotNull()
    s = F.col(score).cast("double")
    return df.where(given & F.col(item).isNotNull() & s.isNotNull() & ~F.isnan(s)).select(
        g.cast("string").alias("_g"), F.col(item).cast("string").alias("_i"), (s + F.lit(0.0)).alias("_s")
    )


def _open(uri: str):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    system, path = fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(path))


def _writer(path: str, group_rows: int, level_rows: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One file of the partition, and its row groups' statistics. The rows come sorted: split groups first,
        each by score downwards; then the others by level. A row group holds one split group or rows of
        others. A task that is run again writes a file of another name; only files of the statistics count."""
        import pyarrow.fs as fs
        import pyarrow.parquet as pq

        system, base = fs.FileSystem.from_uri(path)
        name = f"{base}/{uuid.uuid4().hex}.parquet"
        out, held, rows, key, stats = None, [], 0, None, []

        def flush(most: int) -> None:
            nonlocal held, rows, out
            table = pa.concat_tables(held)
            part, rest = table.slice(0, most), table.slice(most)
            held, rows = [rest] if len(rest) else [], len(rest)
            if out is None:
                system.create_dir(base, recursive=True)
                out = pq.ParquetWriter(system.open_output_stream(name), _ITEMS)
            out.write_table(part.select(["_g", "_i", "_s"]).cast(_ITEMS), row_group_size=len(part))
            s = part["_s"].to_numpy()
            one = part["_g"][0].as_py() if part["_split"][0].as_py() else None
            above = 0 if one is not None else int(part["_r"].to_numpy().min()) - 1
            stats.append((f"{path}/{name.rsplit('/', 1)[1]}", len(stats), len(part), one, float(s.min()), float(s.max()), above))

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            table = pa.Table.from_batches([batch])
            split = batch.column("_split").to_numpy(zero_copy_only=False).astype(bool)
            level = batch.column("_level").to_numpy()
            codes = batch.column("_g").dictionary_encode().indices.to_numpy()
            turn = (split[1:] != split[:-1]) | (level[1:] != level[:-1]) | (split[1:] & (codes[1:] != codes[:-1]))
            at = [0, *(np.flatnonzero(turn) + 1).tolist(), n]
            for lo, hi in zip(at, at[1:]):
                mine = (True, batch.column("_g")[lo].as_py()) if split[lo] else (False, int(level[lo]))
                if rows and mine != key and (mine[0] or key[0] or rows >= level_rows):
                    flush(rows)
                key = mine
                held.append(table.slice(lo, hi - lo))
                rows += hi - lo
                while rows >= group_rows:
                    flush(group_rows)
        if rows:
            flush(rows)
        if out is not None:
            out.close()
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.float64(), pa.float64(), pa.int64()]
        names = ["file", "rg", "n", "g", "smin", "smax", "above"]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in stats], kinds[j]) for j in range(7)], names)

    return write


def cluster_by_group(
    df: DataFrame, group: str, item: str, score: str, path: str, file_rows: int = FILE_ROWS, group_rows: int = GROUP_ROWS, level_rows: int = LEVEL_ROWS
) -> str:
    """Write the items under `path`: Parquet files clustered by group, and the statistics of their row groups.

    An item of a group stands once, with its highest score. A group lies in one file; one with a quarter of a
    file's items or more is split into parts of that size by the hash of the item, has row groups of its own
    and is sorted by score downwards there. The other groups of a file are laid out in levels, whatever N will be
    asked: the best of each group first, then the second best, and so on, levels growing wider from the ninth
    on. A row group's statistics are its lowest and highest score and `above`: so many items of every group in
    it stand in the row groups before it, and all of them are better. (A list of each row group's groups with
    their scores would be as long as the table, as most groups have a dozen items.)

    Number of files: by the items, and at least the cores where each still gets some. One shuffle; rows of a
    split group are pre-aggregated by item first, so an item delivered over and over is no hot key.
    """
    spark = df.sparkSession
    items = valid_items(df, group, item, score).withColumn("_h", F.xxhash64("_g"))
    counts, at = materialize(items.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")), "group-sizes")
    total = counts.agg(F.sum("_n")).first()[0] or 0
    files = max(1, min(spark.sparkContext.defaultParallelism, total // 10_000), -(-total // file_rows))
    limit = max(total // files // 4, int(total * SPLIT_SHARE) + 1)
    hot = counts.where(F.col("_n") >= limit).select("_h", F.ceil(F.col("_n") / limit).alias("_parts"))
    many = hot.count() > 0
    cold = items.withColumn("_split", F.lit(False)).withColumn("_k", F.col("_h"))
    if many:
        marked = items.join(F.broadcast(hot), "_h", "left")
        cold = marked.where(F.col("_parts").isNull()).drop("_parts").withColumn("_split", F.lit(False)).withColumn("_k", F.col("_h"))
        one = marked.where(F.col("_parts").isNotNull()).groupBy("_h", "_g", "_i", "_parts").agg(F.max("_s").alias("_s"))
        one = one.withColumn("_split", F.lit(True)).withColumn("_k", F.xxhash64("_h", F.pmod(F.xxhash64("_i"), F.col("_parts")))).drop("_parts")
        cold = cold.unionByName(one)
    laid = cold.repartition(files, "_k").groupBy("_k", "_split", "_g", "_i").agg(F.max("_s").alias("_s"))
    w = Window.partitionBy("_k", "_g").orderBy(F.col("_s").desc(), F.col("_i"))
    level = F.when(F.col("_split"), 0).otherwise(F.floor(F.log2("_r") * 4)).cast("int")
    laid = laid.withColumn("_r", F.row_number().over(w)).withColumn("_level", level)
    laid = laid.sortWithinPartitions(F.col("_split").desc(), "_level", "_g", F.col("_s").desc(), "_i").select("_g", "_i", "_s", "_split", "_level", "_r")
    group_rows = min(group_rows, max(LEVEL_ROWS, total // files // 16))
    laid.mapInArrow(_writer(f"{path}/items", group_rows, min(level_rows, group_rows)), _MANIFEST).write.parquet(f"{path}/manifest")
    remove_path(spark, at)
    return path


def _first(table: pa.Table, n: int) -> pa.Table:
    """The n first items of each group; every item stands once."""
    table = table.sort_by([("_g", "ascending"), ("_s", "descending"), ("_i", "ascending")])
    codes = table["_g"].combine_chunks().dictionary_encode().indices.to_numpy(zero_copy_only=False)
    start = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]]) if len(codes) else np.zeros(0, int)
    rank = np.arange(len(codes)) - np.repeat(start, np.diff(np.r_[start, len(codes)]))
    return table.filter(pa.array(rank < n))


_FOUND = "_g string, _i string, _s double, rg_read long, by_score long, by_count long"


def _reader(n: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each row is a file with its row groups, read in descending maximum score. A row group of a split
        group is skipped if its maximum lies strictly below that group's N-th score so far, here or in another
        file (`floor`). One of other groups is skipped if every group in it has N items in the row groups
        before: then all its rows lie strictly below every contained group's N-th item. What a row group
        gives is released before the next is read."""
        schema = pa.schema([*_ITEMS, ("rg_read", pa.int64()), ("by_score", pa.int64()), ("by_count", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                source, best = None, {}
                counts = [0, 0, 0]
                for rg in sorted(row["rgs"], key=lambda x: (-x["smax"], x["rg"])):
                    if rg["above"] >= n:
                        counts[2] += 1
                        continue
                    if rg["g"] is not None:
                        mine = best.setdefault(rg["g"], [])
                        nth = mine[0] if len(mine) == n else float("-inf")
                        if rg["smax"] < max(nth, rg["floor"] if rg["floor"] is not None else float("-inf")):
                            counts[1] += 1
                            continue
                    counts[0] += 1
                    source = source or _open(row["file"])
                    top = _first(source.read_row_group(rg["rg"], columns=["_g", "_i", "_s"]), n)
                    if rg["g"] is not None:
                        for s in top["_s"].to_pylist():
                            (heapq.heappush if len(mine) < n else heapq.heappushpop)(mine, s)
                    for b in top.to_batches():
                        zero = pa.array(np.zeros(b.num_rows, np.int64))
                        yield pa.RecordBatch.from_arrays([*(b.column(k).cast(schema.field(k).type) for k in range(3)), zero, zero, zero], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.string()), pa.nulls(1, pa.float64()), *(pa.array([c]) for c in counts)], schema=schema)

    return read


def _floors(n: int):
    def floors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, s = [], []
            for file, rg in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top = _first(_open(file).read_row_group(rg, columns=["_g", "_i", "_s"]), n)
                if top.num_rows >= n:
                    g.append(top["_g"][0].as_py())
                    s.append(top["_s"][n - 1].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.string()), pa.array(s, pa.float64())], ["g", "floor"])

    return floors


def _read(spark: SparkSession, path: str, n: int) -> DataFrame:
    rgs = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    # The best row group of a split group is read in any case: its own N-th score then bounds all others.
    lead = rgs.where("g IS NOT NULL").groupBy("g").agg(F.max_by(F.struct("file", "rg"), F.struct("smax", "smin", "file", "rg")).alias("top"), F.count(F.lit(1)).alias("m"))
    floor = lead.where(F.col("m") > 1).select("top.file", "top.rg").mapInArrow(_floors(n), "g string, floor double")
    files = rgs.select("file").distinct().count()
    per_file = rgs.join(floor, "g", "left").groupBy("file").agg(F.collect_list(F.struct("rg", "g", "smax", "above", "floor")).alias("rgs"))
    return per_file.repartition(max(1, files)).mapInArrow(_reader(n), _FOUND)


def skip_report(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(row_groups, rg_read, rg_skipped, by_score, by_count) of top_n over the table written by
    cluster_by_group; zeros for an empty one."""
    sums = _read(spark, path, n).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("rg_read", "by_score", "by_count")))
    skipped = F.col("by_score") + F.col("by_count")
    return sums.select((F.col("rg_read") + skipped).alias("row_groups"), "rg_read", skipped.alias("rg_skipped"), "by_score", "by_count")


def top_n(spark: SparkSession, path: str, n: int) -> DataFrame:
    """(_g, _i, _s, rank) of the n best items of each group in the table written by cluster_by_group.

    What the row groups give is n items a group each at most, so the last shuffle is about the result.
    """
    found = _read(spark, path, n).where(F.col("_g").isNotNull()).select("_g", "_i", "_s")
    w = Window.partitionBy("_g").orderBy(F.col("_s").desc(), F.col("_i"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int) -> DataFrame:
    """(group, item, score, rank): the n best items of each group as written, by score downwards, then item
    upwards in byte order; the same on every run.

    Rows whose group is NULL or "", whose item is NULL, or whose score is NULL or NaN take no part (an
    infinite score does). Rows of one item in one group are one item, with its highest score. Equal scores
    are decided by the item; -0.0 equals 0.0. Empty input gives no rows; further columns are ignored.
    """
    spark = df.sparkSession
    path = cluster_by_group(df, group, item, score, scratch_path(spark, "clustered"))
    best, _ = materialize(top_n(spark, path, n), "best")
    remove_path(spark, path)
    return best.select(F.col("_g").alias(group), F.col("_i").alias(item), F.col("_s").alias("score"), F.col("rank").cast("int").alias("rank"))
