"""Records that differ only in the format of one field, found through partition-merged Bloom filters."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mapweave.util import join_by_group, materialize, remove_path, scratch_path

#: Bits of a filter's shard, by their logarithm; a shard is merged and tested in one task.
SHARD_BITS = 21
PROBES = 3
BITS_PER_ROW = 16
#: A row number holds its partition above these bits.
PARTITION_SHIFT = 33


def canonical_text(c: Column) -> Column:
    """The text without what formatting can change: letter case, white space, punctuation and, for a text of
    `key: value` fields, their order.

    Letters and digits stay, in order. A text with `:` or `=` is a list of fields, parted by `;` `|` `,` or a
    line break where a key follows (a comma within a value is punctuation); a field is its key and its
    value, each stripped; the fields are sorted, so values stay with their keys and repeated fields count.
    NULL stays NULL and is no copy of ""; texts of nothing but punctuation are equal to each other.
    """
    folded = F.lower(F.upper(c))

    def strip(x: Column) -> Column:
        return F.regexp_replace(x, r"[^\p{L}\p{N}]+", "")

    def field(x: Column) -> Column:
        parts = F.split(x, "[:=]", 2)
        return F.concat(strip(F.element_at(parts, 1)), F.lit("\u0002"), strip(F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))))

    fields = F.split(folded, r"[;|,\n\r]+(?=[^;|,\n\r:=]*[:=])")
    fields = F.array_sort(F.filter(F.transform(fields, field), lambda x: x != "\u0002"))
    return F.when(c.rlike("[:=]"), F.concat(F.lit("\u0001"), F.array_join(fields, "\u0001"))).otherwise(strip(folded))


def _comparable(df: DataFrame, name: str) -> Column:
    """The column in a form that can be grouped: a map as its sorted entries."""
    c = F.col(f"`{name}`")
    return F.array_sort(F.map_entries(c)) if dict(df.dtypes)[name].startswith("map<") else c


def _positions(h: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard of each hash, and its PROBES bit positions in there."""
    u = h.astype(np.int64).view(np.uint64)
    shard = (u >> np.uint64(40)) % np.uint64(shards)
    a, b = u * np.uint64(0x9E3779B97F4A7C15), (u ^ (u >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    at = np.stack([(a + np.uint64(k) * b) >> np.uint64(64 - SHARD_BITS) for k in range(PROBES)], axis=1)
    return shard.astype(np.int64), at.astype(np.uint32)


def _pack(values: np.ndarray) -> bytes:
    """Sorted whole numbers, by their differences."""
    return zlib.compress(np.diff(np.sort(values), prepend=0).astype("<i8").tobytes(), 1)


def _unpack(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(data), "<i8"))


_PARTS = "shard long, once binary, twice binary, hashes binary, numbers binary"
_MARKS = "part long, numbers binary"


def _builder(shards: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of one partition and each shard: the filters of hashes it saw, and of those it saw repeatedly, and the
        hashes and numbers of rows whose hash it saw once. Rows of hashes it saw repeatedly come out as shard -1:
        they are repeats whatever the others saw, so a hash reaches a shard once from each partition at most."""
        seen = [(b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)) for b in batches if b.num_rows]
        if not seen:
            return
        h, number = (np.concatenate([x[k] for x in seen]) for k in range(2))
        distinct, back, n = np.unique(h, return_inverse=True, return_counts=True)
        lone = n[back] == 1
        rows = []
        for part in np.unique(number[~lone] >> PARTITION_SHIFT):
            rows.append((-1, None, None, None, _pack(number[~lone & (number >> PARTITION_SHIFT == part)])))
        shard, at = _positions(distinct, shards)
        first = np.zeros(len(distinct), np.int64)
        first[back] = number
        order = np.argsort(shard, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            one = mine[n[mine] == 1]
            rows.append((int(shard[mine[0]]), _pack(np.unique(at[mine])), _pack(np.unique(at[mine[n[mine] > 1]])), distinct[one].astype("<i8").tobytes(), first[one].astype("<i8").tobytes()))
        kinds = [pa.int64(), *[pa.binary()] * 4]
        for lo in range(0, len(rows), 64):
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[lo : lo + 64]], kinds[j]) for j in range(5)], ["shard", "once", "twice", "hashes", "numbers"])

    return build


def _test(shards: int):
    def test(parts: pa.Table) -> pa.Table:
        """The partitions' filters of a shard merged (repeated is what either saw repeatedly, or both saw), and the
        rows of the shard that it may have seen repeatedly, by the partition they stand in."""
        once, twice = (np.zeros(1 << SHARD_BITS, bool) for _ in range(2))
        columns = [parts.column(c) for c in ("once", "twice", "hashes", "numbers")]
        for a, b in zip(*columns[:2]):
            mine = _unpack(a.as_py())
            twice[mine[once[mine]]] = True
            twice[_unpack(b.as_py())] = True
            once[mine] = True
        found = []
        for h, number in zip(*columns[2:]):
            h, number = (np.frombuffer(x.as_py(), "<i8") for x in (h, number))
            if len(h):
                found.append(number[twice[_positions(h, shards)[1]].all(axis=1)])
        number = np.concatenate(found) if found else np.zeros(0, np.int64)
        part = number >> PARTITION_SHIFT
        order = np.argsort(part, kind="stable")
        groups = [g for g in np.split(order, np.flatnonzero(np.diff(part[order])) + 1) if len(g)]
        return pa.table({"part": pa.array([int(part[g[0]]) for g in groups], pa.int64()), "numbers": pa.array([_pack(number[g]) for g in groups], pa.binary())})

    return test


_MARKED: dict[tuple[str, int], np.ndarray] = {}


def _marked(path: str, part: int) -> np.ndarray:
    """Numbers of the possible repeats of a partition, from the shared folder; the last few are kept."""
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    if (path, part) not in _MARKED:
        system, base = fs.FileSystem.from_uri(path)
        at = f"{base}/at={part}"
        found = []
        if system.get_file_info(at).type == fs.FileType.Directory:
            for f in system.get_file_info(fs.FileSelector(at)):
                if f.base_name.endswith(".parquet"):
                    with system.open_input_file(f.path) as opened:
                        found += [_unpack(x.as_py()) for x in pq.ParquetFile(opened).read(["numbers"])["numbers"]]
        while len(_MARKED) >= 8:
            _MARKED.pop(next(iter(_MARKED)))
        _MARKED[path, part] = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return _MARKED[path, part]


def _tester(path: str):
    @F.pandas_udf("boolean")
    def possible(number: pd.Series) -> pd.Series:
        n = number.to_numpy()
        found = np.zeros(len(n), bool)
        part = n >> PARTITION_SHIFT
        for p in np.unique(part):
            marks, mine = _marked(path, int(p)), part == p
            if len(marks):
                at = np.minimum(np.searchsorted(marks, n[mine]), len(marks) - 1)
                found[mine] = marks[at] == n[mine]
        return pd.Series(found)

    return possible


def mark_possible_repeats(df: DataFrame, hash_col: str) -> tuple[DataFrame, int, list[str]]:
    """df with the boolean `_repeat`, False only for rows whose hash no other row has; the number of rows, and the
    paths of the tables it is read from.

    The rows are written once, each with its partition and place as number. The filters of once-seen and
    repeatedly-seen hashes are built per partition and merged per shard of 2^SHARD_BITS bits, and each shard
    is tested where it is merged: of every row only hash and number travel there, of possible repeats the
    number comes back, into a table by partition that the tasks reading a partition look up. Nothing goes
    through the driver or to all executors, whatever the number of rows.
    """
    spark = df.sparkSession
    rows, rows_at = materialize(df.withColumn("_n", F.monotonically_increasing_id()), "numbered")
    total = rows.count()
    shards = max(1, math.ceil(total * BITS_PER_ROW / (1 << SHARD_BITS)))
    parts, parts_at = materialize(rows.select(hash_col, "_n").mapInArrow(_builder(shards), _PARTS), "bloom")
    across = parts.where(F.col("shard") >= 0).groupBy("shard").applyInArrow(_test(shards), _MARKS)
    marks = across.select("part", "numbers").unionByName(parts.where(F.col("shard") < 0).select(_part_of("numbers").alias("part"), "numbers"))
    path = scratch_path(spark, "marks")
    marks.repartition("part").withColumnRenamed("part", "at").write.partitionBy("at").parquet(path)
    remove_path(spark, parts_at)
    return rows.withColumn("_repeat", _tester(path)("_n")).drop("_n"), total, [rows_at, path]


def _part_of(numbers: str) -> Column:
    @F.pandas_udf("long")
    def part(packed: pd.Series) -> pd.Series:
        return packed.map(lambda x: int(_unpack(x)[0]) >> PARTITION_SHIFT).astype("int64")

    return part(numbers)


def format_duplicates(df: DataFrame, text: str, row_id: str, ignore: list[str]) -> DataFrame:
    """(first_id, row_id, copies): each row with the smallest id among the copies of its record and their
    number, 1 for a record that stands alone.

    Rows are copies if canonical_text of `text` agrees and all other columns but row_id and `ignore` are
    equal as written; NULL equals NULL and nothing else, NaN equals NaN. row_id is unique. Empty input gives
    no rows. Columns may have any names.

    Only rows that the merged Bloom filters report as possible repeats are shuffled with their columns; the
    rest come out as singletons from the scan. Groups are exact: the filter and its hash only rule out. The
    grouping combines before its shuffle, and a record with a third of all rows is joined back by broadcast.
    """
    others = [c for c in df.columns if c not in {text, row_id, *ignore}]
    key = F.struct(canonical_text(F.col(f"`{text}`")).alias("t"), *(_comparable(df, c).alias(f"c{k}") for k, c in enumerate(others)))
    keyed = df.select(F.col(f"`{row_id}`").alias("_id"), key.alias("_k")).withColumn("_h", F.xxhash64("_k"))
    marked, total, paths = mark_possible_repeats(keyed, "_h")
    marked, marked_at = materialize(marked.select("_id", "_k", "_repeat"), "marked")
    for at in paths:
        remove_path(df.sparkSession, at)
    possible = marked.where(F.col("_repeat")).select("_id", "_k")
    groups, groups_at = materialize(possible.groupBy("_k").agg(F.min("_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "copies")
    copies = join_by_group(possible, groups, "_k", "copies", total).select("first_id", F.col("_id").alias("row_id"), "copies")
    single = marked.where(~F.col("_repeat")).select(F.col("_id").alias("first_id"), F.col("_id").alias("row_id"), F.lit(1).cast("long").alias("copies"))
    out, _ = materialize(copies.unionByName(single), "grouped")
    for at in (marked_at, groups_at):
        remove_path(df.sparkSession, at)
    return out


def collapse_format_duplicates(df: DataFrame, text: str, row_id: str, ignore: list[str]) -> DataFrame:
    """The records themselves: the first copy of each, all its columns as written, and their number in
    `copies` (with `_` behind it while the table has such a column)."""
    name = "copies"
    while name in {c.lower() for c in df.columns}:
        name += "_"
    first = format_duplicates(df, text, row_id, ignore).where(F.col("first_id") == F.col("row_id"))
    return df.join(first.select(F.col("row_id").alias(row_id), F.col("copies").alias(name)), row_id)
