"""A stored index of name vectors: build, upsert, clear, rebuild, search."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mapweave.operators import match
from mapweave.operators.kb import KnowledgeBase
from mapweave.util import materialize, remove_path

#: Letters of an entry's id; longer ones are cut.
ID_LETTERS = 63
#: A pass over the entries takes so many blocks of queries, and compares so many queries at a time.
PASS_BLOCKS, COMPARED = 8, 256
#: More than a cosine in single precision can be off: 64 terms of none below zero, 64 * 2^-24 of their sum.
MARGIN = 1e-5
ENTRY_SCHEMA = "id string, source string, target string, vec array<float>"


def entry_id(prefix: Column, source: Column, target: Column) -> Column:
    return F.left(F.translate(F.concat_ws("_", prefix, source, target), " ", "_"), F.lit(ID_LETTERS))


class _Best:
    """The k best entries of each query among those added in the order of their ids: score (to nine places, -inf where there
    is none) and at (number of the entry, -1), downwards. Of equal scores the earlier stays."""

    def __init__(self, q: np.ndarray, k: int) -> None:
        self.q, self.k, self.seen = q, k, 0
        self.size = np.sqrt((q * q).sum(axis=1))
        self.units = (q / self.size[:, None]).astype(np.float32)
        self.score, self.at = np.full((len(q), k), -np.inf), np.full((len(q), k), -1, np.int64)

    def add(self, v: np.ndarray, step: int) -> np.ndarray:
        """Add the entries of vectors v, `step` queries at a time, and give the numbers of those that are among the best now."""
        size = np.sqrt((v * v).sum(axis=1))
        units = np.ascontiguousarray((v / size[:, None]).astype(np.float32).T)
        used = []
        for a in range(0, len(self.q), step):
            near = self.units[a : a + step] @ units
            least = self.score[a : a + step, -1]
            if len(v) > self.k and np.isneginf(least).any():
                least = np.maximum(least, np.partition(near, len(v) - self.k, axis=1)[:, len(v) - self.k])
            hit = np.flatnonzero(near >= (least - MARGIN).astype(np.float32)[:, None])
            i, j = np.divmod(hit, len(v))
            i += a
            s = np.round(np.einsum("ij,ij->i", self.q[i], v[j]) / (self.size[i] * size[j]), 9)
            better = s > self.score[i, -1]
            i, j, s = i[better], j[better], s[better]
            if not len(i):
                continue
            rows = np.unique(i)
            query = np.concatenate([np.repeat(rows, self.k), i])
            score = np.concatenate([self.score[rows].ravel(), s])
            at = np.concatenate([self.at[rows].ravel(), j + self.seen])
            order = np.lexsort((at, -score, query))  # places without an entry come last by their score
            first = np.searchsorted(query[order], rows)
            top = order[first[:, None] + np.arange(self.k)]
            self.score[rows], self.at[rows] = score[top], at[top]
            used.append(self.at[rows].ravel())
        used = np.unique(np.concatenate([np.zeros(0, np.int64), *used]))
        used = used[used >= self.seen]
        self.seen += len(v)
        return used


@dataclass(frozen=True)
class VectorIndex:
    """Entries (id, source, target, vec) as Parquet under `path`, in numbered generations: a change writes a new one
    beside the old and then removes that, so a lost executor or a reader in between sees a whole index. The vector is
    that of the source name (match.hash_embedding)."""

    spark: SparkSession
    path: str

    def _generations(self) -> list[int]:
        fs = self.spark._jvm.org.apache.hadoop.fs
        at = fs.Path(self.path)
        system = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(at):
            return []
        names = [s.getPath().getName() for s in system.listStatus(at)]
        return sorted(int(n[1:]) for n in names if n.startswith("g") and n[1:].isdigit() and system.exists(fs.Path(f"{self.path}/{n}/_SUCCESS")))

    def entries(self) -> DataFrame:
        found = self._generations()
        if not found:
            return self.spark.createDataFrame([], ENTRY_SCHEMA)
        return self.spark.read.schema(ENTRY_SCHEMA).parquet(f"{self.path}/g{found[-1]}")

    def _replace(self, entries: DataFrame) -> None:
        old = self._generations()
        entries.write.mode("overwrite").parquet(f"{self.path}/g{(old[-1] if old else 0) + 1}")
        for g in old:
            remove_path(self.spark, f"{self.path}/g{g}")

    @staticmethod
    def _vectors(pairs: DataFrame) -> DataFrame:
        """Grams are hashed once each in a task; match.hash_embedding hashes those of a row again for every place of its vector."""

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = match.GramPlaces()
            for batch in batches:
                v = match.place_counts(known.of(batch.column(3).to_pylist())).astype(np.float32)
                vec = pa.ListArray.from_arrays(np.arange(len(v) + 1, dtype=np.int32) * v.shape[1], v.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], vec], ["id", "source", "target", "vec"])

        return pairs.select("id", "source", "target", F.lower("source").alias("text")).mapInArrow(count, ENTRY_SCHEMA)

    @staticmethod
    def _ided(pairs: DataFrame, prefix: str) -> DataFrame:
        """pairs (source, target) with ids, of those with one id the first."""
        ided = pairs.select(entry_id(F.lit(prefix), F.col("source"), F.col("target")).alias("id"), F.struct("source", "target").alias("p"))
        return ided.groupBy("id").agg(F.min("p").alias("p")).select("id", "p.source", "p.target")

    def build(self, kb: KnowledgeBase, prefix: str = "kb") -> None:
        """An entry for each distinct pair of a name and one of its destinations, in place of what is there. Pairs whose ids
        are cut to the same letters are one entry, the first by name and path."""
        pairs = kb.mappings().where("source <> ''").select("source", F.col("destination").alias("target"))
        self._replace(self._vectors(self._ided(pairs, prefix)))

    reindex = build

    def clear(self) -> None:
        for g in self._generations():
            remove_path(self.spark, f"{self.path}/g{g}")

    def upsert(self, pairs: DataFrame, prefix: str = "user") -> None:
        """pairs (source, target): added, or put in place of entries with their ids. NULL and empty names are left out."""
        new, new_at = materialize(self._ided(pairs.where((F.col("source") != "") & F.col("target").isNotNull()), prefix), "added")
        kept = self.entries()
        replaced, replaced_at = materialize(kept.select("id").join(new.select("id"), "id", "left_semi"), "replaced")
        if not replaced.isEmpty():  # else no vector is shuffled
            kept = kept.join(replaced, "id", "left_anti")
        self._replace(kept.unionByName(self._vectors(new)))
        for at in (new_at, replaced_at):
            remove_path(self.spark, at)

    def search(self, queries: DataFrame, k: int = 5) -> DataFrame:
        """queries (query) -> (query, id, source, target, score, rank): the k most similar entries by cosine, to nine
        places, ties by id. Queries are a stated set, shipped in blocks, each a pass over the entries; each partition of the
        entries keeps k of each, so what is shuffled doesn't grow with the index. All pairs are compared in single precision;
        those within MARGIN of a query's k best so far are scored in double."""
        asked = queries.select("query").where(F.length("query") > 0).distinct()
        passes = max(1, -(-asked.count() // (PASS_BLOCKS * match.QUERY_BLOCK)))
        entries, out, step = self.entries().sortWithinPartitions("id"), None, min(match.QUERY_BLOCK, COMPARED)
        for b in range(passes):
            mine = asked if passes == 1 else asked.where(F.pmod(F.xxhash64("query"), F.lit(passes)) == b)
            got = mine.select("query", match.hash_places(F.col("query")).alias("p")).collect()
            counts = match.place_counts(pa.array([r.p for r in got], pa.list_(pa.int64())))
            shipped = self.spark.sparkContext.broadcast(([r["query"] for r in got], counts))

            def near(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
                names, q = shipped.value
                best, texts = _Best(q, k), {}
                for batch in batches:
                    if not batch.num_rows or not names:
                        continue
                    v = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(batch.num_rows, -1)
                    used = best.add(v, step)
                    kept = batch.select(range(3)).take(pa.array(used - best.seen + batch.num_rows))
                    texts.update(zip(used.tolist(), zip(*(c.to_pylist() for c in kept.columns))))
                    if len(texts) > 2 * best.at.size + 10_000:
                        texts = {p: texts[p] for p in np.unique(best.at[best.at >= 0]).tolist()}
                for a in range(0, len(names), match.QUERY_BLOCK):
                    i, j = np.nonzero(best.at[a : a + match.QUERY_BLOCK] >= 0)
                    found = [texts[p] for p in best.at[a + i, j].tolist()]
                    columns = [pa.array([names[x] for x in (a + i).tolist()], pa.string()), *(pa.array([e[c] for e in found], pa.string()) for c in range(3)), pa.array(best.score[a + i, j])]
                    yield pa.RecordBatch.from_arrays(columns, ["query", "id", "source", "target", "score"])

            found = entries.mapInArrow(near, "query string, id string, source string, target string, score double")
            out = found if out is None else out.unionByName(found)
        w = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
