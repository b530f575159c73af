"""Approximate nearest neighbours: an inverted file of coarse clusters, exact scores for what is probed."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corviq.errors import EngineError
from corviq.operators.batches import CELLS, by_rows
from corviq.operators.retrieval import TILE, _best, _tile, batch_knn, matrix

SAMPLE = 50_000  # rows at most from which centroids are fitted; every row is indexed
ROUNDS = 12
RECALL = 0.95  # of a sample's exact neighbours, which the probes are chosen for
VISIBLE_SHARE = 0.1  # below it a full scan is cheaper than probing lists that are mostly invisible


@dataclass(frozen=True)
class Coarse:
    """Centroids (lists x dimensions); a few MB at most, they travel with the tasks."""

    centroids: np.ndarray

    def nearest(self, x: np.ndarray, n: int = 1) -> np.ndarray:
        """The ``n`` nearest lists of each row, by Euclidean distance, ties by number."""
        square = (self.centroids**2).sum(axis=1)[None, :]
        return self._first(x, n, lambda some: square - 2 * (some @ self.centroids.T))

    def probes(self, queries: np.ndarray, n: int) -> np.ndarray:
        """The lists whose centroids have the largest inner products with each query."""
        return self._first(queries, n, lambda some: -(some @ self.centroids.T))

    def _first(self, x: np.ndarray, n: int, away: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        """The ``n`` lists that are least away from each row, ``CELLS`` distances at a time."""
        n = min(n, len(self.centroids))
        out, step = np.empty((len(x), n), np.int64), max(1, CELLS // len(self.centroids))
        for at in range(0, len(x), step):
            far = away(x[at : at + step])
            out[at : at + step] = far.argmin(axis=1)[:, None] if n == 1 else np.argsort(far, axis=1, kind="stable")[:, :n]
        return out


def fit(df: DataFrame, lists: int | None = None, vector: str = "embedding", seed: int = 7) -> Coarse:
    """Lloyd's rounds over a sample of at most ``SAMPLE`` rows, chosen by a hash of the vectors, so reruns agree."""
    known = df.where(F.col(vector).isNotNull())
    n = known.count()
    if not n:
        raise EngineError("22000", "no vectors to index")
    share = min(1.0, SAMPLE / n)
    few = known if share == 1.0 else known.where(F.pmod(F.xxhash64(vector), F.lit(1 << 30)) < int(share * (1 << 30)))
    sample = few.select(F.col(vector)).limit(2 * SAMPLE).toArrow().column(0).combine_chunks()
    x = sample.flatten().to_numpy(zero_copy_only=False).reshape(len(sample), -1).astype(float)
    lists = lists or max(1, min(4096, int(math.sqrt(n))))
    rng = np.random.default_rng(seed)
    centers = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        label = Coarse(centers).nearest(x)[:, 0]
        sums = np.zeros_like(centers)
        np.add.at(sums, label, x)
        sizes = np.bincount(label, minlength=len(centers))
        centers[sizes > 0] = sums[sizes > 0] / sizes[sizes > 0][:, None]
    return Coarse(centers)


def assign(df: DataFrame, coarse: Coarse, vector: str = "embedding", keep: Sequence[str] = ()) -> DataFrame:
    """``df``'s id, vector and columns ``keep`` with the number of their list; write it partitioned by ``list`` to prune scans."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
                yield pa.record_batch([*batch.columns, pa.array(coarse.nearest(x)[:, 0].astype(np.int32))], [*batch.schema.names, "list"])

    more = [c for c in keep if c in df.columns]
    source = df.where(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("id"), F.col(vector).alias("embedding"), *more)
    return source.mapInArrow(run, ", ".join(["id long, embedding array<float>", *(f"`{c}` {dict(df.dtypes)[c]}" for c in more), "list int"]))


def search(index: DataFrame, coarse: Coarse, queries: Mapping[int, Sequence[float]], k: int, probes: int = 8) -> DataFrame:
    """(qid, id, score, rank) over the probed lists: partition-local top k with exact inner products, then one window.

    At most 4096 queries a batch. The filter on ``list`` prunes partitions of a stored index.
    """
    if len(queries) > 4096:
        raise EngineError("54000", "more than 4096 queries in a batch")
    ids, matrix = np.array(list(queries), np.int64), np.array(list(queries.values()), float)
    chosen = coarse.probes(matrix, probes)
    wanted = np.zeros((len(ids), len(coarse.centroids)), bool)
    wanted[np.arange(len(ids))[:, None], chosen] = True

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best_id = [np.empty(0, np.int64) for _ in ids]
        best = [np.empty(0) for _ in ids]
        for batch in by_rows(batches, len(ids)):
            who, where = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1).astype(float)
            scores = matrix @ x.T
            scores[~wanted[:, where]] = -np.inf
            for q in range(len(ids)):
                good = np.isfinite(scores[q])
                s, w = np.concatenate((best[q], scores[q][good])), np.concatenate((best_id[q], who[good]))
                order = np.lexsort((w, -s))[:k]
                best[q], best_id[q] = s[order], w[order]
        yield pa.record_batch([pa.array(np.repeat(ids, [len(b) for b in best])), pa.array(np.concatenate(best_id)), pa.array(np.concatenate(best))], ["qid", "id", "score"])

    lists = sorted({int(x) for x in chosen.ravel()})
    local = index.where(F.col("list").isin(*lists)).select("id", "embedding", "list").mapInArrow(run, "qid long, id long, score double")
    w = Window.partitionBy("qid").orderBy(F.desc("score"), F.asc("id"))
    return local.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _probed(batches: Iterator[pa.RecordBatch], coarse: Coarse, probes: int) -> Iterator[pa.RecordBatch]:
    """Queries (qid, q) once for each list that they probe; so many at a time that their copies stay small."""
    for batch in by_rows(batches, min(probes, len(coarse.centroids)) * coarse.centroids.shape[1]):
        chosen = coarse.probes(matrix(batch.column(1)), probes)
        at = pa.array(np.repeat(np.arange(batch.num_rows), chosen.shape[1]))
        yield pa.record_batch([batch.column(0).take(at), batch.column(1).take(at), pa.array(chosen.ravel().astype(np.int32))], ["qid", "q", "list"])


def search_join(index: DataFrame, coarse: Coarse, queries: DataFrame, k: int, probes: int = 8, vector: str = "embedding", rows: int = TILE) -> DataFrame:
    """(qid, id, score, rank) for each row (id, vector) of ``queries``, of any number: queries meet the lists they probe.

    A list of more than ``rows`` vectors is dealt to several tasks by hash, its queries to each of them, so that no
    list is too large for a task.
    """

    asked = queries.where(F.col(vector).isNotNull()).select(F.col("id").cast("long").alias("qid"), F.col(vector).cast("array<double>").alias("q"))
    asked = asked.mapInArrow(lambda it: _probed(it, coarse, probes), "qid long, q array<double>, list int")
    parts = F.broadcast(index.groupBy("list").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")))  # as many rows as lists
    left = index.join(parts, "list").select("list", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), "id", F.col("embedding").alias("v"))
    right = asked.join(parts, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "qid", "q")
    local = left.groupBy("list", "part").cogroup(right.groupBy("list", "part")).applyInArrow(lambda a, c: _tile(a, c, k), "qid long, id long, score double")
    return _best(local, k)


def tune(index: DataFrame, coarse: Coarse, k: int = 10, least: float = RECALL, queries: int = 64) -> int:
    """The fewest probes with which a sample of indexed vectors finds the share ``least`` of its exact neighbours.

    One exact batch search over the index; only the sample's ``k`` neighbours and their lists reach the driver.
    """
    few = {r["id"]: list(r["embedding"]) for r in index.orderBy(F.xxhash64("id"), "id").limit(queries).select("id", "embedding").collect()}
    exact = batch_knn(index, few, k).select("qid", "id").join(index.select("id", "list"), "id").select("qid", "list").collect()
    matrix = np.array(list(few.values()), float)
    place = np.argsort(coarse.probes(matrix, len(coarse.centroids)), axis=1)  # of each list in a query's order
    at = {q: n for n, q in enumerate(few)}
    needed = np.sort([place[at[r["qid"]], r["list"]] for r in exact])
    return int(needed[min(len(needed) - 1, math.ceil(least * len(needed)) - 1)]) + 1 if len(needed) else 1


def worthwhile(visible: int, total: int) -> bool:
    """Whether probing beats a full scan: enough of the indexed rows are visible to the session."""
    return total > 0 and visible / total >= VISIBLE_SHARE
