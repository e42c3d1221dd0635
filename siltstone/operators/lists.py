"""Approximate vector search by lists around centroids, beside the exact one in ``vector``.

* Centroids are fitted on a bounded sample (FIT_ROWS rows, chosen by a hash of their id) by a few rounds of spherical k-means.
* Every vector goes to the list of its nearest centroid; the index is a table with the list as a column, to be written partitioned by it.
* A query is sent to the lists of its nearest centroids only. Lists are dealt into blocks of at most BLOCK rows, so that a crowded list is many tasks; a
  block meets the queries of its list in one matrix product and gives the best k of each.
* How many lists to probe is measured, not guessed: ``calibrated`` raises the number until the recall of a sample of the indexed vectors
  against an exact search of them reaches what is asked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

FIT_ROWS, ROUNDS, SEED = 20_000, 8, 7
BLOCK = 8192
ROWS_A_LIST = 512
MOST_LISTS = 4096


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Unit rows; a row that is null or has a null component is all zeros, and so is near to nothing."""
    values = column.to_pylist()
    width = max((len(v) for v in values if v), default=1)
    out = np.zeros((len(values), width))
    for i, v in enumerate(values):
        if v and len(v) == width and all(x is not None for x in v):
            out[i] = v
    norm = np.sqrt((out * out).sum(1))
    return out / np.where(norm > 0, norm, 1)[:, None]


def _sample(vectors: DataFrame, rows: int, id_column: str, vector_column: str) -> np.ndarray:
    near = vectors.filter(F.col(vector_column).isNotNull()).orderBy(F.xxhash64(id_column), id_column).limit(rows).select(F.col(vector_column).cast("array<double>").alias("v")).toArrow()
    x = _matrix(near.column("v"))
    return x[x.any(1)]


def fitted(vectors: DataFrame, lists: int | None = None, id_column: str = "vec_id", vector_column: str = "embedding") -> np.ndarray:
    """Unit centroids, as many as ``lists`` or one for each ROWS_A_LIST vectors, MOST_LISTS at most."""
    sample = _sample(vectors, FIT_ROWS, id_column, vector_column)
    wanted = lists or math.ceil(vectors.count() / ROWS_A_LIST)
    n = max(1, min(wanted, MOST_LISTS, len(sample)))
    if not len(sample):
        return np.zeros((1, 1))
    centroids = sample[np.random.default_rng(SEED).choice(len(sample), n, replace=False)].copy()
    for _ in range(ROUNDS):
        own = (sample @ centroids.T).argmax(1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, sample)
        norm = np.sqrt((sums * sums).sum(1))
        centroids = np.where(norm[:, None] > 0, sums / np.where(norm > 0, norm, 1)[:, None], centroids)
    return centroids


def indexed(vectors: DataFrame, centroids: np.ndarray, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, list and v of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            width = min(x.shape[1], centroids.shape[1])
            own = (x[:, :width] @ centroids[:, :width].T).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(own, pa.int32()), batch.column("v")], names=["vec_id", "list", "v"])

    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "vec_id long, list int, v array<double>")


def probed(queries: DataFrame, centroids: np.ndarray, probes: int) -> DataFrame:
    """query_id, v and list for each of the nearest lists of each query. queries: query_id, query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            width = min(x.shape[1], centroids.shape[1])
            near = np.argsort(-(x[:, :width] @ centroids[:, :width].T), axis=1, kind="stable")[:, :probes]
            at = np.repeat(np.arange(len(x)), near.shape[1])
            yield pa.RecordBatch.from_arrays([batch.column("query_id").take(pa.array(at)), batch.column("v").take(pa.array(at)), pa.array(near.ravel(), pa.int32())], names=["query_id", "v", "list"])

    rows = queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("v"))
    return rows.mapInArrow(run, "query_id long, v array<double>, list int")


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, probes: int, k: int = 10) -> DataFrame:
    """query_id, vec_id, score (cosine) and rank: the best k of each query in its lists. Equal scores go by smaller id."""
    sizes = cut(index.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    dealt = index.join(F.broadcast(sizes), "list").select("list", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int").alias("block"), "vec_id", "v")
    each = sizes.select(F.col("list").alias("near"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("place"))
    asked = probed(queries, centroids, probes).join(F.broadcast(each), F.col("list") == F.col("near")).select(F.col("near").alias("to_list"), F.col("place").alias("to_block"), "query_id", "v")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        if left.num_rows and right.num_rows:
            x, q = _matrix(left.column("v")), _matrix(right.column("v"))
            ids, query_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            width = min(x.shape[1], q.shape[1])
            for i in range(0, len(q), 256):
                scores = np.round(q[i : i + 256, :width] @ x[:, :width].T, 6)
                for row, one in zip(scores, query_ids[i : i + 256], strict=True):
                    some = np.flatnonzero(row >= np.partition(row, -k)[-k]) if len(row) > k else np.arange(len(row))
                    best = some[np.lexsort((ids[some], -row[some]))[:k]]
                    for into, values in zip(out, (np.full(len(best), one), ids[best], row[best]), strict=True):
                        into.append(values)
        return pa.table([pa.array(np.concatenate(c)) for c in out], names=["query_id", "vec_id", "score"])

    found = dealt.groupBy("list", "block").cogroup(asked.groupBy("to_list", "to_block")).applyInArrow(meet, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def calibrated(vectors: DataFrame, centroids: np.ndarray, recall: float = 0.95, k: int = 10, sample: int = 2_000, id_column: str = "vec_id", vector_column: str = "embedding") -> int:
    """The fewest probes that find ``recall`` of the k nearest of ``sample`` vectors among themselves, measured against all of them."""
    x = _sample(vectors, sample, id_column, vector_column)
    if len(x) < 2:
        return len(centroids)
    width = min(x.shape[1], centroids.shape[1])
    near = x[:, :width] @ centroids[:, :width].T
    own = near.argmax(1)
    place = np.argsort(np.argsort(-near, axis=1, kind="stable"), axis=1, kind="stable")  # of each list among a query's
    hits = np.zeros(len(centroids))
    for i in range(0, len(x), 256):
        scores = x[i : i + 256] @ x.T
        best = np.argsort(-scores, axis=1, kind="stable")[:, : k + 1]
        np.add.at(hits, place[np.arange(i, i + len(scores))[:, None], own[best]].ravel(), 1)
    return int(np.searchsorted(np.cumsum(hits) / hits.sum(), recall) + 1)


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, recall: float = 0.95) -> DataFrame:
    """The whole way: fit, calibrate, index, search."""
    centroids = fitted(vectors)
    return search(cut(indexed(vectors, centroids)), queries, centroids, calibrated(vectors, centroids, recall, k), k)
