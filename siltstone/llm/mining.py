"""Hard negatives by a two-dimensional block matrix product.

* Rows become integer matrices of at most ROW_BLOCK rows, anchors matrices of at most ANCHOR_BLOCK. Blocks are cut by place, not by key, so
  no label, id or group of copies makes a block larger.
* Both are cut into chunks of CHUNK dimensions. The grid has a cell for each of (group of row blocks, group of anchor blocks, chunk): a chunk of
  a row block goes to the cells of its row of the grid, a chunk of an anchor block to those of its column. A cell multiplies
  what meets there and gives one tile of partial int64 scores for each pair of blocks.
* Partial tiles of a pair of blocks are shuffled together and added. A whole tile is reduced at once to the best rows of each anchor's label, and
  to those rows of other labels that can still lie in a window: the tile's own last positive bounds from below where the windows of
  the final ones begin, as these can only score higher.
* The best positives of all tiles give each anchor its windows; each tile then gives the best negatives in each window, and
  the best of these are the result.

Cost: 8 bytes for each row, anchor and chunk are shuffled as tiles, which is what the method is. Products are made in double precision where
all sums stay below 2**53, so that they are exact; else in 64-bit integers.

Defined results: rows with a null id, label or vector, or with any null or non-finite component, take no part; components that a shorter vector lacks count as
0; repeated rows are rows of their own, each with its results, and "other rows" are all but the row itself; equal scores go by smaller id; anchors without
positives or without negatives in a window give no row for it; no rows give no result; other columns are not read. Components beyond
2**62 / 256 don't fit and raise an error.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

ROW_BLOCK = 2048
ANCHOR_BLOCK = 256
CHUNK = 32
CELL_ROWS = 8192
CELL_ANCHORS = 512
MOST_SENT = 1_000  # blocks of anchors whose windows are sent to every executor at most

I = np.int64  # noqa: E741
_UID_BITS = 20


def quantised(lists: pa.Array, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * x) of each row, padded with zeros, and which rows are whole."""
    at, present = np.asarray(lists.offsets).astype(I), lists.is_valid().to_numpy(zero_copy_only=False)
    numbers = lists.values.fill_null(math.nan).to_numpy(zero_copy_only=False).astype(np.float64)
    length = np.diff(at)
    bad = np.concatenate(([0], np.cumsum(~np.isfinite(numbers))))
    whole = present & (bad[at[1:]] == bad[at[:-1]])
    out = np.zeros((len(lists), int(length.max(initial=0))), I)
    for i in np.flatnonzero(whole):
        x = np.floor(scale * numbers[at[i] : at[i + 1]])
        if np.abs(x).max(initial=0) >= 2.0**62:
            raise ValueError("a component is too large for 64-bit scores")
        out[i, : length[i]] = x
    return out, whole


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices over their common width."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * width < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(I)
    return np.einsum("ik,jk->ij", a, b)


def _matrix(data: bytes, rows: int) -> np.ndarray:
    return np.frombuffer(data, I).reshape(rows, -1)


def blocks(rows: DataFrame, scale: int) -> DataFrame:
    """block, rows, ids, labels, anchors (marks) and data of each block. ``rows`` has id, label, anchor and vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            data, whole = quantised(batch.column("vector"), scale)
            column = lambda name, kind: batch.column(name).to_numpy(zero_copy_only=False).astype(kind)[whole]  # noqa: B023, E731
            data, ids, labels, marks = data[whole], column("id", I), column("label", I), column("anchor", np.bool_)
            parts = -(-len(ids) // ROW_BLOCK)
            for at in np.array_split(np.arange(len(ids)), parts) if parts else []:
                values = [[number], [len(at)], *([x[at].tobytes()] for x in (ids, labels, marks, data))]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["block", "rows", "ids", "labels", "anchors", "data"])
                number += 1

    return rows.mapInArrow(run, "block long, rows long, ids binary, labels binary, anchors binary, data binary")


def anchor_blocks(row_blocks: DataFrame, total: int) -> DataFrame:
    """The anchors of all row blocks in blocks of their own, with the row's uid."""

    def single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (row for batch in batches for row in batch.to_pylist()):
            at = np.flatnonzero(np.frombuffer(x["anchors"], np.bool_))
            ids, labels, data = np.frombuffer(x["ids"], I)[at], np.frombuffer(x["labels"], I)[at], _matrix(x["data"], x["rows"])[at]
            yield pa.RecordBatch.from_arrays([pa.array((x["block"] << _UID_BITS) + at), pa.array(ids), pa.array(labels), pa.array([d.tobytes() for d in data], pa.binary())], names=["uid", "id", "label", "data"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i in range(0, batch.num_rows, ANCHOR_BLOCK):
                part = batch.slice(i, ANCHOR_BLOCK)
                data = [np.frombuffer(d, I) for d in part.column("data").to_pylist()]
                wide = np.zeros((len(data), max(map(len, data))), I)
                for k, d in enumerate(data):
                    wide[k, : len(d)] = d
                values = [[number], [len(data)], *([part.column(c).to_numpy().tobytes()] for c in ("uid", "id", "label")), [wide.tobytes()]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int64(), *[pa.binary()] * 4], strict=True)], names=["anchor_block", "rows", "uids", "ids", "labels", "data"])
                number += 1

    singles = row_blocks.mapInArrow(single, "uid long, id long, label long, data binary")
    return singles.repartition(max(1, -(-total // ANCHOR_BLOCK)), "uid").mapInArrow(packed, "anchor_block long, rows long, uids binary, ids binary, labels binary, data binary")


def _chunked(panels: DataFrame, name: str, carried: list[str]) -> DataFrame:
    """A row for each chunk of dimensions of each block; ids and labels go with the first."""
    schema = ", ".join([f"{name} long, rows long, chunk int", *(f"{c} binary" for c in carried), "data binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in (row for batch in batches for row in batch.to_pylist()):
            data = _matrix(x["data"], x["rows"])
            for k in range(max(1, -(-data.shape[1] // CHUNK))):
                part = np.ascontiguousarray(data[:, k * CHUNK : (k + 1) * CHUNK]).tobytes()
                values = [x[name], x["rows"], k, *(x[c] if k == 0 else None for c in carried), part]
                kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * (len(carried) + 1)]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[name, "rows", "chunk", *carried, "data"])

    return panels.select(name, "rows", *carried, "data").mapInArrow(run, schema)


_TILE = "block long, anchor_block long, chunk int, tile binary, ids binary, labels binary, anchor_uids binary, anchor_labels binary"


def partial_tiles(row_blocks: DataFrame, anchors: DataFrame, rows: int, n_anchors: int) -> DataFrame:
    """A tile of partial scores (anchors by rows) for each pair of blocks and chunk."""
    high, wide = max(1, -(-rows // CELL_ROWS)), max(1, -(-n_anchors // CELL_ANCHORS))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    place = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    left = _chunked(row_blocks, "block", ["ids", "labels"]).withColumn("gi", place("block", high)).withColumn("gj", every(wide))
    right = _chunked(anchors, "anchor_block", ["uids", "labels"]).withColumn("gj", place("anchor_block", wide)).withColumn("gi", every(high))
    names = [f.split()[0] for f in _TILE.split(", ")]

    def multiply(a: pa.Table, b: pa.Table) -> pa.Table:
        out = []
        panels = [(y, _matrix(y["data"], y["rows"])) for y in b.to_pylist()]
        for x in a.to_pylist() if panels else []:
            data = _matrix(x["data"], x["rows"])
            out += [(x["block"], y["anchor_block"], x["chunk"], product(d, data).tobytes(), x["ids"], x["labels"], y["uids"], y["labels"]) for y, d in panels]
        columns = list(zip(*out, strict=True)) or [[]] * len(names)
        kinds = [pa.int64(), pa.int64(), pa.int32(), *[pa.binary()] * 5]
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    cell = ["gi", "gj", "chunk"]
    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(multiply, _TILE)


def reduced(partial: DataFrame, positives: int, low: int) -> DataFrame:
    """Whole tiles, reduced: for each pair of blocks the positives and negatives that can matter, as packed (anchor, score, id, uid)."""

    def run(table: pa.Table) -> pa.Table:
        parts = table.to_pylist()
        first = next(p for p in parts if p["chunk"] == 0)
        ids, labels = np.frombuffer(first["ids"], I), np.frombuffer(first["labels"], I)
        uids, own_labels = np.frombuffer(first["anchor_uids"], I), np.frombuffer(first["anchor_labels"], I)
        tile = np.zeros((len(uids), len(ids)), I)
        for p in parts:
            tile += np.frombuffer(p["tile"], I).reshape(tile.shape)
        row_uids = (first["block"] << _UID_BITS) + np.arange(len(ids))
        good, bad = [np.zeros((0, 4), I)], [np.zeros((0, 4), I)]
        for i, scores in enumerate(tile):
            same = np.flatnonzero((labels == own_labels[i]) & (row_uids != uids[i]))
            best = same[np.lexsort((row_uids[same], ids[same], -scores[same]))[:positives]]
            floor = max(0, int(scores[best[-1]])) if len(best) == positives else 0
            other = np.flatnonzero((labels != own_labels[i]) & (100 * scores >= low * floor))
            for at, into in ((best, good), (other, bad)):
                into.append(np.stack((np.full(len(at), i), scores[at], ids[at], row_uids[at]), 1))
        values = [[first["block"]], [first["anchor_block"]], [np.concatenate(good).tobytes()], [np.concatenate(bad).tobytes()]]
        return pa.table([pa.array(v, k) for v, k in zip(values, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], strict=True)], names=["block", "anchor_block", "positives", "negatives"])

    return partial.groupBy("block", "anchor_block").applyInArrow(run, "block long, anchor_block long, positives binary, negatives binary")


def best_positives(tiles: DataFrame, positives: int) -> DataFrame:
    """anchor_block and the windows of its anchors: packed (anchor, rank, score, id)."""

    def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column("anchor_block").to_pylist(), batch.column("positives").to_pylist(), strict=True):
                x = np.frombuffer(data, I).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), block)), *(pa.array(x[:, k]) for k in range(4))], names=["anchor_block", "anchor", "score", "id", "uid"])

    rows = tiles.select("anchor_block", "positives").mapInArrow(unpacked, "anchor_block long, anchor long, score long, id long, uid long")
    order = Window.partitionBy("anchor_block", "anchor").orderBy(F.desc("score"), "id", "uid")
    best = rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= positives)
    return best.groupBy("anchor_block").agg(F.collect_list(F.struct("anchor", "rank", "score", "id")).alias("windows"))


def in_windows(tiles: DataFrame, windows: DataFrame, negatives: int, low: int) -> DataFrame:
    """The first negatives of each tile in each window."""
    names = ["anchor_block", "anchor", "window", "positive_score", "positive_id", "score", "id", "uid"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                rows = np.frombuffer(x["negatives"], I).reshape(-1, 4)
                edges = np.searchsorted(rows[:, 0], np.arange(rows[-1, 0] + 2)) if len(rows) else np.zeros(1, I)
                sorted_rows: dict[int, np.ndarray] = {}
                out = [np.zeros((0, 8), I)]
                for w in x["windows"]:
                    i, top = w["anchor"], w["score"]
                    if i + 1 >= len(edges):
                        continue
                    if i not in sorted_rows:
                        own = rows[edges[i] : edges[i + 1]]
                        sorted_rows[i] = own[np.lexsort((own[:, 3], own[:, 2], -own[:, 1]))]
                    own = sorted_rows[i]
                    found = own[(low * top <= 100 * own[:, 1]) & (own[:, 1] <= top)][:negatives]
                    out.append(np.concatenate((np.tile([x["anchor_block"], i, w["rank"], top, w["id"]], (len(found), 1)), found[:, 1:]), 1).astype(I))
                whole = np.concatenate(out)
                yield pa.RecordBatch.from_arrays([pa.array(whole[:, k]) for k in range(8)], names=names)

    return tiles.select("anchor_block", "negatives").join(windows, "anchor_block").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def hard_negatives(
    vectors: DataFrame, anchor: Column, label: Column | str = "label", id_column: str = "vec_id", vector_column: str = "embedding", positives: int = 5, negatives: int = 5, low: int = 80, scale: int = 256
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    For each row where ``anchor`` holds and each of its best ``positives`` of the same label: the best ``negatives`` of other labels whose score
    is at least ``low`` hundredths of the positive's and at most the positive's. Scores are inner products of floor(scale * component).
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = vectors.select(F.col(f"`{id_column}`").cast("long").alias("id"), label.cast("long").alias("label"), F.coalesce(anchor, F.lit(False)).alias("anchor"), F.col(f"`{vector_column}`").cast("array<double>").alias("vector"))
    row_blocks = stage(blocks(rows.filter("id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL"), scale), "row-blocks")
    n_rows = row_blocks.agg(F.sum("rows")).first()[0] or 0
    n_anchors = rows.filter("anchor").count()
    anchors = stage(anchor_blocks(row_blocks, n_anchors), "anchor-blocks")
    tiles = stage(reduced(partial_tiles(row_blocks, anchors, n_rows, n_anchors), positives, low), "tiles")
    windows = stage(best_positives(tiles, positives), "windows")
    few = windows.limit(MOST_SENT + 1).count() <= MOST_SENT
    found = in_windows(tiles, F.broadcast(windows) if few else windows, negatives, low)
    order = Window.partitionBy("anchor_block", "anchor", "window").orderBy(F.desc("score"), "id", "uid")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    names = anchors.select("anchor_block", "ids").mapInArrow(_named, "anchor_block long, anchor long, anchor_id long")
    return best.join(names, ["anchor_block", "anchor"]).select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for block, data in zip(batch.column("anchor_block").to_pylist(), batch.column("ids").to_pylist(), strict=True):
            ids = np.frombuffer(data, I)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), block)), pa.array(np.arange(len(ids))), pa.array(ids)], names=["anchor_block", "anchor", "anchor_id"])
