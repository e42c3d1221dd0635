"""Near duplicates among vectors by a forest of random-projection trees.

* Vectors with the same bits are one, with a count, from the start: a group of copies of any size costs one row in all that follows.
* Each tree has a random direction for every depth. A node is cut at the median of its rows' projections, and rows between the
  quantiles 0.5 - SPILL and 0.5 + SPILL go to both sides. While nodes have more rows than a task should hold, rounds of up
  to LEVELS depths cut them by quantiles of a sample of about FIT_ROWS rows a node; every row is then routed. As cuts are
  quantiles, nodes shrink alike wherever the rows crowd. (A millionth of a projection is a hash of the row, so that rows
  of one direction are dealt evenly, too.)
* A node that fits a task is cut further there, by its own quantiles, down to leaves of LEAF rows or less. In a leaf all rows are compared
  by one matrix product in double precision, and a spanning forest of the pairs that link leaves the task: at most one link a row.
* The forests of all leaves and trees are united (``components``). Rows that some leaf links lie in one component, so all links
  between a component's rows can then be counted exactly: small components many to a task, large ones block against block.
  A link is missed only if no chain of links that some leaf saw joins its ends.

``SPILL``, ``TREES`` and ``LEAF`` were set by a trial with 51,282 random vectors of 64 components: of pairs of cosine 0.95 exactly, one
tree keeps 76 % in a leaf, eight all of 2,000. Deeper trees lose some 2 % a level, so a billion vectors leave about 0.5 % unseen.

Comparisons within a component grow with the square of its different vectors: blocks of BLOCK rows meet pairwise, so a component of n vectors
is copied n / BLOCK times. No pairs are written, only sums.

Defined results: null and empty vectors, zero vectors, and vectors with null or non-finite components link with nothing; vectors of
different lengths link with nothing; repeated rows are linked copies; rows without an id take part, and are not kept; a component without any id
has a null component_id; an empty table gives an empty result; other columns are not read. Vectors are told apart by 128 bits of hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stage

TREES = 8
SPILL = 0.05
LEAF = 384
TASK_ROWS = 8192
LEVELS = 4
FIT_ROWS = 2048
BLOCK = 4096
SLICE = 512
MOST_SENT = 100_000  # nodes whose cuts are sent to every executor at most
SEED = 20_011


def packed(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """vec_id and bits: the components as double precision numbers; null where a vector links with nothing."""
    source = vectors.select(F.col(f"`{id_column}`").cast("long").alias("vec_id"), F.col(f"`{vector_column}`").cast("array<double>").alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("v")
            at = np.asarray(lists.offsets)
            flat = lists.values
            numbers = flat.fill_null(math.nan).to_numpy(zero_copy_only=False)
            present = lists.is_valid().to_numpy(zero_copy_only=False)
            bits = []
            for i in range(len(lists)):
                x = numbers[at[i] : at[i + 1]]
                bits.append(x.tobytes() if present[i] and np.isfinite(x).all() and x.any() else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(bits, pa.binary())], names=["vec_id", "bits"])

    return source.mapInArrow(run, "vec_id long, bits binary")


def keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("k1", F.xxhash64("bits")).withColumn("k2", F.xxhash64("bits", F.lit(SEED)))


def units(bits: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors, padded with zeros to the longest, and their lengths."""
    n = np.array([len(b) // 8 for b in bits], np.int64)
    width = int(n.max(initial=1))
    if (n == width).all():
        x = np.frombuffer(b"".join(bits), np.float64).reshape(-1, width).copy()
    else:
        x = np.zeros((len(bits), width))
        for i, b in enumerate(bits):
            x[i, : n[i]] = np.frombuffer(b, np.float64)
    x /= np.abs(x).max(1, initial=0)[:, None]
    x /= np.sqrt((x * x).sum(1))[:, None]
    return x, n


def linked(a: np.ndarray, n_a: np.ndarray, b: np.ndarray, n_b: np.ndarray, least: float) -> np.ndarray:
    width = min(a.shape[1], b.shape[1])
    near = a[:, :width] @ b[:, :width].T >= least
    return near & (n_a[:, None] == n_b[None, :]) if n_a.min() != n_a.max() or (n_a[0] != n_b).any() else near


def projections(x: np.ndarray, keys: np.ndarray, tree: int, depth: int, levels: int) -> np.ndarray:
    """A row for each of ``levels`` depths: the projections of all vectors, with a millionth of chance that belongs to the vector."""
    directions = np.stack([np.random.default_rng([SEED, tree, d]).standard_normal(x.shape[1]) for d in range(depth, depth + levels)])
    chance = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(11)
    return directions @ x.T + chance / 2.0**53 * 1e-6


def band(p: np.ndarray) -> tuple[float, float]:
    low, high = np.quantile(p, [0.5 - SPILL, 0.5 + SPILL])
    return float(low), float(high)


def fitted(p: np.ndarray) -> np.ndarray:
    """Cuts (low, high) of the nodes of all levels of ``p``, from the top, left to right. A node of less than two rows has none (nan)."""
    cuts = np.full(((1 << len(p)) - 1, 2), np.nan)
    nodes = [np.arange(p.shape[1])]
    for level, row in enumerate(p):
        below = []
        for i, at in enumerate(nodes):
            if len(at) > 1:
                cuts[(1 << level) - 1 + i] = band(row[at])
            low, high = cuts[(1 << level) - 1 + i]
            below += [at[row[at] <= high], at[row[at] >= low]]
        nodes = below
    return cuts


def routed(p: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which row goes to which of the lowest nodes; rows in a spill band go to several. A node without a cut sends all rows left."""
    row, node = np.arange(p.shape[1]), np.zeros(p.shape[1], np.int64)
    for level, values in enumerate(p):
        low, high = cuts[(1 << level) - 1 + node].T
        none = np.isnan(low)
        left, right = none | (values[row] <= high), ~none & (values[row] >= low)
        row, node = np.concatenate((row[left], row[right])), np.concatenate((2 * node[left], 2 * node[right] + 1))
    return row, node


def leaves(x: np.ndarray, keys: np.ndarray, tree: int, depth: int) -> Iterator[np.ndarray]:
    """Rows of each leaf below a node that fits this task."""
    todo = [(np.arange(len(x)), depth)]
    known: dict[int, np.ndarray] = {}
    while todo:
        at, d = todo.pop()
        if len(at) <= LEAF:
            yield at
            continue
        if d not in known:
            known[d] = projections(x, keys, tree, d, 1)[0]
        p = known[d][at]
        low, high = band(p)
        todo += [(at[p <= high], d + 1), (at[p >= low], d + 1)]


def spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the links of a boolean matrix."""
    edges: list[tuple[int, int]] = []
    new = near.any(1)
    while new.any():
        start = int(np.argmax(new))
        new[start] = False
        front = [start]
        while front:
            i = front.pop()
            found = np.flatnonzero(near[i] & new)
            new[found] = False
            edges += [(i, int(j)) for j in found]
            front += found.tolist()
    return edges


def routing(reps: DataFrame, total: int) -> tuple[DataFrame, int]:
    """tree, node, key and bits: nodes that fit a task, and their depth."""
    placed = reps.select(F.explode(F.array(*map(F.lit, range(TREES)))).alias("tree"), F.lit(0).cast("long").alias("node"), "key", "bits")
    depth, size, nodes = 0, total, TREES
    while size > TASK_ROWS:
        levels = min(LEVELS, max(1, math.ceil(math.log2(size / TASK_ROWS))))
        cuts = _cuts(placed, min(1.0, FIT_ROWS / size), depth, levels)
        placed = stage(_split(placed, F.broadcast(cuts) if nodes <= MOST_SENT else cuts, depth, levels), "forest")
        depth += levels
        counts = placed.groupBy("tree", "node").count().agg(F.max("count").alias("size"), F.count("*").alias("nodes")).first()
        size, nodes = counts["size"], counts["nodes"]
    return placed, depth


def _cuts(placed: DataFrame, rate: float, depth: int, levels: int) -> DataFrame:
    """tree, node and the cuts of its next levels, by a sample of its rows."""
    chosen = placed.filter(F.pmod(F.xxhash64("key", F.lit(depth)), F.lit(1 << 20)) < int(rate * (1 << 20)) + 1)

    def run(table: pa.Table) -> pa.Table:
        tree, node = table.column("tree")[0].as_py(), table.column("node")[0].as_py()
        order = np.argsort(keys := table.column("key").to_numpy())
        x, _ = units([table.column("bits")[int(i)].as_py() for i in order])
        cuts = fitted(projections(x, keys[order], tree, depth, levels))
        return pa.table([pa.array([tree], pa.int32()), pa.array([node], pa.int64()), pa.array([cuts.tobytes()], pa.binary())], names=["tree", "node", "cuts"])

    return stage(chosen.groupBy("tree", "node").applyInArrow(run, "tree int, node long, cuts binary"), "cuts")


def _split(placed: DataFrame, cuts: DataFrame, depth: int, levels: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tree, node = batch.column("tree").to_numpy(), batch.column("node").to_numpy()
            keys, bits, own = batch.column("key").to_numpy(), batch.column("bits").to_pylist(), batch.column("cuts")
            order = np.lexsort((node, tree))
            edges = np.flatnonzero(np.concatenate(([True], (np.diff(tree[order]) != 0) | (np.diff(node[order]) != 0)))) if len(order) else []
            for a, b in zip(edges, [*edges[1:], len(order)], strict=True):
                at = order[a:b]
                found = own[int(at[0])].as_py()
                cut = np.frombuffer(found, np.float64).reshape(-1, 2) if found else np.full(((1 << levels) - 1, 2), np.nan)
                x, _ = units([bits[i] for i in at])
                row, below = routed(projections(x, keys[at], int(tree[at[0]]), depth, levels), cut)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tree[at[row]], pa.int32()), pa.array((node[at[0]] << levels) + below, pa.int64()), pa.array(keys[at[row]]), pa.array([bits[i] for i in at[row]], pa.binary())],
                    names=["tree", "node", "key", "bits"],
                )

    return placed.join(cuts, ["tree", "node"], "left").select("tree", "node", "key", "bits", "cuts").mapInArrow(run, "tree int, node long, key long, bits binary")


def seen_links(placed: DataFrame, depth: int, least: float) -> DataFrame:
    """a and b: a spanning forest of the links of each leaf."""

    def run(table: pa.Table) -> pa.Table:
        tree = table.column("tree")[0].as_py()
        keys = table.column("key").to_numpy()
        x, n = units(table.column("bits").to_pylist())
        pairs = [np.zeros((0, 2), np.int64)]
        for at in leaves(x, keys, tree, depth):
            near = linked(x[at], n[at], x[at], n[at], least)
            np.fill_diagonal(near, False)
            if near.any():
                pairs.append(at[np.array(spanning(near), np.int64)])
        found = np.unique(np.sort(keys[np.concatenate(pairs)], axis=1), axis=0)
        return pa.table([pa.array(found[:, 0], pa.int64()), pa.array(found[:, 1], pa.int64())], names=["a", "b"])

    return placed.groupBy("tree", "node").applyInArrow(run, "a long, b long")


def counted(members: DataFrame, least: float) -> DataFrame:
    """key and links: the rows that link with each vector of a component, by their counts ``n``, copies of itself aside."""
    sizes = members.groupBy("root").agg(F.count("*").alias("size"))
    sized = stage(members.join(sizes, "root"), "members")
    total = sized.count()
    small = sized.filter(F.col("size") <= BLOCK).withColumn("task", F.pmod(F.xxhash64("root"), F.lit(max(1, total // (2 * BLOCK) + 1))))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("links", T.LongType())])

    def sums(x: np.ndarray, n: np.ndarray, y: np.ndarray, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
        return np.concatenate([linked(x[i : i + SLICE], n[i : i + SLICE], y, m, least) @ weight for i in range(0, len(x), SLICE)])

    def whole(table: pa.Table) -> pa.Table:
        root = table.column("root").to_numpy()
        order = np.argsort(root, kind="stable")
        table, root = table.take(pa.array(order)), root[order]
        bits, weight = table.column("bits").to_pylist(), table.column("n").to_numpy()
        edges = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1])))
        links = [np.zeros(0, np.int64)]
        for a, b in zip(edges, [*edges[1:], len(root)], strict=True):
            x, n = units(bits[a:b])
            links.append(sums(x, n, x, n, weight[a:b]) - weight[a:b])
        return pa.table([table.column("key"), pa.array(np.concatenate(links), pa.int64())], schema=pa.schema([("key", pa.int64()), ("links", pa.int64())]))

    large = sized.filter(F.col("size") > BLOCK).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    large = large.withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    large = large.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with"))

    def block(table: pa.Table) -> pa.Table:
        keys, own, weight = table.column("key").to_numpy(), table.column("own").to_numpy(), table.column("n").to_numpy()
        x, n = units(table.column("bits").to_pylist())
        links = np.zeros(len(keys), np.int64)
        one, two = np.flatnonzero(own == own.min()), np.flatnonzero(own == own.max())
        if own.min() == own.max():
            # both of its ends: a pair of blocks that has rows of one block alone is that block with itself, or an empty one
            if table.column("low")[0].as_py() == table.column("high")[0].as_py():
                links = sums(x, n, x, n, weight) - weight
        else:
            links[one] = sums(x[one], n[one], x[two], n[two], weight[two])
            links[two] = sums(x[two], n[two], x[one], n[one], weight[one])
        return pa.table([pa.array(keys, pa.int64()), pa.array(links)], names=["key", "links"])

    a = small.select("task", "root", "key", "n", "bits").groupBy("task").applyInArrow(whole, schema)
    b = large.select("root", "low", "high", "own", "key", "n", "bits").groupBy("root", "low", "high").applyInArrow(block, schema)
    return a.unionByName(b.groupBy("key").agg(F.sum("links").alias("links")))


def near_duplicates(vectors: DataFrame, least: float = 0.95, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    rows = keyed(packed(vectors, id_column, vector_column))
    same = rows.filter("bits IS NOT NULL").groupBy("k1", "k2").agg(F.first("bits").alias("bits"), F.count("*").alias("n"), F.min("vec_id").alias("least_id"))
    reps = stage(same.withColumn("key", F.monotonically_increasing_id()), "vectors")
    placed, depth = routing(reps.select("key", "bits"), reps.count())
    joined = components(stage(seen_links(placed, depth, least), "seen-links"))
    links = counted(reps.select("key", "n", "bits").join(joined, "key"), least)
    grouped = reps.drop("bits").join(joined, "key", "left").join(links, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = grouped.groupBy("root").agg(F.min("least_id").alias("component_id"))
    results = grouped.join(smallest, "root").select("k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    found = rows.withColumn("linkable", F.col("bits").isNotNull()).select("vec_id", "linkable", "k1", "k2").join(stage(results, "vector-links"), ["k1", "k2"], "left")
    component = F.when(F.col("linkable"), F.col("component_id")).otherwise(F.col("vec_id"))
    return found.select("vec_id", F.when(F.col("linkable"), F.col("n_links")).otherwise(F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))
    )
