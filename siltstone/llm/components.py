"""Connected components of a table of links, by contraction.

Every round gives each vertex that still has links a mark (a hash of its key, another one every round) and lets it
move to the neighbour with the smallest mark, if that is below its own. Two jumps follow such moves to their ends, or near
them; then links are renamed by where their ends went, and those that became loops go. A vertex stays only if its mark is the
smallest among its neighbours' (or if it lies at most three moves up a chain), which has a chance of at most one half whatever the
shape of the graph, as marks are drawn anew. So the links of a chain halve every round, like those of
any other graph: rounds grow with the logarithm of the number of vertices, and there is no limit to them.

What is left is settled in one task once it has at most ``small`` links, so that the last rounds don't cost a dozen jobs each.
The moves of all rounds are then followed back from the last to the first; their tables shrink as the links do.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import stage

SMALL = 200_000


def components(links: DataFrame, small: int = SMALL) -> DataFrame:
    """key and root (the smallest key of its component) for every key in a link (a, b).

    Loops make a component of one key; repeated and reversed links count once; a link with a null end is no link; no links, no rows.
    """
    clean = links.select("a", "b").filter("a IS NOT NULL AND b IS NOT NULL")
    edges = stage(clean.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links")
    loops = edges.filter("a = b").select(F.col("a").alias("key"))
    edges = edges.filter("a <> b")
    moves: list[DataFrame] = []
    while edges.limit(small + 1).count() > small:
        moves.append(_moved(edges, len(moves)))
        step = moves[-1]
        renamed = edges.join(step.toDF("a", "to_a"), "a").join(step.toDF("b", "to_b"), "b").filter("to_a <> to_b")
        edges = stage(renamed.select(F.least("to_a", "to_b").alias("a"), F.greatest("to_a", "to_b").alias("b")).distinct(), "links")
    placed = stage(edges.coalesce(1).mapInArrow(_united, "key long, root long"), "roots")
    for step in reversed(moves):
        placed = step.join(placed.toDF("to", "root"), "to", "left").select("key", F.coalesce("root", "to").alias("root"))
    least = placed.groupBy("root").agg(F.min("key").alias("least"))
    named = placed.join(least, "root").select("key", F.col("least").alias("root"))
    alone = loops.join(named, "key", "left_anti").select("key", F.col("key").alias("root"))
    return stage(named.unionByName(alone), "components")


def _moved(edges: DataFrame, turn: int) -> DataFrame:
    """key and to: where each vertex goes in this round (itself, if it stays)."""
    mark = lambda c: F.struct(F.xxhash64(F.lit(turn), c).alias("mark"), F.col(c).alias("v"))
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    nearest = both.groupBy("a").agg(F.min(mark("b")).alias("near"))
    to = stage(nearest.select(F.col("a").alias("key"), F.least("near", mark("a"))["v"].alias("to")), "moves")
    for _ in range(2):
        to = to.join(to.toDF("to", "further"), "to").select("key", F.col("further").alias("to"))
    return stage(to, "moves")


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded number of links; a root is any key of its component."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            a, b = top(a), top(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
    keys = list(parent)
    for i in range(0, len(keys), 50_000):
        part = keys[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array([top(k) for k in part], pa.int64())], names=["key", "root"])
