"""Dependency graphs: edges, levels, critical paths, cycles.

Frontiers move by joins, one step a round, until nothing moves; no length is fixed. Every round
writes its small result to the checkpoint folder, so a round's plan reads files and never the
rounds before it.
"""

from __future__ import annotations

from collections import deque
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..session import cut
from .places import places

SMALL = 200_000  # nodes and arcs of a graph, or of many small graphs together, that one task orders


def edges(nodes: DataFrame, node: str = "node", depends: str = "depends_on") -> DataFrame:
    """src -> dst for each dependency that names another node of the table."""
    pairs = nodes.select(F.explode(depends).alias("src"), F.col(node).alias("dst")).filter("src <> dst").distinct()
    return pairs.join(nodes.select(F.col(node).alias("src")).distinct(), "src", "left_semi")


def ordered(nodes: DataFrame, arcs: DataFrame, with_paths: bool = True) -> DataFrame:
    """node, level (length of the longest way that leads to it) and, if wanted, path: that way as node>node>...,
    the smallest of equally long ones. Nodes on or behind a cycle have null in both.

    A node is placed when its last source is; until then it keeps its open sources and the best way so
    far. A round reads only the arcs that leave the nodes placed in the round before.
    """
    name = F.col("node").cast("string")
    inward = arcs.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("open"))
    best = F.struct(F.lit(0).alias("order"), F.lit(None).cast("string").alias("path"))
    waiting = cut(nodes.select("node").distinct().join(inward, "node", "left").select("node", F.coalesce("open", F.lit(0)).alias("open"), best.alias("best")))
    ready = waiting.filter("open = 0").select("node", F.lit(0).alias("level"), name.alias("path"))
    waiting = waiting.filter("open > 0")
    placed = [ready]
    while not ready.isEmpty():
        step = F.struct((-F.col("level") - 1).alias("order"), (F.col("path") if with_paths else F.lit(None).cast("string")).alias("path"))
        offers = arcs.join(ready.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("done"), F.min(step).alias("offer"))
        moved = waiting.join(offers, "node", "left")
        waiting = cut(moved.select("node", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open"), F.least("best", F.coalesce("offer", "best")).alias("best")))
        ready = waiting.filter("open = 0").select("node", (-F.col("best.order")).alias("level"), F.concat("best.path", F.lit(">"), name).alias("path"))
        waiting = waiting.filter("open > 0")
        placed.append(ready)
    found = reduce(DataFrame.unionByName, placed)
    return nodes.select("node").distinct().join(found if with_paths else found.drop("path"), "node", "left")


def levels(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    return ordered(nodes, arcs, with_paths=False)


def critical_path(nodes: DataFrame, arcs: DataFrame) -> DataFrame:
    """For each node with an arc that lies on no cycle and behind none, the longest path to it and its number of nodes."""
    linked = arcs.select(F.explode(F.array("src", "dst")).alias("node")).distinct()
    found = ordered(nodes, arcs).filter("level IS NOT NULL").join(linked, "node", "left_semi")
    return found.select("node", (F.col("level") + 1).alias("n_nodes"), "path")


def cycles(arcs: DataFrame) -> DataFrame:
    """Nodes that reach themselves, with the length of the shortest way.

    Nodes without a way in or out are peeled off first; from the rest, searches spread side by
    side, each over every node once, and end where they return.
    """
    core, n = cut(arcs.select("src", "dst").distinct()), -1
    while (left := core.count()) != n:
        n = left
        core = cut(core.join(core.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(core.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"))
    onward = core.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    seen = cut(onward.select(F.col("at").alias("start"), F.col("next").alias("at"), F.lit(1).alias("steps")))
    front, found = seen, [seen.filter("start = at")]
    for steps in range(2, n + 2):  # no way back is longer than the arcs that are left
        open_ = front.join(found[-1].select("start"), "start", "left_anti")
        nearer = open_.join(onward, "at").select("start", F.col("next").alias("at")).distinct().join(seen, ["start", "at"], "left_anti")
        front = cut(nearer.withColumn("steps", F.lit(steps)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front))
        found.append(front.filter("start = at"))
    return reduce(DataFrame.unionByName, found).groupBy(F.col("start").alias("node")).agg(F.min("steps").alias("cycle_length"))


def node_risk(confidence: Column, supported: Column) -> Column:
    """1 to 10 from a node's confidence, two more without support."""
    return C.clip((F.bround((1 - confidence) * 9, 0) + 1 + F.when(supported, 0).otherwise(2)).cast("int"), 1, 10)


def renumber(nodes: DataFrame, arcs: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes numbered 1, 2, ... in an order within their graph, and arcs in the new numbers."""
    numbered = nodes.withColumn("number", F.row_number().over(Window.partitionBy("graph").orderBy(*order)))
    key = numbered.select("graph", "node", "number")
    moved = (
        arcs.join(key.select("graph", F.col("node").alias("src"), F.col("number").alias("src_number")), ["graph", "src"])
        .join(key.select("graph", F.col("node").alias("dst"), F.col("number").alias("dst_number")), ["graph", "dst"])
        .select("graph", "src_number", "dst_number")
    )
    return numbered, moved


def kahn(nodes: DataFrame, arcs: DataFrame, small: int = SMALL) -> DataFrame:
    """graph, node, place and ordered: the order in which a queue takes the nodes of each graph.

    The queue begins with the nodes without a way in, by id, and takes a node in when the last of its sources has left; those that become ready together
    come by id. Nodes on a cycle or behind one are not ``ordered`` and come last, by id. Graphs of up to ``small`` nodes and arcs are ordered many
    to a task. In larger ones all nodes of a level leave before those of the next and, within a level, follow their last
    source, then their id: a level is one round for all large graphs, and its places are counted by ranges.
    """
    known = nodes.select("graph", F.col("node").cast("long").alias("node")).distinct()
    ways = arcs.select("graph", F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("node")).filter("src <> node").distinct()
    ways = ways.join(known, ["graph", "node"], "left_semi").join(known.withColumnRenamed("node", "src"), ["graph", "src"], "left_semi")
    items = cut(known.select("graph", "node", F.lit(None).cast("long").alias("src")).unionByName(ways))
    sizes = cut(items.groupBy("graph").count())
    large = sizes.filter(F.col("count") > small).select("graph")
    few = items.join(large, "graph", "left_anti")
    packs = max(1, -(-(sizes.filter(F.col("count") <= small).agg(F.sum("count")).first()[0] or 0) // max(1, small)))
    kind = nodes.schema["graph"].dataType.simpleString()
    found = few.withColumn("pack", F.pmod(F.xxhash64("graph"), F.lit(packs))).groupBy("pack").applyInArrow(_queued, f"graph {kind}, node long, place long, ordered boolean")
    if large.isEmpty():
        return found
    return found.unionByName(_queued_by_levels(items.join(large, "graph", "left_semi")))


def _queued(table: pa.Table) -> pa.Table:
    graphs: dict[object, dict[int, list[int]]] = {}
    for g, node, src in zip(*(table.column(c).to_pylist() for c in ("graph", "node", "src")), strict=True):
        sources = graphs.setdefault(g, {}).setdefault(node, [])
        if src is not None:
            sources.append(src)
    out = []
    for g, sources in graphs.items():
        ids, onward = sorted(sources), {}
        for node in ids:
            for s in sources[node]:
                onward.setdefault(s, []).append(node)  # by id, as ids are
        open_ = {node: len(s) for node, s in sources.items()}
        queue, done = deque(n for n in ids if not open_[n]), []
        while queue:
            done.append(node := queue.popleft())
            for child in onward.get(node, ()):
                open_[child] -= 1
                if not open_[child]:
                    queue.append(child)
        out += [(g, n, i, True) for i, n in enumerate(done)]
        out += [(g, n, len(done) + i, False) for i, n in enumerate(n for n in ids if open_[n])]
    columns = list(zip(*out, strict=True)) or [[]] * 4
    kinds = [table.schema.field("graph").type, pa.int64(), pa.int64(), pa.bool_()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["graph", "node", "place", "ordered"])


def _queued_by_levels(items: DataFrame) -> DataFrame:
    ways = cut(items.filter("src IS NOT NULL"))
    inward = ways.groupBy("graph", "node").agg(F.count("*").alias("open"))
    waiting = items.filter("src IS NULL").select("graph", "node").join(inward, ["graph", "node"], "left").withColumn("open", F.coalesce("open", F.lit(0)))
    waiting = cut(waiting.withColumn("last", F.lit(-1).cast("long")))
    taken = cut(waiting.groupBy("graph").agg(F.lit(0).cast("long").alias("taken")))
    found = []
    while True:
        ready = waiting.filter("open = 0")
        over = ready.isEmpty()
        ranked = places(waiting if over else ready, ["graph"], ["node"] if over else ["last", "node"], "nth")
        placed = cut(ranked.join(taken, "graph").select("graph", "node", (F.col("taken") + F.col("nth")).alias("place"), F.lit(not over).alias("ordered")))
        found.append(placed)
        if over:
            return reduce(DataFrame.unionByName, found)
        moved = ways.join(placed.select("graph", F.col("node").alias("src"), "place"), ["graph", "src"]).groupBy("graph", "node").agg(F.count("*").alias("done"), F.max("place").alias("latest"))
        still = waiting.filter("open > 0").join(moved, ["graph", "node"], "left")
        waiting = cut(still.select("graph", "node", (F.col("open") - F.coalesce("done", F.lit(0))).alias("open"), F.greatest("last", "latest").alias("last")))
        taken = cut(taken.join(placed.groupBy("graph").count(), "graph", "left").select("graph", (F.col("taken") + F.coalesce("count", F.lit(0))).alias("taken")))
