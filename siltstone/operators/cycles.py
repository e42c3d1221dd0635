"""Cycles of a dependency graph: strongly connected components, and a shortest cycle of each.

Components are found on a shrinking graph. Every round trims nodes without a way in or without a way out, and folds nodes with a single way in
or a single way out into their neighbours: for a folded node v with ways a -> v -> b there are now ways a -> b, and v belongs to
the component of a and b if these two share one. As one side is single, folding adds no arcs. Folded nodes are no neighbours of each other: of two
candidates side by side the one with the smaller mark (a hash, another one every round) goes, so a long chain or ring shrinks by
a constant part a round. What then still has more than ``small`` arcs and nothing to trim or fold is cut up by colours: every node takes the smallest
node that reaches it, and what reaches back to that node within its colour is its component. At ``small`` arcs one task finishes.

A shortest cycle through the smallest node of each component is found in the same way: nodes with one way in and one way out fold
into an arc with the sum of their lengths, a search runs over what is left, and the arcs that it took unfold again, each into two a round.

Rounds so grow with the logarithm of the length of chains and rings, and with the diameter of what is left of more than ``small`` arcs.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut

SMALL = 200_000


def _mark(column: str, turn: int) -> F.Column:
    return F.struct(F.xxhash64(F.lit(turn), column).alias("mark"), F.col(column).alias("node"))


def _chosen(core: DataFrame, candidates: DataFrame, turn: int) -> DataFrame:
    """Candidates that no candidate beside them outdoes."""
    one, two = candidates.withColumnRenamed("node", "src"), candidates.withColumnRenamed("node", "dst")
    beside = core.join(one, "src", "left_semi").join(two, "dst", "left_semi")
    loser = F.greatest(_mark("src", turn), _mark("dst", turn))["node"]
    return cut(candidates.join(beside.select(loser.alias("node")).distinct(), "node", "left_anti"))


def components(arcs: DataFrame, small: int = SMALL) -> DataFrame:
    """node and component (its smallest node) of every node on a cycle; other nodes are left out. Arcs from a node to itself count for nothing."""
    core = cut(arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst").distinct())
    folds: list[DataFrame] = []
    loops: list[DataFrame] = []
    solved: list[DataFrame] = []
    turn = 0
    while core.limit(small + 1).count() > small:
        turn += 1
        degrees = cut(
            core.select(F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("x"))
            .groupBy("x.node")
            .agg(F.sum("x.i").alias("ways_in"), F.sum(1 - F.col("x.i")).alias("ways_out"))
        )
        ends = degrees.filter("ways_in = 0 OR ways_out = 0").select("node")
        chosen = _chosen(core, degrees.filter("(ways_in = 1 OR ways_out = 1) AND ways_in > 0 AND ways_out > 0").select("node"), turn)
        gone = cut(ends.unionByName(chosen))
        if gone.isEmpty():
            found, core = _coloured(core)
            solved.append(found)
            continue
        into = core.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select(F.col("src").alias("a"), F.col("dst").alias("node"))
        out = core.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("node"), F.col("dst").alias("b"))
        fold = cut(into.join(out, "node"))
        folds.append(fold)
        kept = core.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti")
        made = fold.select(F.col("a").alias("src"), F.col("b").alias("dst")).join(ends.withColumnRenamed("node", "src"), "src", "left_anti").join(ends.withColumnRenamed("node", "dst"), "dst", "left_anti")
        loops.append(fold.filter("a = b").select(F.col("a").alias("node")).distinct())
        core = cut(kept.unionByName(made.filter("src <> dst")).distinct())
    solved.append(cut(core.coalesce(1).mapInArrow(_in_one_task, "node long, component long")))
    placed = reduce(DataFrame.unionByName, solved)
    if folds:
        alone = reduce(DataFrame.unionByName, loops).distinct()
        alone = cut(alone.withColumn("component", F.col("node")))
        folded = reduce(DataFrame.unionByName, [f.select("node") for f in folds]).distinct()
        placed = cut(placed.unionByName(alone.join(placed, "node", "left_anti").join(folded, "node", "left_anti")))
        for fold in reversed(folds):
            side = lambda c: placed.toDF(c, f"of_{c}")  # noqa: B023, E731
            shared = fold.join(side("a"), "a").join(side("b"), "b").filter("of_a = of_b").select("node", F.col("of_a").alias("component")).distinct()
            own = alone.join(fold.select("node").distinct(), "node", "left_semi").join(shared, "node", "left_anti")
            placed = cut(placed.unionByName(shared).unionByName(own))
    least = placed.groupBy("component").agg(F.min("node").alias("least"))
    return cut(placed.join(least, "component").select("node", F.col("least").alias("component")))


def _coloured(core: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Components of the colours' first nodes, and the arcs that are left within colours."""
    colour = cut(core.select(F.explode(F.array("src", "dst")).alias("node")).distinct().withColumn("colour", F.col("node")))
    front = colour
    while True:
        offers = core.join(front.toDF("src", "offer"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("offer").alias("offer"))
        moved = cut(colour.join(offers, "node", "left").select("node", F.least("colour", F.coalesce("offer", "colour")).alias("colour"), (F.col("offer") < F.col("colour")).alias("moved")))
        front = moved.filter("moved").select("node", "colour")
        colour = moved.select("node", "colour")
        if front.isEmpty():
            break
    inside = core.join(colour.toDF("src", "colour"), "src").join(colour.toDF("dst", "other"), "dst").filter("colour = other").select("src", "dst", "colour")
    inside = cut(inside)
    found = front = cut(colour.filter("node = colour"))
    while not front.isEmpty():
        front = cut(inside.join(front.toDF("dst", "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct().join(found, ["node", "colour"], "left_anti"))
        found = cut(found.unionByName(front))
    done = found.select("node")
    left = inside.select("src", "dst").join(done.withColumnRenamed("node", "src"), "src", "left_anti").join(done.withColumnRenamed("node", "dst"), "dst", "left_anti")
    sizes = found.groupBy("colour").count().filter("count > 1").select("colour")
    return cut(found.join(sizes, "colour").select("node", F.col("colour").alias("component"))), cut(left)


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of two nodes or more of a bounded graph, by one search that keeps its own stack."""
    onward: dict[int, list[int]] = {}
    for batch in batches:
        for a, b in zip(batch.column("src").to_pylist(), batch.column("dst").to_pylist(), strict=True):
            onward.setdefault(a, []).append(b)
    seen: dict[int, int] = {}  # the order in which nodes were met
    low: dict[int, int] = {}
    open_: list[int] = []
    closed: set[int] = set()
    out: list[tuple[int, int]] = []
    for root in onward:
        if root in seen:
            continue
        work = [(root, iter(onward[root]))]
        seen[root] = low[root] = len(seen)
        open_.append(root)
        while work:
            node, ways = work[-1]
            for to in ways:
                if to not in seen:
                    seen[to] = low[to] = len(seen)
                    open_.append(to)
                    work.append((to, iter(onward.get(to, ()))))
                    break
                if to not in closed:
                    low[node] = min(low[node], seen[to])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == seen[node]:
                    at = len(open_) - 1
                    while open_[at] != node:
                        at -= 1
                    members = open_[at:]
                    del open_[at:]
                    closed.update(members)
                    if len(members) > 1:
                        out += [(m, node) for m in members]
    for i in range(0, len(out), 50_000):
        part = out[i : i + 50_000]
        yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in part], pa.int64()), pa.array([c for _, c in part], pa.int64())], names=["node", "component"])


_PIECE = "component long, position long, src long, dst long, turn int, mid long"


def shortest(arcs: DataFrame, members: DataFrame, small: int = SMALL) -> DataFrame:
    """component, position (from 0, at the smallest node) and node of a shortest cycle through the smallest node of each component.

    Where arcs were not folded, the cycle is the smallest of equally short ones, compared node by node.
    """
    inside = arcs.select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")).filter("src <> dst").distinct()
    inside = inside.join(members.toDF("src", "component"), "src").join(members.toDF("dst", "other"), "dst").filter("component = other")
    now = cut(inside.select("component", "src", "dst", F.lit(1).cast("long").alias("length"), F.lit(0).alias("turn"), F.lit(None).cast("long").alias("mid")))
    before: list[DataFrame] = []
    turn = 0
    while True:
        crowded = cut(now.groupBy("component").count().filter(F.col("count") > small).select("component"))
        if crowded.isEmpty():
            break
        large = now.join(crowded, "component", "left_semi")
        ends = F.explode(F.array(F.struct(F.col("src").alias("node"), F.lit(0).alias("i")), F.struct(F.col("dst").alias("node"), F.lit(1).alias("i")))).alias("x")
        degrees = large.select("component", ends).groupBy("component", "x.node").agg(F.sum("x.i").alias("ways_in"), F.sum(1 - F.col("x.i")).alias("ways_out"))
        single = cut(degrees.filter("ways_in = 1 AND ways_out = 1 AND node <> component").select("node"))
        chosen = _chosen(large.filter("src <> dst"), single, turn := turn + 1)
        if chosen.isEmpty():
            break
        before.append(now)
        into = now.join(chosen.withColumnRenamed("node", "dst"), "dst", "left_semi").select("component", F.col("src").alias("a"), F.col("dst").alias("mid"), F.col("length").alias("one"))
        out = now.join(chosen.withColumnRenamed("node", "src"), "src", "left_semi").select(F.col("src").alias("mid"), F.col("dst").alias("b"), F.col("length").alias("two"))
        made = into.join(out, "mid").filter("a <> b OR a = component").select("component", F.col("a").alias("src"), F.col("b").alias("dst"), (F.col("one") + F.col("two")).alias("length"), F.lit(turn).alias("turn"), "mid")
        kept = now.join(chosen.withColumnRenamed("node", "src"), "src", "left_anti").join(chosen.withColumnRenamed("node", "dst"), "dst", "left_anti")
        best = F.min(F.struct("length", "turn", "mid")).alias("best")
        now = cut(kept.unionByName(made).groupBy("component", "src", "dst").agg(best).select("component", "src", "dst", "best.*"))
    sizes = now.groupBy("component").count()
    fits = now.join(sizes.filter(F.col("count") <= small).select("component"), "component", "left_semi")
    packs = max(1, -(-now.count() // max(1, small)))
    pieces = cut(fits.withColumn("pack", F.pmod(F.xxhash64("component"), F.lit(packs))).groupBy("pack").applyInArrow(_searched, _PIECE))
    if not crowded.isEmpty():
        pieces = cut(pieces.unionByName(_searched_by_rounds(now.join(sizes.filter(F.col("count") > small).select("component"), "component", "left_semi"))))
    for k in range(len(before), 0, -1):
        whole, folded = pieces.filter(F.col("turn") < k), pieces.filter(F.col("turn") == k)
        way = before[k - 1]
        first = folded.select("component", "position", "src", F.col("mid").alias("dst")).join(way, ["component", "src", "dst"])
        second = folded.select("component", "position", "src", F.col("mid").alias("via"), F.col("dst").alias("to"))
        step = way.select("component", F.col("src").alias("src"), F.col("dst").alias("via"), F.col("length").alias("skip"))
        second = second.join(step, ["component", "src", "via"]).select("component", (F.col("position") + F.col("skip")).alias("position"), F.col("via").alias("src"), F.col("to").alias("dst"))
        second = second.join(way, ["component", "src", "dst"])
        columns = ["component", "position", "src", "dst", "turn", "mid"]
        pieces = cut(whole.unionByName(first.select(*columns)).unionByName(second.select(*columns)))
    return pieces.select("component", "position", F.col("src").alias("node"))


def _searched(table: pa.Table) -> pa.Table:
    """The arcs of a shortest cycle through the smallest node of each component of a bounded pack."""
    graphs: dict[int, dict[int, list[tuple[int, int, int, int | None]]]] = {}
    for c, a, b, n, turn, mid in zip(*(table.column(x).to_pylist() for x in ("component", "src", "dst", "length", "turn", "mid")), strict=True):
        graphs.setdefault(c, {}).setdefault(b, []).append((a, n, turn, mid))
    out = []
    for root, backward in graphs.items():
        # How far each node is from the root, ahead; the way is then walked forward by the smallest node that stays on a shortest one.
        ahead, heap, direct = {root: 0}, [(0, root)], [n for a, n, _, _ in backward.get(root, ()) if a == root]
        while heap:
            far, node = heapq.heappop(heap)
            if far > ahead[node]:
                continue
            for a, n, _, _ in backward.get(node, ()):
                if a != root and far + n < ahead.get(a, far + n + 1):
                    ahead[a] = far + n
                    heapq.heappush(heap, (far + n, a))
        onward: dict[int, list[tuple[int, int, int, int | None]]] = {}
        for b, ways in backward.items():
            for a, n, turn, mid in ways:
                onward.setdefault(a, []).append((b, n, turn, mid))
        least = min([n + ahead[b] for b, n, _, _ in onward[root] if b != root and b in ahead] + direct)
        node, left = root, least
        while left:
            b, n, turn, mid = min((w for w in onward[node] if w[0] in ahead and w[1] + ahead[w[0]] == left), key=lambda w: w[0])
            out.append((root, least - left, node, b, turn, mid))
            node, left = b, left - n
    columns = list(zip(*out, strict=True)) or [[]] * 6
    kinds = [*[pa.int64()] * 4, pa.int32(), pa.int64()]
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["component", "position", "src", "dst", "turn", "mid"])


def _searched_by_rounds(ways: DataFrame) -> DataFrame:
    """The same for components that don't fit a task: distances to the root spread backwards, then one walk forward for all components side by side."""
    far = cut(ways.select("component").distinct().select("component", F.col("component").alias("node"), F.lit(0).cast("long").alias("far")))
    front = far
    while not front.isEmpty():
        offers = ways.join(front.withColumnRenamed("node", "dst"), ["component", "dst"]).filter("src <> component")
        offers = offers.groupBy("component", F.col("src").alias("node")).agg(F.min(F.col("far") + F.col("length")).alias("far"))
        front = cut(offers.join(far.withColumnRenamed("far", "had"), ["component", "node"], "left").filter("had IS NULL OR far < had").select("component", "node", "far"))
        far = cut(far.unionByName(front).groupBy("component", "node").agg(F.min("far").alias("far")))
    onward = cut(ways.join(far.withColumnRenamed("node", "dst"), ["component", "dst"]).withColumn("total", F.col("length") + F.col("far")))
    least = onward.filter("src = component").groupBy("component").agg(F.min("total").alias("total"))
    at = cut(least.select("component", F.col("component").alias("src"), F.lit(0).cast("long").alias("position"), F.col("total").alias("left")))
    taken = []
    while not at.isEmpty():
        fitting = at.join(onward, ["component", "src"]).filter("total = left")
        step = fitting.groupBy("component", "src", "position", "left").agg(F.min(F.struct("dst", "length", "turn", "mid")).alias("way"))
        step = cut(step.select("component", "position", "src", "left", "way.*"))
        taken.append(step.select("component", "position", "src", "dst", "turn", "mid"))
        at = cut(step.select("component", F.col("dst").alias("src"), (F.col("position") + F.col("length")).alias("position"), (F.col("left") - F.col("length")).alias("left")).filter("left > 0"))
    return reduce(DataFrame.unionByName, taken) if taken else ways.select("component", F.lit(0).cast("long").alias("position"), "src", "dst", "turn", "mid").limit(0)
