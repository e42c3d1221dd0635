"""Histogram sort: shards of near-equal bytes, found by counting, filled by one exchange.

Every document gets a 62-bit sort key: 40 bits from the hash of its text, 10 from the hash of its id and 12 from the hash
of its row's number, so that equal texts lie together and yet a group of copies of any size
can be cut, be they copies with ids of their own or repeats of one row. (Numbers are given once, as the keys are written.) The splitters are found without sorting: a first pass counts exact rows and bytes
in 2**13 equal key ranges; each range that holds a boundary and is heavier than the tolerance, or that
has more than a HEAVY part of all bytes, is split into 2**10 smaller ranges and counted again, until
the boundary meets the tolerance or the key has no more bits. Only the counts of ranges reach the
driver: at most 2**13 rows, then at most (shards - 1 + HEAVY) * 2**10 rows a round, whatever the input. One exchange then brings the rows of a
range together, and a row's slot is its range's first slot plus its rank in the range.

Defined results: null text counts as no bytes (its size is the overhead alone) and sorts with
the empty text; repeated rows are rows of their own and are cut like other copies; ties in the key are broken by doc_id, then
text hash; an empty table gives an empty result; other columns, whatever their names, pass
through ``assign`` untouched unless they bear the names of its outputs, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage

KEY_BITS, TEXT_BITS, ID_BITS, FIRST_BITS, STEP_BITS = 62, 40, 10, 13, 10
HEAVY = 1 << 11


def size_of(text: Column, overhead: int = 16) -> Column:
    """UTF-8 bytes of the text (null: none) plus the overhead of a record."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + F.lit(overhead)


def sort_key(text: Column, doc_id: Column) -> Column:
    parts = ((F.xxhash64(F.coalesce(text, F.lit(""))), TEXT_BITS), (F.xxhash64(doc_id, F.lit("id")), ID_BITS), (F.xxhash64(F.monotonically_increasing_id()), KEY_BITS - TEXT_BITS - ID_BITS))
    key, below = F.lit(0).cast("long"), KEY_BITS
    for hashed, bits in parts:
        below -= bits
        key = key.bitwiseOR(F.shiftleft(F.shiftrightunsigned(hashed, 64 - bits), below))
    return key


def _counted(light: DataFrame, shift: int, inside: list[tuple[int, int]] | None) -> list[tuple[int, int]]:
    """(key range's number, bytes) of the non-empty ranges of 2**shift keys, of all keys or of those inside some ranges."""
    if inside is not None:
        parent = inside[0][1]
        light = light.filter(F.shiftright("key", parent).isin([n for n, _ in inside]))
    rows = light.groupBy(F.shiftright("key", shift).alias("n")).agg(F.sum("size").alias("b")).collect()
    return sorted((r.n, r.b) for r in rows)


def find_splitters(light: DataFrame, shards: int, tolerance: float = 0.005) -> tuple[list[int], list[tuple[int, list[int]]]]:
    """Lowest keys of shards 1.., and for each round the (shift, numbers) of ranges that it split.

    ``tolerance`` is the most that a boundary may be off, as a part of a shard's share of bytes.
    """
    shift = KEY_BITS - FIRST_BITS
    counts = _counted(light, shift, None)
    total = sum(b for _, b in counts)
    slack = tolerance * total / shards
    targets = [total * j / shards for j in range(1, shards)]
    found: dict[int, int] = {}
    below, open_ranges = 0, {}  # boundaries that lie within a range that is too heavy
    heavy = max(slack, total / HEAVY)
    pending = {None: (counts, 0, list(range(len(targets))))}
    splits: list[tuple[int, list[int]]] = []
    while pending:
        open_ranges = {}
        for ranges, start, wanted in pending.values():
            below, i = start, 0
            for n, b in ranges:
                while i < len(wanted) and targets[wanted[i]] <= below + b:
                    before, after = targets[wanted[i]] - below, below + b - targets[wanted[i]]
                    if min(before, after) <= slack or shift == 0:
                        found[wanted[i]] = (n if before <= after else n + 1) << shift
                    else:
                        open_ranges.setdefault(n, (below, []))[1].append(wanted[i])
                    i += 1
                if b > heavy and shift > 0:  # one task would sort all its rows
                    open_ranges.setdefault(n, (below, []))
                below += b
            for j in wanted[i:]:  # rounding of the last target
                found[j] = 1 << KEY_BITS
        if not open_ranges:
            break
        splits.append((shift, sorted(open_ranges)))
        finer = max(0, shift - STEP_BITS)
        counts = _counted(light, finer, [(n, shift) for n in open_ranges])
        pending = {n: ([(m, b) for m, b in counts if m >> (shift - finer) == n], *open_ranges[n]) for n in open_ranges}
        shift = finer
    keys = [found[j] for j in range(len(targets))]
    return [max(keys[: j + 1]) for j in range(len(keys))], splits


def _shard_of(splitters: list[int]) -> Column:
    """How many splitters are at most the key: a chain of comparisons inside generated code."""
    if not splitters:
        return F.lit(0)
    return F.size(F.filter(F.array(*[F.lit(s) for s in splitters]), lambda s: s <= F.col("key")))


def _leaf(splits: list[tuple[int, list[int]]]) -> Column:
    """The smallest counted range of a key: its lowest key, with the round in the lowest bits to keep ranges apart."""
    shift = KEY_BITS - FIRST_BITS
    leaf = F.shiftleft(F.shiftright("key", shift), shift)
    for at, numbers in splits:
        finer = max(0, at - STEP_BITS)
        leaf = F.when(F.shiftright("key", at).isin(numbers), F.shiftleft(F.shiftright("key", finer), finer)).otherwise(leaf)
    return leaf


def assign(docs: DataFrame, shards: int = 40, overhead: int = 16, tolerance: float = 0.005, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` without its text, with size, text_crc32, law, shard, slot and grown_shard.

    Join it back on the id, or use ``write_shards`` for the files themselves.
    """
    made = ["size", "text_crc32", "law", "shard", "slot", "grown_shard"]
    names = [c for c in docs.columns if c not in {text, *made}]
    others = [c for c in names if c != doc_id]
    own_id, own_text = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    light = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in others)).alias("carried") if others else F.lit(0).alias("carried"),
        own_id.alias("id"),
        size_of(own_text, overhead).alias("size"),
        F.crc32(F.coalesce(own_text, F.lit("")).cast("binary")).alias("text_crc32"),
        sort_key(own_text, own_id).alias("key"),
    )
    light = stage(light if others else light.drop("carried"), "shard-keys")
    splitters, splits = find_splitters(light, shards, tolerance)
    placed = light.withColumn("shard", _shard_of(splitters)).withColumn("leaf", _leaf(splits))
    counts = placed.groupBy("shard", "leaf").agg(F.count("*").alias("rows"))  # at most the counted ranges and the splitters
    before = Window.partitionBy("shard").orderBy("leaf").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select("shard", "leaf", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    rank = F.row_number().over(Window.partitionBy("shard", "leaf").orderBy("key", "id", "text_crc32", "size"))
    back = [F.col("id").alias(doc_id) if c == doc_id else F.col(f"carried.`{c}`") for c in names]
    return (
        placed.withColumn("rank", rank)
        .join(first, ["shard", "leaf"])
        .select(*back, "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


def write_shards(docs: DataFrame, path: str, shards: int = 40, tolerance: float = 0.005) -> None:
    """Write the documents as ``path/shard=N`` folders, sorted by key: the one exchange of whole rows.

    Rows go to tasks by shard and a part of the key, so that a large shard is written by many tasks.
    """
    keys = docs.select(sort_key(F.col("text"), F.col("doc_id")).alias("key"), size_of(F.col("text")).alias("size"))
    splitters, _ = find_splitters(stage(keys, "shard-keys"), shards, tolerance)
    whole = docs.select(F.struct("*").alias("row"), sort_key(F.col("text"), F.col("doc_id")).alias("key")).withColumn("shard", _shard_of(splitters))
    placed = whole.repartitionByRange("shard", "key").sortWithinPartitions("shard", "key")
    placed.select(*(F.col(f"row.`{c}`") for c in docs.columns if c != "shard"), "shard").write.partitionBy("shard").parquet(path)
