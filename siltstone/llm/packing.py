"""Shortest-pack-first packing over the histogram of lengths.

Documents become token ids with an end id; what is longer than a sequence is cut into whole
sequences and a rest. Only the histogram of piece lengths (at most ``size`` rows) goes to the
driver. There lengths are placed longest first, each into the shortest open pack that takes it,
by counts: one step moves many packs of the same fill at once. A group of packs with the same
fill is a range of sequence ids, so a placement says "pieces of this length with ranks a to b go
to sequences from c on, at this offset". Pieces find their placement by their rank among the
pieces of their length; ranks come from a window over (length, hash bucket), so a length that a
third of all pieces share is dealt over many tasks.

Special tokens of the vocabulary are read as such where a text holds their strings, as the
vocabulary's own library does; without ``special`` they are ordinary text.

Defined results: null text is the empty text, whose only token is the end id; repeated rows and
repeated ids are pieces of their own, and ties in rank are broken by doc_id, start and the other
columns' hash; an empty table gives an empty result; a text of any length is encoded whole; other
columns, whatever their names, are not read by ``tokenize`` and pass through ``assign``, but for
sequence_id and offset, which it replaces.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import stage, tucked, untucked
from .textnum import slices


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def special_tokens(path: str) -> dict[str, int]:
    """The special tokens that the JSON file of a vocabulary adds."""
    with open(path, encoding="utf-8") as f:
        return {t["content"]: t["id"] for t in json.load(f)["added_tokens"] if t["special"]}


@lru_cache(maxsize=4)
def encoder(ranks_path: str, special: tuple[tuple[str, int], ...] = ()):
    """The byte-level vocabulary as ranks: the same ids as the tokenizers file of that vocabulary, six times as fast."""
    import public_tokenizers
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(special))


def tokenize(docs: DataFrame, ranks_path: str, size: int = 2048, end_id: int = 1, special: dict[str, int] | None = None) -> DataFrame:
    """Pieces of at most ``size`` ids: doc_id, start, length, doc_tokens, and ids as little-endian unsigned 32-bit numbers."""
    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("doc_tokens", T.LongType()), T.StructField("ids", T.BinaryType())]
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(ranks_path, tuple((special or {}).items()))
        for batch in batches:
            for part, _, _ in slices(batch, "text"):
                row, start, length, total, ids = [], [], [], [], []
                for i, text in enumerate(part.column("text").to_pylist()):
                    got = np.append(enc.encode_to_numpy(text or "", allowed_special="all", disallowed_special=()), end_id).astype("<u4")
                    for at in range(0, len(got), size):
                        piece = got[at : at + size]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        total.append(len(got))
                        ids.append(piece.tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"],
                )

    return docs.select("doc_id", "text").mapInArrow(encode, schema)


def shortest_pack_first(histogram: dict[int, int], size: int) -> tuple[dict[int, list[tuple[int, int, int]]], int]:
    """Placements (first rank, first sequence, offset) of each length, by rank; and the number of sequences.

    Every step places as many pieces as the chosen group of packs can take, so the steps number
    with the groups, not with the pieces.
    """
    placed: dict[int, list[tuple[int, int, int]]] = {}
    groups: dict[int, list[tuple[int, int]]] = {}  # by fill: (first sequence, packs)
    fills: list[int] = []
    sequences = 0

    def put(fill: int, first: int, packs: int) -> None:
        if fill < size:
            if not groups.get(fill):
                groups[fill] = []
                heapq.heappush(fills, fill)
            groups[fill].append((first, packs))

    for length in sorted(histogram, reverse=True):
        left, rank, steps = histogram[length], 0, []
        while left:
            while fills and not groups[fills[0]]:
                heapq.heappop(fills)
            if fills and fills[0] + length <= size:
                fill = fills[0]
                first, packs = groups[fill].pop()
                taken = min(left, packs)
                if taken < packs:
                    groups[fill].append((first + taken, packs - taken))
                steps.append((rank, first, fill))
                put(fill + length, first, taken)
            else:  # new packs, each filled with as many pieces of this length as it takes
                each = min(size // length, left)
                packs = left // each
                for slot in range(each):
                    steps.append((rank + slot * packs, sequences, slot * length))
                put(each * length, sequences, packs)
                sequences += packs
                taken = each * packs
            rank += taken
            left -= taken
        placed[length] = steps
    return placed, sequences


def assign(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset; every column but doc_id, start and ``length`` is only carried along."""
    spark = pieces.sparkSession
    names, used = [c for c in pieces.columns if c not in ("sequence_id", "offset")], ["doc_id", "start", "length"]
    pieces = stage(pieces.select(*(F.col(f"`{c}`") for c in names)), "pieces")
    buckets = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    bucketed = tucked(pieces, used).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    histogram = {int(r.length): int(r.n) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    placed, _ = shortest_pack_first(histogram, size)
    steps = [(length, [s[0] for s in p], [s[1] for s in p], [s[2] for s in p]) for length, p in sorted(placed.items())]
    where = spark.createDataFrame(steps, "length long, ranks array<long>, sequences array<long>, offsets array<long>")
    if sum(len(p) for p in placed.values()) <= 1 << 20:  # a row a length, and at most a million placements: 24 MB
        where = F.broadcast(where)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", F.xxhash64("carried")))
    ranked = bucketed.withColumn("within", within).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("within") - 1)
    found = ranked.join(where, "length").withColumn("step", F.size(F.filter("ranks", lambda r: r <= F.col("rank"))))
    at = lambda c: F.element_at(c, F.col("step"))
    return found.select(*untucked(names, used), (at("sequences") + F.col("rank") - at("ranks")).alias("sequence_id"), at("offsets").alias("offset"))


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves: sequence_id, used, and ids as an array of (offset, doc_id, start, ids) in order."""
    return packed.groupBy("sequence_id").agg(
        F.sum("length").alias("used"), F.sort_array(F.collect_list(F.struct("offset", "doc_id", "start", "ids"))).alias("pieces")
    )
