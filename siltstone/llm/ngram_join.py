"""N-gram Jaccard self-join by parity sketches.

The set of a document is the set of its distinct 5-word shingles, as 64-bit hashes. Two sets of
sizes a and b reach a Jaccard of 0.75 only if they differ in at most d = (a + b) // 7 shingles.

* Parity sketch: every shingle flips a bit. Two sketches differ in at most as many bits as the
  sets differ in shingles, so their Hamming distance is a lower bound of the difference.
* Pigeonhole per size band: within the band of sizes 2**k to 2**(k+1) - 1 the sketch is cut into
  the same blocks for all documents, more of them than two linked sets can differ in. d differences
  spoil at most d blocks, so linked sets share a block, unchanged. A block's content is named by
  the XOR of its shingles' hashes; band, block and content make a token.
* Only the first d + 1 tokens in a common order are needed for that. Tokens of blocks with many
  shingles come first, as few texts share those, and empty blocks last. A larger document also
  gives tokens for the band below, if partners there are large enough.
* Tokens are dealt by value over tasks as packed arrays. A bucket of documents with one token
  becomes a star around its smallest member, never all pairs. By their sketches star pairs are
  close (a Jaccard of 0.3 or so) or not, and the components of the close ones are families. Of
  each member the nearest pair that may link is verified on the texts.
* What may still link lies in one family, or in two families that meet in a bucket. Both are settled
  exactly: members of different components are compared, in small groups by a join, in large ones
  block against block by their sketches. There a forest of the nearest pairs goes first; only where
  one of its pairs does not link, all others that the bound allows follow. No step gives all
  pairs of a group.
* Components of the verified links come from contraction (``components``), in rounds that grow with the logarithm of a chain's length.

Documents with equal sets share one representative from the start, and a token that many
documents of one slice of a batch share is reduced to one of them before the shuffle (with its other
members listed by themselves), so groups of copies of any size cost no more than their rows.
Sets are told apart by 128 bits: tokens carry 64, and sets that share those get keys of their own.

Defined results: null and empty texts, and texts of white space, have no set and are linked with
nothing (component_id is their own doc_id); texts of one to four words are one shingle; repeated
rows are linked by their equal sets and each gets its result; rows without an id take part, and
a component with no id at all has a null component_id; an empty table gives an empty result;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import components
from .shared import stage, tucked, untucked
from .textnum import MULTIPLIER, U, mix, slices, span_hashes, windows, words

LOCAL_STAR = 32
SMALL_BUCKET = 15
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
TOKENS_A_PART = 1_500_000
MOST_SENT = 500_000  # ids or keys that are sent to every executor at most


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    starts, ends, first = words(data, offsets)
    hashes = span_hashes(data, starts, ends, lower=True)
    all_windows, index = windows(hashes, first, k)
    for i in range(len(first) - 1):
        n = first[i + 1] - first[i]
        if 0 < n < k:
            h = U(n)
            for w in hashes[first[i] : first[i + 1]]:
                h = mix(np.array([h], U) * MULTIPLIER + w)[0]
            yield np.array([h], U)
        else:
            yield np.unique(all_windows[index[i] : index[i + 1]])


def set_key(shingles: np.ndarray, seed: int = 0x5851F42D4C957F2D) -> int:
    return int(np.add.reduce(mix(shingles ^ U(seed))).astype(np.int64))


def set_check(shingles: np.ndarray) -> int:
    """A second key, which tells sets of the same key apart."""
    return set_key(shingles, 0x2545F4914F6CDD1D)


def sketch_of(shingles: np.ndarray, density: int = 4) -> bytes:
    """Parity of ``density`` or more bits a shingle; the width is a power of two, so that a wide sketch folds onto a narrow one."""
    bits = max(64, 1 << int(density * len(shingles) - 1).bit_length())
    odd = np.bincount((mix(shingles * MULTIPLIER) & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, size: int) -> np.ndarray:
    """A sketch of ``size`` bytes: the parities of positions that are equal modulo the narrower width."""
    bits = np.frombuffer(sketch, np.uint8)
    return np.bitwise_xor.reduce(bits.reshape(-1, size), axis=0)


def hamming(a: bytes, b: bytes) -> int:
    size = min(len(a), len(b))
    return int(np.bitwise_count(folded(a, size) ^ folded(b, size)).sum())


def may_link(size_a: int, size_b: int) -> int:
    """Most shingles that two linked sets of these sizes can differ in; -1 if the sizes alone forbid a link."""
    small, large = min(size_a, size_b), max(size_a, size_b)
    return (size_a + size_b) // 7 if 4 * small >= 3 * large else -1


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= 75 * (len(a) + len(b) - both)


def band_tokens(shingles: np.ndarray, band: int, need: int) -> np.ndarray:
    """The first ``need`` tokens of a set in a band. Linked sets that meet there differ in at most (2**(band + 1) - 1) // 3 shingles."""
    blocks = max((3 << band) // 4, ((2 << band) - 1) // 3 + 1)
    spread = mix(shingles ^ U(0xA0761D6478BD642F))
    block = ((spread >> U(32)) * U(blocks)) >> U(32)
    order = np.argsort(block)
    block = block[order]
    start = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
    content = np.bitwise_xor.reduceat(spread[order], start)
    count = np.diff(np.concatenate((start, [len(order)])))
    block = block[start]
    if len(block) < need:
        empty = np.setdiff1d(np.arange(blocks, dtype=U), block)
        block, content, count = (np.concatenate((x, y)) for x, y in ((block, empty), (content, np.zeros(len(empty), U)), (count, np.zeros(len(empty), np.int64))))
    token = mix(content + mix(block + (U(band) << U(48))))
    return token[np.lexsort((token, -count))[:need]]


def tokens_of(shingles: np.ndarray) -> np.ndarray:
    n = len(shingles)
    band = n.bit_length() - 1
    own = band_tokens(shingles, band, n // 3 + 1)
    if band > 0 and -(-3 * n // 4) < 1 << band:
        below = band_tokens(shingles, band - 1, (n + (1 << band) - 1) // 7 + 1)
        return np.concatenate((own, below))
    return own


def profiles(docs: DataFrame) -> DataFrame:
    """doc_id, n, sid and check (keys of the set) and sketch of every document."""
    fields = [("n", T.LongType()), ("sid", T.LongType()), ("check", T.LongType()), ("sketch", T.BinaryType())]
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(*f) for f in fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                found = list(shingle_sets(data, offsets))
                of = lambda f, kind: pa.array([f(s) if len(s) else None for s in found], kind)  # noqa: B023, E731
                arrays = [part.column("doc_id"), pa.array([len(s) for s in found], pa.int64()), of(set_key, pa.int64()), of(set_check, pa.int64()), of(sketch_of, pa.binary())]
                yield pa.RecordBatch.from_arrays(arrays, names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def distinct_sets(rows: DataFrame) -> DataFrame:
    """key, sid, check, doc_id (of one document with the set), n and sketch of every set. The key is the sid, unless two sets have that."""
    last = [F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")]
    by_sid = stage(rows.filter("sid IS NOT NULL").groupBy("sid").agg(F.min("check").alias("check"), F.max("check").alias("other"), *last), "sets")
    columns = ["key", "sid", "check", "doc_id", "n", "sketch"]
    sets = by_sid.filter("check = other").withColumn("key", F.col("sid")).select(*columns)
    twins = by_sid.filter("check <> other").select("sid")
    if twins.isEmpty():
        return sets
    own = rows.join(twins, "sid").groupBy("sid", "check").agg(*last).withColumn("key", F.xxhash64("sid", "check"))
    return stage(sets.unionByName(own.select(*columns)), "sets")


def sent(df: DataFrame) -> DataFrame:
    """``df`` for a join: with a broadcast hint if it has at most MOST_SENT rows."""
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def dealt_tokens(docs: DataFrame, parts: int) -> DataFrame:
    """Packed arrays by part: tokens with the keys of their sets, tokens that were reduced to one set, and the members of those."""
    pack = lambda x: pa.array([v.tobytes() for v in x], pa.binary())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in slices(batch, "text"):
                found = {set_key(s): s for s in shingle_sets(data, offsets) if len(s)}
                if not found:
                    continue
                tokens = [tokens_of(s) for s in found.values()]
                token = np.concatenate(tokens)
                sid = np.repeat(np.array(list(found), np.int64), [len(t) for t in tokens])
                order = np.lexsort((sid, token))
                token, sid = token[order], sid[order]
                start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1])))
                size = np.diff(np.concatenate((start, [len(token)])))
                crowded = np.repeat(size > LOCAL_STAR, size)
                leads = np.zeros(len(token), bool)
                leads[start] = True
                keep = ~crowded | leads
                rows: dict[int, list[np.ndarray]] = {}
                empty_u, empty_i = np.zeros(0, U), np.zeros(0, np.int64)
                part = (token % U(parts)).astype(np.int64)
                for p, at in _grouped(part[keep]):
                    t, s = token[keep][at], sid[keep][at]
                    rows[p] = [t, s, t[(crowded & leads)[keep][at]], empty_u, empty_i]
                member_part = (sid[crowded] % parts).astype(np.int64)
                for p, at in _grouped(member_part):
                    rows.setdefault(p, [empty_u, empty_i, empty_u, empty_u, empty_i])[3:] = [token[crowded][at], sid[crowded][at]]
                columns = list(zip(*rows.values(), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(rows), pa.int32()), *map(pack, columns)], names=["part", "tokens", "sids", "reduced", "member_tokens", "member_sids"])

    return docs.select("text").mapInArrow(run, "part int, tokens binary, sids binary, reduced binary, member_tokens binary, member_sids binary")


def _grouped(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    edges = np.flatnonzero(np.concatenate(([True], keys[order][1:] != keys[order][:-1])))
    for a, b in zip(edges, [*edges[1:], len(keys)], strict=True):
        yield int(keys[order[a]]), order[a:b]


def buckets(dealt: DataFrame) -> DataFrame:
    """From packed tokens: star pairs (a, b), and (bucket, sid) for buckets of more than two sets.

    Buckets of a part with the same members are kept once.
    """

    def unpack(column: pa.ChunkedArray, kind: type) -> np.ndarray:
        return np.concatenate([np.frombuffer(x, kind) for x in column.to_pylist()] or [np.zeros(0, kind)])

    def run(table: pa.Table) -> pa.Table:
        token, sid = unpack(table.column("tokens"), U), unpack(table.column("sids"), np.int64)
        reduced = np.unique(unpack(table.column("reduced"), U))
        order = np.lexsort((sid, token))
        token, sid = token[order], sid[order]
        new = np.concatenate(([True], (token[1:] != token[:-1]) | (sid[1:] != sid[:-1])))[: len(token)]
        token, sid = token[new], sid[new]
        start = np.flatnonzero(np.concatenate(([True], token[1:] != token[:-1]))[: len(token)])
        size = np.diff(np.concatenate((start, [len(token)])))
        is_reduced = np.isin(token[start], reduced)
        rows = np.repeat((size > 1) | is_reduced, size)
        leader = np.repeat(sid[start], size)
        star = rows & (sid != leader)
        pairs = np.unique(np.stack((leader[star], sid[star]), 1), axis=0) if star.any() else np.zeros((0, 2), np.int64)
        # one bucket for each distinct set of members; those reduced before have members elsewhere, so they keep their token's name
        mixed = np.add.reduceat(mix(sid.astype(U)), start) if len(start) else np.zeros(0, U)
        name = np.where(is_reduced, token[start], mix(mixed + size.astype(U)))
        once = np.zeros(len(start), bool)
        once[np.unique(name, return_index=True)[1]] = True
        listed = once & ((size > 2) | is_reduced)
        wide = np.repeat(listed, size)
        bucket, member = np.repeat(name, size)[wide], sid[wide]
        bucket = np.concatenate((bucket, unpack(table.column("member_tokens"), U))).astype(np.int64)
        member = np.concatenate((member, unpack(table.column("member_sids"), np.int64)))
        n, m = len(pairs), len(bucket)
        gap = lambda k: pa.nulls(k, pa.int64())
        join = lambda x, y: pa.chunked_array([x, y])
        return pa.table(
            [join(pa.array(pairs[:, 0]), gap(m)), join(pa.array(pairs[:, 1]), gap(m)), join(gap(n), pa.array(bucket)), join(gap(n), pa.array(member))],
            names=["a", "b", "bucket", "sid"],
        )

    return dealt.groupBy("part").applyInArrow(run, "a long, b long, bucket long, sid long")


def compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that are close: a, b, their Hamming distance, and whether sizes and the Hamming bound allow a link.

    Close is a difference, estimated from the distance, of at most 7 in 13 of both sizes. All that may link is close.
    """
    one = sets.select(F.col("sid").alias("a"), F.col("key").alias("key_a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sets.select(F.col("sid").alias("b"), F.col("key").alias("key_b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    joined = pairs.distinct().join(one, "a").join(two, "b").filter(F.least("n_a", "n_b") * 10 >= F.greatest("n_a", "n_b") * 3)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.to_pydict()
            far, may, close = [], [], []
            for n, m, p, q in zip(x["n_a"], x["n_b"], x["sketch_a"], x["sketch_b"], strict=True):
                h, bits = hamming(p, q), 8 * min(len(p), len(q))
                far.append(h)
                may.append(h <= may_link(n, m))
                close.append(may[-1] or (2 * h < bits and -bits / 2 * np.log1p(-2 * h / bits) <= 7 / 13 * (n + m)))
            arrays = [batch.column("key_a"), batch.column("key_b"), pa.array(far, pa.int64()), pa.array(may, pa.bool_())]
            yield pa.RecordBatch.from_arrays(arrays, names=["a", "b", "far", "may"]).filter(pa.array(close, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long, far long, may boolean")


def texts_of(keys: DataFrame, docs: DataFrame, sets: DataFrame) -> DataFrame:
    """key, sid, check and text of one document for each of the sets."""
    owner = sets.select("key", "sid", "check", F.col("doc_id").alias("owner_id")).join(keys, "key")
    found = docs.select("doc_id", "text").join(sent(stage(owner, "owners")), F.col("doc_id").eqNullSafe(F.col("owner_id")))
    return stage(found.select("key", "sid", "check", "text"), "link-texts")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs whose texts link."""
    ends = sent(stage(pairs.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "ends"))
    needed = texts.join(ends, "key")
    side = lambda x: needed.toDF(x, f"sid_{x}", f"check_{x}", f"text_{x}")
    joined = pairs.join(side("a"), "a").join(side("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, offsets in slices(batch, "text_a"):
                keep = []
                _, other, at = next(slices(part, "text_b", 1 << 62))
                names = zip(*(part.column(c).to_pylist() for c in ("sid_a", "check_a", "sid_b", "check_b")), strict=True)
                for (a, a2, b, b2), x, y in zip(names, shingle_sets(data, offsets), shingle_sets(other, at), strict=True):
                    # an id may have rows with other texts
                    keep.append((set_key(x), set_check(x), set_key(y), set_check(y)) == (a, a2, b, b2) and linked(x, y))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long").distinct()


def _unsettled(members: DataFrame, nodes: DataFrame) -> DataFrame:
    """Members (group, key, apart) of groups that lie in several components and are apart, with their roots and the group's size.

    Of a group only members with different ``apart`` are to be compared; null is apart from all.
    """
    rooted = members.join(nodes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    spread = [F.min("root").alias("low"), F.max("root").alias("high"), F.min(F.coalesce("apart", "key")).alias("one"), F.max(F.coalesce("apart", "key")).alias("two")]
    per_group = rooted.groupBy("group").agg(F.count("*").alias("size"), *spread)
    return rooted.join(per_group.filter("low <> high AND one <> two").select("group", "size"), "group")


def _few(open_: DataFrame) -> DataFrame:
    """All pairs to compare in small groups: at most SMALL_BUCKET / 2 a member."""
    small = open_.filter(F.col("size") <= SMALL_BUCKET)
    other = small.select("group", F.col("key").alias("b"), F.col("root").alias("root_b"), F.col("apart").alias("apart_b"))
    differ = "key < b AND root <> root_b AND coalesce(apart <> apart_b, true)"
    return small.join(other, "group").filter(differ).select(F.col("key").alias("a"), "b").distinct()


def _near_in_blocks(open_: DataFrame, sets: DataFrame, forest: bool) -> DataFrame:
    """Pairs (a, b) to compare in large groups that sizes and the Hamming bound allow.

    A group is dealt into blocks by rows and by shingles, and every two blocks meet in one task
    with their sketches, which are so wide that few pairs pass that do not link. With ``forest``, pairs
    are taken from the nearest on and those whose ends are already joined are passed over, which
    leaves at most a pair a member.
    """
    large = stage(open_.filter(F.col("size") > SMALL_BUCKET).join(sets.select("key", "n", "sketch"), "key"), "large-groups")
    weight = large.groupBy("group").agg(F.sum("n").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("size") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    placed = large.join(weight, "group").withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("key"), "blocks").cast("int"))
    spread = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    spread = spread.withColumn("low", F.least("own", "with")).withColumn("high", F.greatest("own", "with"))
    spread = spread.select("group", "low", "high", "own", "key", F.coalesce("apart", "key").alias("apart"), "root", "n", "sketch")

    def run(table: pa.Table) -> pa.Table:
        x = table.select(["key", "root", "n", "own", "apart", "sketch"]).to_pydict()
        key, root, n, own, apart = (np.array(x[c], np.int64) for c in ("key", "root", "n", "own", "apart"))
        size = min(map(len, x["sketch"]))
        bits = np.stack([folded(s, size) for s in x["sketch"]])
        one_block = len(np.unique(own)) == 1
        near = [np.zeros((0, 3), np.int64)]
        for i in range(len(key) - 1):
            ok = (root[i + 1 :] != root[i]) & (apart[i + 1 :] != apart[i]) & (one_block | (own[i + 1 :] != own[i]))
            j = i + 1 + np.flatnonzero(ok & (4 * np.minimum(n[i + 1 :], n[i]) >= 3 * np.maximum(n[i + 1 :], n[i])))
            far = np.bitwise_count(bits[j] ^ bits[i]).sum(1, dtype=np.int64)
            ok = far <= (n[j] + n[i]) // 7
            near.append(np.stack((far[ok], np.full(ok.sum(), i), j[ok]), 1))
        pairs = np.concatenate(near)
        if forest:
            group = {r: r for r in x["root"]}

            def top(r: int) -> int:
                while group[r] != r:
                    group[r] = group[group[r]]
                    r = group[r]
                return r

            keep = []
            for k in np.argsort(pairs[:, 0], kind="stable").tolist():
                p, q = top(x["root"][pairs[k, 1]]), top(x["root"][pairs[k, 2]])
                if p != q:
                    group[p] = q
                    keep.append(k)
            pairs = pairs[keep]
        one, two = key[pairs[:, 1]], key[pairs[:, 2]]
        return pa.table([pa.array(np.minimum(one, two)), pa.array(np.maximum(one, two))], names=["a", "b"])

    return spread.groupBy("group", "low", "high").applyInArrow(run, "a long, b long").distinct()


def classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spark: SparkSession = docs.sparkSession
    rows = stage(profiles(docs), "shingle-profiles")
    sets = distinct_sets(rows)
    total = rows.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-total * 45 // 100 // TOKENS_A_PART), spark.sparkContext.defaultParallelism)
    found = stage(buckets(dealt_tokens(docs, parts)), "buckets")
    stars = stage(compared(found.filter("bucket IS NULL").select("a", "b"), sets), "stars")
    families = components(stars).withColumnRenamed("root", "family")
    # Groups in which members may still link: families, and buckets in which families meet.
    members = found.filter("bucket IS NOT NULL").select("bucket", "sid").distinct().join(sets.select("sid", "key"), "sid")
    members = members.join(families, "key", "left").withColumn("apart", F.coalesce("family", "key"))
    mixed = members.groupBy("bucket").agg(F.min("apart").alias("low"), F.max("apart").alias("high")).filter("low <> high").select("bucket")
    meetings = members.join(mixed, "bucket").select(F.col("bucket").alias("group"), "key", "apart")
    groups = stage(meetings.unionByName(families.select(F.col("family").alias("group"), "key", F.lit(None).cast("long").alias("apart"))), "groups")

    texts = texts_of(groups.select("key").distinct(), docs, sets)
    nearest = stars.filter("may").groupBy("b").agg(F.min_by("a", F.struct("far", "a")).alias("a")).select("a", "b")
    links = stage(verified(nearest, texts), "star-links")
    nodes = components(links)
    open_ = stage(_unsettled(groups, nodes), "unsettled")
    if not open_.isEmpty():
        few = compared(_few(open_).join(nearest, ["a", "b"], "left_anti"), sets.withColumn("sid", F.col("key"))).filter("may").select("a", "b")
        tested = stage(few.unionByName(_near_in_blocks(open_, sets, forest=True)).distinct(), "near")
        links = stage(links.unionByName(verified(tested, texts)), "all-links")
        nodes = components(links)
        # Where a pair of a forest did not link, another pair may: all others that the bound allows are tested.
        large = stage(_unsettled(open_.filter(F.col("size") > SMALL_BUCKET).select("group", "key", "apart"), nodes), "unsettled")
        rest = stage(_near_in_blocks(large, sets, forest=False).join(tested, ["a", "b"], "left_anti"), "near")
        if not rest.isEmpty():
            nodes = components(links.unionByName(verified(rest, texts)))
    named = rows.select("doc_id", "n", "sid", "check")
    twins = sets.filter("key <> sid").select("sid", "check", "key")
    named = named.withColumn("key", F.col("sid")) if twins.isEmpty() else named.join(twins, ["sid", "check"], "left").withColumn("key", F.coalesce("key", "sid"))
    placed = named.join(nodes, "key", "left").withColumn("root", F.coalesce("root", "key"))
    smallest = placed.filter("root IS NOT NULL").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return placed.join(smallest, "root", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents without those linked to one with a smaller id, and without repeats of a row's id and text."""
    losers = classes(docs).filter("doc_id <> component_id").select(F.col("doc_id").alias("lost")).distinct()
    used = ["doc_id", "text"]
    whole = tucked(docs, used)  # names of other columns can't clash then
    kept = whole.join(losers, F.col("doc_id") == F.col("lost"), "left_anti")
    # Only rows of ids that come again are shuffled with their texts.
    again = stage(docs.groupBy(F.col("doc_id").alias("again")).count().filter("count > 1").select("again"), "repeated-ids")
    if not again.isEmpty():
        again, same = sent(again), F.col("doc_id").eqNullSafe(F.col("again"))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates(used))
    return kept.select(*untucked(docs.columns, used))
