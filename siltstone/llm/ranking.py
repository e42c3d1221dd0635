"""Ranked lexical search, score at a time over postings ordered by impact.

* Queries are read first: their terms are the vocabulary, and only postings of these terms are kept. Queries go in blocks of bounded size, a
  block of items at a time meets all documents.
* One pass over the documents cuts each text into terms and gives index shards of at most SHARD_DOCS documents or some SHARD_POSTINGS postings: ids and lengths
  of the documents, and (term, frequency) by document. Numbers of documents, terms and documents with a term are summed from the shards.
* A second pass reads shards alone. With the totals, every posting has an integer impact; a term's postings are grouped by exact impact.
  An item takes the groups of its terms from the largest contribution down and adds them to the scores of their documents, more
  of them each time. After each helping, what a document can still gain is at most the sum of each term's next contribution. Once that is less
  than the k-th best score so far, no unseen document can enter; once few enough seen ones can, these are completed from the
  postings by document, and the rest of the groups is never read. The k-th best score of shards that a task has read before counts, too.
* The best k of all shards are ranked by a window over the item, which takes the best of each task first.

All sums are 64-bit integers, so scores are exact and the same in any order. Terms are told apart by 64-bit hashes.

Defined results: null texts have no terms; items without terms give no rows; repeated rows are documents, or items, of their own; equal scores go by ascending
id, rows without an id last; no documents or no items, no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stage
from .textnum import flat, per_text, runs, slices, span_hashes, spread

ITEMS_A_BLOCK = 10_000
TERMS_A_BLOCK = 2_000_000
SHARD_DOCS = 1 << 15
SHARD_POSTINGS = 1 << 20
FIRST_HELPING = 1 << 11
COMPLETED = 16  # times k: as many documents are completed at most, else the next groups are read
LAST = np.iinfo(np.int64).max

TERM_BYTE = np.zeros(256, bool)
TERM_BYTE[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the terms of each text in order, and their per-text index (len + 1)."""
    starts, ends, first = runs(TERM_BYTE[data], offsets)
    return span_hashes(data, starts, ends, lower=True), first


def item_terms(items: DataFrame) -> DataFrame:
    """id, n, hashes and counts of the distinct terms of each item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes, first = terms(*flat(batch.column("text")))
            found = [np.unique(hashes[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            arrays = [batch.column("id"), pa.array([len(h) for h, _ in found], pa.int64()), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n", "hashes", "counts"])

    return items.mapInArrow(run, "id long, n long, hashes binary, counts binary")


_SHARD = "docs long, with_terms long, all_terms long, ids binary, lengths binary, upto binary, term binary, tf binary, terms array<int>, dfs array<long>"


def index(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Shards of postings by document; ``vocabulary`` is sorted."""

    def shard(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        ids, known, lengths, sizes, term, tf = (np.concatenate(x) for x in zip(*parts, strict=True))
        found, dfs = np.unique(term, return_counts=True)
        values = [len(ids), int((lengths > 0).sum()), int(lengths.sum()), np.where(known, ids, LAST).tobytes(), lengths.tobytes(), np.cumsum(sizes).tobytes(), term.tobytes(), tf.tobytes(), found.tolist(), dfs.tolist()]
        kinds = [*[pa.int64()] * 3, *[pa.binary()] * 5, pa.list_(pa.int32()), pa.list_(pa.int64())]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=[f.split()[0] for f in _SHARD.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple[np.ndarray, ...]] = []
        n_docs = n_postings = 0
        for batch in batches:
            for part, data, offsets in slices(batch, "text"):
                hashes, first = terms(data, offsets)
                at = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
                hit = vocabulary[at] == hashes
                doc = np.repeat(np.arange(len(first) - 1), np.diff(first))[hit]
                code, tf = np.unique(doc * len(vocabulary) + at[hit], return_counts=True)
                doc = code // len(vocabulary)
                ids = part.column("doc_id")
                known = ids.is_valid().to_numpy(zero_copy_only=False)
                parts.append((ids.fill_null(0).to_numpy(), known, np.diff(first), np.bincount(doc, minlength=len(first) - 1), (code % len(vocabulary)).astype(np.int32), tf.astype(np.int32)))
                n_docs, n_postings = n_docs + len(first) - 1, n_postings + len(code)
                if n_docs >= SHARD_DOCS or n_postings >= SHARD_POSTINGS:
                    yield shard(parts)
                    parts, n_docs, n_postings = [], 0, 0
        if parts:
            yield shard(parts)

    return docs.mapInArrow(run, _SHARD)


class Shard:
    """Postings of one shard with their impacts, by document and by (term, impact)."""

    def __init__(self, row: dict, weights: np.ndarray, n_docs: int, all_terms: int):
        column = lambda name, kind: np.frombuffer(row[name], kind)
        self.ids, lengths, upto = column("ids", np.int64), column("lengths", np.int64), column("upto", np.int64)
        self.term, tf = column("term", np.int32), column("tf", np.int32).astype(np.int64)
        self.start = np.concatenate(([0], upto))
        norm = 100 - 25 + 25 * lengths * n_docs // max(1, all_terms)
        doc = np.repeat(np.arange(len(self.ids)), np.diff(self.start))
        self.impact = weights[self.term] * (1_000_000_000 * tf // (1000 * tf + 12 * norm[doc]))
        order = np.lexsort((doc, -self.impact, self.term))
        self.doc = doc[order]
        term, impact = self.term[order], self.impact[order]
        edges = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (impact[1:] != impact[:-1])))) if len(term) else np.zeros(0, np.int64)
        self.group_at, self.group_size = edges, np.diff(np.append(edges, len(term)))
        self.group_impact = impact[edges]
        self.groups_of = np.searchsorted(term[edges], np.arange(len(weights) + 1))  # groups of term t: groups_of[t] to groups_of[t + 1]

    def completed(self, docs: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Whole scores of some documents; ``times`` has how often the item has each term."""
        size = self.start[docs + 1] - self.start[docs]
        at = spread(self.start[docs], size)
        return per_text(np.concatenate(([0], np.cumsum(size))), self.impact[at] * times[self.term[at]])

    def best(self, own: np.ndarray, counts: np.ndarray, times: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents and scores of the k best of an item, if they score ``known`` or more; ``own`` are its terms."""
        low, high = self.groups_of[own], self.groups_of[own + 1]
        groups = spread(low, high - low)
        value = self.group_impact[groups] * np.repeat(counts, high - low)
        order = np.argsort(-value, kind="stable")
        of = np.repeat(np.arange(len(own)), high - low)[order]
        groups, value = groups[order], value[order]
        upto = np.cumsum(self.group_size[groups])
        scores = np.zeros(len(self.ids), np.int64)
        done, helping = 0, FIRST_HELPING
        while done < len(groups):
            end = min(len(groups), int(np.searchsorted(upto, (upto[done - 1] if done else 0) + helping, "left")) + 1)
            size = self.group_size[groups[done:end]]
            np.add.at(scores, self.doc[spread(self.group_at[groups[done:end]], size)], np.repeat(value[done:end], size))
            done, helping = end, 2 * helping
            if done == len(groups):
                break
            least = max(known, int(np.partition(scores, -k)[-k]) if len(scores) >= k else 0)
            later, first = np.unique(of[done:], return_index=True)
            gain = int(value[done + first].sum())  # of each term the next group, the largest that is left
            if gain < least:
                open_ = np.flatnonzero(scores + gain >= least)
                if len(open_) <= COMPLETED * k:
                    return self._top(open_, self.completed(open_, times), k, known)
        seen = np.flatnonzero(scores)
        return self._top(seen, scores[seen], k, known)

    def _top(self, docs: np.ndarray, scores: np.ndarray, k: int, known: int) -> tuple[np.ndarray, np.ndarray]:
        keep = scores >= max(1, known)
        docs, scores = docs[keep], scores[keep]
        first = np.lexsort((self.ids[docs], -scores))[:k]
        return docs[first], scores[first]


def ranked(shards: DataFrame, items: list[tuple[np.ndarray, np.ndarray]], weights: np.ndarray, n_docs: int, all_terms: int, k: int) -> DataFrame:
    """item (its number), doc_id and score: the best k of each task and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = np.zeros(len(weights), np.int64)
        kept = [np.zeros(0, np.int64)] * len(items)  # the best k scores of each item so far
        for row in (row for batch in batches for row in batch.to_pylist()):
            shard = Shard(row, weights, n_docs, all_terms)
            out: list[tuple[np.ndarray, ...]] = []
            for number, (own, counts) in enumerate(items):
                times[own] = counts
                docs, scores = shard.best(own, counts, times, k, int(kept[number][-1]) if len(kept[number]) == k else 0)
                times[own] = 0
                kept[number] = -np.sort(-np.concatenate((kept[number], scores)))[:k]
                out.append((np.full(len(docs), number), shard.ids[docs], scores))
            number, ids, scores = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(number, pa.int64()), pa.array(ids, mask=ids == LAST), pa.array(scores, pa.int64())], names=["item", "doc_id", "score"])

    return shards.mapInArrow(run, "item long, doc_id long, score long")


def _block(docs: DataFrame, rows: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    pairs = [(np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["counts"], np.int64)) for r in rows]
    vocabulary = np.unique(np.concatenate([h for h, _ in pairs]))
    shards = stage(index(docs, vocabulary), "index")
    totals = shards.agg(F.sum("with_terms").alias("n"), F.sum("all_terms").alias("l")).first()
    counted = shards.select(F.explode(F.arrays_zip("terms", "dfs")).alias("x")).groupBy("x.terms").agg(F.sum("x.dfs").alias("df"))
    df = np.zeros(len(vocabulary), np.int64)
    for r in counted.collect():  # as many rows as the block's items have terms
        df[r["terms"]] = r["df"]
    n, all_terms = totals["n"] or 0, totals["l"] or 0
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    items = [(np.searchsorted(vocabulary, h), c) for h, c in pairs]
    found = ranked(shards, items, weights, n, all_terms, k)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r["id"]) for i, r in enumerate(rows)], "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = 20, doc_column: str = "doc_id", item_column: str = "item_id", text_column: str = "text") -> DataFrame:
    """item_id, rank, doc_id and score: for each item the k documents that score highest, above 0."""
    named = lambda df, column, to: df.select(F.col(f"`{column}`").cast("long").alias(to), F.col(f"`{text_column}`").alias("text"))
    queries = stage(item_terms(named(items, item_column, "id")).filter("n > 0"), "items")
    size = queries.agg(F.count("*").alias("items"), F.sum("n").alias("terms")).first()
    parts = max(1, -(-size["items"] // ITEMS_A_BLOCK), -(-(size["terms"] or 0) // TERMS_A_BLOCK))
    dealt = queries.withColumn("part", F.pmod(F.xxhash64("id", "hashes"), F.lit(parts)))
    source = named(docs, doc_column, "doc_id")
    found = None
    for part in range(parts):
        rows = sorted(dealt.filter(F.col("part") == part).collect(), key=lambda r: (r["id"] is None, r["id"], r["hashes"]))
        if rows:
            block = _block(source, rows, k)
            found = block if found is None else found.unionByName(block)
    return found if found is not None else source.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
