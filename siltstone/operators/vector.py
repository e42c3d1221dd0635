"""Exact vector search with filters, and the scores that rank what it finds.

A vector table has one row a vector: vec_id, embedding, and metadata. Queries meet it in blocks of bounded size, by count and by bytes: a block goes to every
task, the table is scanned once for it and never shuffled for the search. A task multiplies a batch of vectors with the block as matrices; a search for
the k best keeps only the best so far of each query, whichever score ranks them, so that what leaves a task does not grow with its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import ROUND_HALF_UP, Decimal, localcontext
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import columns as C
from ..functions import lexicon

FILTER_KEYS = ("source_type", "source", "namespace", "company", "sector", "label", "date", "authority")
MOST_QUERIES, MOST_NUMBERS = 10_000, 4_000_000  # queries of a block, and numbers in their vectors
SLICE = 1 << 20  # scores at a time
PAIRS = 20_000  # rows of a batch that leaves a task


def metadata_filter(vectors: DataFrame, wanted: dict) -> DataFrame:
    """Equality, or membership for a list; keys that are no filter keys are ignored. The filters reach the scan."""
    for key, value in wanted.items():
        if key in FILTER_KEYS and key in vectors.columns:
            vectors = vectors.filter(F.col(key).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(key) == value)
    return vectors


def date_range(vectors: DataFrame, first: str | None = None, last: str | None = None, column: str = "doc_date") -> DataFrame:
    if first:
        vectors = vectors.filter(F.col(column) >= F.lit(first).cast("date"))
    if last:
        vectors = vectors.filter(F.col(column) <= F.lit(last).cast("date"))
    return vectors


def similarity(vectors: DataFrame, queries: DataFrame, digits: int = 6, k: int | None = None, within: str | None = None, as_of: str | None = None, least: float | None = None) -> DataFrame:
    """Every vector with every query: the vector's columns but its embedding, query_id, score, and the query's other columns. ``queries``: query_id, query, any number of rows.

    With ``k``, each task leaves of its rows only the k best of each query (and of each value of the column ``within``), ties to the smaller vec_id. They are best by
    score, or, with ``as_of``, by the final score of ``hybrid_score``. With ``least``, only pairs stay that may reach it. The score is null where a vector is null, has
    a null component or another length than the query.
    """
    ready = vectors if as_of is None else _with_shares(vectors, as_of)
    blocks = [_with_block(ready, block, _Wanted(digits, k, within, as_of is not None, least)) for block in _blocks(queries)]
    return reduce(DataFrame.unionByName, blocks).withColumn("score", F.round("score", digits)).drop(*SHARES)


def best_of_queries(vectors: DataFrame, queries: DataFrame, as_of: str, digits: int = 6) -> DataFrame:
    """vec_id, the best final score that a vector has for any of the queries, and n_queries, the number of queries. A task sends one row a vector and block of queries."""
    ready = _with_shares(vectors, as_of)
    parts = [_with_block(ready.select("vec_id", "embedding", *SHARES, *[c for c in ("terms",) if c in ready.columns]), block, _Wanted(digits, None, None, True, None, merged=True)) for block in _blocks(queries)]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("vec_id").agg(F.max(F.round("final_score", digits)).alias("final_score"), F.sum("n_queries").alias("n_queries"))


#: What a vector brings to the final score whatever the query.
SHARES = ("authority_share_", "recency_share_")


def _with_shares(vectors: DataFrame, as_of: str) -> DataFrame:
    return vectors.withColumn(SHARES[0], C.authority_share(C.authority(F.col("source_type")))).withColumn(SHARES[1], C.recency_cosine(F.col("doc_date"), F.lit(as_of).cast("date")))


def _blocks(queries: DataFrame) -> list[DataFrame]:
    asked = queries.withColumn("query", F.col("query").cast("array<double>"))
    size = asked.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.greatest(F.size("query"), F.lit(0))), F.lit(0)).alias("numbers")).first()
    parts = max(1, -(-size.n // MOST_QUERIES), -(-size.numbers // MOST_NUMBERS))
    dealt = asked.withColumn("part_", F.pmod(F.xxhash64("query_id"), F.lit(parts)))
    return [dealt.filter(F.col("part_") == i).drop("part_") for i in range(parts)]


@dataclass(frozen=True)
class _Wanted:
    """What a task leaves of the pairs of its rows with a block of queries."""

    digits: int
    k: int | None
    within: str | None
    hybrid: bool
    least: float | None
    merged: bool = False


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """As Spark rounds doubles: half up, of the decimal digits that are shown."""
    x = np.asarray(x, dtype=np.float64)
    scale = 10.0**digits
    with np.errstate(invalid="ignore", over="ignore"):
        y = x * scale
        near = np.rint(y)
        open_ = (np.abs(np.abs(y - near) - 0.5) < 1e-6) | (np.abs(y) > 1e9)
    out = near / scale
    at = np.nonzero(open_ & np.isfinite(x))
    if len(at[0]):
        values, inverse = np.unique(x[at], return_inverse=True)
        step = Decimal(1).scaleb(-digits)
        with localcontext() as c:
            c.prec = 400
            out[at] = np.array([float(Decimal(repr(float(v))).quantize(step, ROUND_HALF_UP)) for v in values])[inverse]
    return np.where(np.isfinite(x), out, x)


class _Final:
    """The final score of pairs, by the same steps as ``hybrid_score``, before it is rounded; -inf for null. Terms are told apart by the queries of the block."""

    def __init__(self, held: pa.Table, digits: int):
        self.digits, self.terms = digits, held.column("query_terms").to_pylist() if "query_terms" in held.column_names else None
        self.known = {t: i for i, t in enumerate(dict.fromkeys(t for said in self.terms or [] for t in said or []))}

    def _marks(self, lists: list) -> np.ndarray:
        out = np.zeros((len(lists), len(self.known)), dtype=np.float32)
        for i, said in enumerate(lists):
            out[i, [self.known[t] for t in said or [] if t in self.known]] = 1
        return out

    def rows(self, batch: pa.RecordBatch) -> None:
        self.shares = [batch.column(c).to_numpy(zero_copy_only=False) for c in SHARES]
        self.overlaps = self.terms is not None and "terms" in batch.schema.names
        if self.overlaps:
            said = batch.column("terms").to_pylist()
            self.marks, self.unsaid = self._marks(said), np.array([t is None for t in said])

    def of(self, scores: np.ndarray, at: np.ndarray) -> np.ndarray:
        s, a, r, o = lexicon.HYBRID_WEIGHTS
        score = rounded(scores, self.digits)
        clipped = np.where(np.isnan(score) | np.isneginf(score), 1.0, np.clip(score, 0.0, 1.0))  # as greatest and least pass over nulls
        overlap = np.zeros((1, 1))
        if self.overlaps:
            asked = [self.terms[i] for i in at]
            n = np.array([len(t) if t else 0 for t in asked])[:, None]
            overlap = np.where(n > 0, rounded((self._marks(asked) @ self.marks.T).astype(np.float64) / np.maximum(n, 1), 6), 0.0)
            unknown = (self.unsaid[None, :] & (n > 0)) | np.array([t is None for t in asked])[:, None]
        out = s * clipped + a * self.shares[0] + r * self.shares[1] + o * overlap
        return np.where(unknown, -np.inf, out) if self.overlaps else out


class _Best:
    """The k best rows of each query and group so far, by rounded worth and then by id, with what these rows hold."""

    def __init__(self, k: int, digits: int):
        self.k, self.digits = k, digits
        self.query = self.group = self.row = np.zeros(0, dtype=np.int64)
        self.worth = self.score = np.zeros(0)
        self.rows, self.groups = None, {}

    def groups_of(self, batch: pa.RecordBatch, within: str | None) -> np.ndarray:
        said = batch.column(within).to_pylist() if within else [None] * batch.num_rows
        return np.array([self.groups.setdefault(g, len(self.groups)) for g in said], dtype=np.int64)

    def candidates(self, worth: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of those pairs that may be among the k best of this batch."""
        found = []
        for g in np.unique(groups):
            mine = np.nonzero(groups == g)[0]
            part = worth[:, mine] if len(mine) < worth.shape[1] else worth
            least = np.partition(part, -self.k, axis=1)[:, -self.k][:, None] if len(mine) > self.k else np.full((len(part), 1), -np.inf)
            row, column = np.nonzero(part >= least - 3 * 10.0**-self.digits)
            found.append((row, mine[column]))
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])

    def add(self, rows: pa.Table, query: np.ndarray, group: np.ndarray, row: np.ndarray, worth: np.ndarray, score: np.ndarray) -> None:
        before = 0 if self.rows is None else self.rows.num_rows
        rows = rows if self.rows is None else pa.concat_tables([self.rows, rows])
        query, group, row = np.concatenate((self.query, query)), np.concatenate((self.group, group)), np.concatenate((self.row, row + before))
        worth, score = np.concatenate((self.worth, rounded(worth, self.digits))), np.concatenate((self.score, score))
        said = rows.column("vec_id")
        ids = pc.fill_null(said, -(2**31)).to_numpy() if pa.types.is_integer(said.type) else np.unique(np.array([str(v or "") for v in said.to_pylist()]), return_inverse=True)[1]
        order = np.lexsort((ids[row], -worth, group, query))
        q, g = query[order], group[order]
        new = np.concatenate(([True], (q[1:] != q[:-1]) | (g[1:] != g[:-1]))) if len(q) else np.zeros(0, dtype=bool)
        start = np.maximum.accumulate(np.where(new, np.arange(len(q)), 0)) if len(q) else new
        order = order[np.arange(len(q)) - start < self.k]
        used, self.row = np.unique(row[order], return_inverse=True)
        self.rows = rows.take(pa.array(used)).combine_chunks()
        self.query, self.group, self.worth, self.score = query[order], group[order], worth[order], score[order]


def _numbers(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows as a matrix, and which of them are whole."""
    at, values = np.asarray(column.offsets), column.values
    whole = column.is_valid().to_numpy(zero_copy_only=False) & (np.diff(at) == width)
    if values.null_count:
        missing = np.concatenate(([0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))))
        whole &= missing[at[1:]] == missing[at[:-1]]
    out = np.zeros((len(column), width))
    flat = values.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64)
    if whole.any():
        out[whole] = flat[at[:-1][whole][:, None] + np.arange(width)]
    return out, whole


def _with_block(vectors: DataFrame, block: DataFrame, wanted: _Wanted) -> DataFrame:
    names = [c for c in block.columns if c != "query"]
    kept = [f for f in vectors.schema.fields if f.name != "embedding"]
    schema = T.StructType([*kept, *(block.schema[c] for c in names), T.StructField("score", T.DoubleType())])
    if wanted.merged:
        schema = T.StructType([vectors.schema["vec_id"], T.StructField("final_score", T.DoubleType()), T.StructField("n_queries", T.LongType())])
    table = block.toArrow().combine_chunks()
    held = table.select(names)
    by_width: dict[int, list[int]] = {}
    for i, v in enumerate(table.column("query").to_pylist()):
        by_width.setdefault(len(v) if v is not None and None not in v else -1, []).append(i)
    asked = {w: (np.array(at), np.array([table.column("query")[i].as_py() if w > 0 else [] for i in at]).reshape(len(at), max(w, 0))) for w, at in by_width.items()}

    def pairs(rows: pa.RecordBatch | pa.Table, column: np.ndarray, query: np.ndarray, value: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(value), PAIRS):
            part = slice(i, i + PAIRS)
            found = pa.Table.from_batches([rows]) if isinstance(rows, pa.RecordBatch) else rows
            found, said = found.take(pa.array(column[part])).combine_chunks(), held.take(pa.array(query[part])).combine_chunks()
            columns = [t.column(c).chunk(0) for t in (found, said) for c in t.column_names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(value[part], mask=np.isneginf(value[part]))], names=schema.names)

    def slices(batch: pa.RecordBatch, final: _Final | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, their scores with all rows of the batch, and what these are worth."""
        if final:
            final.rows(batch)
        for width, (at, matrix) in asked.items():
            x, whole = _numbers(batch.column("embedding"), max(width, 0))
            whole &= width >= 0
            for i in range(0, len(at), step := max(1, SLICE // batch.num_rows)):
                scores = np.where(whole, matrix[i : i + step] @ x.T, -np.inf)
                worth = final.of(scores, at[i : i + step]) if final else scores
                yield at[i : i + step], scores, np.where(np.isnan(worth), np.inf, worth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        final = _Final(held, wanted.digits) if wanted.hybrid else None
        best_so_far = _Best(wanted.k, wanted.digits) if wanted.k is not None else None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = batch.select([f.name for f in kept])
            if wanted.merged:
                most = np.full(batch.num_rows, -np.inf)
                for _, _, worth in slices(batch, final):
                    np.maximum(most, worth.max(axis=0), out=most)
                yield pa.RecordBatch.from_arrays([rows.column("vec_id"), pa.array(most, mask=np.isneginf(most)), pa.array(np.full(len(most), held.num_rows))], names=schema.names)
            elif best_so_far is not None:
                groups, found = best_so_far.groups_of(batch, wanted.within), []
                for at, scores, worth in slices(batch, final):
                    row, column = best_so_far.candidates(worth, groups)
                    found.append((at[row], groups[column], column, worth[row, column], scores[row, column]))
                if found:
                    best_so_far.add(pa.Table.from_batches([rows]), *[np.concatenate(c) for c in zip(*found, strict=True)])
            else:
                for at, scores, worth in slices(batch, final):
                    row, column = np.nonzero(worth >= wanted.least - 3 * 10.0**-wanted.digits) if wanted.least is not None else np.divmod(np.arange(scores.size), scores.shape[1])
                    yield from pairs(rows, column, at[row], scores[row, column])
        if best_so_far is not None and best_so_far.rows is not None:
            yield from pairs(best_so_far.rows, best_so_far.row, best_so_far.query, best_so_far.score)

    return vectors.mapInArrow(run, schema)


def best(scored: DataFrame, k: int, by: str = "score", within: tuple[str, ...] = ("query_id",), tie: str = "vec_id") -> DataFrame:
    """The k best rows of each group, ranked; ties go to the smaller id. Spark keeps only k rows a group before the shuffle."""
    w = Window.partitionBy(*within).orderBy(F.desc(by), tie)
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def knn(vectors: DataFrame, queries: DataFrame, k: int = 10, wanted: dict | None = None, min_score: float | None = None) -> DataFrame:
    """The k nearest vectors (1 to 20) of each query."""
    scored = similarity(metadata_filter(vectors, wanted or {}), queries, k=max(1, min(20, k)))
    if min_score is not None:
        scored = scored.filter(F.col("score") >= min_score)
    return best(scored, max(1, min(20, k)))


def fan_out(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k nearest of each namespace, merged into the k nearest of all."""
    per_namespace = best(similarity(vectors, queries, k=max(1, min(20, k)), within="namespace"), max(1, min(20, k)), within=("query_id", "namespace")).drop("rank")
    return best(per_namespace.dropDuplicates(["query_id", "vec_id"]), k)


#: Presets: the namespace, the least authority, and how many results.
PRESETS = {"regulatory": ("regulatory", 0.95, 8), "corporate": ("corporate", None, 8), "research": ("research", 0.20, 5)}


def preset(vectors: DataFrame, queries: DataFrame, name: str, as_of: str, company: str | None = None) -> DataFrame:
    """A search in one namespace, ranked by the hybrid score; of one company, if it is named."""
    namespace, least, k = PRESETS[name]
    wanted = {"namespace": namespace} | ({"company": company} if company else {})
    rows = metadata_filter(vectors, wanted)
    return hybrid_best(rows if least is None else authority_floor(rows, least), queries, as_of, k)


def hybrid_best(vectors: DataFrame, queries: DataFrame, as_of: str, k: int) -> DataFrame:
    """The k best vectors of each query by their final score."""
    return best(hybrid_score(similarity(vectors, queries, k=k, as_of=as_of), as_of), k, by="final_score")


def hybrid_score(scored: DataFrame, as_of: str, overlap: Column | None = None, weights: tuple[float, ...] = lexicon.HYBRID_WEIGHTS) -> DataFrame:
    """Adds authority_weight, authority_score, recency_score, overlap_score and final_score.

    The overlap is the share of query_terms among terms, where the rows have both; 0 without.
    """
    s, a, r, o = weights
    if overlap is None and {"terms", "query_terms"} <= set(scored.columns):
        overlap = C.recall(F.col("query_terms"), F.col("terms"))
    return (
        scored.withColumn("authority_weight", C.authority(F.col("source_type")))
        .withColumn("authority_score", C.authority_share(F.col("authority_weight")))
        .withColumn("recency_score", C.recency_cosine(F.col("doc_date"), F.lit(as_of).cast("date")))
        .withColumn("overlap_score", overlap if overlap is not None else F.lit(0.0))
        .withColumn("final_score", F.round(s * C.clip(F.col("score"), 0.0, 1.0) + a * F.col("authority_score") + r * F.col("recency_score") + o * F.col("overlap_score"), 6))
    )


def rerank(scored: DataFrame, as_of: str, overlap: Column, top: int = 6, floor: float = 0.3, least: float = 0.10) -> DataFrame:
    """Multiplicative score: similarity, raised by recency and term overlap, times the authority factor."""
    kept = scored.filter(F.col("score") >= floor)
    out = kept.withColumn(
        "rerank_score",
        F.round(
            F.col("score")
            * (1 + 0.3 * C.recency_linear(F.col("doc_date"), F.lit(as_of).cast("date")))
            * C.authority(F.col("source_type"), lexicon.AUTHORITY_FACTOR, 0.7)
            * (1 + 0.2 * overlap),
            6,
        ),
    )
    return best(out.filter(F.col("rerank_score") >= least), top, by="rerank_score")


def authority_floor(rows: DataFrame, least: float) -> DataFrame:
    return rows if least <= 0 else rows.filter(C.authority(F.col("source_type")) >= least)


def merge_queries(found: DataFrame, k: int, by: str = "final_score", within: tuple[str, ...] = ()) -> DataFrame:
    """Results of several queries as one list: the best score of each id, then the k best (of each group in ``within``)."""
    merged = found.groupBy(*within, "vec_id").agg(F.max(by).alias(by), F.count("*").alias("n_queries"))
    return best(merged, k, by=by, within=within).drop("rank") if within else merged.orderBy(F.desc(by), "vec_id").limit(k)


def composite_floor(scored: DataFrame, least: float) -> DataFrame:
    """Rows whose composite score, not their similarity, reaches the floor."""
    return scored.filter(F.col("final_score") >= least)


def index_stats(vectors: DataFrame) -> DataFrame:
    return vectors.groupBy("namespace").agg(F.count("*").alias("n_vectors"), F.max(F.size("embedding")).alias("dimension"))


def fetch(vectors: DataFrame, ids: DataFrame) -> DataFrame:
    return vectors.join(ids.select("vec_id").distinct(), "vec_id", "left_semi")


def upsert(current: DataFrame, batch: DataFrame, key: str = "vec_id", version: str = "version") -> DataFrame:
    """Last write wins: of all rows with a key, the one with the highest version."""
    every = current.unionByName(batch)
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return every.withColumn("latest", F.row_number().over(w)).filter("latest = 1").drop("latest")


def delete(current: DataFrame, ids: DataFrame, key: str = "vec_id") -> DataFrame:
    return current.join(ids.select(key).distinct(), key, "left_anti")


def checked(vectors: DataFrame, dimension: int) -> DataFrame:
    """The vectors that may be stored: an id and the right number of values."""
    return vectors.filter(F.col("vec_id").isNotNull() & (F.size("embedding") == dimension))


def write_by_namespace(vectors: DataFrame, path: str) -> None:
    vectors.withColumn("namespace", C.lookup(F.col("source_type"), lexicon.NAMESPACES, "default")).write.partitionBy("namespace").mode("overwrite").parquet(path)
