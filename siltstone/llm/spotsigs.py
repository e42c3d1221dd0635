"""SpotSigs fingerprints: chains of content words that follow common words.

Every common word of a text is an anchor; its signature is the anchor with the next ``CHAIN``
content words after it (common words in between are skipped). A fingerprint is the sorted set
of 32-bit signature hashes; two fingerprints are compared by their exact Jaccard likeness. With a
threshold, pairs whose set lengths already forbid it are settled by the lengths alone, and
``length_band`` numbers the partitions in which such pairs lie; the query gives the likeness itself, so
it takes no threshold. A join of all texts over these sets is not built.

Words are maximal runs of letters and digits, lower-cased. A text in which no common word
occurs has one signature, the hash of all of it, so that equal texts always have equal
fingerprints and other texts seldom do. Null counts as the empty text.

Defined results: null and empty texts have the one signature of the empty text; the first half of a
one-character text is the text, its edit adds nothing; repeated rows and rows of the same id are rows of
their own, in the order of their columns' hash; rows without an id come first; the next row of the
last, or of a single row, is the first; an empty table gives an empty result; very long texts are
read whole, by one task each; other columns, whatever their names, pass through ``with_next`` and are
not read by the query.

Everything here is built-in Spark functions on strings and arrays: one pass over a text, no
explode, no shuffle.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Frequent function words of the four languages of the corpus, in natural order.
COMMON_WORDS = (
    "a an and are as at be but by for from had has have he her his i in is it not of on or she that the their they this to was we were which will with you "
    "au aux avec ce dans de des du elle en est et il la le les mais ne nous on ou par pas pour qui que se sur un une vous "
    "als am auf aus bei das dem den der des die ein eine er es für ich im ist mit nicht sich sie und von war zu zum "
    "al con como de del el en es esta la las lo los más no o para pero por que se su sus un una y"
).split()
CHAIN = 2


def with_signatures(df: DataFrame, text: str, out: str, common: list[str] | tuple[str, ...] = tuple(COMMON_WORDS)) -> DataFrame:
    """``df`` with the sorted array of distinct signature hashes of a text column.

    The steps are columns of their own, because an expression that a lambda refers to would be
    evaluated again for every element.
    """
    common = sorted(set(common))
    lines, found = f"{out}_lines", f"{out}_found"
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    # A content word ends a line, a common word ends with a space: a line is then some anchors and the word they lead to.
    marked = F.array_join(F.transform(words, lambda w: F.concat(w, F.when(w.isin(common), F.lit(" ")).otherwise(F.lit("\n")))), "")
    df = df.withColumn(lines, F.split(marked, "\n"))
    df = df.withColumn(found, lines_to_signatures(F.col(lines)))
    whole = F.array(F.hash(F.lit("whole text"), F.coalesce(text, F.lit(""))))
    return df.withColumn(out, F.when(F.size(found) > 0, F.col(found)).otherwise(whole)).drop(lines, found)


def lines_to_signatures(lines: Column) -> Column:
    last = lambda line: F.substring_index(line, " ", -1)

    def of_line(line: Column, i: Column) -> Column:
        parts = F.split(line, " ")
        chain = [last(F.coalesce(F.get(lines, i + k), F.lit(""))) for k in range(1, CHAIN)]
        return F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda anchor: F.hash(anchor, last(line), *chain))

    return F.array_sort(F.array_distinct(F.flatten(F.transform(lines, of_line))))


def fingerprint(sigs: Column) -> Column:
    """Base64 of the sorted hashes, four bytes each, on one line."""
    byte_pairs = F.transform(sigs, lambda s: F.lpad(F.hex(s.cast("long").bitwiseAND(F.lit(0xFFFFFFFF))), 8, "0"))
    return F.translate(F.base64(F.unhex(F.array_join(byte_pairs, ""))), "\r\n", "")


def likeness(a: Column, b: Column, threshold: float = 0.0) -> Column:
    """Jaccard of two signature sets; below the threshold by length alone, it is given as 0 and the sets are not compared."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b)).cast("double")
    exact = F.when(a == b, F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))
    return F.when(small < threshold * large, F.lit(0.0)).otherwise(exact) if threshold > 0 else exact


def length_band(sigs: Column, threshold: float = 0.75) -> Column:
    """Number of the length partition: sets that reach the threshold lie in the same or in neighbouring ones."""
    return F.floor(F.log(F.size(sigs).cast("double")) / math.log(1 / threshold)).cast("int")


def _fences(ids: DataFrame, rows_per_bucket: int = 500, most: int = 4096) -> list[int]:
    """Ids that cut the id range into buckets of about equal row counts; a bounded number of quantiles."""
    n = ids.count()
    buckets = max(1, min(most, n // rows_per_bucket))
    if buckets == 1:
        return []
    at = [i / buckets for i in range(1, buckets)]
    found = ids.agg(F.percentile_approx("ord", at, 10 * buckets).alias("q")).first().q
    return sorted(set(found))


def _bucket(fences: list[int]) -> Column:
    """How many fences are at most ``ord``: over groups of fences first, then in the one group that matters."""
    if not fences:
        return F.lit(0)
    width = max(1, math.isqrt(len(fences)))
    groups = [fences[i : i + width] for i in range(0, len(fences), width)]
    below = lambda values: F.size(F.filter(values, lambda x: x <= F.col("ord")))
    group = below(F.lit([g[0] for g in groups])) - 1
    nested = F.array(*[F.lit(g) for g in groups])
    return F.when(group < 0, F.lit(0)).otherwise(group * width + below(F.get(nested, F.greatest(group, F.lit(0)))))


def with_next(docs: DataFrame, columns: list[str], doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with next_<column> of the next row by ascending id; the first row's after the last.

    Rows are bucketed by id quantiles; the first row of each bucket is also sent to the bucket
    before it, so no row has to cross a task boundary later. Null ids come first; rows with the
    same id are ordered by the hash of their columns.
    """
    lowest = -(2**63)
    names = docs.columns
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row"))
    rows = rows.withColumn("ord", F.coalesce(F.col(f"row.`{doc_id}`").cast("long"), F.lit(lowest)))
    of = lambda c: F.col(f"row.`{c}`")
    ids = rows.select("ord")
    fences = _fences(ids)
    bucket = _bucket(fences)
    heads = sorted(ids.groupBy(bucket.alias("bucket")).agg(F.min("ord").alias("ord")).collect())  # a row per bucket
    if not heads:
        return rows.select("row.*", *[of(c).alias(f"next_{c}") for c in columns])
    before = {ord_: heads[i - 1].bucket for i, (_, ord_) in enumerate(heads)}
    previous = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])[F.col("ord")]
    place = lambda b, tail: F.struct(b.cast("int").alias("bucket"), F.lit(tail).alias("tail"))
    both = F.when(F.col("ord").isin(list(before)), F.array(place(F.col("own"), 0), place(previous, 1))).otherwise(F.array(place(F.col("own"), 0)))
    spread = rows.withColumn("tie", F.xxhash64(*[of(c) for c in columns])).withColumn("own", bucket).select("row", "ord", "tie", F.explode(both).alias("place")).select("row", "ord", "tie", "place.*")
    w = Window.partitionBy("bucket").orderBy("tail", "ord", "tie")
    with_leads = spread.select("row", "tail", F.struct(*[F.lead(of(c)).over(w).alias(f"next_{c}") for c in columns]).alias("following"))
    return with_leads.filter("tail = 0").select("row.*", "following.*")


def edited_text(text: Column, following: Column) -> Column:
    """The text with its last half of code points replaced by as many (or all) first ones of the following text."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    return F.concat(F.substr(text, F.lit(1), n - half), F.substr(following, F.lit(1), half))


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likenesses; see the query's contract."""
    base = with_signatures(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sigs")
    paired = with_next(base, ["text", "sigs"])
    edited = with_signatures(paired.withColumn("edited", edited_text(F.col("text"), F.col("next_text"))), "edited", "edited_sigs")
    return edited.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"),
        fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs")).alias("near_edited"),
        likeness(F.col("sigs"), F.col("next_sigs")).alias("near_next"),
    )
