"""Pairs of word sets that share at least so many words, by an inverted index with a count filter.

Words are ordered by how many sets hold them, rarest first. Two sets of m and n words that share ``least`` of them share one among the first
m - least + 1 of one and the first n - least + 1 of the other, so only these are joined: the commonest words of each set, with the longest lists, never
are. Candidates then meet whole and are counted. Sets with fewer words than ``least`` are out from the start.

Where only the first of each title is asked for, ``first_sharing`` finds it without the pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut

LEAST = 3


def sharing(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """left_id, right_id and shared for all pairs with ``shared`` >= ``least``. Both sides have id and words (an array; repeats count once).

    Null ids and null arrays take no part. What grows is the join of the prefixes: as a word's lists on both sides, multiplied.
    """
    clean = lambda df: df.filter("id IS NOT NULL").select("id", F.array_distinct(F.array_compact("words")).alias("words")).filter(F.size("words") >= least)
    one, two = cut(clean(left)), cut(clean(right))
    words = one.select(F.explode("words").alias("word")).unionByName(two.select(F.explode("words").alias("word")))
    counts = words.groupBy("word").agg(F.count("*").alias("sets"))

    def prefix(df: DataFrame, name: str) -> DataFrame:
        placed = df.select("id", F.size("words").alias("n"), F.explode("words").alias("word")).join(counts, "word")
        ordered = placed.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("sets", "word"))).alias("order"))
        first = F.slice("order", F.lit(1), F.size("order") - least + 1)
        return ordered.select(F.col("id").alias(name), F.explode(first).alias("x")).select(name, F.col("x.word").alias("word"))

    candidates = prefix(one, "left_id").join(prefix(two, "right_id"), "word").select("left_id", "right_id").distinct()
    whole = candidates.join(one.toDF("left_id", "left_words"), "left_id").join(two.toDF("right_id", "right_words"), "right_id")
    return whole.select("left_id", "right_id", F.size(F.array_intersect("left_words", "right_words")).alias("shared")).filter(F.col("shared") >= least)


def long_words(text: F.Column) -> F.Column:
    """Distinct words of four letters a to z or more, that no other letter, digit or underscore touches."""
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"(?U)\b[a-z]{4,}\b"), F.lit(0)))


#: Theses and passages that meet in one group, the firsts that may come of it, and those that a batch of them has.
LEFT_ROWS, RIGHT_ROWS, FOUND_ROWS, SENT = 16_384, 16_384, 1_048_576, 65_536


def _firsts(least: int, names: list[str]):
    """Of each group of theses and passages: for each thesis and title the first passage that shares enough words, with their number.

    Passages have nth, their place by title and order, and group, the number of their title.
    """

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.take(pc.sort_indices(right["nth"]))
        titles, words = right["group"].to_numpy(), right["words"].combine_chunks()
        spoken = words.flatten().dictionary_encode()
        codes = spoken.indices.to_numpy()
        lists = np.repeat(np.arange(len(right)), pc.list_value_length(words).to_numpy())[np.argsort(codes, kind="stable")]
        ends = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(spoken.dictionary)))])
        asked = left["words"].combine_chunks()
        known = pc.fill_null(pc.index_in(asked.flatten(), value_set=spoken.dictionary), -1).to_numpy()
        owners = np.repeat(np.arange(len(left)), pc.list_value_length(asked).to_numpy())[known >= 0]
        known, bounds = known[known >= 0], np.searchsorted(owners, np.arange(len(left) + 1))
        nobody = np.zeros(0, np.int64)
        theses, places, shared = [nobody], [nobody], [nobody]
        for i in np.flatnonzero(np.diff(bounds) >= least):
            counts = np.bincount(np.concatenate([lists[ends[w] : ends[w + 1]] for w in known[bounds[i] : bounds[i + 1]]]))
            enough = np.flatnonzero(counts >= least)
            if len(enough):
                enough = enough[np.flatnonzero(np.diff(titles[enough], prepend=-1))]
                theses.append(np.full(len(enough), i))
                places.append(enough)
                shared.append(counts[enough])
        at, of = np.concatenate(places), np.concatenate(theses)
        found = pa.Table.from_arrays([left["id"].take(of), right["title"].take(at), right["first"].take(at), pa.array(np.concatenate(shared), pa.int64())], names=names)
        return pa.Table.from_batches(found.to_batches(SENT), found.schema)

    return run


def first_sharing(left: DataFrame, right: DataFrame, least: int = LEAST) -> DataFrame:
    """id, title, first and shared: for each id of ``left`` and each title the smallest ``first`` of the rows of ``right`` that share ``least`` words with it.

    left: id, words; right: title, first (any order that Spark knows), words; arrays without repeats and nulls. Of rows with one title and the same words only the smallest is compared. Blocks of
    left meet blocks of right, in which words are counted over inverted lists, so that a task has a bounded number of rows and only firsts leave it, where pairs would
    grow with both sides multiplied. The blocks' pairs grow so too, by one for each LEFT_ROWS x RIGHT_ROWS; where a block has many titles, so that more
    than FOUND_ROWS may come of such a pair, fewer rows of left meet it.
    """
    spark = left.sparkSession
    one = cut(left.select("id", "words"))
    two = cut(right.groupBy("title", F.sort_array("words").alias("words")).agg(F.min("first").alias("first")))
    n_blocks = max(1, -(-two.count() // RIGHT_ROWS))
    order = Window.partitionBy("block").orderBy("title", "first")
    two = two.repartitionByRange(n_blocks, "title", "first").withColumn("block", F.spark_partition_id())
    two = cut(two.select("*", F.row_number().over(order).alias("nth"), F.dense_rank().over(Window.partitionBy("block").orderBy("title")).alias("group")))
    n_titles = two.agg(F.max("group")).first()[0] or 1
    n_parts = max(-(-one.count() // max(1, min(LEFT_ROWS, FOUND_ROWS // n_titles))), -(-spark.sparkContext.defaultParallelism // n_blocks))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    n_tasks = max(n_parts * n_blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    one = one.withColumn("part", F.pmod(F.xxhash64("id"), F.lit(n_parts)).cast("int")).select("*", each(n_blocks).alias("block")).repartition(n_tasks, "part", "block")
    two = two.select("*", each(n_parts).alias("part")).repartition(n_tasks, "part", "block")
    schema = T.StructType([one.schema["id"], two.schema["title"], two.schema["first"], T.StructField("shared", T.LongType())])
    found = one.groupBy("part", "block").cogroup(two.groupBy("part", "block")).applyInArrow(_firsts(least, schema.names), schema)
    found = found.repartition(4 * n_tasks, "id", "title")  # few repeat, so that sums before the exchange would only hold a task's whole output
    return found.groupBy("id", "title").agg(F.min(F.struct("first", "shared")).alias("x")).select("id", "title", "x.*")


def corpus_analogs(theses: DataFrame, events: DataFrame, least: int = LEAST, most: float = 0.95) -> DataFrame:
    """id, title, score and place for each thesis and each event that a passage names which shares ``least`` words with it.

    theses: id, text. events: id (of the passage), place (its order), title, base, text. Of the passages that name an event the first by place counts; its score is
    base and a hundredth for each shared word, at most ``most``.
    """
    worded = lambda df: df.filter("id IS NOT NULL").withColumn("words", long_words(F.col("text"))).filter(F.size("words") >= least)
    found = first_sharing(worded(theses), worded(events).withColumn("first", F.struct("place", "id", "base")), least)
    score = F.round(F.least(F.col("first.base") + F.col("shared") / 100, F.lit(most)), 3)
    return found.select("id", "title", score.alias("score"), "first.place")
