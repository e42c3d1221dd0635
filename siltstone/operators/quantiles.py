"""Exact order statistics of groups of any size, by counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut

BUCKETS = 4096
CROWDED = 1_000_000  # rows of a bucket that are not ranked in one task
MOST_SENT = 100_000  # rows that are sent to every executor at most


def _sent(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.limit(MOST_SENT + 1).count() <= MOST_SENT else df


def values_at(rows: DataFrame, key: str, value: str, places: dict[str, Callable[[Column], Column]]) -> DataFrame:
    """key, n (values that are not null), mean, and for each name the value at a place of the key's sorted values.

    ``places`` gives a place, counted from 0, from n. The range of each key's values is cut into BUCKETS of one width; exact counts say in which of
    them each place lies, and only the rows of those are ranked, equal values as one row. A bucket with more than CROWDED rows is
    cut anew in the same way, over its own range. Not a number counts as the largest of all, as in a sort.
    """
    known = rows.select(F.col(key).alias("g"), F.col(value).alias("v"), F.lit(1).cast("long").alias("times")).filter("v IS NOT NULL")
    totals = cut(known.groupBy("g").agg(F.count("*").alias("n"), F.avg("v").alias("mean"), *_ends()))
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), place(F.col("n")).cast("long").alias("place")) for name, place in places.items()])
    picked = _picked(known, totals.select("g", "low", "high"), totals.select("g", F.explode(wanted).alias("w")).select("g", "w.name", "w.place"))
    sides = picked.groupBy(F.col("g").alias("of")).agg(*[F.max(F.when(F.col("name") == name, F.col("v"))).alias(name) for name in places])
    found = totals.select("g", "n", "mean").join(sides, F.col("g").eqNullSafe(F.col("of")))
    return cut(found.select(F.col("g").alias(key), "n", "mean", *places))


def _ends() -> tuple[Column, Column]:
    x = F.col("v").cast("double")
    finite = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    return F.min(finite).alias("low"), F.max(finite).alias("high")


def _bucket() -> Column:
    """The bucket of v, which never falls as v grows."""
    x = F.col("v").cast("double")
    share = (x / 2 - F.col("low") / 2) / (F.col("high") / 2 - F.col("low") / 2)
    inside = F.when(F.col("high") > F.col("low"), F.floor(share * BUCKETS).cast("int")).otherwise(0)
    return F.when(F.isnan(x), BUCKETS + 2).when(x == float("inf"), BUCKETS + 1).when(x == float("-inf"), -1).otherwise(inside)


def _picked(known: DataFrame, ends: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, name and v: the value at each wanted place. known: g, v and how many times it stands there."""
    ends = _sent(ends).withColumnRenamed("g", "of")
    dealt = known.join(ends, F.col("g").eqNullSafe(F.col("of"))).select("g", "v", "times", _bucket().alias("bucket"))
    counts = dealt.groupBy("g", "bucket").agg(F.sum("times").alias("inside"), F.count("*").alias("rows"))
    upto = Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("inside").over(upto), F.lit(0))).select(F.col("g").alias("of"), "bucket", "before", "inside", "rows")
    hits = counts.join(wanted, F.col("g").eqNullSafe(F.col("of"))).filter("before <= place AND place < before + inside")
    hits = cut(hits.select("g", "name", "bucket", (F.col("place") - F.col("before")).alias("place"), "rows"))
    buckets = _sent(hits.select(F.col("g").alias("of"), F.col("bucket").alias("at"), (F.col("rows") > CROWDED).alias("crowded")).distinct())
    chosen = dealt.join(buckets, F.col("g").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).groupBy("g", "bucket", "v", "crowded").agg(F.sum("times").alias("times"))
    few = chosen.filter("NOT crowded").withColumn("upto", F.sum("times").over(Window.partitionBy("g", "bucket").orderBy("v")))
    few = few.select(F.col("g").alias("of"), F.col("bucket").alias("at"), "v", "times", "upto")
    found = hits.join(few, F.col("g").eqNullSafe(F.col("of")) & (F.col("bucket") == F.col("at"))).filter("upto - times <= place AND place < upto").select("g", "name", "v")
    if hits.filter(F.col("rows") > CROWDED).isEmpty():
        return found
    whole = F.struct("g", "bucket")
    again = cut(chosen.filter("crowded").select(whole.alias("g"), "v", "times"))
    finer = _picked(again, cut(again.groupBy("g").agg(*_ends())), hits.filter(F.col("rows") > CROWDED).select(whole.alias("g"), "name", "place"))
    return found.unionByName(finer.select("g.g", "name", "v"))


def medians(rows: DataFrame, key: str, value: str) -> DataFrame:
    """key, n, mean and median: the middle value, or the mean of both middle ones."""
    both = values_at(rows, key, value, {"low": lambda n: F.floor((n - 1) / 2), "high": lambda n: F.floor(n / 2)})
    return both.select(key, "n", "mean", ((F.col("low") + F.col("high")) / 2).alias("median"))
