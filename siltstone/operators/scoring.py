"""Roll-ups of risks, assumptions and evidence into levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon


def strength(risks: DataFrame, key: str, weights: dict | None = None) -> DataFrame:
    """weighted and plain mean score of each thesis, with the class of either; the final class is the plain one.

    Weighted: below 4 Strong, up to 7 Medium, else Weak. Plain: below 4 Strong, below 7 Medium, else Weak.
    """
    w = C.lookup(F.col("dimension"), weights or lexicon.RISK_WEIGHTS, 1.0)
    means = risks.groupBy(key).agg(F.round(F.sum(F.col("score") * w) / F.sum(w), 4).alias("weighted"), F.round(F.avg("score"), 4).alias("plain"))
    by_weight = F.when(F.col("weighted") < 4, "Strong").when(F.col("weighted") <= 7, "Medium").otherwise("Weak")
    by_mean = F.when(F.col("plain") < 4, "Strong").when(F.col("plain") < 7, "Medium").otherwise("Weak")
    return means.withColumn("weighted_strength", by_weight).withColumn("strength", by_mean)


def thesis_confidence(assumptions: DataFrame, risks: DataFrame, key: str) -> DataFrame:
    """Low, Medium or High from the support of assumptions and the mean risk."""
    supported = F.col("supported").cast("int")
    support = assumptions.groupBy(key).agg(F.avg(supported).alias("support_rate"), F.sum((F.col("critical") & ~F.col("supported")).cast("int")).cast("long").alias("critical_unsupported"))
    risk = risks.groupBy(key).agg(F.avg("score").alias("avg_risk"))
    both = support.join(risk, key, "left").withColumn("avg_risk", F.coalesce("avg_risk", F.lit(7.0)))
    low = (F.col("support_rate") < 0.30) | (F.col("avg_risk") > 7.0) | (F.col("critical_unsupported") >= 2)
    high = (F.col("support_rate") >= 0.70) & (F.col("avg_risk") < 5.0) & (F.col("critical_unsupported") == 0)
    return both.withColumn("confidence", F.when(low, "Low").when(high, "High").otherwise("Medium"))


def answer_confidence(chunks: DataFrame, key: str, major: Column | None = None) -> DataFrame:
    """Low, Medium or High from the number, mean score and authority of the chunks, and major conflicts."""
    stats = chunks.groupBy(key).agg(
        F.count("*").alias("n"),
        F.round(F.avg("final_score"), 6).alias("avg_score"),
        F.sum((C.authority(F.col("source_type")) >= 0.65).cast("int")).cast("long").alias("n_authority"),
        (F.max(major) if major is not None else F.lit(0)).alias("n_major"),
    )
    low = (F.col("n") < 2) | (F.col("avg_score") < 0.35) | (F.col("n_major") >= 3)
    high = (F.col("n") >= 4) & (F.col("avg_score") >= 0.60) & (F.col("n_major") == 0) & (F.col("n_authority") >= 2)
    return stats.withColumn("confidence", F.when(low, "Low").when(high, "High").otherwise("Medium")).drop("n_major")


def robustness(assumptions: DataFrame, key: str, has_cycle: Column) -> DataFrame:
    """Low with a cycle, two critical assumptions without support or mean confidence below .4; High from .65 with none."""
    stats = assumptions.groupBy(key).agg(
        F.round(F.avg("confidence"), 4).alias("avg_confidence"), F.sum((F.col("critical") & ~F.col("supported")).cast("int")).cast("long").alias("critical_unsupported"), F.max(has_cycle).alias("cyclic")
    )
    low = F.col("cyclic") | (F.col("critical_unsupported") >= 2) | (F.col("avg_confidence") < 0.4)
    high = (F.col("avg_confidence") >= 0.65) & (F.col("critical_unsupported") == 0)
    return stats.withColumn("robustness", F.when(low, "Low").when(high, "High").otherwise("Medium"))


def heuristic_risk(confidence: Column, critical_unsupported: Column) -> Column:
    """1 to 10: rounded half to even, after what means leave beyond six digits, raised by unsupported critical assumptions."""
    return C.clip((F.bround(F.round((1 - confidence) * 9, 6), 0) + 1 + F.least(2 * critical_unsupported, F.lit(3))).cast("int"), 1, 10)


def max_per_source(rows: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    """The best row of each source, as citations list them."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), tie)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def context_budget(ranked: DataFrame, most_chars: int, key: str, rank: str = "rank", text: str = "text") -> DataFrame:
    """The leading rows of each list whose texts fit the budget together; the first that does not fit ends the list."""
    w = Window.partitionBy(key).orderBy(rank).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn("chars_so_far", F.sum(F.length(text)).over(w)).filter(F.col("chars_so_far") <= most_chars)


def support(assumptions: DataFrame, chunks: DataFrame, least_score: float = 0.35, needed: float = 0.25) -> DataFrame:
    """Authority-weighted share of each assumption's terms in the chunks.

    The weight of the chunks that hold a word is summed first, a row a word, and meets the terms
    by an equi-join. assumptions: assumption_id, terms (array); chunks: words (array, distinct), source_type, score.
    """
    relevant = chunks.filter(F.col("score") >= least_score).withColumn("weight", C.authority(F.col("source_type")))
    of_word = relevant.select(F.explode("words").alias("term"), "weight").groupBy("term").agg(F.sum("weight").alias("weight"))
    terms = assumptions.select("assumption_id", F.explode(F.array_distinct("terms")).alias("term"))
    hits = terms.join(of_word, "term").groupBy("assumption_id").agg(F.sum("weight").alias("hit"))
    totals = relevant.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("all_weight"))  # one row
    every = assumptions.join(hits, "assumption_id", "left").join(F.broadcast(totals))
    rate = F.coalesce(F.try_divide(F.col("hit"), F.col("all_weight") * F.size("terms")), F.lit(0.0))
    return every.select("assumption_id", F.round(rate, 6).alias("support"), (rate >= needed).alias("supported"))


def coverage(subqueries: DataFrame, chunks: DataFrame, least_score: float = 0.30) -> DataFrame:
    """Whether any chunk holds at least half (one at least) of a sub-query's tokens; chunks of its own query only."""
    need = F.greatest(F.lit(1), F.floor(F.size("tokens") / 2))
    hits = subqueries.join(chunks.filter(F.col("score") >= least_score).select("query_id", "words"), "query_id", "left")
    matched = F.coalesce(F.size(F.array_intersect("tokens", F.coalesce("words", F.array().cast("array<string>")))), F.lit(0))
    return hits.groupBy("query_id", "subquery_id").agg(F.max((matched >= need).cast("int")).cast("boolean").alias("covered"))


def compare(theses: DataFrame) -> DataFrame:
    """Ranks theses: stronger class first, then the lower mean risk."""
    order = F.when(F.col("strength") == "Strong", 0).when(F.col("strength") == "Medium", 1).otherwise(2)
    return theses.withColumn("class_order", order)
