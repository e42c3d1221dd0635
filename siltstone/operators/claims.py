"""Numeric claims of several sources: latest per source, conflicts in pairs, and their resolution.

A claim row has metric, entity, period, source, source_type, value, day, is_ratio. Claims meet only
within their (metric, entity, period) by an equi-join after one row a source is left, so a group
pairs at most its sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import lexicon
from ..session import cut, spread_far

KEY = ["metric", "entity", "period"]


def keyed(claims: DataFrame) -> DataFrame:
    """The group key in one spelling: metric upper, entity and period lower, years as two digits."""
    period = F.regexp_replace(F.lower(F.trim("period")), r"fy\s*(?:19|20)(\d{2})", "fy$1")
    return claims.withColumn("metric", F.upper(F.trim("metric"))).withColumn("entity", F.lower(F.trim("entity"))).withColumn("period", period)


def latest_per_source(claims: DataFrame, tie: str = "claim_id") -> DataFrame:
    w = Window.partitionBy(*KEY, "source").orderBy(F.desc("day"), tie)
    return claims.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")


def groups_with_sources(claims: DataFrame, least: int = 2) -> DataFrame:
    """Groups that at least so many distinct sources speak of, with their number.

    Claims are dealt out by group, over tasks whose number grows with the table, before anything is counted: groups are
    small and many, so that counts before the exchange would hold a task's whole input and merge little of it.
    """
    rows = claims.select(F.struct(*KEY).alias("of"), F.lower(F.trim("source")).alias("source"))  # one column, as Spark deals rows out anew when one of several is constant
    each = spread_far(rows, "of").groupBy("of", "source").agg(F.count("*").alias("n"))
    groups = each.groupBy("of").agg(F.count("source").alias("n_sources"), F.sum("n").alias("n_claims"))
    return groups.filter(F.col("n_sources") >= least).select("of.*", "n_sources", "n_claims")


def pairs(claims: DataFrame) -> DataFrame:
    """Unordered pairs of claims of one group from different sources, a before b by claim_id."""
    side = lambda s: claims.select(*KEY, *[F.col(c).alias(f"{c}_{s}") for c in claims.columns if c not in KEY])
    return side("a").join(side("b"), KEY).filter("claim_id_a < claim_id_b AND source_a <> source_b")


def compared(paired: DataFrame, pct_limit: float = 5.0, abs_limit: float = 0.5, signed_mean: bool = False, digits: int = 4) -> DataFrame:
    """Adds abs_diff, pct_diff, is_conflict and severity.

    The percentage is of the mean's absolute value; ``signed_mean`` takes the mean as it is,
    under which negative pairs never conflict.
    """
    mean = (F.col("value_a") + F.col("value_b")) / 2
    base = mean if signed_mean else F.abs(mean)
    diff = F.abs(F.col("value_a") - F.col("value_b"))
    pct = F.when(base == 0, F.lit(0.0)).otherwise(diff / base * 100)
    over = (pct > pct_limit) | (F.col("is_ratio_a") & (diff > abs_limit))
    return (
        paired.withColumn("abs_diff", F.round(diff, digits))
        .withColumn("pct_diff", F.round(pct, 2))
        .withColumn("is_conflict", over)
        .withColumn("severity", C.severity(pct))
    )


def resolved(conflicts: DataFrame) -> DataFrame:
    """Adds winner and reason: the newer claim, else the higher authority, else nobody."""
    factor = lambda s: C.authority(F.col(f"source_type_{s}"), lexicon.AUTHORITY_FACTOR, 0.7)
    by_date = F.when(F.col("day_a") > F.col("day_b"), "A").when(F.col("day_b") > F.col("day_a"), "B")
    by_authority = F.when(factor("a") > factor("b"), "A").when(factor("b") > factor("a"), "B")
    reason = F.concat_ws(
        "; ",
        F.when(by_date.isNotNull(), F.concat(F.lit("newer: "), by_date)),
        F.when(by_authority.isNotNull(), F.concat(F.lit("authority: "), by_authority)),
        F.when(by_date.isNotNull() & by_authority.isNotNull() & (by_date != by_authority), F.lit("date goes before authority")),
        F.when(by_date.isNull() & by_authority.isNull(), F.lit("equal; verify by hand")),
    )
    return conflicts.withColumn("winner", F.coalesce(by_date, by_authority, F.lit("UNRESOLVED"))).withColumn("reason", reason)


def enough_sources(claims: DataFrame, least: int = 3) -> DataFrame:
    """All claims, or none if fewer than ``least`` distinct sources speak in all of them."""
    gate = claims.agg((F.count_distinct(F.lower(F.trim("source"))) >= least).alias("open"))  # one row
    return claims.join(F.broadcast(gate.filter("open"))).drop("open")


def conflicts(claims: DataFrame, least_sources: int = 3, top: int | None = 8) -> DataFrame:
    """From claims to the conflicts most worth a look: grouped, gated, compared, resolved, worst first.

    The latest of each source are written once, as the gate, both sides of the pairs and the order read them; they speak for the sources of all claims.
    """
    latest = enough_sources(cut(latest_per_source(keyed(claims))), least_sources)
    found = resolved(compared(pairs(latest)).filter("is_conflict"))
    rank = F.when(F.col("severity") == "Major", 0).when(F.col("severity") == "Moderate", 1).otherwise(2)
    ordered = found.orderBy(rank, F.desc("pct_diff"), *KEY, "claim_id_a", "claim_id_b")
    return ordered.limit(top) if top else ordered
