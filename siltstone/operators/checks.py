"""Rule checks on numeric records: robust outliers, ranges, ratios, units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import medians

#: Plausible ranges of metrics, low and high.
RANGES = {"nim": (0.0, 15.0), "gnpa": (0.0, 50.0), "pcr": (0.0, 100.0), "casa": (0.0, 100.0), "crar": (0.0, 60.0), "roe": (-100.0, 100.0), "pe": (0.0, 1000.0)}

#: Fixed values: (code, level) of a metric below its range and above it.
RANGE_LEVELS = {
    "crar": (("IMPOSSIBLE_VALUE", "critical"), ("OUT_OF_RANGE", "warning")),
    "pcr": (("OUT_OF_RANGE", "critical"), ("OUT_OF_RANGE", "critical")),
    "casa": (("OUT_OF_RANGE", "critical"), ("OUT_OF_RANGE", "critical")),
    "nim": (("IMPOSSIBLE_VALUE", "critical"), ("OUT_OF_RANGE", "warning")),
    "gnpa": (("IMPOSSIBLE_VALUE", "critical"), ("OUT_OF_RANGE", "warning")),
    "roe": (("OUT_OF_RANGE", "warning"), ("OUT_OF_RANGE", "warning")),
    "pe": (("IMPOSSIBLE_VALUE", "warning"), ("OUT_OF_RANGE", "info")),
}

#: Crores in one unit.
UNIT_SCALE = {"crore": 1.0, "cr": 1.0, "lakh": 0.01, "lacs": 0.01, "mn": 0.1, "million": 0.1, "bn": 100.0, "billion": 100.0}


def outliers(rows: DataFrame, group: str, value: str, limit: float = 3.5, least: int = 4) -> DataFrame:
    """Rows whose modified z-score exceeds the limit.

    The score is .6745 |x - median| / MAD; where the MAD is 0, |x - median| over the mean
    absolute deviation times .7979; where that is 0 too, nothing stands out. Medians are exact,
    by ``quantiles.medians``, so that a group of any size is dealt over many tasks.
    """
    med = medians(rows, group, value).filter(F.col("n") >= least).select(group, F.col("median").alias("med"))
    away = rows.join(med, group).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    spread = medians(away, group, "dev").select(group, F.col("median").alias("mad"), F.col("mean").alias("mean_dev"))
    score = F.when(F.col("mad") > 0, 0.6745 * F.col("dev") / F.col("mad")).when(F.col("mean_dev") > 0, F.col("dev") * 0.7979 / F.col("mean_dev"))
    return away.join(spread, group).withColumn("z", F.round(score, 4)).filter(F.col("z") > limit)


def warning(code: str, level: str, metric: str, when: Column, message: str) -> Column:
    return F.when(when, F.struct(F.lit(code).alias("code"), F.lit(level).alias("level"), F.lit(metric).alias("metric"), F.lit(message).alias("message")))


def ratio_rules(records: DataFrame, tolerance: float = 0.15) -> DataFrame:
    """One row for each rule that a record breaks. A record has metric columns; those it lacks break nothing."""
    has = set(records.columns)
    rules = []
    for m, (low, high) in RANGES.items():
        if m in has:
            for (code, level), beyond in zip(RANGE_LEVELS[m], (F.col(m) < low, F.col(m) > high), strict=True):
                rules.append(warning(code, level, m, beyond, f"{m} outside {low:g} to {high:g}"))
    if {"gnpa", "nnpa"} <= has:
        rules.append(warning("GNPA_BELOW_NNPA", "critical", "gnpa", F.col("gnpa") < F.col("nnpa"), "net exceeds gross"))
    for ratio, (top, bottom) in {"nim": ("nii", "assets"), "roe": ("pat", "equity"), "roa": ("pat", "assets")}.items():
        if {ratio, top, bottom} <= has:
            expected = F.col(top) * 100 / F.when(F.col(bottom) > 0, F.col(bottom))
            off = F.when(expected == 0, F.col(ratio) != 0).otherwise(F.abs(F.col(ratio) - expected) / F.abs(expected) > tolerance)
            rules.append(warning("RATIO_INCONSISTENCY", "warning", ratio, off, f"{ratio} is not {top} over {bottom}"))
    ids = [c for c in records.columns if c in ("record_id", "entity", "period")]
    broken = F.filter(F.array(*rules), lambda w: w.isNotNull())
    return records.select(*ids, F.explode(broken).alias("w")).select(*ids, "w.*")


def unit_scale(unit: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for pair in UNIT_SCALE.items() for x in pair])
    return pairs[F.lower(unit)]


def unit_mismatch(claims: DataFrame, low: float = 0.01, high: float = 100.0) -> DataFrame:
    """Values of one (metric, entity, period) in different units that differ as the units do not.

    A row for each pair of distinct values with units of different scale: unit and value of both, ratio,
    and how many pairs of claims have them. Repeats of a value are counted before the join, so a
    group pairs its distinct values at most.
    """
    key = ["metric", "entity", "period"]
    scaled = claims.withColumn("scale", unit_scale(F.col("unit"))).filter("scale IS NOT NULL AND value <> 0")
    values = scaled.groupBy(*key, "unit", "scale", "value").agg(F.count("*").alias("times"))
    side = lambda s: values.select(*key, *[F.col(c).alias(f"{c}_{s}") for c in ("unit", "scale", "value", "times")])
    ratio = F.try_divide(F.col("value_a") * F.col("scale_a"), F.col("value_b") * F.col("scale_b"))
    both = side("a").join(side("b"), key).filter("unit_a < unit_b AND scale_a <> scale_b")
    found = both.withColumn("ratio", F.round(ratio, 6)).filter((F.col("ratio") >= high) | (F.col("ratio") <= low))
    return found.withColumn("n_pairs", F.col("times_a") * F.col("times_b")).drop("times_a", "times_b", "scale_a", "scale_b")


def percent_as_absolute(claims: DataFrame) -> DataFrame:
    """Values of ratio metrics that are no percentages: above ten times the plausible maximum, or basis points given as a level."""
    tops = F.create_map(*[F.lit(x) for m, (_, high) in RANGES.items() for x in (m, high)])
    top = tops[F.lower("metric")]
    code = F.when((F.col("unit") != "%") & (F.col("value") > 10 * top), "PERCENT_AS_ABSOLUTE").when((F.col("unit") == "bps") & (F.col("value") > 100), "BPS_AS_LEVEL")
    return claims.withColumn("code", code).filter("code IS NOT NULL")


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key in a given order."""
    from pyspark.sql import Window

    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("nth", F.row_number().over(w)).filter("nth = 1").drop("nth")
