"""Counts and wording of responses: theses, answers, batches, break conditions, traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Source types whose citations count as regulatory, and the target of a response in milliseconds.
REGULATORY = ("rbi", "sebi", "mca")
TARGET_MS = 3000


def thesis_counters(assumptions: DataFrame, risks: DataFrame, breaks: DataFrame, key: str) -> DataFrame:
    """avg_risk, highest_risk (the dimension; ties: the first by name), counts of critical, unsupported, triggered and likely ones, and the support rate in percent."""
    count = lambda condition: F.sum(condition.cast("int")).cast("long")
    a = assumptions.groupBy(key).agg(
        count(F.col("critical")).alias("n_critical"), count(~F.col("supported")).alias("n_unsupported"), F.round(F.avg(F.col("supported").cast("int")) * 100, 1).alias("support_rate")
    )
    r = risks.groupBy(key).agg(F.round(F.avg("score"), 2).alias("avg_risk"), F.min_by("dimension", F.struct(-F.col("score"), "dimension")).alias("highest_risk"))
    b = breaks.groupBy(key).agg(count(F.col("triggered")).alias("n_triggered"), count(F.col("probability") == "High").alias("n_likely"))
    return a.join(r, key, "full").join(b, key, "full").na.fill(0, ["n_critical", "n_unsupported", "n_triggered", "n_likely"])


def verdict(strength: Column, confidence: Column, avg_risk: Column) -> Column:
    """``Medium Thesis | High Confidence | Avg Risk: 5.4/10``."""
    return F.concat(strength, F.lit(" Thesis | "), confidence, F.lit(" Confidence | Avg Risk: "), avg_risk.cast("string"), F.lit("/10"))


def answer_counts(citations: DataFrame, conflicts: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """Per answer: n_citations, n_regulatory, n_conflicts, has_conflicts, and in_time (within the latency target)."""
    c = citations.groupBy(key).agg(F.count("*").alias("n_citations"), F.sum(F.lower("source_type").isin(list(REGULATORY)).cast("int")).cast("long").alias("n_regulatory"))
    k = conflicts.groupBy(key).agg(F.count("*").alias("n_conflicts"))
    out = answers.join(c, key, "left").join(k, key, "left").na.fill(0, ["n_citations", "n_regulatory", "n_conflicts"])
    return out.withColumn("has_conflicts", F.col("n_conflicts") > 0).withColumn("in_time", F.col("latency_ms") <= TARGET_MS)


def batch_summary(answers: DataFrame, batch: str) -> DataFrame:
    """Per batch: n, n_successful (not of low confidence, or from the cache), n_failed, and the mean latency."""
    good = ((F.col("confidence") != "Low") | F.col("cache_hit")).cast("int")
    return answers.groupBy(batch).agg(F.count("*").alias("n"), F.sum(good).cast("long").alias("n_successful"), F.round(F.avg("latency_ms"), 1).alias("avg_latency_ms")).withColumn("n_failed", F.col("n") - F.col("n_successful"))


def metrics_view(events: DataFrame, key: str) -> DataFrame:
    """Per kind of request: n, rates of cache hits and errors in percent, and the mean latency. events: cache_hit, error, latency_ms."""
    rate = lambda c: F.round(F.avg(F.col(c).cast("int")) * 100, 2)
    return events.groupBy(key).agg(F.count("*").alias("n"), rate("cache_hit").alias("hit_pct"), rate("error").alias("error_pct"), F.round(F.avg("latency_ms"), 2).alias("avg_latency_ms"))


def token_sum(rows: DataFrame, batch: str, text: str = "text") -> DataFrame:
    """White-space tokens of each batch."""
    return rows.groupBy(batch).agg(F.sum(F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))).cast("long").alias("n_tokens"))


def heuristic_breaks(assumptions: DataFrame, most: int = 6, key: str = "thesis", order: str = "n") -> DataFrame:
    """A break condition for each critical assumption, the first six of a thesis: condition, trigger_metric, threshold, probability, triggered."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    rows = assumptions.filter("critical").withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
    return rows.select(
        key,
        "place",
        F.concat(F.lit("Assumption fails: "), F.substring("sentence", 1, 200)).alias("condition"),
        F.concat(F.lit("Monitor: "), F.col("category"), F.lit(" indicators")).alias("trigger_metric"),
        F.lit("Below minimum required level").alias("threshold"),
        F.when(F.col("confidence") < 0.5, "High").otherwise("Medium").alias("probability"),
        F.lit(False).alias("triggered"),
    )


#: Words of a condition that are no terms.
EMPTY_WORDS = ("will", "when", "that", "this", "from", "with", "have", "been", "than", "below", "above", "falls")


def triggered(conditions: DataFrame, chunks: DataFrame, key: str = "condition_id", least_score: float = 0.7, least_terms: int = 2, least_chunks: int = 2) -> DataFrame:
    """key and triggered: the condition names a threshold, and two chunks of a high score have two of its first five terms.

    conditions: key, condition; chunks: chunk_id, text, score. Terms meet the chunks' words by an equi-join; a term
    counts where it begins a word or lies in it, so words are matched by all their parts of the terms' lengths.
    """
    low = F.lower("condition")
    threshold = low.rlike(r"(?:below|above|exceeds?|falls?\s+below|rises?\s+above|drops?\s+below|jumps?\s+above)\s+[\d.]+")
    terms = F.filter(F.regexp_extract_all(low, F.lit(r"[a-z]{4,}"), F.lit(0)), lambda w: ~w.isin(list(EMPTY_WORDS)))
    asked = conditions.withColumn("named", threshold).withColumn("terms", F.array_distinct(F.slice(terms, 1, 5)))
    each = asked.filter("named").select(key, F.explode("terms").alias("term"))
    lengths = each.select(F.length("term").alias("size")).distinct()  # at most as many as there are lengths of words
    runs = chunks.filter(F.col("score") >= least_score).select("chunk_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[a-z]{4,}"), F.lit(0)))).alias("word"))
    sized = runs.join(F.broadcast(lengths), F.length("word") >= F.col("size"))
    parts = sized.select("chunk_id", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1), lambda i: F.substr("word", i, F.col("size")))).alias("term"))
    hits = each.join(parts.distinct(), "term").groupBy(key, "chunk_id").agg(F.count("*").alias("n")).filter(F.col("n") >= least_terms)
    enough = hits.groupBy(key).agg(F.count("*").alias("n_chunks")).filter(F.col("n_chunks") >= least_chunks)
    return asked.select(key).join(enough.select(key, F.lit(True).alias("triggered")), key, "left").na.fill(False, ["triggered"])


def trace(steps: DataFrame, key: str) -> DataFrame:
    """Per request: the steps in order with their milliseconds, the slowest of them and the total. steps: key, n, step, ms."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("n", "step", "ms"))), lambda s: F.concat(s["step"], F.lit(" "), s["ms"].cast("string"), F.lit(" ms")))
    return steps.groupBy(key).agg(F.array_join(ordered, " > ").alias("trace"), F.max_by("step", F.struct("ms", -F.col("n"))).alias("slowest"), F.sum("ms").alias("total_ms"))
