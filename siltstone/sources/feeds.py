"""Readers of articles, folders, feeds and listings, and the registry of what was taken in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ARTICLE = "title string, content string, url string, date string, source string"


def article_text(df: DataFrame) -> DataFrame:
    """Title, content, url, date and source in one text, parted by blank lines; what is empty is left out."""
    parts = [F.nullif(F.trim(c), F.lit("")) for c in ("title", "content", "url", "date", "source")]
    return df.withColumn("text", F.concat_ws("\n\n", *parts))


def json_articles(spark: SparkSession, path: str) -> DataFrame:
    return article_text(spark.read.schema(ARTICLE).option("multiLine", True).json(path))


def text_files(spark: SparkSession, path: str, recursive: bool = True, pattern: str = "*.{txt,md,csv}") -> DataFrame:
    """One row a file: path, text, file_hash."""
    rows = spark.read.option("recursiveFileLookup", recursive).option("pathGlobFilter", pattern).text(path, wholetext=True)
    return rows.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.md5(F.col("value").cast("binary")).alias("file_hash"))


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """Raw files for a parser of the caller's (a Python function over content): path, content, file_hash."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return rows.select("path", "content", F.md5("content").alias("file_hash"))


def rss_items(spark: SparkSession, path: str) -> DataFrame:
    """Items of RSS files: title, link, published (text), description."""
    schema = "title string, link string, pubDate string, description string"
    rows = spark.read.format("xml").schema(schema).option("rowTag", "item").load(path)
    return rows.select("title", F.trim("link").alias("link"), F.col("pubDate").alias("published"), "description")


def fresh_items(items: DataFrame, cutoff: Column, keywords: tuple[str, ...] = (), registry: DataFrame | None = None, most: int | None = None) -> DataFrame:
    """Items with title and link that are newer than the cutoff (undated ones pass), match a keyword if any are given,
    and are not in the registry (url_hash); at most so many, newest first.
    """
    day = F.try_to_timestamp(F.regexp_replace("published", r"^\w{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    out = items.filter("title IS NOT NULL AND link IS NOT NULL").withColumn("published_at", day).filter(F.col("published_at").isNull() | (F.col("published_at") >= cutoff))
    if keywords:
        text = F.lower(F.concat_ws(" ", "title", "description"))
        out = out.filter(F.size(F.filter(F.array(*[F.lit(k.lower()) for k in keywords]), lambda k: F.contains(text, k))) > 0)
    out = out.withColumn("url_hash", F.md5("link"))
    if registry is not None:
        out = out.join(registry.select("url_hash").distinct(), "url_hash", "left_anti")
    return out.orderBy(F.desc_nulls_last("published_at"), "link").limit(most) if most else out


def links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """Distinct links of pages: href and whether it names a PDF."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']([^"'#>]+)["']"""), F.lit(1))
    return pages.select(key, F.explode(F.array_distinct(found)).alias("href")).withColumn("is_pdf", F.lower("href").endswith(".pdf"))


def register(registry: DataFrame, batch: DataFrame) -> DataFrame:
    """The registry with the batch's urls: the first time that each was seen."""
    return registry.select("url_hash", "seen_at").unionByName(batch.select("url_hash", "seen_at")).groupBy("url_hash").agg(F.min("seen_at").alias("seen_at"))


def mixed_batch(spark: SparkSession, sources: list[tuple[str, str]]) -> DataFrame:
    """Files of several kinds as one table of texts, in the order given: place, kind, path, text. sources: (kind, path), kind json or text."""
    from functools import reduce

    parts = []
    for place, (kind, path) in enumerate(sources):
        rows = json_articles(spark, path).select(F.lit(path).alias("path"), "text") if kind == "json" else text_files(spark, path).select("path", "text")
        parts.append(rows.select(F.lit(place).alias("place"), F.lit(kind).alias("kind"), "path", "text"))
    return reduce(DataFrame.unionByName, parts)


def listing_rows(pages: DataFrame, years: tuple[int, int] | None = None, html: str = "html", key: str = "page_id") -> DataFrame:
    """Anchors of listing pages: key, url, title (tags out), year (the last in title or url) and out_of_range; each url of a page once."""
    anchor = r"""(?is)<a\b[^>]*?href\s*=\s*["']([^"'#>]+)["'][^>]*>(.*?)</a>"""
    found = F.arrays_zip(F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(1)).alias("url"), F.regexp_extract_all(F.col(html), F.lit(anchor), F.lit(2)).alias("inner"))
    rows = pages.select(key, F.posexplode(found).alias("n", "a")).select(key, "n", "a.url", F.trim(F.regexp_replace(F.regexp_replace("a.inner", r"<[^>]*>", " "), r"\s+", " ")).alias("title"))
    year = F.regexp_extract(F.concat_ws(" ", "url", "title"), r"^.*\b((?:19|20)\d{2})\b", 1).try_cast("int")
    firsts = rows.groupBy(key, "url").agg(F.min_by("title", "n").alias("title")).withColumn("year", year)
    low, high = years or (0, 9999)
    return firsts.withColumn("out_of_range", F.coalesce(~F.col("year").between(low, high), F.lit(False)))


def resolved_link(hrefs: Column, base: Column, preferred: tuple[str, ...] = ("annual", "report")) -> Column:
    """The first link to a PDF of an array, those that hold a preferred word before others, as a full url; null without."""
    pdfs = F.filter(hrefs, lambda h: F.lower(h).rlike(r"\.pdf(?:[?#]|$)"))
    with_word = lambda w: F.filter(pdfs, lambda h: F.contains(F.lower(h), F.lit(w)))
    ranked = [F.get(with_word(w), F.lit(0)) for w in preferred]
    link = F.coalesce(*ranked, F.get(pdfs, F.lit(0)))
    host, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^?#]*/)", 1)
    return F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.lit("https:"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.coalesce(F.nullif(folder, F.lit("")), F.concat(host, F.lit("/"))), link))


def write_new_articles(articles: DataFrame, path: str, known: DataFrame) -> None:
    """Append articles as JSON whose url_hash is not among those known; the caller registers them after."""
    articles.withColumn("url_hash", F.md5("url")).dropDuplicates(["url_hash"]).join(known.select("url_hash").distinct(), "url_hash", "left_anti").write.mode("append").json(path)


def write_logs(events: DataFrame, path: str, kind: str = "log_type") -> None:
    """Append log rows, a folder for each kind."""
    events.write.mode("append").partitionBy(kind).parquet(path)
