"""Feeds and listings as streams: every item once, over as many runs as there are.

Files, or rows of stored pages, come by Spark's own file sources, so that a run's offsets lie in its checkpoint and any store that Spark reads will do. Each
micro-batch is joined against the urls of the batches before it, and what is new is written as a folder of its own, which a
batch that runs again replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))


def plain_text(markup: Column) -> Column:
    """Text of an XML element: sections of character data opened, tags out, entities read, white space single."""
    out = F.regexp_replace(markup, r"(?s)<!\[CDATA\[(.*?)\]\]>", "$1")
    out = F.regexp_replace(out, r"(?s)<[^>]*>", " ")
    for entity, sign in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(sign))
    return F.nullif(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def feed_items(feeds: DataFrame, content: str = "content", key: str = "path") -> DataFrame:
    """key, n, title, link, published (text), description and url_hash of the items of RSS and the entries of Atom feeds. Items without title or link go."""
    text = F.col(content).cast("string")
    items = F.regexp_extract_all(text, F.lit(r"(?is)<(?:item|entry)\b[^>]*>(.*?)</(?:item|entry)>"), F.lit(1))
    rows = feeds.select(key, F.posexplode(items).alias("n", "item"))
    inside = lambda names: plain_text(F.regexp_extract("item", rf"(?is)<(?:{names})\b[^>]*>(.*?)</(?:{names})>", 1))
    # Atom names its link in an attribute; of several, the one that is the page itself
    anchors = F.regexp_extract_all("item", F.lit(r"(?is)<link\b[^>]*>"), F.lit(0))
    own = F.filter(anchors, lambda a: ~a.rlike(r"""(?i)\brel\s*=\s*["'](?!alternate)"""))
    href = plain_text(F.regexp_extract(F.coalesce(F.get(own, F.lit(0)), F.lit("")), r"""(?is)\bhref\s*=\s*["']([^"']*)["']""", 1))
    found = rows.select(key, "n", inside("title").alias("title"), F.coalesce(inside("link"), href).alias("link"), inside("pubDate|published|updated").alias("published"), inside("description|summary|content").alias("description"))
    return found.filter("title IS NOT NULL AND link IS NOT NULL").withColumn("url_hash", F.md5(F.col("link").cast("binary")))


def feed_files(spark: SparkSession, folder: str, pattern: str = "*.xml", files_per_trigger: int = 1_000) -> DataFrame:
    """Feed files of a folder as they come."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_trigger).load(folder)


def table_stream(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """The parquet files of a table as they come; the table may be one file or a folder of them.

    A path of a single file has no base folder for a stream, but a pattern that only this path fits needs none.
    """
    return spark.readStream.schema(schema).parquet(f"{path[:-1]}[{path[-1]}]")


def listing_links(pages: DataFrame, html: str = "html", key: str = "page_id") -> DataFrame:
    """key, n, link and url_hash of every link of listing pages, in order; for streams and tables."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"""(?i)href\s*=\s*["']([^"'#>]+)["']"""), F.lit(1))
    return pages.select(key, F.posexplode(found).alias("n", "link")).withColumn("url_hash", F.md5(F.col("link").cast("binary")))


def each_once(items: DataFrame, out: str, order: list[str]) -> DataFrame:
    """Take in what is there now; all items so far, with the batch that brought each.

    ``items`` is a stream with url_hash; of equal urls in a batch the first by ``order`` counts, and a url of an earlier batch, or of an
    earlier run with the same ``out``, counts no more.
    """
    spark = items.sparkSession

    def put(rows: DataFrame, batch: int) -> None:
        first = rows.withColumn("nth", F.row_number().over(Window.partitionBy("url_hash").orderBy(*order))).filter("nth = 1").drop("nth")
        if batch:
            known = spark.read.schema("url_hash string, batch long").parquet(f"{out}/items/batch-*").filter(F.col("batch") < batch).select("url_hash")
            first = first.join(known, "url_hash", "left_anti")
        first.select(*rows.columns, F.lit(batch).cast("long").alias("batch")).write.mode("overwrite").parquet(f"{out}/items/batch-{batch}")

    items.writeStream.foreachBatch(put).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    schema = StructType([*items.schema.fields, StructField("batch", LongType())])
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{out}/items/none")  # a stream without files has no batch
    return spark.read.schema(schema).parquet(f"{out}/items/*")
