"""The corpus pipeline: documents in, packed token sequences out, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the docs of the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import ngram_join, packing, pii, quality, toxicity
from siltstone.llm.shared import named, stage
from siltstone.session import ship
from siltstone.sources.tables import table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that op 5 does not call toxic, by a model learned from the labels that are not held out.

    Null and empty texts score as texts without evidence; without labels of both classes all stay; repeated
    rows share their fate; columns of any names pass through; an empty table stays empty.
    """
    ship(spark)
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.learn(docs, labels)
    return toxicity.ordinary(docs, model)


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep.

    Null, empty and short texts (under 50 words) go by the base rule; documents of a language with too little text for a
    reference are held to the base rule alone; repeated rows share their fate; columns of any names pass through; an
    empty table stays empty.
    """
    ship(spark)
    return quality.passing(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates.

    Null and empty texts are linked with nothing and stay; of rows with the same id and text one stays; rows without an
    id stay; texts of any length are compared whole; columns of any names pass through; an empty table stays empty.
    """
    ship(spark)
    return ngram_join.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in their texts replaced by its kind in brackets, and n_chars to match.

    Null texts stay null; empty texts, repeated rows and very long texts are rows like others; columns of any names pass
    through; an empty table stays empty.
    """
    ship(spark)
    masked = pii.mask(docs, pii.learn(docs))
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*map(named, docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token ids, each with its place in a sequence of at most 2048.

    Null and empty texts are their end id alone; repeated rows are packed as often as they come; a text longer than a
    sequence is cut into whole ones and a rest; other columns end here; an empty table gives an empty result.
    """
    ship(spark)
    special = packing.special_tokens(packing.vocabulary_path("byte_bpe_50k.json"))
    pieces = packing.tokenize(docs, packing.vocabulary_path("byte_bpe_50k.tiktoken"), size=2048, end_id=1, special=special)
    return packing.assign(pieces, size=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", mask_personal_data),
    ("packing", pack),
]

#: Learned models and token ids are beyond SQL. The tests hold the join, the masking and the packing against plain Python, the first
#: two stages against the verdicts of their operators on the same documents.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over the documents table."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, apply) in enumerate(STAGES):
        docs = stage(apply(spark, docs, sf_dir), f"pipeline-{i}")
    return docs
