"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's ``docs``. All stages but the last return the columns of ``docs``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevitals.llm import near_dedup, quality, secret_scan
from codevitals.llm.common import table
from codevitals.llm.mixing import mix, n_words, with_pattern
from codevitals.llm.packing import pack
from codevitals.session import stored

#: SQL can express neither the trained models nor the seeded choice; tests compare the stages' operators with brute force.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality rules reject; the trees learn from the labels of the documents at hand."""
    return quality.keep_good(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def first_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest doc_id of each near-duplicate group."""
    return near_dedup.keep_first(docs)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace secrets in the texts; every document stays."""
    return secret_scan.redact(docs, secret_scan.train(docs))


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that the sources' words come near their targets."""
    rows = docs.select("doc_id", n_words(F.col("text")).alias("size"), "source", F.struct("*").alias("row"))
    rows = with_pattern(rows, F.array("source"))
    choice = mix(stored(rows.drop("row", "source"), "sizes"))[0]
    used = choice.times(rows).where("times > 0")
    copies = used.select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy"))
    return copies.select("row.*")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences."""
    return pack(docs)


STAGES = [
    ("quality rules", good_quality), ("near duplicates", first_of_near_copies), ("secrets", without_secrets),
    ("mixing", mixed_sources), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are a table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
