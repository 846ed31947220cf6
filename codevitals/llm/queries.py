"""The operators' queries over the given tables; their SQL, where SQL can express them, is in ``oracle``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevitals.llm import language, lm_score, near_dedup, prefix_trie, quality, reversed_search, secret_scan, substring_dedup, vector_links, warc
from codevitals.llm.common import table
from codevitals.llm.mixing import mix, n_words, with_pattern
from codevitals.llm.oracle import ORACLE
from codevitals.llm.packing import pack
from codevitals.llm.token_files import token_file_digests
from codevitals.session import stored

Query = Callable[[SparkSession, str], DataFrame]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language.predict(docs, language.learn(docs))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", n_words(F.col("text")).alias("size"), "source")
    docs = stored(with_pattern(docs, F.array("source")), "sizes")
    choice, sizes, targets = mix(docs)
    rows = [(s, n, targets[s]) for s, n in sizes.items()]  # a row for each source
    sources = F.broadcast(spark.createDataFrame(rows, "name string, source_size long, target double"))
    return (choice.times(docs).join(sources, F.col("source").eqNullSafe(F.col("name")))
            .select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("times")).alias("taken")))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_file_digests(table(spark, sf_dir, "documents"))


def op5_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.links(table(spark, sf_dir, "embeddings"))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.verdicts(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.derivatives(warc.responses(table(spark, sf_dir, "pages")))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.groups(table(spark, sf_dir, "documents"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan.scan(docs, secret_scan.train(docs))


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substring_dedup.without_repeats(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reversed_search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    op1_packing, op2_language, op3_mixing, op4_token_files, op5_vector_links, op6_lm_score, op7_quality,
    op8_warc, op9_near_dedup, op10_secrets, op11_substring_dedup, op12_reversed_search, op13_prefix_trie)}
