"""Ranked search turned round: items are indexed, documents stream past.

The items' terms and their postings (item, times the term occurs there) are the index, which is broadcast. A first pass over the documents
counts their terms and keeps, for each document, the counts of terms that the index knows; corpus statistics are sums of these. A second
pass streams the kept counts through the index and updates a heap of the best ``k`` documents for each item, in each task; heaps are
merged in two rounds, so that no task meets those of all others.

The index is cut into parts of about ``PART`` postings by items, each with its own second pass, so what is broadcast doesn't grow with the items; terms of one item
are never split, so the longest item's terms are the other bound.

A null text has no term. Rows of one item_id are one item with all their terms (null is an item_id as well). Every row of documents counts and
can be found; rows without a doc_id come last among equal scores. Other columns are ignored. Without documents or items there are no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codevitals.llm.byte_words import word_lists
from codevitals.session import stored

TOP = 20
#: Postings of an index part.
PART = 1 << 20
#: Scores that are computed at a time: documents times items.
CELLS = 1 << 22
#: Tasks' heaps meet in so many groups before they meet for an item.
MERGERS = 256
#: A term: digits, ASCII letters and whatever isn't ASCII, as long as possible.
TERM = "[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"
# Bytes of UTF-8: A-Z become small, what can't stand in a term becomes white space.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_NO_ID = 1 << 63  # greater than any doc_id


def terms(text: Column) -> Column:
    """The terms of a text as a column."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.regexp_extract_all(F.translate(text, upper, lower), F.lit(f"({TERM})"))


def postings(items: DataFrame) -> DataFrame:
    """item_id, term, times."""
    found = items.select(F.col("item_id").cast("long").alias("item_id"), F.explode(terms(F.col("text"))).alias("term"))
    return found.groupBy("item_id", "term").agg(F.count("*").alias("times"))


def term_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """doc_id, n (terms of the document), codes and tfs (known terms and how often they occur) of documents with a term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    width = len(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for batch in batches:
            n, keys = np.zeros(len(batch), np.int64), [np.zeros(0, np.int64)]
            for row, text in enumerate(batch.column(1).cast(pa.binary())):
                for found in word_lists((text.as_py() or b"").translate(_FOLD)):
                    code = np.fromiter(map(get, found, repeat(-1)), np.int64, len(found))
                    keys.append(code[code >= 0] + row * width)
                    n[row] += len(found)
            key, tf = np.unique(np.concatenate(keys), return_counts=True)
            some = np.flatnonzero(n)
            begin = np.searchsorted(key, np.append(some, len(batch)) * width)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(some)), pa.array(n[some]),
                 pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array((key % max(width, 1)).astype(np.int32))),
                 pa.ListArray.from_arrays(pa.array(begin, pa.int32()), pa.array(tf.astype(np.int64)))], ["doc_id", "n", "codes", "tfs"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, codes array<int>, tfs array<long>")


def holders(counts: DataFrame) -> DataFrame:
    """code, df: in how many documents a term occurs; tasks sum before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[int] = Counter()
        for batch in batches:
            code, df = np.unique(batch.column(0).flatten().to_numpy(), return_counts=True)
            total.update(dict(zip(code.tolist(), df.tolist(), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["code", "df"])

    return counts.select("codes").mapInArrow(run, "code int, df long").groupBy("code").agg(F.sum("df").alias("df"))


class Index:
    """Postings of each term in one array: items (numbered), and weight times occurrences."""

    def __init__(self, rows: list[tuple[int | None, int, int]], weight: dict[int, int], width: int):
        """``rows``: item_id, code of the term, times."""
        self.items = sorted({r[0] for r in rows}, key=lambda x: (x is not None, x))
        number = {x: i for i, x in enumerate(self.items)}
        rows = sorted((r for r in rows if r[1] in weight), key=lambda r: r[1])  # terms of no document score nothing
        code = np.array([r[1] for r in rows], np.int64)
        self.begin = np.searchsorted(code, np.arange(width + 1))
        self.item = np.array([number[r[0]] for r in rows], np.int64)
        self.value = np.array([weight[r[1]] * r[2] for r in rows], np.int64)


def scores(index: Index, n: np.ndarray, offsets: np.ndarray, codes: np.ndarray, tfs: np.ndarray, n_docs: int, length: int) -> np.ndarray:
    """Scores of documents (rows) for items (columns); ``offsets`` tells where a document's codes begin."""
    size = np.diff(offsets)
    # 25 * n * N may pass 64 bits in huge corpora, so it is computed once a document, in Python's integers.
    m = np.array([75 + 25 * x * n_docs // length for x in n.tolist()], np.int64)
    part = 1_000_000_000 * tfs // (1000 * tfs + 12 * np.repeat(m, size))
    row = np.repeat(np.arange(len(n)), size)
    out = np.zeros((len(n), len(index.items)), np.int64)
    order = np.argsort(codes, kind="stable")
    row, part = row[order], part[order]
    known, begin = np.unique(codes[order], return_index=True)
    for code, b, e in zip(known.tolist(), begin.tolist(), np.append(begin, len(codes))[1:].tolist(), strict=True):
        low, high = index.begin[code], index.begin[code + 1]
        if low < high:  # a term is once in a document and once in an item's postings, so no cell is met twice
            out[row[b:e, None], index.item[low:high]] += part[b:e, None] * index.value[low:high]
    return out


def update(heaps: list[list[tuple[int, int]]], ids: list[int], found: np.ndarray, k: int) -> None:
    """Push what can enter the heaps: (score, -doc_id), the worst first."""
    least = np.array([h[0][0] if len(h) == k else 1 for h in heaps], np.int64)
    if len(found) > k:  # of these documents, the k best of an item and their equals are enough
        least = np.maximum(least, np.partition(found, len(found) - k, axis=0)[len(found) - k])
    for item, row in zip(*(x.tolist() for x in np.nonzero((found >= least).T)), strict=True):
        entry = (int(found[row, item]), -ids[row])
        if len(heaps[item]) < k:
            heapq.heappush(heaps[item], entry)
        elif entry > heaps[item][0]:
            heapq.heapreplace(heaps[item], entry)


def best(counts: DataFrame, index: Index, n_docs: int, length: int, k: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest positive scores of each item of ``index``."""
    shared = counts.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps: list[list[tuple[int, int]]] = [[] for _ in index.items]
        step = max(1, CELLS // max(1, len(heaps)))
        for whole in batches:
            for begin in range(0, len(whole), step):
                batch = whole.slice(begin, step)
                lists = batch.column(2)
                found = scores(index, batch.column(1).to_numpy(), lists.offsets.to_numpy() - lists.offsets[0].as_py(), lists.flatten().to_numpy(),
                               batch.column(3).flatten().to_numpy(), n_docs, length)
                update(heaps, [_NO_ID if x is None else x for x in batch.column(0).to_pylist()], found, k)
        rows = [(x, None if d == -_NO_ID else -d, s) for x, h in zip(index.items, heaps, strict=True) for s, d in h]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["item_id", "doc_id", "score"])

    heaps = counts.mapInArrow(run, "item_id long, doc_id long, score long").withColumn("part", F.spark_partition_id() % MERGERS)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    for keys in (["item_id", "part"], ["item_id"]):
        heaps = heaps.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return heaps.select("item_id", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, part: int = PART) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    lists = stored(postings(items), "postings")
    n_parts = lists.count() // part + 1
    lists = lists.withColumn("part", F.pmod(F.xxhash64("item_id"), F.lit(n_parts)))
    out = None
    for number in range(n_parts):
        rows = lists.where(F.col("part") == number).drop("part").collect()  # about PART rows
        vocabulary = {t: i for i, t in enumerate(sorted({r.term for r in rows}))}
        counts = stored(term_counts(docs, {t.encode(): i for t, i in vocabulary.items()}), "term-counts")
        total = counts.agg(F.count("*").alias("n"), F.sum("n").alias("length")).first()
        df = {r.code: r.df for r in holders(counts).collect()}  # one row a term of this part
        weight = {code: math.floor(1000 * math.log((2 * total.n + 2) / (2 * x + 1))) for code, x in df.items()}
        index = Index([(r.item_id, vocabulary[r.term], r.times) for r in rows], weight, len(vocabulary))
        found = stored(best(counts, index, total.n, total.length, k), "best")
        out = found if out is None else out.unionAll(found)
    return out if out is not None else spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
