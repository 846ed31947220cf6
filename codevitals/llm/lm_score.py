"""Log-likelihoods of whole documents under a gated recurrent language model, and under smoothed word counts.

Words are counted over all training documents (held in a table by 64-bit hash). The most frequent words, at most ``HEAD`` of them, go to
every worker; the counts of all other words are joined, so both scores are exact sums over all tokens. The network knows the ``VOCABULARY`` most frequent
words; another word costs the network's probability of an unknown word times the word's smoothed share of the unknown words' counts.

Texts are read and split once, into a table of token numbers. The network learns from every training document once. In each round, replicas learn from different documents and their
weights are averaged; the rounds grow with the logarithm of the documents, the replicas of a round with the rest.

A null text is empty: its end is its only token. A null doc_id is not held out and keeps its row; repeated rows are
counted and scored each. Other columns are not looked at. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codevitals.llm import recurrent
from codevitals.llm.byte_words import word_lists
from codevitals.llm.common import LOWER
from codevitals.session import stored

VOCABULARY = 2046
HEAD = 200_000
#: Rounds of a small table; one more each time that the training documents double.
ROUNDS = 3
#: Documents that a replica learns from in a round, about.
REPLICA_DOCS = 1500
_END_KEY = 0


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def _keys(words: list[bytes]) -> np.ndarray:
    """Signed 64-bit hashes of words; the end, written as an empty word, has the key 0."""
    keys = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)).view(np.int64)
    empty = np.fromiter(map(len, words), np.int64, len(words)) == 0
    return np.where(empty, _END_KEY, np.where(keys == _END_KEY, 1, keys))


def tokens(docs: DataFrame) -> DataFrame:
    """The tokens of the documents, read and split once: a row for each batch of documents.

    ids, taught (whether it is a training document), mark (a hash that deals it to a round), lengths, keys (distinct tokens, 64 bits
    each), codes (the tokens of all these documents as places in ``keys``, 16 bits each where that is enough, else 32).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, code, lengths = _tokens(batch.column(3).cast(pa.binary()).to_pylist())
            codes = code.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32).tobytes()
            lists = [pa.ListArray.from_arrays(pa.array([0, len(batch)], pa.int32()), c) for c in (*batch.columns[:3], pa.array(lengths))]
            yield pa.RecordBatch.from_arrays([*lists, pa.array([_keys(words).tobytes()]), pa.array([codes])],
                                             ["ids", "taught", "mark", "lengths", "keys", "codes"])

    mark = F.xxhash64(F.lit("lm"), "doc_id", F.length("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (~held_out(F.col("doc_id"))).alias("taught"), mark.alias("mark"), "text")
    return rows.mapInArrow(run, "ids array<long>, taught array<boolean>, mark array<long>, lengths array<long>, keys binary, codes binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """ids, taught, mark, lengths, keys, codes of each row of ``tokens``."""
    for i in range(len(batch)):
        ids, taught, mark, lengths = (batch.column(k)[i].values for k in range(4))
        keys = np.frombuffer(batch.column(4)[i].as_buffer(), np.int64)
        codes = np.frombuffer(batch.column(5)[i].as_buffer(), np.uint16 if len(keys) <= 1 << 16 else np.uint32)
        yield ids, taught.to_numpy(zero_copy_only=False), mark.to_numpy(), lengths.to_numpy(), keys, codes


def count_words(said: DataFrame) -> DataFrame:
    """key, c: the tokens of the training documents of ``tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def rows() -> pa.RecordBatch:
            keys, at = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            c = np.bincount(at, weights=np.concatenate([c for _, c in held])).astype(np.int64)  # far below 2^53
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c)], ["key", "c"])

        for batch in batches:
            for _, taught, _, lengths, keys, codes in _unpacked(batch):
                c = np.bincount(codes[np.repeat(taught, lengths)], minlength=len(keys))
                held.append((keys[c > 0], c[c > 0]))
                if sum(len(k) for k, _ in held) > 2_000_000:
                    yield rows()
                    held = []
        if held:
            yield rows()

    return said.mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


class Head:
    """The frequent tokens' counts by sorted key, and their numbers in the network's vocabulary."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        at = np.argsort(keys)
        self.keys, self.counts = keys[at], counts[at]
        rank = np.lexsort((self.keys, -self.counts))
        rank = rank[self.keys[rank] != _END_KEY][:VOCABULARY]
        self.symbol = np.full(len(keys) + 1, recurrent.UNKNOWN, dtype=np.int16)
        self.symbol[rank] = np.arange(2, 2 + len(rank))
        self.symbol[np.flatnonzero(self.keys == _END_KEY)] = recurrent.END
        self.vocabulary = self.counts[rank]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys; the place after the last for others."""
        at = np.searchsorted(self.keys, keys)
        if not len(self.keys):
            return at
        hit = self.keys[np.minimum(at, len(self.keys) - 1)] == keys
        return np.where(hit, at, len(self.keys))


def _tokens(texts: list[bytes | None]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct tokens, the tokens of all texts as places among them, tokens of each text (UTF-8)."""
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    codes, lengths = [], []
    for text in texts:
        lengths.append(1)
        for words in word_lists((text or b"").translate(LOWER)):
            codes.append(np.fromiter(map(index.__getitem__, words), np.int32, len(words)))
            lengths[-1] += len(words)
        codes.append(np.array([index[b""]], np.int32))
    return list(index), np.concatenate(codes) if codes else np.zeros(0, np.int32), np.array(lengths, dtype=np.int64)


def lessons(said: DataFrame, head: Head, rounds: int) -> DataFrame:
    """part (the round, from 0), symbols (16 bits each): every training document of ``tokens`` once, those of a row and round together."""
    shared = said.sparkSession.sparkContext.broadcast(head)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = shared.value
        for batch in batches:
            for _, taught, mark, lengths, keys, codes in _unpacked(batch):
                symbols, part = head.symbol[head.find(keys)][codes], np.where(taught, mark % rounds, -1)
                of = np.repeat(part, lengths)
                parts = np.unique(part[part >= 0])
                yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), pa.array([symbols[of == p].tobytes() for p in parts], pa.binary())],
                                                 ["part", "symbols"])

    return said.mapInArrow(run, "part long, symbols binary")


def train(said: DataFrame, head: Head, counts: np.ndarray, n_docs: int) -> tuple[recurrent.Weights, int]:
    """The network, and the tokens that it has learned from: those of all training documents."""
    spark = said.sparkSession
    weights, taught = recurrent.initial(counts), 0
    rounds = ROUNDS + int(np.log2(max(1, n_docs / REPLICA_DOCS)))
    replicas = max(1, round(n_docs / rounds / REPLICA_DOCS))
    every = stored(lessons(said, head, rounds), "lm-lessons", partition_by=["part"])  # a round reads its own part alone
    for r in range(rounds):
        shared = spark.sparkContext.broadcast(weights.pack())

        def learn(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            symbols = [np.frombuffer(x.as_buffer(), np.int16) for batch in batches for x in batch.column(0)]
            if symbols:
                stream = np.concatenate(symbols)
                out = recurrent.train(recurrent.initial(counts).unpack(shared.value), stream)
                part = TaskContext.get().partitionId()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part % 16]), pa.array([part]), pa.array([len(stream)]), pa.array([out.pack()])], ["g", "part", "n", "data"])

        def average(rows: pa.Table) -> pa.Table:
            rows = rows.sort_by("part")  # sums of one order, whatever order the shuffle brings
            n = np.array(rows.column("n").to_pylist(), dtype=np.float64)
            mean = sum(k / n.sum() * np.frombuffer(x.as_buffer(), "<f4") for k, x in zip(n, rows.column("data"), strict=True))
            return pa.table({"g": rows.column("g")[:1], "n": pa.array([int(n.sum())]), "data": pa.array([mean.astype("<f4").tobytes()])})

        learned = every.where(F.col("part") == r).select("symbols").coalesce(replicas).mapInArrow(learn, "g long, part long, n long, data binary")
        means = learned.groupBy("g").applyInArrow(average, "g long, n long, data binary").collect()  # 16 rows at most
        if means:
            total = sum(m.n for m in means)
            taught += total
            mean = sum(m.n / total * np.frombuffer(m.data, "<f4").astype(np.float64) for m in sorted(means))
            weights = weights.unpack(mean.astype("<f4").tobytes())
    return weights, taught


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    said = stored(tokens(docs), "lm-tokens")
    counts = stored(count_words(said), "word-counts")
    total = counts.agg(F.sum("c"), F.count("*")).first()
    n_all, v_all = total[0] or 0, total[1]
    # The least count of the head: the smallest that no more than HEAD words reach.
    sizes = counts.groupBy("c").agg(F.count("*").alias("k"))
    sizes = sizes.groupBy(F.least("c", F.lit(1 << 20)).alias("c")).agg(F.sum("k").alias("k")).orderBy(F.desc("c")).limit(1 << 20).collect()
    least, words = 1 << 20, 0
    for s in sizes:
        if words + s.k > HEAD:
            break
        least, words = s.c, words + s.k
    frequent = (F.col("c") >= least) | (F.col("key") == _END_KEY)
    found = counts.where(frequent).toPandas()
    head = Head(found["key"].to_numpy(np.int64), found["c"].to_numpy(np.int64))
    n_end = int(head.counts[head.keys == _END_KEY].sum())
    n_unknown = n_all - n_end - int(head.vocabulary.sum())
    v_unknown = v_all - min(1, n_end) - len(head.vocabulary)
    weights, _ = train(said, head, np.concatenate([[n_end, n_unknown], head.vocabulary]), n_end)
    shared = spark.sparkContext.broadcast((head, weights))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, weights = shared.value
        log_c = np.log10(np.append(head.counts, 0) + 0.1)
        unknown = head.symbol == recurrent.UNKNOWN
        base = np.int64(TaskContext.get().partitionId()) << 40
        ids, outs, symbols, sizes, tails, n_rows = [], [], [], [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            lengths = np.concatenate(sizes)
            log_p = recurrent.score(weights, np.concatenate(symbols), lengths) / np.log(10)
            rows = base + n_rows + np.arange(len(lengths))
            columns = [np.concatenate([o[i] for o in outs]) for i in range(4)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows), pa.concat_arrays(ids), pa.array(lengths), *(pa.array(c) for c in columns), pa.array(log_p),
                 pa.concat_arrays(tails)],
                ["row", "doc_id", "n_tokens", "n_head", "head_sum", "n_unknown", "unknown_sum", "log_p", "tail"])

        for batch in batches:
            for doc_ids, _, _, lengths, keys, codes in _unpacked(batch):
                at = head.find(keys)[codes]
                doc = np.repeat(np.arange(len(lengths)), lengths)
                in_head = at < len(head.keys)
                known_rare = in_head & unknown[at]
                sums = [np.bincount(doc, weights=m * v, minlength=len(lengths)) for m, v in (
                    (in_head, 1.0), (in_head, log_c[at]), (~in_head | known_rare, 1.0), (known_rare, log_c[at]))]
                outs.append([sums[0].astype(np.int64), sums[1], sums[2].astype(np.int64), sums[3]])
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[~in_head], minlength=len(lengths)))])
                tails.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(keys[codes[~in_head]])))
                ids.append(doc_ids)
                symbols.append(head.symbol[at])
                sizes.append(lengths)
                if sum(len(s) for s in symbols) >= 4_000_000:
                    yield from flush()
                    n_rows += sum(len(s) for s in sizes)
                    ids, outs, symbols, sizes, tails = [], [], [], [], []
        if ids:
            yield from flush()

    schema = ("row long, doc_id long, n_tokens long, n_head long, head_sum double, n_unknown long, unknown_sum double, "
              "log_p double, tail array<long>")
    scored = stored(said.mapInArrow(run, schema), "lm-scores")
    rare = counts.where(~frequent)
    tail = scored.select("row", F.explode("tail").alias("key")).groupBy("row", "key").agg(F.count("*").alias("n"))
    c = F.coalesce("c", F.lit(0))
    tail = (tail.join(rare, "key", "left").groupBy("row")
            .agg(F.sum(F.col("n") * F.log10(c + 0.1)).alias("tail_sum"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_tail")))
    out = scored.drop("tail").join(tail, "row", "left").na.fill({"tail_sum": 0.0, "n_tail": 0})
    all_norm, unknown_norm = (float(np.log10(n + 0.1 * (v + 1))) for n, v in ((n_all, v_all), (n_unknown, v_unknown)))
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "n_tokens", (F.col("n_head") + F.col("n_tail")).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"),
        (F.col("head_sum") + F.col("tail_sum") - F.col("n_tokens") * all_norm).alias("base_score"),
        (F.col("log_p") + F.col("unknown_sum") + F.col("tail_sum") - F.col("n_unknown") * unknown_norm).alias("score"))
