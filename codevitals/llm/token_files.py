"""Token ids in files: canonical length-limited Huffman codes with bit-offset checkpoints.

A file set has two tables. ``codebook`` holds the code length of every id that occurs; the canonical
codes follow from the lengths. ``segments`` holds, in ascending order of doc_id, segments of about a
million ids: a small header, the documents' ids and token counts, the bit offset at which each
block of ``BLOCK`` ids begins, and the bits. Any block can be decoded alone from its checkpoint; a reader
decodes all blocks of a segment at once, one table look-up per id.

Rows with a null doc_id come first and keep it; a null text is an empty text (only the end id is
written); repeated doc_ids are all written, ordered by their ids' checksum. Columns other than
doc_id and text are not looked at. An empty table gives an empty file set.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codevitals.llm.common import encoder, tokenizer_path
from codevitals.session import scratch_dir, stored

MAGIC = b"HUF1"
BLOCK = 1024
SEGMENT_IDS = 1 << 20
LIMIT = 16
_HEAD = "<4sIQIQ"  # magic, documents, ids, blocks, 32-bit words


def code_lengths(weights: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits for positive ``weights`` (package-merge)."""
    n = len(weights)
    if n <= 1:
        return np.ones(n, dtype=np.uint8)
    if limit > 16:
        raise ValueError("codes have 16 bits at most")
    if n > 1 << limit:
        raise ValueError(f"{n} ids don't fit into codes of {limit} bits")
    order = np.argsort(weights, kind="stable")
    leaves = weights[order].astype(np.float64)
    level, is_leaf = leaves, [np.ones(n, dtype=bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([leaves, pairs])
        at = np.argsort(both, kind="stable")
        level = both[at]
        is_leaf.append(at < n)
    lengths, take = np.zeros(n, dtype=np.uint8), 2 * n - 2
    for kind in reversed(is_leaf):
        used = int(kind[:take].sum())
        lengths[order[:used]] += 1
        take = 2 * (take - used)
    return lengths


class Code:
    """Canonical code of the ids ``symbols`` with the given lengths."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, limit: int = LIMIT):
        at = np.lexsort((symbols, lengths))
        symbols, lengths = symbols[at].astype(np.int64), lengths[at].astype(np.int64)
        self.limit = limit
        span = np.int64(1) << (limit - lengths)  # table entries of a code
        first = np.cumsum(span) - span
        size = int(symbols.max()) + 1 if len(symbols) else 0
        # Code (high bits) and length of each symbol.
        self.codes = np.zeros(size, dtype=np.int64)
        self.codes[symbols] = first >> (limit - lengths) << 8 | lengths
        # Length (high bits) and symbol of the code that any ``limit`` bits begin with.
        self.table = np.full(1 << limit, 1 << 24, dtype=np.int32)
        self.table[: int(span.sum())] = np.repeat((lengths << 24 | symbols).astype(np.int32), span)

    def encode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bit offset of each block, and the bits as 32-bit words (with two spare words)."""
        found = self.codes[ids]
        if len(found) % 2:
            found = np.append(found, 0)
        # Two codes at a time: 32 bits at most, wherever they begin in a word.
        length, code = (x.reshape(-1, 2) for x in (found & 255, found >> 8))
        code = (code[:, 0] << length[:, 1] | code[:, 1]).astype(np.uint64)
        length = length.sum(axis=1)
        end = np.cumsum(length)
        begin = end - length
        total = int(end[-1]) if len(end) else 0
        window = code << (64 - (begin & 31) - length).astype(np.uint64)
        word, n_words = begin >> 5, total // 32 + 3
        # Codes don't overlap, so the sums stay under 2^32 and are exact in doubles.
        bits = np.bincount(word, weights=(window >> np.uint64(32)).astype(np.float64), minlength=n_words)
        bits += np.bincount(word + 1, weights=(window & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=n_words)
        return begin[:: BLOCK // 2].astype("<u8"), bits.astype("<u4")

    def decode(self, offsets: np.ndarray, words: np.ndarray, n_ids: int) -> np.ndarray:
        """The ids of the blocks that begin at ``offsets``, ``n_ids`` in all."""
        at, last = offsets.astype(np.int64), len(words) - 2
        wide = words.astype(np.uint64)
        wide = (wide[:-1] << np.uint64(32)) | wide[1:]
        out = np.empty((min(BLOCK, n_ids), len(at)), dtype=np.int32)
        mask, shift = np.uint64((1 << self.limit) - 1), 64 - self.limit
        for step in range(len(out)):
            window = wide[np.minimum(at >> 5, last)] >> (shift - (at & 31)).astype(np.uint64)
            found = self.table[(window & mask).astype(np.int64)]
            out[step] = found
            at += found >> 24
        out &= (1 << 24) - 1
        if len(at) <= 1:
            return out.T.reshape(-1)[:n_ids]
        full = out[:, :-1].T.reshape(-1)
        return np.concatenate([full, out[: n_ids - len(full), -1]])


def pack_segment(code: Code, docs: list[tuple[int | None, np.ndarray]]) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    offsets, words = code.encode(ids)
    head = struct.pack(_HEAD, MAGIC, len(docs), len(ids), len(offsets), len(words))
    null = np.packbits(np.array([k is None for k, _ in docs], dtype=bool))
    keys = np.array([k or 0 for k, _ in docs], dtype="<i8")
    counts = np.array([len(x) for _, x in docs], dtype="<u4")
    return b"".join([head, null.tobytes(), keys.tobytes(), counts.tobytes(), offsets.tobytes(), words.tobytes()])


def unpack_segment(code: Code, blob: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc_ids, token counts, and all ids one after the other."""
    magic, n_docs, n_ids, n_blocks, n_words = struct.unpack_from(_HEAD, blob)
    if magic != MAGIC:
        raise ValueError("not a token segment")
    at = struct.calcsize(_HEAD)

    def read(kind: str, n: int) -> np.ndarray:
        nonlocal at
        x = np.frombuffer(blob, dtype=kind, count=n, offset=at)
        at += x.nbytes
        return x

    null = np.unpackbits(read("u1", (n_docs + 7) // 8), count=n_docs).astype(bool)
    keys, counts = read("<i8", n_docs), read("<u4", n_docs)
    ids = code.decode(read("<u8", n_blocks), read("<u4", n_words), n_ids)
    return [None if z else int(k) for k, z in zip(keys, null, strict=True)], counts, ids


def encode_ids(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, ids (16-bit little-endian, with the end id), counts.

    After a task's documents comes one row that holds ``counts`` alone: how often each id of the vocabulary occurs among them.
    """
    from tokenizers import Tokenizer

    size = max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    if size > 1 << 16:
        raise ValueError("vocabularies over 65,536 ids aren't supported")
    names = ["doc_id", "ids", "counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, total = encoder(path, "H"), np.zeros(size, dtype="<i8")
        end = end_id.to_bytes(2, "little")
        for batch in batches:
            out = [enc.encode(text or "") + end for text in batch.column(1).to_pylist()]
            for begin in range(0, len(out), 200):
                total += np.bincount(np.frombuffer(b"".join(out[begin: begin + 200]), dtype="<u2"), minlength=size)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.binary()), pa.nulls(len(out), pa.binary())], names)
        if total.any():
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()])], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids binary, counts binary")


def count_ids(encoded: DataFrame) -> DataFrame:
    """id, n: how often each id occurs in all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total = total + np.frombuffer(x.as_buffer(), dtype="<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counts = encoded.where(F.col("counts").isNotNull()).select("counts")
    return counts.mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2) -> None:
    """Write ``folder/codebook`` and ``folder/segments``."""
    spark = docs.sparkSession
    encoded = stored(encode_ids(docs, path or tokenizer_path(), end_id), "token-ids")
    counts = count_ids(encoded).orderBy("id").toPandas()  # at most one row for each id of the vocabulary
    symbols = counts["id"].to_numpy(np.int64)
    lengths = code_lengths(counts["n"].to_numpy(np.float64))
    book = [(int(a), int(b)) for a, b in zip(symbols, lengths, strict=True)]
    spark.createDataFrame(book, "id int, bits int").coalesce(1).write.parquet(f"{folder}/codebook")
    shared = spark.sparkContext.broadcast((symbols, lengths))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, docs, size, seg, start = Code(*shared.value), [], 0, 0, 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist(
                [{"seg": seg, "start": start, "n_ids": size, "data": pack_segment(code, docs)}], schema=schema)

        for batch in batches:
            for k, x in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                docs.append((k, np.frombuffer(x.as_buffer(), dtype="<u2")))
                size += len(docs[-1][1])
                if size >= SEGMENT_IDS:
                    yield flush()
                    seg, start, docs, size = seg + 1, start + size, [], 0
        if docs:
            yield flush()

    schema = pa.schema([("seg", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
    ranged = encoded.where(F.col("ids").isNotNull()).select("doc_id", "ids").repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.crc32("ids"))
    segments = ranged.mapInArrow(run, "seg int, start long, n_ids long, data binary")
    segments.select(F.spark_partition_id().alias("part"), "*").write.option("compression", "none").parquet(f"{folder}/segments")


def read_token_files(spark: SparkSession, folder: str, digests: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), ids (32-bit little-endian, with the end id).

    With ``digests``: doc_id, start, n_tokens, ids_crc32 (of those bytes) instead.
    """
    book = spark.read.schema("id int, bits int").parquet(f"{folder}/codebook").toPandas()
    shared = spark.sparkContext.broadcast((book["id"].to_numpy(np.int64), book["bits"].to_numpy(np.int64)))
    segments = spark.read.schema("part int, seg int, start long, n_ids long, data binary").parquet(f"{folder}/segments")
    # One row for each file that was written.
    parts = segments.groupBy("part").agg(F.sum("n_ids").alias("n_ids")).collect()
    before, at = {}, 0
    for row in sorted(parts):
        before[row.part], at = at, at + row.n_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value)
        for batch in batches:
            for part, start, blob in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                keys, counts, ids = unpack_segment(code, blob)
                ends = np.cumsum(counts, dtype=np.int64)
                raw = memoryview(ids.astype("<u4")).cast("B")
                pieces = [raw[4 * (e - n): 4 * e] for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                columns = [pa.array(keys, pa.int64()), pa.array(before[part] + start + ends - counts)]
                if digests:
                    columns += [pa.array(counts, pa.int64()), pa.array([zlib.crc32(p) for p in pieces], pa.int64())]
                else:
                    columns.append(pa.array([bytes(p) for p in pieces], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in schema.split(", ")])

    schema = f"doc_id long, start long, {'n_tokens long, ids_crc32 long' if digests else 'ids binary'}"
    return segments.select("part", "start", "data").mapInArrow(run, schema)


def token_file_digests(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write the texts' ids, read them back, and digest what was read."""
    spark = docs.sparkSession
    folder = folder or f"{scratch_dir(spark)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, folder)
    return read_token_files(spark, folder, digests=True)
