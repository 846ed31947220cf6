"""Passages that repeat word by word, removed from all texts but the first.

A window is ``width`` consecutive words of one document. Its Rabin-Karp hash (96 bits of two polynomials over hashes of the words, rolled as
differences of prefix sums) stands for its words. Windows of one hash are counted in a Spark group of hashes; all but the first by
(doc_id, start) are repeats, and a document's overlapping or touching repeats merge into maximal intervals, which are removed.

Every window is hashed and counted. What a task sends of a chunk of windows are arrays by group of hashes: a hash that occurs several times in the chunk
is sent once, with its first place, and its other places go straight to their documents' groups, so a hot passage costs a hash group one entry a chunk.
Groups of hashes and of documents grow in number with the input, so none grows in size. Texts are shuffled only if something is removed from them.

A text that is null has no words; texts shorter than a window keep all words. Rows equal in doc_id and text are one document (their windows
tie, and all get its result). Rows of one doc_id with different texts are one document whose texts follow each other in the order of
their hashes; no window spans two. Rows without a doc_id come after all others, in the order of their texts' hashes. Other columns are not passed
on. An empty table gives no rows.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.llm.byte_words import PIECE_BYTES, word_lists
from codevitals.session import stored

WIDTH = 20
#: Windows of a chunk; what a task holds at a time.
CHUNK = 1 << 20
#: Characters of text for each group of hashes (some three million windows).
GROUP_CHARS = 16_000_000
#: 64-bit words of the bit map of documents with repeats.
_MAP_WORDS = 1 << 20
_LAST = (1 << 63) - 1
_KINDS = (np.uint64, np.uint32, np.int64, np.int64, np.int32)  # of a window: hash, more hash, document, its text, start
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_powers: dict[tuple[int, int], np.ndarray] = {}

Windows = tuple[np.ndarray, ...]


def _power(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n and more, modulo 2 ** 64."""
    have = _powers.get((base, 0))
    if have is None or len(have) <= n:
        steps = np.full(max(n + 1, PIECE_BYTES // 4), base, dtype=np.uint64)
        steps[0] = 1
        have = _powers[base, 0] = np.cumprod(steps, dtype=np.uint64)
    return have


def rolled(values: np.ndarray, width: int, base: int) -> np.ndarray:
    """For each i, the polynomial of values[i: i + width] in the inverse of ``base`` modulo 2 ** 64, mixed."""
    n = len(values)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum(values * _power(pow(base, -1, 1 << 64), n)[:n], out=sums[1:])
    h = (sums[width:] - sums[:n + 1 - width]) * _power(base, n)[:n + 1 - width]
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def windows(rows: list[tuple[int, int, int, list[bytes]]], width: int) -> Windows:
    """All windows of the lists of words; a row: document, text, the first word's place in it, words."""
    words = [w for r in rows for w in r[3]]
    if len(words) < width:
        return tuple(np.zeros(0, k) for k in _KINDS)
    index: defaultdict[bytes, int] = defaultdict(count().__next__)
    code = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
    hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, index)), dtype="<u8").reshape(-1, 2)
    size = np.array([len(r[3]) for r in rows])
    begin = np.cumsum(size) - size
    of = np.repeat(np.arange(len(rows)), size)
    at = np.flatnonzero(of[width - 1:] == of[:len(of) - width + 1])  # windows within one list
    of = of[at]
    first = np.array([r[2] for r in rows]) - begin
    return (rolled(hashes[code, 0], width, _BASES[0])[at], (rolled(hashes[code, 1], width, _BASES[1])[at] >> np.uint64(32)).astype(np.uint32),
            np.array([r[0] for r in rows], np.int64)[of], np.array([r[1] for r in rows], np.int64)[of], (at + first[of]).astype(np.int32))


def split(w: Windows) -> tuple[Windows, Windows]:
    """The first window of each hash, in the order of hashes, and the windows that start after the first of theirs."""
    order = np.argsort(w[0], kind="stable")
    h = w[0][order]
    twin = h[1:] == h[:-1]
    many = np.zeros(len(h), bool)
    many[1:] |= twin
    many[:-1] |= twin
    some = order[many]
    some = some[np.lexsort([x[some] for x in reversed(w)])]
    h1, h2, *place = (x[some] for x in w)
    new = np.ones(len(some), bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    lead = np.flatnonzero(new)[np.cumsum(new) - 1] if len(some) else some
    later = np.zeros(len(some), bool)
    for x in place:
        later |= x != x[lead]
    firsts = np.concatenate([order[~many], some[new]])
    firsts = firsts[np.argsort(w[0][firsts], kind="stable")]
    return tuple(x[firsts] for x in w), tuple(x[some[later]] for x in w)


def packed(columns: Windows) -> bytes:
    """Numbers by their bytes' planes, compressed: sorted and small numbers have planes that nearly vanish."""
    return pa.compress(b"".join(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T.tobytes() for x in columns), codec="zstd", asbytes=True)


def unpacked(data: bytes, n: int, kinds: tuple) -> Windows:
    sizes = [np.dtype(k).itemsize for k in kinds]
    raw = np.frombuffer(pa.decompress(data, n * sum(sizes), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, size in zip(kinds, sizes, strict=True):
        out.append(np.ascontiguousarray(raw[at: at + n * size].reshape(size, n).T).view(kind).reshape(n))
        at += n * size
    return tuple(out)


def _gathered(rows: pa.Table, kinds: tuple) -> Windows:
    parts = [unpacked(x.as_py(), n.as_py(), kinds) for n, x in zip(rows.column("n"), rows.column("data"), strict=True)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def _scaled(h: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n`` that grow with the 64-bit ``h``."""
    return (((h >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)).astype(np.int64)


def _dealt(key: np.ndarray, columns: Windows, first_key: int = 0) -> list[tuple[int, int, bytes]]:
    """(key, n, data) for each key; ``key`` is sorted."""
    keys, begin = np.unique(key, return_index=True)
    ends = np.append(begin, len(key))[1:]
    return [(int(k) + first_key, int(e - b), packed(tuple(x[b:e] for x in columns))) for k, b, e in zip(keys, begin, ends, strict=True)]


def _to_documents(later: Windows, groups: int, first_key: int) -> list[tuple[int, int, bytes]]:
    """Places of repeats, dealt by their document."""
    d, f, s = later[2:]
    h = (d.view(np.uint64) * np.uint64(_BASES[0]) ^ f.view(np.uint64)) * _MIX1
    key = _scaled((h ^ (h >> np.uint64(29))) * _MIX2, groups)
    order = np.lexsort([s, f, d, key])
    return _dealt(key[order], (d[order], f[order], s[order]), first_key)


def _rows(dealt: list[tuple[int, int, bytes]]) -> list[pa.Array]:
    return [pa.array([x[i] for x in dealt], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]


_DEALT = "key long, n long, data binary"


def keyed(docs: DataFrame) -> tuple[DataFrame, int]:
    """doc_id, text, d, f (the document's and its text's place in the order), and the number of all characters."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    mark = F.xxhash64("text")
    ids = stored(docs.groupBy("doc_id").agg(F.min(mark).alias("a"), F.max(mark).alias("z"), F.sum(F.length("text")).alias("chars")), "ids")
    several = stored(ids.where("doc_id is not null and a <> z").select("doc_id", F.lit(True).alias("several")), "several")
    docs = docs.join(several, "doc_id", "left")
    f = F.when(F.col("doc_id").isNull() | F.col("several").isNotNull(), mark).otherwise(F.lit(0).cast("long"))
    return docs.select("doc_id", "text", F.coalesce("doc_id", F.lit(_LAST)).alias("d"), f.alias("f")), ids.agg(F.sum("chars")).first()[0] or 0


def repeats(docs: DataFrame, chars: int, width: int = WIDTH) -> DataFrame:
    """d, f, begins, ends: the maximal intervals of words that repeated windows cover, for documents that have any."""
    groups = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), chars // GROUP_CHARS + 1)

    def sent(chunk: list[Windows]) -> pa.RecordBatch:
        first, later = split(tuple(np.concatenate(x) for x in zip(*chunk, strict=True)))
        return pa.RecordBatch.from_arrays(_rows(_dealt(_scaled(first[0], groups), first) + _to_documents(later, groups, groups)), ["key", "n", "data"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk: list[Windows] = []
        rows: list[tuple[int, int, int, list[bytes]]] = []
        held = 0
        for batch in batches:
            for text, d, f in zip(batch.column(0).cast(pa.binary()), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                tail, at = [], 0
                for words in word_lists(text.as_py() or b""):
                    words = tail + words
                    if len(words) >= width:
                        rows.append((d, f, at, words))
                        held += len(words)
                    tail = words[max(0, len(words) - width + 1):]
                    at += len(words) - len(tail)
                    if held >= CHUNK // 4:
                        chunk.append(windows(rows, width))
                        rows, held = [], 0
                        if sum(len(x[0]) for x in chunk) >= CHUNK:
                            yield sent(chunk)
                            chunk = []
        chunk.append(windows(rows, width))
        if any(len(x[0]) for x in chunk):
            yield sent(chunk)

    def counted(rows: pa.Table) -> pa.Table:
        """Of a group of hashes, the places that aren't first; places that are for documents already go on."""
        if (key := rows.column("key")[0].as_py()) >= groups:
            return rows.set_column(0, "key", pa.array([key - groups] * len(rows), pa.int64()))
        return pa.Table.from_arrays(_rows(_to_documents(split(_gathered(rows, _KINDS))[1], groups, 0)), ["key", "n", "data"])

    def merged(rows: pa.Table) -> pa.Table:
        d, f, s = _gathered(rows, _KINDS[2:])
        order = np.lexsort([s, f, d])
        d, f, s = d[order], f[order], s[order].astype(np.int64)
        other = np.ones(len(d), bool)  # another document than before
        other[1:] = (d[1:] != d[:-1]) | (f[1:] != f[:-1])
        opens = other.copy()
        opens[1:] |= s[1:] > s[:-1] + width
        begin, docs_at = np.flatnonzero(opens), np.flatnonzero(other)
        ends = s[np.append(begin[1:], len(s)) - 1] + width
        offsets = pa.array(np.append(np.searchsorted(begin, docs_at), len(begin)), pa.int32())
        return pa.table({"d": d[docs_at], "f": f[docs_at], "begins": pa.ListArray.from_arrays(offsets, pa.array(s[begin])),
                         "ends": pa.ListArray.from_arrays(offsets, pa.array(ends))})

    places = docs.select("text", "d", "f").mapInArrow(hashed, _DEALT).groupBy("key").applyInArrow(counted, _DEALT)
    return places.groupBy("key").applyInArrow(merged, "d long, f long, begins array<long>, ends array<long>")


def kept(text: bytes, begins: list[int], ends: list[int]) -> tuple[int, int, bytes]:
    """Number of words, of removed ones, and the rest joined by spaces."""
    out: list[bytes] = []
    n, k = 0, 0
    for words in word_lists(text):
        at, n, done = n, n + len(words), 0
        while k < len(begins) and begins[k] < n:
            out += words[done: max(0, begins[k] - at)]
            done = ends[k] - at
            if ends[k] > n:  # it goes on in the next list
                break
            k += 1
        out += words[max(0, done):]
    return n, n - len(out), b" ".join(out)


def without_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, text (the words that stay, joined by spaces), n_words, n_removed, begins, ends of every row of ``docs`` (doc_id, text)."""
    docs, chars = keyed(docs)
    spans = stored(repeats(docs, chars, width), "repeats")
    bits = F.xxhash64("d", "f")
    place = [F.pmod(F.shiftright(bits, 6), F.lit(_MAP_WORDS)).alias("w"), F.pmod(bits, F.lit(64)).cast("int").alias("b")]
    # A bit map of a fixed size (2^20 rows at most) tells which texts needn't be shuffled; a few that it lets through do no harm.
    marked = spans.select(*place).groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    found = docs.select("*", *place).join(F.broadcast(marked), "w", "left")
    hit = F.expr("coalesce(bits & shiftleft(1L, b), 0L) <> 0")
    touched = found.where(hit).select("doc_id", "text", "d", "f").join(spans, ["d", "f"], "left")
    others = found.where(~hit)
    for name in ("begins", "ends"):
        others = others.withColumn(name, F.lit(None).cast("array<long>"))
    columns = ["doc_id", "text", "begins", "ends"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            done = [kept(t or b"", b or [], e or []) for t, b, e in zip(texts, batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[2] for x in done], pa.binary()).cast(pa.string()), pa.array([x[0] for x in done], pa.int64()),
                 pa.array([x[1] for x in done], pa.int64()), batch.column(2), batch.column(3)],
                ["doc_id", "text", "n_words", "n_removed", "begins", "ends"])

    return touched.select(columns).unionByName(others.select(columns)).mapInArrow(
        run, "doc_id long, text string, n_words long, n_removed long, begins array<long>, ends array<long>")
