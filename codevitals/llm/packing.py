"""Harmonic packing of token sequences.

A piece of length n belongs to class j = capacity // n, and a sequence of class j holds exactly j pieces.
Every worker fills the sequences of each class alone, in one pass; only pieces of sequences that stay
incomplete go on: they are filled by groups of ``FAN_IN`` workers, then by class, and the last few
(under j for each class, whatever the input's size) share sequences of any class, longest first.

Documents may be cut, which keeps padding small: full capacities are cut off first; the rest is kept whole
when its class wastes at most 1/64 of a sequence or it is at most 1/32 of the capacity, and otherwise a piece of
exactly capacity // (j + 1) ids is cut off.

A null text is empty: its document is the end id alone. Null doc_ids are kept; repeated doc_ids are
documents of their own (their pieces can be told apart by sequence_id and offset). An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.llm.common import encoder, tokenizer_path
from codevitals.session import stored

CAPACITY = 2048
FAN_IN = 256
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
_PLACED = f"{_PIECE}, class int, worker long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int32() if x.endswith("int") else pa.int64()) for x in _PLACED.split(", ")])


def cut(n: int, capacity: int = CAPACITY) -> list[int]:
    """Lengths of the pieces of a document of ``n`` ids."""
    full, rest = divmod(n, capacity)
    out = [capacity] * full
    while rest:
        j = capacity // rest
        if 64 * (capacity - j * rest) <= capacity or 32 * rest <= capacity:
            out.append(rest)
            break
        out.append(capacity // (j + 1))
        rest -= out[-1]
    return out


class Filler:
    """Sequences of each class, filled piece after piece."""

    def __init__(self, level: int, worker: int, capacity: int):
        self.base, self.n, self.capacity = (level << 58) | (worker << 30), 0, capacity
        self.open: dict[int, list[tuple]] = {}
        self.worker = worker

    def sequence(self, j: int, pieces: list[tuple]) -> list[tuple]:
        offset, out = 0, []
        for p in pieces:
            out.append((*p, j, self.worker, self.base | self.n, offset))
            offset += p[2]
        self.n += 1
        return out

    def add(self, piece: tuple) -> list[tuple]:
        """The rows of the sequence that ``piece`` completes, or none."""
        j = self.capacity // piece[2]
        pieces = self.open.setdefault(j, [])
        pieces.append(piece)
        return self.sequence(j, self.open.pop(j)) if len(pieces) == j else []

    def rest(self) -> list[tuple]:
        return [(*p, j, self.worker, None, None) for j, pieces in self.open.items() for p in pieces]


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _sorted(rows: pa.Table) -> list[tuple]:
    """The pieces' own columns, in a fixed order."""
    columns = [rows.column(i).to_pylist() for i in range(5)]
    return sorted(zip(*columns, strict=True), key=lambda p: (p[0] is not None, p[0], *p[1:]))


def tokenized_pieces(docs: DataFrame, path: str, end_id: int, capacity: int) -> DataFrame:
    """Encode, cut and fill in one pass; incomplete sequences come with a null sequence_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(path), np.array([end_id], dtype="<u4").tobytes()
        filler = Filler(0, TaskContext.get().partitionId(), capacity)
        for batch in batches:
            rows = []
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = memoryview(enc.encode(text or "") + end)
                n, start = len(ids) // 4, 0
                for length in cut(n, capacity):
                    crc = zlib.crc32(ids[4 * start: 4 * (start + length)])
                    rows += filler.add((k, start, length, crc, n))
                    start += length
            yield _arrow(rows, _SCHEMA)
        yield _arrow(filler.rest(), _SCHEMA)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _PLACED)


def _refill(rest: DataFrame, worker: F.Column, level: int, capacity: int) -> DataFrame:
    """Fill what is left by (class, group of workers)."""

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        group = key[1].as_py()
        filler, out = Filler(level, group << 12 | key[0].as_py(), capacity), []
        for p in _sorted(rows):
            out += filler.add(p)
        out = [(*p[:6], group, *p[7:]) for p in out + filler.rest()]
        return pa.Table.from_batches([_arrow(out, _SCHEMA)])

    return rest.withColumn("group", worker).groupBy("class", "group").applyInArrow(run, _PLACED)


def _share(rest: DataFrame, capacity: int) -> DataFrame:
    """Sequences of the last pieces of all classes: fewer than j for each class j, whatever the input."""

    def run(rows: pa.Table) -> pa.Table:
        room: list[int] = []
        out = []
        for p in sorted(_sorted(rows), key=lambda p: -p[2]):
            b = next((b for b, free in enumerate(room) if free >= p[2]), len(room))
            if b == len(room):
                room.append(capacity)
            out.append((*p, capacity // p[2], 0, (3 << 58) | b, capacity - room[b]))
            room[b] -= p[2]
        return pa.Table.from_batches([_arrow(out, _SCHEMA)])

    return rest.groupBy().applyInArrow(run, _PLACED)


def pack(docs: DataFrame, capacity: int = CAPACITY, end_id: int = 1, path: str | None = None) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, class of every piece."""
    first = stored(tokenized_pieces(docs, path or tokenizer_path(), end_id, capacity), "pieces")
    parts = [first]
    for level, worker in ((1, F.floor(F.col("worker") / FAN_IN)), (2, F.lit(0).cast("long"))):
        rest = parts[-1].where(F.col("sequence_id").isNull())
        parts.append(stored(_refill(rest, worker, level, capacity), f"pieces-{level}"))
    last = _share(parts[-1].where(F.col("sequence_id").isNull()), capacity)
    placed = [p.where(F.col("sequence_id").isNotNull()) for p in parts] + [last]
    out = placed[0]
    for p in placed[1:]:
        out = out.unionByName(p)
    return out.drop("worker")
