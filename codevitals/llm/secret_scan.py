"""Secrets in texts: three fixed patterns, and strings that look random to character Markov models.

Two first-order models over the characters of keys are compared by their log-likelihood ratio: one of ordinary text,
counted over all documents outside the fixed patterns' matches, and one of random strings, counted from the values that
these label as secrets together with uniform strings over the usual key alphabets. A run of ``MIN_RUN`` or more key characters
whose mean ratio is above ``least_ratio`` of its length is added as kind ``random``, or else those of its parts between
separators that are, neighbours above ``MIN_RATIO`` taken together. Numbers, and what a base span covers part of, are not added.

A null text is empty and has no spans. Null and repeated doc_ids are scanned like others; other columns are passed on
by ``redact``. An empty table trains on the uniform strings alone and gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MIN_RATIO = 20, 0.9
_assign = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
# Runs are greedy, so asking for the least length finds the runs that the open pattern finds and drops no other.
_access = re.compile(r"AKIA[A-Z0-9]{16,}")
_hex = re.compile(r"[0-9a-f]{24,}")
_run = re.compile(rf"[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_part = re.compile(r"[A-Za-z0-9+]+")
_hints = ("passw", "secret", "token", "api")

#: Characters of the models; all others are one class, the last.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
_N = len(ALPHABET) + 1
_CODE = np.full(256, _N - 1, dtype=np.int64)
_CODE[np.frombuffer(ALPHABET.encode(), np.uint8)] = np.arange(_N - 1)
_NEVER = -1000.0
_KEY_ALPHABETS = ("0123456789abcdef", "0123456789ABCDEF", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", ALPHABET[:62], ALPHABET[:64])


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    out = []
    low = text.lower()
    if any(x in low for x in _hints):
        out += [(m.start(), 0, m.end()) for m in _assign.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in _access.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _hex.finditer(text)]
    return sorted(out)


def transitions(text: str) -> np.ndarray:
    code = _CODE[np.frombuffer(text.encode(), np.uint8)]
    return np.bincount(code[:-1] * _N + code[1:], minlength=_N * _N)


def train(docs: DataFrame) -> np.ndarray:
    """Log-likelihood ratios of the transitions, random against ordinary, from all documents.

    The first matrix is of all random strings. Strings of hexadecimal digits are a small part of these, so each case
    has a matrix of its own, in which other characters count ``_NEVER``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, _N * _N), dtype=np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    spans = base_spans(text)
                    total[0] += transitions(masked(text, spans, "\n"))
                    for start, kind, end in spans:
                        value = _assign.match(text, start)[2] if kind == 0 else text[start:end]
                        total[1] += transitions(value)
        label, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(at), pa.array(total[label, at])], ["label", "at", "n"])

    # At most 2 * 68 * 68 rows.
    rows = (docs.select("text").mapInArrow(run, "label long, at long, n long")
            .groupBy("label", "at").agg(F.sum("n").alias("n")).collect())
    counts = np.full((2, _N, _N), 0.5)
    for r in rows:
        counts[r.label, r.at // _N, r.at % _N] += r.n
    labelled = counts[1].sum()
    for keys in _KEY_ALPHABETS:  # each weighs as much as all labelled values, and 10,000 characters at least
        at = _CODE[np.frombuffer(keys.encode(), np.uint8)]
        counts[1][np.ix_(at, at)] += max(1e4, labelled) / len(at) ** 2
    # Transitions into other characters don't occur inside a run.
    counts[:, :, -1] = 0
    shares = counts / np.maximum(counts.sum(axis=2, keepdims=True), 1e-9)
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.log(shares[1]) - np.log(shares[0])
    out = [np.nan_to_num(ratio, nan=0.0, posinf=0.0, neginf=0.0)]
    for keys in _KEY_ALPHABETS[:2]:
        at = np.ix_(*[_CODE[np.frombuffer(keys.encode(), np.uint8)]] * 2)
        own = np.full((_N, _N), _NEVER)
        own[at] = -np.log(len(keys)) - np.log(shares[0][at])
        out.append(own)
    return np.stack(out)


def least_ratio(n: int) -> float:
    """The mean ratio that a run of ``n`` characters must exceed: long random strings vary less."""
    return MIN_RATIO + min(0.4, 0.03 * (n - MIN_RUN))


def random_parts(run: str, ratio: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of what looks random: the whole run, or parts of it between separators."""
    code = _CODE[np.frombuffer(run.encode(), np.uint8)]
    total = np.pad(np.cumsum(ratio[:, code[:-1], code[1:]], axis=1), ((0, 0), (1, 0)))

    def mean(start: int, end: int) -> float:
        return (total[:, end - 1] - total[:, start]).max() / max(1, end - start - 1)

    if mean(0, len(run)) > least_ratio(len(run)):
        return [(0, len(run))]
    joined: list[tuple[int, int]] = []
    for m in _part.finditer(run):
        start, end = m.span()
        if mean(start, end) > MIN_RATIO:
            if joined and joined[-1][1] + 1 == start:
                start = joined.pop()[0]
            joined.append((start, end))
    return [(s, e) for s, e in joined if e - s >= MIN_RUN and mean(s, e) > least_ratio(e - s)]


def find_spans(text: str, ratio: np.ndarray) -> list[tuple[int, int, int]]:
    """Base spans and the runs that the models add."""
    base = base_spans(text)
    starts, last = [s for s, _, _ in base], list(accumulate((e for _, _, e in base), max))
    added = []
    for m in _run.finditer(text):
        before = bisect_left(starts, m.start() + 1)
        if m[0].isdigit() or before and last[before - 1] >= m.end():  # a base span covers it
            continue
        for start, end in random_parts(m[0], ratio):
            start, end = start + m.start(), end + m.start()
            before = bisect_left(starts, end)  # base spans that begin before this one ends
            if not text[start:end].isdigit() and not (before and last[before - 1] > start):
                added.append((start, 3, end))
    return sorted(base + added)


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """doc_id, counts and digest of the base spans, all spans."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, spans = [], [], []
            for text in batch.column(1).to_pylist():
                found = find_spans(text or "", shared.value)
                base = [x for x in found if x[1] < 3]
                counts.append([sum(x[1] == k for x in base) for k in range(3)])
                digests.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(found))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(digests, pa.string()), pa.array(spans, pa.string())],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def masked(text: str, spans: list[tuple[int, int, int]], mark: str = "[secret]") -> str:
    out, at = [], 0
    for start, _, end in spans:
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, ratio: np.ndarray) -> DataFrame:
    """The documents, all columns, with every span replaced; ``n_chars``, if there, follows."""
    shared, names = docs.sparkSession.sparkContext.broadcast(ratio), docs.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t and masked(t, find_spans(t, shared.value)) for t in batch.column(at).to_pylist()]
            columns = {n: batch.column(i) for i, n in enumerate(names)} | {"text": pa.array(texts, pa.string())}
            if "n_chars" in names:
                kind = batch.schema.field("n_chars").type
                old = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([n if t is None else len(t) for n, t in zip(old, texts, strict=True)], kind)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(run, docs.schema)
