"""Quality rules: fixed rules over document statistics, then gradient-boosted trees.

The trees are grown in numpy on histograms of the statistics of at most ``fit_rows`` labelled documents, with
monotonic constraints (more repetition or symbols never raises the verdict), and flattened into node arrays
that score a whole batch at once. The statistics are taken from every whole text.

A null text has no words, so it fails the base rules. Null and repeated doc_ids are scored like others. Without
labels, or with one class only, there is nothing to learn and the base rules decide. An empty table gives no rows.
Other columns of documents are passed on by ``keep_good`` and never looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codevitals.llm.common import find_words

#: Labelled documents that the trees are grown on, at most.
FIT_ROWS = 20_000
SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\r\x0b\x0c"

#: Statistics that the trees see, each with its constraint: -1 means more of it never raises the verdict.
FEATURES = {
    "log_words": 0, "mean_word": 0, "symbols_per_word": -1, "dup_line_share": -1, "repeat_share": -1, "distinct_share": 1,
    "short_share": 0, "long_share": -1, "digit_share": -1, "upper_share": 0, "punctuation_share": 0, "words_per_line": 0,
    "byte_entropy": 0, "top_word_share": -1,
}
_IS = {
    "digit": np.array([48 <= b < 58 for b in range(256)]), "upper": np.array([65 <= b < 91 for b in range(256)]),
    "symbol": np.array([chr(b) in SYMBOLS for b in range(256)]),
    "mark": np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)]),
}


def statistics(text: str | None) -> tuple[tuple[int, int, int, int, int], list[float]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of ``FEATURES``."""
    text = text or ""
    words = find_words(text)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    chars = int(lengths.sum())
    octets = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    total = max(1, int(octets.sum()))
    symbols = int(octets[_IS["symbol"]].sum())
    lines, seen, dup = 0, set(), 0
    for line in text.split("\n"):
        if line.strip(_BLANK):
            lines += 1
            dup += line in seen
            seen.add(line)
    windows = list(zip(words, words[1:], words[2:]))
    times = Counter(windows)
    repeats = 0
    if len(times) < len(windows):
        twice = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k: k + len(windows)] |= twice
        repeats = int(covered.sum())
    per_word = Counter(words)
    share = octets[octets > 0] / total
    m = max(1, n)
    features = [
        np.log1p(n), chars / m, symbols / m, dup / max(1, lines), repeats / m, len(per_word) / m,
        float((lengths <= 3).sum()) / m, float((lengths > 20).sum()) / m, octets[_IS["digit"]].sum() / total,
        octets[_IS["upper"]].sum() / total, octets[_IS["mark"]].sum() / total, n / max(1, lines),
        float(-(share * np.log2(share)).sum()), max(per_word.values(), default=0) / m,
    ]
    return (n, chars, symbols, dup, repeats), features


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


@dataclass
class Trees:
    """Nodes of all trees in arrays; a leaf points at itself."""

    roots: np.ndarray
    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    start: float
    depth: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        at = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return 1 / (1 + np.exp(-(self.start + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, signs: list[int], trees: int = 60, depth: int = 4, rate: float = 0.15,
         bins: int = 64, least: float = 0.5) -> Trees:
    """Boosted trees for the probability of y = 1; ``least``: the smallest sum of hessians of a leaf."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(edges[f], x[:, f], side="left") for f in range(width)], axis=1)
    p0 = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(p0 / (1 - p0)))
    logit = np.full(n, start)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def node(v: float) -> int:
        feature.append(0)
        threshold.append(np.inf)
        left.append(len(left))
        right.append(len(right))
        value.append(v)
        return len(value) - 1

    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        g, h = y - p, p * (1 - p)
        roots.append(node(0.0))
        open_nodes = [(roots[-1], np.arange(n), -np.inf, np.inf)]
        for _ in range(depth):
            following = []
            for at, rows, low, high in open_nodes:
                best = _best_split(binned[rows], g[rows], h[rows], [len(e) for e in edges], signs, low, high, least)
                if best is None:
                    continue
                f, b, vl, vr = best
                feature[at], threshold[at] = f, edges[f][b]
                left[at], right[at] = node(rate * vl), node(rate * vr)
                goes = binned[rows, f] <= b
                middle = (vl + vr) / 2
                bounds = [(low, high), (low, high)]
                if signs[f]:
                    bounds = [(low, middle), (middle, high)][::signs[f]]
                following += [(left[at], rows[goes], *bounds[0]), (right[at], rows[~goes], *bounds[1])]
                logit[rows[goes]] += value[left[at]] - value[at]
                logit[rows[~goes]] += value[right[at]] - value[at]
            open_nodes = following
    arrays = (np.array(roots), np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value))
    return Trees(*arrays, start, depth)


def _best_split(binned, g, h, n_edges, signs, low, high, least):  # noqa: ANN001, ANN202
    """(feature, bin, value left, value right) of the split of the largest gain that the constraints allow."""
    total_g, total_h = g.sum(), h.sum()
    best, gain = None, 1e-6
    parent = total_g**2 / (total_h + 1)
    for f, n in enumerate(n_edges):
        if not n:
            continue
        gl = np.cumsum(np.bincount(binned[:, f], weights=g, minlength=n + 1))[:n]
        hl = np.cumsum(np.bincount(binned[:, f], weights=h, minlength=n + 1))[:n]
        gr, hr = total_g - gl, total_h - hl
        vl, vr = np.clip(gl / (hl + 1), low, high), np.clip(gr / (hr + 1), low, high)
        gains = 2 * (gl * vl + gr * vr) - (hl + 1) * vl**2 - (hr + 1) * vr**2 - parent
        fits = (hl >= least) & (hr >= least) & (signs[f] * (vr - vl) >= 0)
        gains = np.where(fits, gains, -np.inf)
        b = int(gains.argmax())
        if gains[b] > gain:
            best, gain = (f, b, float(vl[b]), float(vr[b])), gains[b]
    return best


def fit(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Trees | None:
    """Trees for ``labels.quality``; None without labels of both classes."""
    label = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("_y"))
    label = label.withColumn("_h", F.xxhash64("doc_id")).orderBy("_h", "doc_id").limit(fit_rows)
    pairs = docs.select("doc_id", "text").join(F.broadcast(label), "doc_id").select("_y", "text", "_h", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics(t)[1] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), batch.column(3), pa.array(found, pa.list_(pa.float64()))],
                ["y", "h", "doc_id", "x"])

    rows = (pairs.mapInArrow(run, "y long, h long, doc_id long, x array<double>")
            .orderBy("h", "doc_id", "x", "y").limit(fit_rows).collect())
    y = np.array([r.y > 0 for r in rows], dtype=np.float64)
    if len(y) == 0 or y.min() == y.max():
        return None
    return grow(np.array([r.x for r in rows]), y, list(FEATURES.values()))


def _verdicts(texts: list[str | None], trees: Trees | None) -> tuple[list[tuple], list[bool], list[bool], list[float]]:
    found = [statistics(t) for t in texts]
    failed = [base_failed(c[0], c[4]) for c, _ in found]
    good = trees.probability(np.array([f for _, f in found])) if trees and found else np.ones(len(found))
    kept = [not bad and bool(p >= 0.5) for bad, p in zip(failed, good, strict=True)]
    return [c for c, _ in found], failed, kept, [float(p) for p in good]


def verdicts(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """Statistics, base_failed, kept and the trees' probability for each document."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    shared = docs.sparkSession.sparkContext.broadcast(trees)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, failed, kept, good = _verdicts(batch.column(1).to_pylist(), shared.value)
            columns = [pa.array([c[i] for c in counts], pa.int64()) for i in range(5)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *columns, pa.array(failed, pa.bool_()), pa.array(kept, pa.bool_()),
                 pa.array(good, pa.float64())], ["doc_id", *names, "base_failed", "kept", "quality_score"])

    schema = f"doc_id long, {', '.join(f'{n} long' for n in names)}, base_failed boolean, kept boolean, quality_score double"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees | None) -> DataFrame:
    """The documents, all columns, that are kept."""
    shared, at = docs.sparkSession.sparkContext.broadcast(trees), docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = _verdicts(batch.column(at).to_pylist(), shared.value)[2]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
