"""Language identification of mixed-language text.

Letters' scripts narrow the languages a word can be of; each word's scores are log-probabilities of its letter trigrams under
every language; a Viterbi pass with a penalty for each switch labels the words, so spans of one language come out whole.
The document's language is that of the most letters.

The trigram counts come from at most about ``FIT_DOCS`` documents of each language, chosen by a hash of doc_id, whole texts each. Every language of
which one of these has a letter is in the model.

A null text, or one without letters (Unicode category L; numerals such as ``½ ² Ⅷ`` are none), is ``und`` with score 0. Rows with a null lang or doc_id teach nothing and are predicted like others;
repeated rows count as often as they occur. Without anything to learn from, every text is ``und``. Other columns are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codevitals.llm.common import slices

#: Documents of each language that the counts are taken from, about, at most.
FIT_DOCS = 4000
#: Trigrams of each language in the model at most: its most frequent.
LANGUAGE_GRAMS = 200_000
SWITCH = 12.0  # nats
ABSENT = 30.0  # nats that a language loses on a word of a script it isn't written in
#: A letter, then letters and the marks that belong to them; numerals that look like letters are none.
_word = regex.compile(r"\p{L}[\p{L}\p{M}]*+")
_words = _word.findall

# First and last code point of the scripts' main ranges.
SCRIPTS = [
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("greek", 0x1F00, 0x1FFF),
    ("cyrillic", 0x400, 0x52F), ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF),
    ("arabic", 0x750, 0x77F), ("devanagari", 0x900, 0x97F), ("bengali", 0x980, 0x9FF), ("gurmukhi", 0xA00, 0xA7F),
    ("gujarati", 0xA80, 0xAFF), ("tamil", 0xB80, 0xBFF), ("telugu", 0xC00, 0xC7F), ("kannada", 0xC80, 0xCFF),
    ("malayalam", 0xD00, 0xD7F), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF), ("hangul", 0x1100, 0x11FF),
    ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF),
]
_NAMES = ["other", *dict.fromkeys(name for name, _, _ in SCRIPTS)]
_STARTS = np.array([a for _, a, _ in sorted(SCRIPTS, key=lambda s: s[1])])
_ENDS = np.array([b for _, _, b in sorted(SCRIPTS, key=lambda s: s[1])])
_SCRIPT = np.array([_NAMES.index(n) for n, _, _ in sorted(SCRIPTS, key=lambda s: s[1])])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _grams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trigram keys of the words (a space on both sides), the words' ends among them, the words' scripts."""
    text = "".join(f" {w} " for w in words)
    points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    keys = points[:-2] << 42 | points[1:-1] << 21 | points[2:]
    # A word of n letters has n trigrams; the two after it lie across its end.
    first = np.cumsum(lengths + 2) - lengths - 2
    inside = np.ones(len(points), dtype=bool)
    inside[first + lengths] = inside[first + lengths + 1] = False
    at = np.maximum(np.searchsorted(_STARTS, points[first + 1], side="right") - 1, 0)
    script = np.where((points[first + 1] >= _STARTS[at]) & (points[first + 1] <= _ENDS[at]), _SCRIPT[at], 0)
    return keys[inside[:-2]], np.cumsum(lengths), script


@dataclass
class Model:
    languages: list[str]
    keys: np.ndarray  # sorted
    log_p: np.ndarray  # trigram by language; the last row is of unseen ones
    written: np.ndarray  # script by language: whether it occurs

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities of the words by language."""
        keys, ends, script = _grams(words)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        at = np.where(self.keys[at] == keys, at, len(self.keys))
        sums = np.add.reduceat(self.log_p[at], np.concatenate([[0], ends[:-1]]), axis=0)
        known = self.written[script]
        return sums - ABSENT * (~known & known.any(axis=1, keepdims=True))


def learn(docs: DataFrame, fit_docs: int = FIT_DOCS) -> Model | None:
    """The model from the documents that aren't held out and have a language."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    per = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not per:
        return None
    spark = docs.sparkSession
    share = spark.createDataFrame([(k, min(1.0, fit_docs / n)) for k, n in per.items()], "lang string, share double")
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / (1 << 20)
    sample = rows.join(F.broadcast(share), "lang").where(chance < F.col("share")).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: dict[str, Counter] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts.setdefault(lang, Counter()).update(_words(text.lower()))
            for lang, words in counts.items():
                if not words:
                    continue
                keys, ends, script = _grams(list(words))
                times = np.fromiter(words.values(), np.int64, len(words))
                gram, at = np.unique(keys, return_inverse=True)
                n = np.bincount(at, weights=np.repeat(times, np.diff(ends, prepend=0))).astype(np.int64)
                seen = np.bincount(script, weights=times, minlength=len(_NAMES)).astype(np.int64)
                # Scripts are sent as negative keys.
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * (len(gram) + len(seen))), pa.array(np.concatenate([gram, -1 - np.arange(len(seen))])),
                     pa.array(np.concatenate([n, seen]))], ["lang", "key", "n"])

    counts = sample.mapInArrow(run, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n"))
    scripts = counts.where("key < 0").collect()  # a few rows for each language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "key"))
    top = counts.where("key >= 0").withColumn("nth", nth).where(F.col("nth") <= LANGUAGE_GRAMS).select("lang", "key", "n").toPandas()
    if not len(top):
        return None
    languages = sorted(set(top["lang"]))  # all whose texts have letters
    number = {k: i for i, k in enumerate(languages)}
    keys = np.unique(top["key"].to_numpy(np.int64))
    table = np.zeros((len(keys) + 1, len(languages)))
    table[np.searchsorted(keys, top["key"].to_numpy(np.int64)), top["lang"].map(number).to_numpy(np.int64)] = top["n"].to_numpy()
    log_p = np.log((table + 0.5) / (table.sum(axis=0) + 0.5 * len(table)))
    written = np.zeros((len(_NAMES), len(languages)))
    for r in scripts:
        if r.lang in number:
            written[-1 - r.key, number[r.lang]] = r.n
    return Model(languages, keys, log_p, written > 0.01 * written.sum(axis=0))


def viterbi(scores: np.ndarray, begins: np.ndarray, lengths: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """The best language of every word, for texts whose words begin at ``begins`` in ``scores``.

    Texts advance side by side, the longest first, so one step costs a few array operations for all of them.
    """
    order = np.argsort(-lengths, kind="stable")
    begins, lengths = begins[order], lengths[order]
    total, n_lang = scores.shape
    best = np.zeros(total, dtype=np.int16)  # the best language at a word, which a switch comes from
    stays = np.ones((total, n_lang), dtype=bool)
    label = np.zeros(total, dtype=np.int16)
    active = len(lengths)
    value = scores[begins[:active][lengths > 0]]
    steps = int(lengths[0]) if len(lengths) else 0
    alive = [int(np.searchsorted(-lengths, -t, side="left")) for t in range(steps)]  # texts with more than t words
    for t in range(steps):
        n = alive[t]
        at = begins[:n] + t
        if t:
            value = value[:n]
            top = best[at - 1]
            most = value[np.arange(n), top][:, None] - switch
            stays[at] = value >= most
            value = np.maximum(value, most) + scores[at]
        best[at] = value.argmax(axis=1)
    current = np.zeros(len(lengths), dtype=np.int16)
    for t in range(steps - 1, -1, -1):
        n = alive[t]
        at = begins[:n] + t
        final = lengths[:n] == t + 1
        current[:n] = np.where(final, best[at], current[:n])
        label[at] = current[:n]
        if t:
            current[:n] = np.where(stays[at, current[:n]], current[:n], best[at - 1])
    return label


def labelled(texts: list[str | None], model: Model) -> Iterator[tuple[list[str], np.ndarray]]:
    """The words of each text, and the number of each word's language."""
    texts = [(t or "").lower() for t in texts]
    for begin, end in slices(texts):
        docs = [_words(t) for t in texts[begin:end]]
        index: dict[str, int] = {}
        code = np.array([index.setdefault(w, len(index)) for words in docs for w in words], dtype=np.int64)
        if not index:
            yield from ((words, np.zeros(0, dtype=np.int16)) for words in docs)
            continue
        lengths = np.array([len(words) for words in docs])
        begins = np.cumsum(lengths) - lengths
        label = viterbi(model.word_scores(list(index))[code], begins, lengths)
        yield from ((words, label[b:b + n]) for words, b, n in zip(docs, begins, lengths, strict=True))


def spans(text: str, model: Model) -> list[tuple[int, int, str]]:
    """(start, end, language) of the spans of one language, in code points, of a text in lower case or not."""
    low = text.lower()
    if len(low) != len(text):  # a few capitals have longer lower-case forms
        low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
    places = [m.span() for m in _word.finditer(low)]
    out: list[tuple[int, int, str]] = []
    for _, label in labelled([low], model):
        for (start, end), k in zip(places, label, strict=True):
            name = model.languages[k]
            if out and out[-1][2] == name:
                out[-1] = (out[-1][0], end, name)
            else:
                out.append((start, end, name))
    return out


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score: the language of the most letters, and its share of them."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            names, scores = [], []
            texts = batch.column(2).to_pylist()
            for words, label in labelled(texts, model) if model else (([], None) for _ in texts):
                if not words:
                    names.append("und")
                    scores.append(0.0)
                    continue
                letters = np.bincount(label, weights=np.fromiter(map(len, words), np.int64, len(words)))
                names.append(model.languages[int(letters.argmax())])
                scores.append(float(letters.max() / letters.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
