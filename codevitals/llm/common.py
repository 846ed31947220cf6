"""Helpers shared by the operators: tables, words, tokens."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession

#: The white space of the word definition: space and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"
find_words = re.compile(WORD).findall
#: Translates bytes of UTF-8: A-Z become small.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

#: Characters of text that a task works on at a time (one longer text is taken alone).
SLICE_CHARS = 4_000_000


#: Rows that a Python worker is given at a time.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers get ``BATCH_ROWS`` rows at a time, as texts can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: str) -> str:
    """Lower-case A-Z and nothing else."""
    return text.lower() if text.isascii() else text.encode().translate(LOWER).decode()


def slices(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of ``texts`` of about ``SLICE_CHARS`` characters."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= SLICE_CHARS:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


# White space of the tokenizers' own pattern: Unicode White_Space. Most texts have none of it beyond ASCII.
_WIDE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_has_wide = re.compile(rf"[{_WIDE[6:]}]").search
# The letters of Latin-1.
_LETTER = "A-Za-z\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
# That pattern always splits before white space, after a line feed that stands alone, and between letters or digits and marks.
_plain_chunks = re.compile(r"[\t-\r ]*[^\t-\r !-&(-/:-@\[-`{-~]+|[\t-\r ]*[!-&(-/:-@\[-`{-~]+|[\t-\r ]+").findall
# Latin-1 of plain texts: white space, marks, digits and letters; the apostrophe is not among the marks.
_PLAIN = "".join(re.findall(rf"[\t-\r -&(-~{_LETTER[6:]}]", "".join(map(chr, range(256))))).encode("latin-1")


def _is_plain(text: str) -> bool:
    try:
        return not text.encode("latin-1").translate(None, _PLAIN)
    except UnicodeEncodeError:
        return False


_chunks = re.compile(r"[\t-\r ]*[^\t-\r ]+|[\t-\r ]+").findall
_wide_chunks = re.compile(rf"[{_WIDE}]*[^{_WIDE}]+|[{_WIDE}]+").findall
_word_marks = re.compile(rf"( ?[{_LETTER}]+)([!-&(-/:-@\[-`{{-~]*)").fullmatch
_line_feed = re.compile(rf"\n[^{_WIDE}]").match
# Characters on which libraries differ whether they are white space: such texts are encoded in one piece.
_odd = re.compile("[\x1c-\x1f\u180e\u200b\u2060\ufeff]").search
_CACHE_ENTRIES, _CACHE_CHARS = 150_000, 40
_encoders: dict[tuple[str, str], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The letters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Memo(dict):
    """Ids of chunks, made when first asked for; two generations of a bounded size keep the frequent ones."""

    def __init__(self, make: Callable[[str], bytes], older: dict[str, bytes]):
        self.make, self.older = make, older

    def __missing__(self, chunk: str) -> bytes:
        self[chunk] = found = self.older.get(chunk) or self.make(chunk)
        return found


class Encoder:
    """Token ids of whole texts as little-endian unsigned bytes: 32-bit ("I") or 16-bit ("H").

    Merges never cross the boundaries of the tokenizer's pattern, so chunks between such boundaries are encoded once
    and looked up afterwards. Texts that hold an added token's content (such as ``<|endoftext|>``) are encoded in one
    piece, as that content is one token wherever it stands.
    """

    def __init__(self, path: str, kind: str = "I"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.kind = kind
        self.tokenizer = Tokenizer.from_file(path)
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = [t for t in added if t]
        self.tokenize = self.tokenizer.model.tokenize
        self.letters = _byte_letters()
        self.known = _Memo(self._chunk, {})

    def whole(self, text: str) -> bytes:
        return array(self.kind, self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()

    def _chunk(self, chunk: str) -> bytes:
        parts = _word_marks(chunk)
        if not parts:
            return self.known["\n"] + self.known[chunk[1:]] if _line_feed(chunk) else self.whole(chunk)
        if parts[2]:
            return self.known[parts[1]] + self.known[parts[2]]
        word = chunk.encode().decode("latin-1").translate(self.letters)
        return array(self.kind, [t.id for t in self.tokenize(word)]).tobytes()

    def encode(self, text: str) -> bytes:
        if any(content in text for content in self.added):
            return self.whole(text)
        if _is_plain(text):
            chunks = _plain_chunks(text)
        elif _odd(text):
            return self.whole(text)
        else:
            chunks = _wide_chunks(text) if _has_wide(text) else _chunks(text)
        out = b"".join(map(self.known.__getitem__, chunks))
        if len(self.known) > _CACHE_ENTRIES:
            self.known = _Memo(self._chunk, {k: v for k, v in self.known.items() if len(k) <= _CACHE_CHARS})
        return out


def encoder(path: str, kind: str = "I") -> Encoder:
    """One encoder for each worker process, file and kind."""
    if (path, kind) not in _encoders:
        _encoders[path, kind] = Encoder(path, kind)
    return _encoders[path, kind]


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
