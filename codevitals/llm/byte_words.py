"""Words of UTF-8 texts as bytes, in bounded pieces."""

from __future__ import annotations

import re
from collections.abc import Iterator

#: Bytes of a text that are split at a time; a longer text comes in several lists.
PIECE_BYTES = 4_000_000
_space = re.compile(rb"[\x20\x09-\x0D]").search


def word_lists(text: bytes, size: int = PIECE_BYTES) -> Iterator[list[bytes]]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order, a list for each piece; bytes.split() splits at the same six bytes."""
    begin = 0
    while begin < len(text):
        found = _space(text, begin + size) if begin + size < len(text) else None
        end = found.start() if found else len(text)
        yield text[begin:end].split()
        begin = end
