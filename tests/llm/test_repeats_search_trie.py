"""Substring removal, reversed search and the prefix trie against brute force, on given tables and on edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from codevitals.llm import byte_words, prefix_trie, reversed_search, substring_dedup
from codevitals.llm.common import table
from codevitals.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(reversed_search.TERM)


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def without_repeats(texts, width):
    """(words, removed, kept) of texts in order."""
    seen, out = set(), []
    for text in texts:
        words = WORD.findall(text or "")
        gone = [False] * len(words)
        for i in range(len(words) - width + 1):
            key = tuple(words[i:i + width])
            if key in seen:
                gone[i:i + width] = [True] * width
            seen.add(key)
        kept = [w for w, g in zip(words, gone, strict=True) if not g]
        out.append((len(words), sum(gone), " ".join(kept)))
    return out


def test_word_lists_cut_between_words():
    text = "é  a\tbc\x1cd \n longword x".encode()
    for size in range(1, 12):
        lists = list(byte_words.word_lists(text, size))
        assert [w.decode() for ws in lists for w in ws] == WORD.findall(text.decode())


def test_rolled_hashes_stand_for_the_words():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 4, 400).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = substring_dedup.rolled(values, 3, substring_dedup._BASES[0])
    same = {}
    for i in range(398):
        assert same.setdefault(values[i:i + 3].tobytes(), h[i]) == h[i]
    assert len(set(same.values())) == len(same)


def test_substring_dedup_query(spark):
    rows = {r.doc_id: r for r in QUERIES["op11_substring_dedup"](spark, SF).collect()}
    docs = sorted(table(spark, SF, "documents").collect(), key=lambda r: r.doc_id)
    want = without_repeats([r.text for r in docs], 20)
    assert sum(w[1] for w in want) > 0
    for doc, (n, removed, kept) in zip(docs, want, strict=True):
        r = rows[doc.doc_id]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, removed, hashlib.sha256(kept.encode()).hexdigest())


@pytest.mark.parametrize("chunk", [64, 1 << 20])
def test_substring_dedup_of_random_texts(spark, monkeypatch, chunk):
    """Many small chunks and groups, texts cut into short lists, repeats inside a document and over its cuts."""
    rng = random.Random(chunk)
    monkeypatch.setattr(substring_dedup, "CHUNK", chunk)
    texts = [" ".join(rng.choice("ab") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["a " * 300, "\n".join("ab" * 40)]
    docs = spark.createDataFrame([(i - 5, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id + 5: (r.n_words, r.n_removed, r.text) for r in substring_dedup.without_repeats(docs, 6).collect()}
    want = without_repeats(texts, 6)
    assert [got[i] for i in range(len(texts))] == want


def test_substring_dedup_edges(spark):
    a, b = " ".join(f"w{i}" for i in range(30)), " ".join(f"v{i}" for i in range(30))
    rows = [(2, a), (1, b), (2, a), (3, b + " end"), (3, a), (None, a), (None, a), (None, "x y"), (4, None), (5, ""), (6, " \t "), (7, "w0 w1")]
    docs = spark.createDataFrame([(*r, 1, "q", 2.0) for r in rows], "doc_id long, text string, n_words long, d string, begins double")
    cut = substring_dedup.without_repeats(docs)
    assert cut.columns == ["doc_id", "text", "n_words", "n_removed", "begins", "ends"]
    got = sorted(((r.doc_id or 0), r.n_words, r.n_removed, r.text) for r in cut.collect())
    assert got == sorted([(2, 30, 0, a), (2, 30, 0, a), (1, 30, 0, b), (3, 31, 30, "end"), (3, 30, 30, ""), (0, 30, 30, ""), (0, 30, 30, ""),
                          (0, 2, 0, "x y"), (4, 0, 0, ""), (5, 0, 0, ""), (6, 0, 0, ""), (7, 2, 0, "w0 w1")])
    assert substring_dedup.without_repeats(docs.limit(0)).collect() == []


def ranked(docs, items, k=20):
    """Rows of the search by its formula; docs and items are (id, text)."""
    counts = [(d, Counter(TERM.findall(lower(t)))) for d, t in docs]
    counts = [(d, c) for d, c in counts if c]
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    queries = defaultdict(Counter)
    for i, t in items:
        queries[i].update(TERM.findall(lower(t)))
    out = []
    for i, q in queries.items():
        found = []
        for d, c in counts:
            m = 75 + 25 * sum(c.values()) * n_docs // length
            score = sum(x * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m))
                        for t, x in q.items() if t in c)
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(i, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def test_reversed_search_query(spark):
    got = [tuple(r) for r in QUERIES["op12_reversed_search"](spark, SF).select("item_id", "rank", "doc_id", "score").collect()]
    docs, items = ([tuple(r) for r in table(spark, SF, t).select(k, "text").collect()] for t, k in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(got, key=str) == ranked(docs, items)


def test_reversed_search_in_parts_with_ties(spark):
    rng = random.Random(3)
    docs = [(i if i % 7 else None, " ".join(rng.choice(["Aé", "b,", "c-d", "日本", "e", "É"]) for _ in range(rng.randint(0, 9)))) for i in range(300)]
    docs += [(5, "b"), (5, "b"), (900, None), (901, " ,. "), (902, "b " * 50_000)]
    items = [(1, "b B e e"), (1, "c"), (2, None), (3, ""), (None, "日本 aé"), (4, "zzz"), (5, "d")]
    frames = (spark.createDataFrame([(*r, 3, 4) for r in rows], f"{k} long, text string, n long, code long").repartition(4)
              for rows, k in ((docs, "doc_id"), (items, "item_id")))
    docs_df, items_df = frames
    for part in (2, 1 << 20):
        got = reversed_search.search(docs_df, items_df, k=6, part=part)
        assert sorted((tuple(r) for r in got.collect()), key=str) == ranked(docs, items, 6)
    assert reversed_search.search(docs_df.limit(0), items_df).collect() == []
    assert reversed_search.search(docs_df, items_df.limit(0)).collect() == []


def nodes(turns):
    """Rows of the trie; ``turns`` are (conv_id, turn, role, text)."""
    own = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(t)] for c, t in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children, leaves, saved = Counter(n[:-1] for n in members if n), Counter(), Counter()
    for n, m in members.items():
        for d in range(len(n) + 1):
            leaves[n[:d]] += not children[n]
            saved[n[:d]] += (len(m) - 1) * len(WORD.findall(n[-1][1])) if n else 0
    return sorted(((m[0], len(n), members[n[:-1]][0] if n else None, len(m), children[n], leaves[n], saved[n],
                    hashlib.sha256(",".join(map(str, ends[n])).encode()).hexdigest()) for n, m in members.items()), key=str)


def test_prefix_trie_query(spark):
    got = [tuple(r) for r in QUERIES["op13_prefix_trie"](spark, SF).collect()]
    assert sorted(got, key=str) == nodes([tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize(("shard_turns", "limit"), [(5, 1 << 20), (5, 12), (10**6, 1 << 20)])
def test_prefix_trie_of_many_shards(spark, monkeypatch, shard_turns, limit):
    """Copies, prefixes, a hot first turn, a deep conversation and turnless ones, in many shards and with a small skeleton."""
    monkeypatch.setattr(prefix_trie, "END_IDS", 3)
    rng = random.Random(limit)
    turns = []
    for c in range(200):
        kind = rng.random()
        n = 0 if kind < 0.1 else rng.randint(1, 5)
        for t in range(n):
            turns.append((c, t, "user" if t % 2 == 0 else "bot", "hello there" if t == 0 and kind < 0.7 else f"{rng.choice('ab')} b" * rng.randint(1, 2)))
    turns += [(c, t, "user", f"same {t}") for c in range(300, 340) for t in range(3)]
    turns += [(400, t, "user", f"deep {t}") for t in range(150)] + [(441, 0, "a", "only"), (442, 0, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(frame)), shard_turns, limit)
    assert sorted((tuple(r) for r in got.collect()), key=str) == nodes(turns)


def test_prefix_trie_edges(spark):
    turns = [(1, None, "u", "first"), (1, 0, None, "x"), (None, 0, "u", "x"), (2, 1, "u", None), (2, 0, "u", ""), (-3, 0, "u", "long " * 100_000), (7, 3, "ab", "c"), (8, 3, "a", "bc")]
    frame = spark.createDataFrame([(*t, 1, "w") for t in turns], "conv_id long, turn long, role string, text string, depth long, words string")
    got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(frame)))
    assert sorted((tuple(r) for r in got.collect()), key=str) == nodes([t for t in turns if t[0] != -3] + [t for t in turns if t[0] == -3])
    none = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.paths(frame.limit(0))))
    assert none.columns == got.columns and none.collect() == []
    # rows of one turn: in the order of their digests, whatever order they come in
    twice = spark.createDataFrame([(1, 0, "u", "a"), (1, 0, "u", "b")], "conv_id long, turn long, role string, text string")
    flipped = twice.orderBy(F.desc("text"))
    one, other = (prefix_trie.paths(x).first().path for x in (twice, flipped))
    assert one == other == sorted(one)
