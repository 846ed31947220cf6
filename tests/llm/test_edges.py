"""Every operator and stage: nulls, empty and long texts, ties, repeated rows, empty tables, clashing extra columns."""

import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from codevitals.llm import language, lm_score, near_dedup, quality, secret_scan, vector_links, warc
from codevitals.llm.common import encoder, tokenizer_path
from codevitals.llm.mixing import mix, n_words, with_pattern
from codevitals.llm.packing import pack
from codevitals.llm.token_files import token_file_digests

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size long, pattern string, hash long, kept boolean, "
          "n_tokens long, component_id long, key long, value long, row long, c long, n long, x binary")
WORDS = "the of and to in is that it was for on are with they at be this have from or one had by word but not what all were we".split()


def document(k, text, lang="en", source="a"):
    return (k, text, lang, source, None if text is None else len(text), 1, "p", 2, True, 3, 4, 5, 6, 7, 8, 9, b"z")


def sentence(k, n):
    return " ".join(WORDS[(i * i + 3 * i + k * 7 + i * k) % len(WORDS)] + str((i * k) % 97) for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        document(1, sentence(1, 80)), document(2, sentence(1, 80), source="b"), document(3, sentence(2, 90), "fr", None),
        document(3, sentence(2, 90), "fr", None), document(4, ""), document(5, None, None, None), document(None, sentence(3, 70), None),
        document(6, sentence(5, 40_000)), document(7, " \t\n"), document(8, "x"), document(9, "日本語 текст ελληνικά"),
        document(10, sentence(6, 60) + ' token = "' + "ab12cd34" * 5 + '"'), document(11, "\x1c​ #. ,.  \n\n a's"),
        document(12, sentence(1, 80) + " end"), document(-5, sentence(8, 55), "de", ""),
    ]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, 0, 0), (None, 1, 1), (6, None, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted((r.doc_id is not None, r.doc_id) for r in rows)


def test_token_files(docs, none):
    got = token_file_digests(docs).collect()
    assert ids(got) == ids(docs.collect())
    enc, end = encoder(tokenizer_path()), (2).to_bytes(4, "little")
    want = sorted(((r.doc_id is not None, r.doc_id or 0), len(b) // 4, zlib.crc32(b)) for r in docs.collect() for b in [enc.whole(r.text or "") + end])
    assert sorted(((r.doc_id is not None, r.doc_id or 0), r.n_tokens, r.ids_crc32) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    order = [(r.doc_id is not None, r.doc_id) for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert token_file_digests(none).collect() == []


def test_packing(docs, none):
    got = pack(docs).collect()
    assert {r.doc_id for r in got} == {r.doc_id for r in docs.collect()}
    by = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert by.get(r.sequence_id, 0) == r.offset
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 2048
    n = {r.doc_id: r.doc_tokens for r in got}
    assert sum(r.length for r in got) == sum(n.values()) + n[3]  # 3 occurs twice
    assert pack(none).collect() == []


def test_language(docs, none):
    got = language.predict(docs, language.learn(docs)).collect()
    assert ids(got) == ids(docs.collect())
    assert {r.doc_id: r.lang_pred for r in got}[4] == {r.doc_id: r.lang_pred for r in got}[5] == "und"
    assert all(0 <= r.score <= 1 for r in got)
    assert language.learn(none) is None
    assert {r.lang_pred for r in language.predict(docs, None).collect()} == {"und"}
    assert language.predict(none, language.learn(docs)).collect() == []


def mixed(docs):
    rows = with_pattern(docs.select("doc_id", n_words(F.col("text")).alias("size"), "source"), F.array("source")).cache()
    choice, sizes, targets = mix(rows)
    return choice.times(rows).collect(), sizes, targets


def test_mixing(docs, none):
    got, sizes, targets = mixed(docs)
    assert ids(got) == ids(docs.collect())
    assert set(sizes) == {"", "a", "b", None} and all(0 <= r.times <= 2 for r in got)
    for s, t in targets.items():
        assert t <= 2 * sizes[s]
        assert sum(r.size * r.times for r in got if r.source == s) <= 2 * sizes[s]
    assert sorted(map(str, mixed(docs)[0])) == sorted(map(str, got))
    assert mixed(none) == ([], {}, {})


def test_quality(docs, none, labels):
    trees = quality.fit(docs, labels)
    got = quality.verdicts(docs, trees).collect()
    assert ids(got) == ids(docs.collect())
    assert not any(r.kept for r in got if r.base_failed)
    assert quality.keep_good(docs, trees).columns == docs.columns
    assert quality.keep_good(docs, trees).count() == sum(r.kept for r in got)
    assert quality.fit(docs, labels.limit(0)) is None and quality.fit(none, labels) is None
    assert quality.verdicts(none, None).collect() == []
    assert quality.verdicts(docs, None).where("kept = base_failed").count() == 0


def test_secrets(docs, none):
    ratio = secret_scan.train(docs)
    got = secret_scan.scan(docs, ratio).collect()
    assert ids(got) == ids(docs.collect())
    assert [r.doc_id for r in got if r.n_assign] == [10]
    clean = secret_scan.redact(docs, ratio)
    assert clean.columns == docs.columns and clean.count() == docs.count()
    text = clean.where("doc_id = 10").first()
    assert "ab12cd34" not in text.text and text.n_chars == len(text.text)
    assert secret_scan.scan(none, secret_scan.train(none)).collect() == []


def test_near_dedup(docs, none):
    got = near_dedup.groups(docs).collect()
    assert ids(got) == ids(docs.collect())
    component = {r.doc_id: r.component_id for r in got}
    assert component[2] == component[12] == 1 and component[3] == 3 and component[4] == 4 and component[None] is None
    assert {r.doc_id: r.n_shingles for r in got}[5] == 0 and {r.doc_id: r.n_shingles for r in got}[8] == 1
    kept = near_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [-5, 1, 3, 3, 4, 5, 6, 7, 8, 9, 10, 11]
    assert near_dedup.groups(none).collect() == []


def test_lm_score(docs, none):
    got = lm_score.score(docs).collect()
    assert ids(got) == ids(docs.collect())
    empty = next(r for r in got if r.doc_id == 5)
    assert empty.n_tokens == 1 and empty.score < 0
    assert all(r.score < 0 and r.base_score < 0 for r in got)
    assert lm_score.score(none).collect() == []


def test_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0], 7, 1), (2, [2.0, 0.0], 7, 1), (2, [0.0, 3.0], 7, 1), (3, [0.0, 1.0], 7, 1), (4, [0.0, 0.0], 7, 1), (5, None, 7, 1),
            (6, [nan, 1.0], 7, 1), (7, [None, 1.0], 7, 1), (None, [1.0, 0.0], 7, 1), (8, [], 7, 1), (9, [1.0, 0.0], 7, 1), (10, [-1.0, 0.0, 0.0], 7, 1)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id long, n long")
    got = vector_links.links(vectors).collect()
    assert len(got) == len(rows)
    by = sorted((r.vec_id or -1, r.n_links, r.component_id or -1, r.kept) for r in got)
    assert by == [(-1, 0, -1, True), (1, 2, 1, True), (2, 1, 1, False), (2, 2, 1, False), (3, 1, 1, False), (4, 0, 4, True), (5, 0, 5, True),
                  (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 2, 1, False), (10, 0, 10, True)]
    assert vector_links.links(vectors.limit(0)).collect() == []


def test_warc(spark):
    rows = [(1, "http://a.example/x/", "<title>T &amp; U</title><p>one<br>two</p><a href='../y'>z</a><script>bad()</script>", 1), (2, None, None, 1),
            (2, None, None, 1), (None, "no url", "", 1), (3, "http://[bad", "<a href=q>" * 3000 + "<!-- open", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, record_id long")
    got = warc.derivatives(warc.responses(pages)).collect()
    assert len(got) == 2 * len(rows)
    text = next(r for r in got if r.page_id == 1 and r.warc_type == "conversion")
    assert text.block == "T & U\none\ntwo\nz" and text.content_length == len(text.block)
    assert warc.derivatives(warc.responses(pages.limit(0))).collect() == []


def test_stages(spark, docs, none, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for given in (docs, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, given, str(tmp_path))
            assert out.columns == given.columns, name
            assert out.dtypes == given.dtypes, name
            assert out.count() <= 2 * given.count()
