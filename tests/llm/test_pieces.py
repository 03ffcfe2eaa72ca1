"""SentencePiece encoding by backtracking against the sentencepiece library and against plain merging."""

import hashlib

import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import pieces

LIBRARY = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
MODEL = pieces.model_of(pieces.default_model())
SOME = st.sampled_from(sorted(MODEL.ids)[::7])
TEXTS = st.one_of(
    st.text(max_size=60),
    st.lists(SOME, max_size=12).map("".join),
    st.text(alphabet="ab e.,'\n\t ▁=-é́漢😀\x00#<>0 ", max_size=60),
)


@settings(max_examples=600, deadline=None)
@given(TEXTS)
def test_ids_and_text_are_those_of_the_library(text):
    ids = MODEL.encode(text)
    assert ids == LIBRARY.encode(text)
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 400) | st.integers(0, 31999), max_size=12))
def test_any_ids_decode_as_in_the_library(ids):
    assert MODEL.decode(ids) == LIBRARY.decode(ids)


def merged(model, text):
    """The best pair merges first, the leftmost among equals, until none is left."""
    parts = list(text)
    while True:
        pairs = [(-model.scores[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in model.scores]
        if not pairs:
            return parts
        i = min(pairs)[1]
        parts[i : i + 2] = [parts[i] + parts[i + 1]]


BYTES = [(f"<0x{b:02X}>", 0.0, pieces.BYTE) for b in range(256)]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(alphabet="abc", min_size=2, max_size=5), max_size=14, unique=True), st.lists(st.integers(-4, 0), min_size=14, max_size=14), st.text(alphabet="abcd", max_size=40))
def test_backtracking_equals_merging_for_any_scores(words, scores, text):
    """Also for scores that repeat and for pieces that no merge reaches."""
    known = [(w, float(s), pieces.NORMAL) for w, s in zip(words, scores)] + [(c, -9.0, pieces.NORMAL) for c in "ab"]
    assert pieces.Pieces(BYTES + known).split(text) == merged(pieces.Pieces(BYTES + known), text)


def test_long_texts_without_a_cut():
    for text in ("a" * 50_000, "ab" * 20_000, "=" * 5_000 + "ba" * 5_000, " " * 10_001, "\n" * 4_000, "漢" * 3_000):
        assert MODEL.encode(text) == LIBRARY.encode(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(pieces, "PARTS", 3)
    monkeypatch.setattr(pieces, "PAIRS", 3)
    small = pieces.Pieces.load(pieces.default_model())
    text = "the quick brown fox, the lazy dog; the end of the quick fox " * 5
    assert small.encode(text) == LIBRARY.encode(text)


def test_other_models_are_refused():
    with pytest.raises(ValueError):
        pieces.Pieces([("a", 0.0, pieces.NORMAL)])


def test_rows(spark, documents, folder):
    rows = [(1, None), (2, ""), (3, " two  spaces "), (3, " two  spaces "), (None, "naïve 😀\n"), (4, "word " * 30_000)]
    found = pieces.query(spark, folder(documents(rows).withColumnRenamed("source", "ids"))).collect()
    want = []
    for i, text in rows:
        ids = LIBRARY.encode(text or "")
        want.append((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)
    assert pieces.encoded(documents([])).count() == 0


def test_decoding_gives_the_texts_back(documents):
    texts = {1: "plain text", 2: "", 3: "  two\n\nlines ", 4: "ﬁ é 漢字 \u0000"}
    coded = pieces.encoded(documents(list(texts.items())))
    assert {r.doc_id: r.text for r in pieces.decoded(coded.select("doc_id", "ids")).collect()} == texts
    assert pieces.decoded(coded.selectExpr("doc_id", "cast(null as array<int>) as ids")).where("text is not null").count() == 0


def test_every_document_round_trips(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = {r.doc_id: r for r in pieces.encoded(docs).collect()}
    for r in docs.collect():
        assert found[r.doc_id].ids == LIBRARY.encode(r.text)
        assert found[r.doc_id].decoded == LIBRARY.decode(found[r.doc_id].ids)
