"""Packing: exact ids, gapless windows, little padding, and differencing against its definition."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import packing

rng = random.Random(3)
TEXTS = [None, "", " ", "a", "The end<|endoftext|>. x", "naïve  \n\n  ü" * 50, "あ" * 5000, " ".join(rng.choice(["the", "of", "zzq", "Über", "12"]) for _ in range(9000)), "\n" * 3000, "a" * 3000]
TEXTS += [" ".join(rng.choice(["word", "token", "xq"]) for _ in range(rng.randint(1, 900))) for _ in range(300)]


@pytest.fixture(scope="module")
def encoder():
    found = packing.Encoder(*packing.default_vocabulary())
    assert found.fast is not None
    return found


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=200))
def test_ids_are_those_of_the_tokenizer(encoder, text):
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids


def test_the_tokenizer_is_dropped_after_the_probe_and_read_again():
    found = packing.Encoder(*packing.default_vocabulary())
    assert found.fast is not None and "tokenizer" not in vars(found)
    hard = "a" + " " * 1500 + "b"
    got = np.frombuffer(found.encode(hard), "<u4").tolist()
    assert "tokenizer" in vars(found) and got == found.tokenizer.encode(hard, add_special_tokens=False).ids


def test_every_id_lies_in_one_piece(spark, documents, folder, encoder):
    rows = list(enumerate(TEXTS)) + [(3, "a")]
    got = packing.query(spark, folder(documents(rows))).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, text in enumerate(TEXTS):
        ids = np.array([*encoder.tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        own = pieces[i] if i != 3 else pieces[i][:1]
        for p in sorted(own, key=lambda p: p.start):
            assert p.start == at
            assert p.doc_tokens == len(ids)
            assert p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 1024
    assert len(pieces[3]) == 2
    total = sum(r.length for r in got)
    assert 1024 * len(sequences) <= 1.06 * total + 2 * 1024


def test_ids_column_and_empty_table(documents):
    assert [r.ids for r in packing.packed(documents([(1, "")]), with_ids=True).collect()] == [[0]]
    assert packing.packed(documents([])).count() == 0


def test_differencing_known_case():
    parts = packing.difference([8, 7, 6, 5, 4], 2)
    assert sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in parts) == [14, 16]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 1024), min_size=1, max_size=60))
def test_balance_deals_everything_within_capacity(sizes):
    parts = packing.balance(sizes)
    assert sorted(i for p in parts for i in p) == list(range(len(sizes)))
    assert all(sum(sizes[i] for i in p) <= 1024 for p in parts)


def test_windows_rise_when_capacity_is_exceeded():
    assert len(packing.balance([600, 600, 600])) == 3
