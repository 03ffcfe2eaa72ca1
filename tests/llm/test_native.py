"""Secret scan, exact dedup and mixing against plain Python over small tables."""

import hashlib
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from attesta.llm import exact_dedup, mixing, secrets

rng = random.Random(7)
KEY = "".join(rng.choice("0123456789abcdef") for _ in range(40))
B64 = "".join(rng.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(64))
TEXTS = [
    None,
    "",
    " ",
    f"é token = \"{KEY}\" and AKIA{'Q7' * 8} end",
    "secret=token:abcdefg PASSWORD = 'hunter2' passwd: ab ap_key apikey=123456",
    "AKIAKIAQQQQ AKIAZZ " + "a" * 23 + " " + "b" * 24 + " " + "c" * 60,
    f"😀😀 {B64} plain words and words",
    "internationalization0internationalizationinternationalization",
    "0123456789abcdef" * 4,
    "x " * 60000 + "api_key:" + " " * 5 + "zzzzzz",
]


def spans_of(text):
    text = text or ""
    out = []
    for m in re.finditer(r"((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd])|(?:[Pp][Aa][Ss][Ss][Ww][Dd])|(?:[Ss][Ee][Cc][Rr][Ee][Tt])|(?:[Tt][Oo][Kk][Ee][Nn])|(?:[Aa][Pp][Ii]_?[Kk][Ee][Yy]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_spans_equal_plain_regular_expressions(spark, documents, folder):
    docs = documents(list(enumerate(TEXTS)))
    got = {r.doc_id: r for r in secrets.query(spark, folder(docs)).collect()}
    assert len(got) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        want = spans_of(text)
        base = [s for s in got[i].spans.split(",") if s and not s.startswith("random")]
        assert base == want
        assert got[i].base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert got[i].n_assign == sum(w.startswith("assign") for w in want)


def test_random_tokens_are_found_and_structured_ones_left(spark, documents):
    many = [(100 + i, "w" + "".join(rng.choice("etaoinshr") for _ in range(25)) + "1") for i in range(200)]
    found = {r.doc_id: [s for s in r.spans if s.kind == 3] for r in secrets.scan(documents(list(enumerate(TEXTS)) + many)).collect()}
    assert [(s.start, s.stop) for s in found[6]] == [(3, 67)]
    assert not found[7]
    assert not found[8]
    assert sum(bool(found[100 + i]) for i in range(200)) <= 4


def test_scan_of_no_rows(spark, documents):
    assert secrets.scan(documents([])).count() == 0


@pytest.mark.parametrize("keep", ["max", "min"])
def test_exact_groups(documents, keep):
    rows = [(i, rng.choice(["a", "b", "", None, "A", "a "])) for i in range(300)] + [(7, "dup row"), (7, "dup row"), (None, "null id")]
    got = exact_dedup.exact_groups(documents(rows).repartition(7).withColumn("run", F.lit("clash")), keep).collect()
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256((t or "").encode()).hexdigest()].append(i)
    assert len(got) == len(rows)
    for r in got:
        ids = groups[r.text_sha256]
        real = [i for i in ids if i is not None]
        assert r.group_size == len(ids)
        assert r.keep_id == ((max if keep == "max" else min)(real) if real else None)
        assert r.kept == (r.doc_id == r.keep_id)


def test_drop_exact_copies(documents):
    docs = documents([(1, "x"), (2, "x"), (3, "y"), (3, "y"), (4, None), (5, "")])
    assert sorted((r.doc_id, r.text) for r in exact_dedup.drop_exact_copies(docs).collect()) == [(2, "x"), (3, "y"), (5, "")]


def test_exact_groups_of_no_rows(documents):
    assert exact_dedup.exact_groups(documents([])).count() == 0


def fill(sizes, weights=(5, 2, 1), most=3):
    """Water-filling by clamping round after round."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    targets, open_, left = {}, set(names), sum(sizes.values())
    while open_:
        share = {s: left * w[s] / sum(w[t] for t in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return targets | share
        for s in over:
            targets[s] = most * sizes[s]
            left -= targets[s]
            open_.remove(s)
    return targets


@pytest.mark.parametrize("seed", range(4))
def test_mix_meets_targets(documents, seed):
    r = random.Random(seed)
    sources = [None, "a", "b", "c", "é", "z"][: 3 + seed]
    rows = [(i, r.choice([None, "", "w " * r.randint(1, 60)]), "en", r.choices(sources, [1 + 9 * (s == "a") for s in sources])[0]) for i in range(400)]
    docs = documents(rows)
    got = mixing.repetitions(docs).collect()
    sizes = defaultdict(int)
    for _, t, _, s in rows:
        sizes[s] += len((t or "").split())
    want, taken = fill(sizes), defaultdict(int)
    assert len(got) == len(rows)
    for x in got:
        assert x.source_size == sizes[x.source]
        assert x.target == pytest.approx(want[x.source], abs=1e-5)
        assert 0 <= x.times <= 3
        taken[x.source] += x.times * x.size
    for s, t in taken.items():
        assert abs(t - want[s]) <= 60
    again = {(x.doc_id, x.times) for x in mixing.repetitions(docs.repartition(9)).collect()}
    assert again == {(x.doc_id, x.times) for x in got}
    assert mixing.mix(docs).count() == sum(x.times for x in got)


def test_mix_of_no_rows(documents):
    assert mixing.repetitions(documents([])).count() == 0


def test_a_fractional_bound_of_epochs_is_met(documents):
    """The source that is capped at two and a half times its size gets that, by documents taken twice or three times."""
    docs = documents([(i, "one two three four", "en", "a") for i in range(100)] + [(1000 + i, "five six", "en", "b") for i in range(2000)])
    got = [r for r in mixing.repetitions(docs, weights=[5, 1], max_epochs=2.5).collect() if r.source == "a"]
    assert got[0].target == 1000 and abs(sum(r.times * r.size for r in got) - 1000) <= 4
    assert {r.times for r in got} == {2, 3}
