"""Collocations against plain counting and SQL; automata against dictionaries of phrases."""

import random
import re
from collections import Counter

import duckdb
import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from attesta.llm import collocations as op
from attesta.llm import transducers
from attesta.llm.transducers import LONGEST, Transducer, united

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, least=10, inside=50, first=2000):
    counts, total = {}, Counter()
    for row in docs:
        lang = row[2] or "und" if len(row) > 2 else "en"
        f = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", (row[1] or "").translate(LOWER)):
            words = re.findall(r"[^ \t]+", piece)
            total[lang] += len(words)
            f.update(tuple(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1))
    rows = []
    for lang, f in counts.items():
        able = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        gone = {part for p, a in able.items() if len(p) == 3 for part in (p[:2], p[1:]) if 100 * a >= inside * f[part]}
        found = []
        for p, a in able.items():
            if p not in gone:
                score, _, k = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:first], 1):
            rows.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(rows)


def run(docs, **options):
    return sorted(map(tuple, op.collocations(docs, **options).collect()))


def some_docs(seed, n=60):
    r = random.Random(seed)
    words = ["The", "cat", "sat", "on", "a", "mat", "É", "naïve", "x\x1cy", "漢字", "new", "york", "city"]
    text = lambda: "".join(r.choice(words) + r.choice([" "] * 8 + ["  ", "\t", ". ", ",", "\n", "!?", " \r\n"]) for _ in range(r.randrange(60)))
    docs = [(i, text(), r.choice(["en", "de", None])) for i in range(n)]
    return docs + [(n, None, "en"), (n + 1, "", None), (n + 2, ".,\n", "fr"), (1, "new york city " * 40, "en"), (1, "new york city " * 40, "en"), (None, "big apple " * 30, "en")]


def test_equals_plain_counting(documents):
    docs = some_docs(1)
    assert run(documents(docs), least=3) == brute(docs, 3)
    assert run(documents(docs), least=2, inside=80, first=5) == brute(docs, 2, 80, 5)


def test_many_ranges_and_shards(documents):
    """Ranges that end within a word's phrases, shards that end within a text: the same rows."""
    docs = some_docs(2)
    frame = documents(docs).repartition(3)
    assert len(op.bounds_of(frame, 200)) > 5
    assert run(frame, least=3, shard=37, size=200) == brute(docs, 3)
    assert run(frame, least=2, shard=1000, size=90) == brute(docs, 2)


def test_one_pair_in_most_places(documents):
    docs = [(i, f"of the thing{i % 7} of the of the. word{i} of the", "en") for i in range(200)]
    assert run(documents(docs), shard=100, size=300) == brute(docs)


def test_empty_and_clashing(documents):
    assert run(documents([])) == []
    docs = some_docs(3)
    frame = documents(docs)
    for name in ("owner", "part", "n", "rank", "phrase", "score", "key"):
        frame = frame.withColumn(name, frame.source)
    assert run(frame, least=3) == brute(docs, 3)


def test_equals_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf0.001/documents.parquet'")
    found = con.execute(op.SQL)
    names = [c[0] for c in found.description]
    got = op.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted(tuple(r[n] for n in names) for r in got) == sorted(found.fetchall())


TABLES = st.dictionaries(st.lists(st.sampled_from([b"a", b"b", b"c", b"dd", b"e\xff"]), min_size=1, max_size=LONGEST).map(tuple), st.integers(1, 3), max_size=40)


def automaton(table):
    words = sorted({w for p in table for w in p} | {b"unused"})
    number = {w: i + 1 for i, w in enumerate(words)}
    items = sorted(table.items())
    grams = np.array([[number[w] for w in p] + [0] * (LONGEST - len(p)) for p, _ in items], np.int32).reshape(-1, LONGEST)
    return Transducer.load(Transducer.build(words, grams, np.array([v for _, v in items], np.int64)).dump())


def table_of(automaton, grams, weights):
    return dict(zip([tuple(p.split(b" ")) for p in automaton.phrases(grams)], weights.tolist()))


@settings(max_examples=200, deadline=None)
@given(TABLES, TABLES)
def test_automata(one, two):
    a, b = automaton(one), automaton(two)
    assert table_of(a, *a.paths()) == one
    grams, left, right = a.compose(b)
    assert table_of(a, grams, left) == {p: n for p, n in one.items() if p in two}
    assert table_of(a, grams, right) == {p: two[p] for p in one if p in two}
    for packed in (transducers.PACKED, 0):  # numbers, and columns beyond their reach
        transducers.PACKED, before = packed, transducers.PACKED
        try:
            words, grams, sums = united([a, b], 2)
        finally:
            transducers.PACKED = before
        whole = Transducer.build(words, grams, sums)
        assert table_of(whole, *whole.paths()) == {p: n for p, n in (Counter(one) + Counter(two)).items() if n >= 2}


def test_equal_states_are_one():
    shared = automaton({(a, b, c): 1 for a in (b"a", b"b") for b in (b"c", b"d") for c in (b"e", b"f")})
    assert len(shared.first) - 1 == 4  # none, after two words, after one, start
