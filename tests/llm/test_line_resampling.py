"""Target-distribution resampling against plain Python and against its SQL."""

import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import pytest

from attesta.llm import line_resampling as op

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans(op.UPPER, op.LOWER)


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [zlib.crc32(f.encode()) % 10000 for f in words + [f"{a} {b}" for a, b in zip(words, words[1:])]]


def brute(docs, target, share=25, seed=7, least=20):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (big_s + 10000) / ((s[b] + 1.0) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for i, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    for place, r in enumerate(able[: len(able) * share // 100], 1):
        r[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, documents, docs, target, **options):
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    return sorted(map(tuple, op.resample(documents(docs), goal, **options).collect()), key=str)


PROSE = "The quick, brown fox\njumps over\n\nthe lazy dog. And THEN naïve Ünder 42\n...\nit sleeps for a long while in the sun, one two three"
DOCS = [
    (1, PROSE),
    (2, PROSE),
    (3, None),
    (4, ""),
    (5, "\n\n . , \n"),
    (6, "one"),
    (7, "one\ntwo\nthree\nfour\nfour\nfour"),
    (8, ("licence line here\n" * 40)),
    (9, "a\r\nb\x0bc d\te " * 30),
    (10, "É é Ａ \U0001f600 x y " * 8),
    (None, PROSE + " more"),
    (-5, "word " * 5000),
]
TARGET = ["the quick brown fox", "licence\nline here", None, ""]


def test_equals_plain_python(spark, documents):
    assert run(spark, documents, DOCS, TARGET) == brute(DOCS, TARGET)


def test_options(spark, documents):
    found = run(spark, documents, DOCS, TARGET, share=60, seed=3, least_words=1)
    assert found == brute(DOCS, TARGET, 60, 3, 1)
    assert sum(r[4] is not None for r in found) == 9 * 60 // 100


def test_repeated_identifiers_and_rows(spark, documents):
    """Rows of one identifier are weighed by their own texts; equal rows keep one row each, ranked one after the other."""
    docs = [(1, PROSE), (1, PROSE), (1, "other " + PROSE), (2, None), (2, None)]
    found = run(spark, documents, docs, TARGET, share=100)
    assert [r[:4] for r in found] == [r[:4] for r in sorted(brute(docs, TARGET, 100), key=str)]
    assert sorted(r[4] for r in found if r[4]) == [1, 2, 3]


def test_empty_tables(spark, documents):
    assert run(spark, documents, [], TARGET) == []
    assert run(spark, documents, DOCS, []) == brute(DOCS, [])
    assert run(spark, documents, [(1, None)], [None]) == brute([(1, None)], [])


def test_clashing_columns(spark, documents):
    docs = documents(DOCS)
    for name in ("line", "words", "k1", "gain", "rank", "copies", "text_key"):
        docs = docs.withColumn(name, docs.lang)
    goal = spark.createDataFrame([(t,) for t in TARGET], "text string")
    assert sorted(map(tuple, op.resample(docs, goal).collect()), key=str) == brute(DOCS, TARGET)


def test_line_in_a_third_of_all_documents(spark, documents):
    """Lines beyond the share that is joined by broadcast, next to lines that are not."""
    docs = [(i, f"common line\nline number {i}\n" + "common line\n" * (i % 3)) for i in range(1500)]
    assert run(spark, documents, docs, ["common line", "number 7"], least_words=5) == brute(docs, ["common line", "number 7"], least=5)


@pytest.mark.parametrize("scale", ["sf0.001"])
def test_equals_sql(spark, scale):
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '/root/testdata/{scale}/{name}.parquet'")
    found = con.execute(op.SQL)
    names = [c[0] for c in found.description]
    got = op.query(spark, f"/root/testdata/{scale}")
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
