"""Near-duplicate detection against all pairs over small tables."""

import random
import re

import pytest

from attesta.llm import near_dedup, store

rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(900)]


def shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    if len(words) < width:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def brute(rows, width, percent):
    sets = {i: shingles(t, width) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus():
    texts = [None, "", " \t\n", "one", "One", "one two", "one two", "ÄÖ ü", "äö ü", "a b c d e f g h i"]
    passage = [rng.choice(VOCABULARY) for _ in range(60)]
    for size in (8, 30, 120, 400, 3000):
        base = [rng.choice(VOCABULARY) for _ in range(size)]
        for edits in (0, 0, 1, 1, 1, 2, 3, 5, 8, 13):
            words = list(base)
            for _ in range(edits * size // 150 + (edits > 0)):
                words[rng.randrange(len(words))] = rng.choice(VOCABULARY)
            texts.append(" ".join(words))
    base = [rng.choice(VOCABULARY) for _ in range(150)]
    for _ in range(150):
        words = list(base)
        for _ in range(rng.randint(1, 5)):
            words[rng.randrange(150)] = rng.choice(VOCABULARY)
        texts.append("  ".join(words).upper() if rng.random() < 0.3 else " ".join(words))
    for _ in range(80):
        texts.append(" ".join([rng.choice(VOCABULARY) for _ in range(rng.randint(5, 60))] + passage))
    rng.shuffle(texts)
    return [(i * 3 + 1, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize(("width", "percent"), [(3, 85), (5, 80)])
def test_components_equal_all_pairs(documents, width, percent):
    rows = corpus()
    got = near_dedup.near_duplicates(documents(rows).repartition(5), width, percent).collect()
    want = brute(rows, width, percent)
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_shuffled_ids_beyond_the_broadcast_bound(documents, monkeypatch):
    monkeypatch.setattr(store, "BROADCAST_IDS", 0)
    rows = corpus()
    got = near_dedup.near_duplicates(documents(rows), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 3, 85)


def test_long_chain_is_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(10, 70)] + [(5, 200), (3, 3)], "a long, b long")
    got = {r.node: r.component for r in near_dedup.components(edges).collect()}
    assert got == {i: 10 for i in range(10, 71)} | {5: 5, 200: 5}


def test_no_rows(documents):
    assert near_dedup.near_duplicates(documents([])).count() == 0


def test_drop_keeps_columns(documents):
    docs = documents([(1, "a b c d"), (2, "A b c  d"), (3, None), (4, "x")])
    kept = near_dedup.drop_near_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]


@pytest.mark.parametrize("percent", [50, 66, 75, 80, 85])
def test_small_sets_that_link_share_a_run(spark, percent):
    # every pair of sets over nine values, so wherever the values that only one of them has may lie
    sets = {mask: [v for v in range(9) if mask >> v & 1] for mask in range(1, 512)}
    heads = spark.createDataFrame([(m, len(v), v) for m, v in sets.items()], "doc_id long, n long, sketch array<long>")
    keys = {m: set() for m in sets}
    for r in near_dedup._keyed(heads, percent).collect():
        keys[r.doc_id].add(r.key)
    linked = [(a, b) for a in sets for b in range(1, a) if 100 * (a & b).bit_count() >= percent * (a | b).bit_count()]
    assert linked
    assert not [p for p in linked if not keys[p[0]] & keys[p[1]]]


def test_eight_words_and_one_more(documents):
    own = random.Random(4)
    rows = []
    for i in range(0, 240, 2):
        words = [f"{own.choice(VOCABULARY)}{i}" for _ in range(9)]
        rows += [(i, " ".join(words[:8])), (i + 1, " ".join(words if i % 4 else words[8:] + words[:8]))]
    got = near_dedup.near_duplicates(documents(rows), 5, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute(rows, 5, 80)
    assert sum(r.kept for r in got) == 120
