"""The trained operators: n-gram counts against plain Python, held-out accuracy, and what each must not look at."""

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from attesta.llm import importance, language, textvec, toxicity

rng = random.Random(2)


@pytest.fixture(autouse=True)
def seeded():
    """Every test draws the same texts, whichever others run."""
    rng.seed(5)


ODD = [None, "", " ", "123 456", "\U0001f600", "é", "w " * 40000, "x" * 50000]


def syllables(letters):
    return ["".join(rng.choice(letters) for _ in range(3)) for _ in range(40)]


SPEECH = {"xa": syllables("abcde"), "xb": syllables("fghij"), "xc": syllables("aéfük")}


def prose(lang, n):
    return " ".join("".join(rng.choice(SPEECH[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


def test_ngrams_are_those_of_each_text(monkeypatch):
    texts = ["abc", "", "Ab", "é!", "a" * 50, None, "zz"]
    for block in (7, 1 << 20):
        monkeypatch.setattr(textvec, "BLOCK", block)
        data, offsets = textvec.buffers(pa.array(texts))
        for width in (1, 2, 3):
            got = Counter((int(r), int(h)) for row, hashes in textvec.ngrams(data, offsets, width) for r, h in zip(row, hashes, strict=True))
            want = Counter()
            for i, t in enumerate(texts):
                raw = (t or "").lower().encode()
                for j in range(len(raw) - width + 1):
                    want[i, int(textvec.ngram_hashes(np.frombuffer(raw[j : j + width], np.uint8), width)[0])] += 1
            assert got == want


def test_hashing_words_holds_little_beside_its_result():
    data, offsets = textvec.buffers(pa.array(["word " * 200_000] * 2))
    tracemalloc.start()
    textvec.word_hashes(data, offsets)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 15 * len(data)


def test_words_do_not_depend_on_the_batch(monkeypatch):
    texts = ["One two", "two\x0bone ", "", "a" * 40 + " two", "é x two", "two"]
    whole = textvec.word_hashes(*textvec.buffers(pa.array(texts)))
    monkeypatch.setattr(textvec, "BLOCK", 8)
    parts = [textvec.word_hashes(*textvec.buffers(pa.array([t])))[0] for t in texts]
    assert np.concatenate(parts).tolist() == whole[0].tolist()
    assert np.diff(whole[1]).tolist() == [2, 2, 0, 2, 2, 1]
    assert whole[0][1] == whole[0][2] == whole[0][-1]
    cut = textvec.word_hashes(*textvec.buffers(pa.array(["a.b ,c", "###"])), punctuation=True)
    assert np.diff(cut[1]).tolist() == [5, 1]


@pytest.fixture(scope="module")
def spoken():
    rows = [(i, prose(lang, rng.randint(5, 80)), lang) for i, lang in enumerate(rng.choices(list(SPEECH), k=600))]
    return rows + [(1000 + i, t, "xa") for i, t in enumerate(ODD)] + [(5, rows[5][1], rows[5][2]), (2000, "abc", None)]


def test_language_of_held_out_texts(documents, folder, spark, spoken):
    got = language.query(spark, folder(documents(spoken))).collect()
    assert len(got) == len(spoken)
    right = [r.lang_pred == spoken[r.doc_id][2] for r in got if r.doc_id < 600 and r.held_out]
    assert np.mean(right) > 0.97
    by_id = {r.doc_id: r for r in got}
    assert [by_id[1000 + i].lang_pred == "und" for i in range(6)] == [True] * 5 + [False]
    assert all(0 <= r.score <= 1 and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)


def test_language_learns_nothing_from_held_out_rows(documents, spoken):
    docs = documents(spoken)
    swapped = docs.withColumn("lang", F.when(language.held_out(), F.lit("xz")).otherwise(F.col("lang")))
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score) for r in language.identify(df).collect())
    assert key(docs) == key(swapped)


def test_a_rare_language_is_learned_and_found(documents):
    rows = [(i, prose("xa" if i % 3 else "xb", 40), "xa" if i % 3 else "xb") for i in range(1500)] + [(5000 + i, prose("xc", 40), "xc") for i in range(15)]
    docs = documents(rows)
    assert language.train(docs.where(~language.held_out()), 40).langs == ["xa", "xb", "xc"]
    got = [(r.lang_pred, "xc" if r.doc_id >= 5000 else "other") for r in language.identify(docs, 40).collect() if r.held_out]
    assert sum(want == "xc" for _, want in got) > 2
    assert all((pred == "xc") == (want == "xc") for pred, want in got)


def test_languages_are_sampled_evenly_by_smallest_hash(documents):
    docs = documents([(i, "a", ("xa", "xb")[i % 10 == 0]) for i in range(3000)] + [(9000, "a", "xc"), (9000, "a", "xc")])
    chosen, sizes = language.sampled(docs, 90)
    want = {}
    for r in docs.select("lang", "doc_id", F.xxhash64("doc_id").alias("h")).distinct().collect():
        want.setdefault(r.lang, []).append((r.h, r.doc_id))
    assert sorted((r.lang, r.doc_id) for r in chosen.collect()) == sorted((lang, i) for lang, v in want.items() for _, i in sorted(v)[:30])
    assert sizes == {"xa": 2700, "xb": 300, "xc": 2}
    assert language.sampled(docs, 3)[0].count() == 7


def test_language_without_anything_to_learn(documents):
    assert [r.lang_pred for r in language.identify(documents([(1, "abc", None)])).collect()] == ["und"]
    assert language.identify(documents([])).count() == 0


def test_elastic_net_leaves_zeros(monkeypatch):
    monkeypatch.setattr(language, "L1", 8.0)
    x = np.random.default_rng(0).normal(size=(300, 50)).astype(np.float32)
    y = (x[:, 0] > 0).astype(int)
    w = language.ftrl(x, y, 2)
    assert (w[1:-1] == 0).mean() > 0.3
    assert np.abs(w[0]).max() > 5 * np.abs(w[1:-1]).max()


def test_temperature_restores_overconfident_scores():
    r = np.random.default_rng(1)
    true = r.normal(size=(4000, 3))
    y = np.array([r.choice(3, p=p) for p in language.softmax(true)])
    assert language.temperature_of(true * 4, y) == pytest.approx(4, rel=0.15)


INSULTS = ["blockhead", "nitwit", "dunderhead"]


def insulted(text, times):
    words = text.split()
    for _ in range(times):
        words.insert(rng.randrange(len(words) + 1), rng.choice(INSULTS))
    return " ".join(words)


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_toxic_texts_are_found_and_neutral_mentions_left(documents, folder, spark):
    rows, labels = [], []
    for i in range(700):
        toxic = i % 5 == 0
        text = prose("xa", 60)
        if rng.random() < (0.6 if toxic else 0.05):
            text += " muslims"
        rows.append((i, insulted(text, 3) if toxic else text))
        labels.append((i, 1, int(toxic)))
    rows += [(1000 + i, t) for i, t in enumerate(ODD)] + [(3, rows[3][1])] + [(2000 + i, prose("xa", 60) + " muslims") for i in range(50)]
    got = toxicity.query(spark, folder(documents(rows), labelled(spark, labels + [(0, None, None), (None, 1, 1)]))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1
        assert r.predicted == (r.score >= 0.7)
    held = [(r.predicted, int(r.doc_id % 5 == 0)) for r in got if r.held_out and r.doc_id < 700]
    assert np.mean([p for p, t in held if t]) > 0.95
    assert np.mean([p for p, t in held if not t]) < 0.02
    assert not any(r.predicted for r in got if r.doc_id >= 2000)


def test_counterfactual_penalty_shrinks_the_score_change(monkeypatch):
    texts = [("black " if i % 3 else "") + prose("xb", 20) + (" nitwit" if i % 3 else "") for i in range(120)]
    y = np.array([i % 3 > 0 for i in range(120)])

    def change():
        model = toxicity.fit(texts, y)
        at = lambda t: math.log((p := float(model.score(*textvec.buffers(pa.array([t])))[0])) / (1 - p))
        return abs(at("black stuff") - at(toxicity.counterfactual("black stuff")))

    fair = change()
    monkeypatch.setattr(toxicity, "FAIRNESS", 0.0)
    assert fair < 0.2 * change()


def test_counterfactual_keeps_case():
    assert toxicity.counterfactual("Women and men, womenfolk") == "Men and girls, womenfolk"


def test_toxicity_without_labels(documents, spark):
    assert [r.score for r in toxicity.score(documents([(1, "a")]), labelled(spark, [])).collect()] == [0.0]
    assert toxicity.score(documents([]), labelled(spark, [])).count() == 0


def test_junk_is_rejected_and_good_text_kept(documents, folder, spark):
    rows, labels = [], []
    for i in range(500):
        junk = i % 6 == 0
        words = prose("xc", 60).split()
        rows.append((i, " ".join(w + rng.choice(["###", "$$$", "&&&"]) for w in words) if junk and i % 4 else " ".join(w for w in words for _ in range(1 + 8 * junk))))
        labels.append((i, int(not junk), 0))
    rows += [(1000 + i, t) for i, t in enumerate(ODD[:5])]
    docs = documents(rows)
    got = importance.query(spark, folder(docs, labelled(spark, labels[:300]))).collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in range(500) if i % 6 == 0)
    assert np.mean([kept[i] for i in range(500) if i % 6]) > 0.97  # a small corpus: each text weighs much in the raw model
    assert all(kept[1000 + i] for i in range(3))
    again = {r.doc_id: r.kept for r in importance.resample(docs.repartition(5), *(labelled(spark, labels[:300]).where(f"quality = {q}") for q in (1, 0))).collect()}
    assert again == kept
    assert importance.keep_quality(docs, labelled(spark, labels[:300]).where("quality = 1")).columns == docs.columns


@pytest.mark.parametrize("k", [0, 1, 17, 399, 400, 900])
def test_top_k_is_exact(spark, k):
    values = [(i, rng.choice([rng.gauss(0, 1), rng.gauss(0, 1e5), 3.0])) for i in range(400)]
    kept = {r.doc_id for r in importance.top_k(spark.createDataFrame(values, "doc_id long, key double"), k).where("kept").collect()}
    assert kept == {i for i, _ in sorted(values, key=lambda v: (-v[1], v[0]))[:k]}


def test_resampling_without_targets_or_rows(documents, spark):
    none = labelled(spark, []).select("doc_id")
    assert [r.log_weight for r in importance.resample(documents([(1, "a b")]), none).collect()] == [0.0]
    assert importance.resample(documents([]), none).count() == 0
