"""The pipeline against its stages done one after the other in plain Python."""

import random

import corpus_pipeline
from attesta.llm import importance, mixing, packing

from .test_classifiers import prose
from .test_near_dedup import brute

rng = random.Random(9)


def test_stages_keep_what_plain_python_keeps(spark, documents, folder):
    rows, labels = [], []
    for i in range(240):
        junk = i % 8 == 0
        text = prose("xb", 70)
        rows.append((i, text.replace(" ", "### ") if junk else text, "en", rng.choice(["a", "a", "b", "c", None])))
        labels.append((i, int(not junk), 0))
    for i in range(240, 300):
        original = rows[rng.choice([j for j in range(240) if j % 8])]
        words = original[1].split()
        if i % 2:
            words[-1] = "changed"
        rows.append((i, " ".join(words), "en", original[3]))
    docs = documents(rows)
    path = folder(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    now, seen = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, path)
        if name != "packing":
            assert now.columns == docs.columns
            seen[name] = sorted(r.doc_id for r in now.collect())
    good = {r.doc_id for r in importance.query(spark, path).collect() if r.kept}
    assert seen["quality_classifier"] == sorted(good)
    assert not any(i % 8 == 0 for i in good if i < 240)
    last = {}
    for i, t, *_ in sorted(r for r in rows if r[0] in good):
        last[t] = i
    assert seen["exact_dedup"] == sorted(last.values())
    left = [(i, t) for t, i in last.items()]
    assert seen["near_dedup"] == sorted(i for i, (_, c) in brute(left, 5, 80).items() if i == c)
    times = {r.doc_id: r.times for r in mixing.repetitions(docs.where(docs.doc_id.isin(seen["near_dedup"]))).collect()}
    assert seen["source_mix"] == sorted(i for i, n in times.items() for _ in range(n))
    texts = {r[0]: r[1] for r in rows}
    encoder = packing.Encoder(*packing.default_vocabulary())
    tokens = sum(n * (len(encoder.tokenizer.encode(texts[i], add_special_tokens=False).ids) + 1) for i, n in times.items())
    assert sum(r.length for r in now.collect()) == tokens
    assert corpus_pipeline.run(spark, path).count() > 0
