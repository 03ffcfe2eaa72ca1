"""Phrase collocation mining with weighted acyclic automata.

Every task reads its texts in shards of bounded size, sorts the phrases of up to three words and builds an automaton of
their counts. All phrases, in order, are divided into ranges with about equal numbers; each shard's automaton is cut by
these and the cuts of one range are united, weights summed, by whichever task owns the range. Phrases that are rare
everywhere are gone then, since whole counts are known.

To score a phrase its parts' counts are needed, which other ranges own. A range asks each owner with an automaton of the
parts it needs; the owner composes it with its own and sends the weights back. The question also carries how often the
longest phrase with that part occurs, so the owner finds out which of its phrases are mostly part of a longer one.

A frequent phrase is one path of each shard's automaton, and a range may end between any two phrases, so no word, pair
or language makes a range large.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read_table, stored
from .transducers import LONGEST, Transducer, summed, united

LEAST, INSIDE, FIRST = 10, 50, 2000
UNKNOWN = "und"
#: Places in texts that make a shard, and occurrences of phrases that make a range: both bound the memory of a task. The
#: ends of ranges are sent to all tasks, so a larger input on larger executors wants a larger RANGE.
SHARD, RANGE = 1_000_000, 4_000_000
#: Phrases sampled for each range to find its ends; the ends move work between tasks and no result.
SAMPLES = 100
#: Parts that a language's phrases are dealt to before they are ordered.
DEALT = 32
_BREAK = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t" + _BREAK, b"abcdefghijklmnopqrstuvwxyz " + b"\n" * len(_BREAK))
Bound = tuple  # (lang, word, ...) in bytes


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def bounds_of(docs: DataFrame, size: int = RANGE) -> list[Bound]:
    """Where ranges of about ``size`` occurrences begin, by a sample of phrases whose number follows the ranges'."""
    texts = _texts(docs)
    letters = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-letters // (2 * size)))  # about six bytes a word, three phrases a word
    if ranges == 1:
        return []
    rate = SAMPLES * ranges / letters

    def work(batches):
        for batch in batches:
            found = []
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode().translate(_PLAIN)
                rng = np.random.default_rng(zlib.crc32(raw))
                for place in rng.integers(0, max(len(raw), 1), rng.poisson(rate * len(raw))).tolist():
                    start = max(raw.rfind(b" ", 0, place), raw.rfind(b"\n", 0, place)) + 1
                    words = [w for w in raw[start : start + 300].split(b"\n", 1)[0].split(b" ") if w]
                    found.append([lang.encode(), *words[: 1 + int(rng.integers(LONGEST))]])
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.binary()))], names=["phrase"])

    sample = sorted(tuple(r.phrase) for r in texts.mapInArrow(work, "phrase array<binary>").collect())
    return sorted({tuple(map(bytes, sample[k * len(sample) // ranges])) for k in range(1, ranges)} - {()}) if sample else []


def _cut(lang: bytes, words: list[bytes], grams: np.ndarray, bounds: list[Bound]) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of ``grams``, which are in order, for each range that has some."""
    first, last = bisect.bisect_left(bounds, (lang,)), bisect.bisect_left(bounds, (lang + b"\0",))
    ends = []
    for bound in bounds[first:last]:
        low, high = 0, len(grams)
        for k, word in enumerate(bound[1 : 1 + LONGEST]):  # narrows down to the phrases that begin like the bound
            place = bisect.bisect_left(words, word)
            column = grams[low:high, k]
            low, high = low + int(np.searchsorted(column, place + 1)), low + int(np.searchsorted(column, place + 1 + (place < len(words) and words[place] == word)))
            if low == high:
                break
        ends.append(low)
    for k, (a, b) in enumerate(zip([0, *ends], [*ends, len(grams)])):
        if a < b:
            yield first + k, a, b


def _counted(words: list[bytes], numbers: np.ndarray, starts: int) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that begin at the first ``starts`` places, in order, with counts; number 0 ends a piece of text."""
    padded = np.concatenate([numbers, np.zeros(LONGEST, numbers.dtype)])
    wide = np.stack([padded[k : k + starts] for k in range(LONGEST)], axis=1)
    wide[:, 1:][np.logical_or.accumulate(wide == 0, axis=1)[:, 1:]] = 0
    wide = wide[wide[:, 0] > 0]
    one, two = wide.copy(), wide[wide[:, 1] > 0]
    one[:, 1:] = 0
    three = two[two[:, 2] > 0]
    two = two.copy()
    two[:, 2] = 0
    grams = np.concatenate([one, two, three])
    return summed(grams, np.ones(len(grams), np.int64), len(words))


def _shards(bounds: list[Bound], shard: int):
    """Rows of the automata of bounded shards, cut by range: owner, lang, part."""

    def one(lang: str, texts: list[bytes]):
        tokens = [w for w in b"\n".join(texts).replace(b"\n", b" \n ").split(b" ") if w]
        for at in range(0, len(tokens), shard):
            some = tokens[at : at + shard + LONGEST - 1]
            coded = pa.array(some, pa.large_binary()).dictionary_encode()
            known = coded.dictionary.to_pylist()
            order = sorted((i for i in range(len(known)) if known[i] != b"\n"), key=known.__getitem__)
            rank = np.zeros(len(known), np.int32)
            rank[order] = np.arange(1, len(order) + 1)
            words = [known[i] for i in order]
            grams, counts = _counted(words, rank[coded.indices.to_numpy()], min(shard, len(tokens) - at))
            for owner, a, b in _cut(lang.encode(), words, grams, bounds):
                yield owner, lang, Transducer.build(words, grams[a:b], counts[a:b]).dump()

    def work(batches):
        held, size = {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                raw = text.encode().translate(_PLAIN)
                held.setdefault(lang, []).append(raw)
                size += len(raw) + 100
                if size > 6 * shard:
                    for key, texts in held.items():
                        yield from _rows(one(key, texts))
                    held, size = {}, 0
        for key, texts in held.items():
            yield from _rows(one(key, texts))

    return work


def _rows(rows) -> Iterator[pa.RecordBatch]:
    for owner, lang, part in rows:
        yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([lang], pa.string()), pa.array([part], pa.binary())], names=["owner", "lang", "part"])


def phrase_counts(docs: DataFrame, bounds: list[Bound], least: int = LEAST, shard: int = SHARD) -> DataFrame:
    """owner, lang, part (the automaton of the range's phrases that occur ``least`` times), words (all that it counted); written."""
    shards = _texts(docs).mapInArrow(_shards(bounds, shard), "owner long, lang string, part binary")

    def unite(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for lang, some in rows.groupby("lang", sort=True):
            words, grams, sums = united([Transducer.load(p) for p in some.part])
            enough = sums >= least
            single = (grams[:, 1] == 0) if len(grams) else np.zeros(0, bool)
            out.append((int(rows.owner.iloc[0]), lang, Transducer.build(words, grams[enough], sums[enough]).dump(), int(sums[single].sum())))
        return pd.DataFrame(out, columns=["owner", "lang", "part", "words"])

    return stored(shards.groupBy("owner").applyInPandas(unite, "owner long, lang string, part binary, words long"), "phrases")


def _long(automaton: Transducer) -> tuple[np.ndarray, np.ndarray]:
    grams, weights = automaton.paths()
    several = grams[:, 1] > 0
    return grams[several], weights[several]


def _parts(grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Beginnings and ends of all cuts of phrases, and the row of each; of up to three words, all parts of two are such."""
    found, rows = [np.zeros((0, LONGEST), grams.dtype)], [np.zeros(0, np.int64)]
    for size in range(2, LONGEST + 1):
        of = np.flatnonzero((grams > 0).sum(axis=1) == size)
        for k in range(1, size):
            for a, b in ((0, k), (k, size)):
                part = np.zeros((len(of), LONGEST), grams.dtype)
                part[:, : b - a] = grams[of, a:b]
                found.append(part)
                rows.append(of)
    return np.concatenate(found), np.concatenate(rows)


def asked(owned: DataFrame, bounds: list[Bound]) -> DataFrame:
    """owner, lang, source, part: what ``source`` asks the owner; a part weighs 1, of two words also its longest phrase's count."""

    def work(batches):
        for batch in batches:
            for source, lang, raw in zip(*(batch.column(k).to_pylist() for k in range(3))):
                own = Transducer.load(raw)
                grams, counts = _long(own)
                parts, rows = _parts(grams)
                weights = 1 + np.where(parts[:, 1] > 0, counts[rows], 0)
                order = np.lexsort((weights, *parts.T[::-1]))
                parts, weights = parts[order], weights[order]
                last = np.flatnonzero(np.append((parts[1:] != parts[:-1]).any(axis=1), True)) if len(parts) else []
                parts, weights = parts[last], weights[last]  # the largest weight of each part
                for owner, a, b in _cut(lang.encode(), own.words, parts, bounds):
                    part = Transducer.build(own.words, parts[a:b], weights[a:b]).dump()
                    yield pa.RecordBatch.from_arrays([pa.array([owner], pa.int64()), pa.array([lang], pa.string()), pa.array([source], pa.int64()), pa.array([part], pa.binary())], names=["owner", "lang", "source", "part"])

    return owned.select("owner", "lang", "part").mapInArrow(work, "owner long, lang string, source long, part binary")


def answered(owned: DataFrame, questions: DataFrame, inside: int = INSIDE) -> DataFrame:
    """owner (who asked), lang, part with counts; and for owners themselves, marked, phrases that longer ones contain."""

    def reply(key, own: pd.DataFrame, asks: pd.DataFrame) -> pd.DataFrame:
        parts = dict(zip(own.lang, map(Transducer.load, own.part)))
        out = []
        for lang, source, raw in zip(asks.lang, asks.source, asks.part):
            ask = Transducer.load(raw)
            grams, asking, counts = ask.compose(parts[lang])
            order = np.lexsort(grams.T[::-1])
            out.append((source, lang, False, Transducer.build(ask.words, grams[order], counts[order]).dump()))
            within = order[(100 * (asking - 1) >= inside * counts)[order]]
            if len(within):
                out.append((key[0], lang, True, Transducer.build(ask.words, grams[within], np.ones(len(within), np.int64)).dump()))
        return pd.DataFrame(out, columns=["owner", "lang", "contained", "part"])

    owned, questions = owned.select("owner", "lang", "part"), questions.select("owner", "lang", "source", "part")
    return stored(owned.groupBy("owner").cogroup(questions.groupBy("owner")).applyInPandas(reply, "owner long, lang string, contained boolean, part binary"), "answers")


def scored(owned: DataFrame, answers: DataFrame) -> DataFrame:
    """lang, phrase, a, l, r, score of every phrase that no longer one contains, by its lowest-scoring cut."""

    def work(key, own: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        counts, contained = {}, set()
        for lang, marked, raw in zip(told.lang, told.contained, told.part):
            automaton = Transducer.load(raw)
            grams, weights = automaton.paths()
            names = automaton.phrases(grams)
            if marked:
                contained.update((lang, name) for name in names)
            else:
                counts.update(((lang, name), weight) for name, weight in zip(names, weights.tolist()))
        out = []
        for lang, raw in zip(own.lang, own.part):
            automaton = Transducer.load(raw)
            grams, weights = _long(automaton)
            for name, a in zip(automaton.phrases(grams), weights.tolist()):
                if (lang, name) in contained:
                    continue
                words = name.split(b" ")
                cuts = ((counts[lang, b" ".join(words[:k])], counts[lang, b" ".join(words[k:])]) for k in range(1, len(words)))
                score, _, left, right = min((1_000_000 * a * a // (left * right), k, left, right) for k, (left, right) in enumerate(cuts))
                out.append((lang, name.decode(), a, left, right, score))
        return pd.DataFrame(out, columns=["lang", "phrase", "a", "l", "r", "score"])

    owned = owned.select("owner", "lang", "part")
    return owned.groupBy("owner").cogroup(answers.groupBy("owner")).applyInPandas(work, "lang string, phrase string, a long, l long, r long, score long")


def collocations(docs: DataFrame, least: int = LEAST, inside: int = INSIDE, first: int | None = FIRST, shard: int = SHARD, size: int = RANGE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's ``first`` phrases (None: all, without rank).

    ``docs`` has text and lang. A null lang is ``und``; null and empty texts have no words; repeated rows count each time;
    ties are ordered by count and phrase; other columns are ignored, whatever their names; no rows give no rows. Texts of
    any length are read whole, a shard at a time.
    """
    bounds = bounds_of(docs, size)
    owned = phrase_counts(docs, bounds, least, shard)
    found = scored(owned, answered(owned, asked(owned, bounds), inside))
    total = owned.groupBy("lang").agg(F.sum("words").alias("n"))
    if first is None:
        return found.join(total, "lang").select("lang", "phrase", "a", "l", "r", "n", "score")
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    deal = found.withColumn("deal", F.pmod(F.xxhash64("phrase"), F.lit(DEALT)))
    some = deal.withColumn("place", F.row_number().over(Window.partitionBy("lang", "deal").orderBy(*order))).where(F.col("place") <= first)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))


SQL = rf"""
WITH pieces AS (
  SELECT coalesce(lang, '{UNKNOWN}') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
found AS (
  SELECT lang, unnest(list_concat(list_transform(w, lambda x: [x]), list_transform(range(1, len(w)), lambda i: w[i:i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]))) AS p FROM words
),
counts AS (SELECT lang, p, count(*) AS f FROM found GROUP BY lang, p),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, p, f AS a FROM counts WHERE len(p) > 1 AND f >= {LEAST}),
cuts AS (SELECT lang, p, a, unnest(range(1, len(p))) AS k FROM candidates),
cut_scores AS (
  SELECT c.lang, c.p, c.a, c.k, x.f AS l, y.f AS r, (1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS score
  FROM cuts c JOIN counts x ON x.lang = c.lang AND x.p = c.p[:c.k] JOIN counts y ON y.lang = c.lang AND y.p = c.p[c.k + 1:]
),
best AS (SELECT * FROM cut_scores QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
longer AS (
  SELECT lang, part, max(a) AS most FROM (SELECT lang, p[1:2] AS part, a FROM candidates WHERE len(p) = 3 UNION ALL SELECT lang, p[2:3], a FROM candidates WHERE len(p) = 3) GROUP BY lang, part
),
kept AS (
  SELECT b.*, array_to_string(b.p, ' ') AS phrase FROM best b LEFT JOIN longer o ON o.lang = b.lang AND o.part = b.p WHERE o.most IS NULL OR 100 * o.most < {INSIDE} * b.a
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM kept JOIN totals USING (lang) QUALIFY rank <= {FIRST}
"""
