"""Surrogates: every mention replaced in its own form, entities kept apart and together."""

import re

import pytest
from pyspark.sql import functions as F

from attesta.llm import surrogates

MENTIONS = [
    "ann.lee7@mail.example.com", "10.2.33.4", "4111111111111111", "4111-1111-1111-1111", "123-45-6789", "+49 30 1234567", "(555) 123-4567", "Mrs. Anna Schmidt", "Mr Schmidt", "Herr Otto Weber", "г-н Иван Петров", "Sra. Lopez",
]


def replaced(documents, rows, **options):
    return {r.doc_id: (r.n_entities, r.text) for r in surrogates.replaced(documents(rows), **options).collect()}


def luhn(number):
    digits = [int(c) for c in re.sub(r"\D", "", number)][::-1]
    return sum(digits[::2]) + sum(sum(divmod(2 * d, 10)) for d in digits[1::2])


def test_mentions_keep_type_and_form(documents):
    got = replaced(documents, [(i, f"é {m}, x") for i, m in enumerate(MENTIONS)])
    for i, m in enumerate(MENTIONS):
        n, text = got[i]
        assert n == 1, m
        assert text.startswith("é ") and text.endswith(", x")
        fresh = text[2:-3]
        assert fresh != m
        if i in (2, 3, 4, 5, 6):
            assert re.sub("[0-9]", "0", fresh) == re.sub("[0-9]", "0", m)
        if i in (2, 3):
            assert luhn(fresh) % 10 == 0
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}[0-9]@[a-z]{8}\.example", got[0][1][2:-3])
    assert re.sub(r"\D", "", got[2][1]) == re.sub(r"\D", "", got[3][1])
    assert all(1 <= int(o) <= 254 for o in got[1][1][2:-3].split("."))
    address, first, last = got[7][1][2:-3].split()
    assert address == "Mrs." and first in surrogates._FIRST["latin", "f"]
    assert got[8][1][2:-3] == f"Mr {last}"
    assert got[9][1].split()[2] in surrogates._FIRST["latin", "m"]
    assert got[10][1].split()[2] in surrogates._FIRST["cyrillic", "m"]
    assert got[11][1].startswith("é Sra. ")


def test_key_decides_and_reruns_agree(documents):
    rows = [(1, "a@b.example"), (2, "see A@B.example twice a@b.example"), (3, None), (4, ""), (1, "a@b.example"), (5, "w " * 50000 + "1.2.3.4")]
    got = replaced(documents, rows)
    assert got == replaced(documents, rows)
    assert got[1] != replaced(documents, rows, key="other")[1]
    assert got[2][0] == 2 and got[1][1].lower() in got[2][1].lower()
    assert (got[3], got[4]) == ((0, ""), (0, ""))
    assert surrogates.replaced(documents([])).count() == 0


def test_collisions_draw_again(documents, monkeypatch):
    # a surrogate space of a hundred values for thirty entities, some of which are values themselves
    monkeypatch.setattr(surrogates, "surrogate", lambda m, attempt, key: F.concat(F.lit("1.1.1."), (F.xxhash64(surrogates.normal_form(m), attempt) % 50 + 50).cast("string")))
    rows = [(i, f"ip 1.1.1.{i} and 9.9.9.{i}") for i in range(1, 31)] + [(99, "1.1.1.3 1.1.1.3")]
    got = replaced(documents, rows)
    seen = {}
    for i, t in rows:
        for old, new in zip(re.findall(r"[\d.]{7,}", t), re.findall(r"[\d.]{7,}", got[i][1]), strict=True):
            assert seen.setdefault(old, new) == new
    assert len(set(seen.values())) == len(seen) == 60
    assert not set(seen.values()) & set(seen)


def numbered(spark, n):
    """Entities with the shortest phone numbers, of which there are 100,000."""
    return spark.range(n).select(F.format_string("+%05d", "id").alias("normal"), F.concat(F.lit("+"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("mention"))


def test_a_dense_space_is_dealt_out_exactly(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "MOST_ATTEMPTS", 1)
    entities = numbered(spark, 45000)
    again = surrogates.attempts(entities)
    attempt = F.coalesce("attempt", F.lit(0).cast("long"))
    rows = entities.join(again, "normal", "left").select("normal", surrogates.surrogate(F.col("mention"), attempt).alias("fresh")).collect()
    fresh = {r.fresh for r in rows}
    assert len(rows) == len(fresh) == 45000
    assert all(re.fullmatch(r"\+[0-9]{5}", f) for f in fresh)
    assert not fresh & {r.normal for r in rows}


def test_a_full_space_is_an_error(spark, monkeypatch):
    monkeypatch.setattr(surrogates, "MOST_ATTEMPTS", 1)
    with pytest.raises(ValueError, match="unused values"):
        surrogates.attempts(numbered(spark, 55000))


def test_many_first_names_keep_one_surname(documents):
    # 40 men and 40 women of one surname, more than there are first names, and the same in Cyrillic
    names = ["".join(chr(97 + (i * 7 + j * 5) % 26) for j in range(5)).title() + "xyz"[i // 26] for i in range(40)]
    rows = [(2 * i, f"Mr {n} Smith, Mr Smith, Mrs {n} Smith") for i, n in enumerate(names)]
    rows += [(2 * i + 1, f"г-н И{'абвгд'[i % 5]}{'клмн'[i // 5]} Петров и г-н Петров") for i in range(20)]
    got = replaced(documents, rows)
    latin = [re.findall(r"(Mrs?)( [A-Z][a-z]+)? ([A-Z][a-z]+)", got[2 * i][1]) for i in range(40)]
    assert len({s for row in latin for _, _, s in row}) == 1
    assert len({row[0][1] for row in latin}) == len({row[2][1] for row in latin}) == 40
    assert all(row[0][1].strip().startswith(tuple(surrogates._FIRST["latin", "m"])) and row[2][1].strip().startswith(tuple(surrogates._FIRST["latin", "f"])) for row in latin)
    russian = [re.findall(r"г-н( \w+)? (\w+)", got[2 * i + 1][1].replace(" и ", " | ")) for i in range(20)]
    assert len({s for row in russian for _, s in row}) == 1
    assert len({row[0][0] for row in russian}) == 20


def test_surnames_that_collide_draw_again_alike(documents, monkeypatch):
    # one syllable to begin with: 40 surnames for 32 values
    real = surrogates._syllables
    monkeypatch.setattr(surrogates, "_syllables", lambda draw, count, script, place: real(draw, F.greatest(count - 3, F.lit(1)), script, place))
    names = [f"{a}{b}li" for a in "BCDFGHKL" for b in "aeiou"]
    got = replaced(documents, [(i, f"Mr Otto {n}. Mr {n}. Frau {n}.") for i, n in enumerate(names)])
    fresh = [re.findall(r"(\w+)\.", got[i][1]) for i in range(40)]
    assert all(len(f) == 3 and len(set(f)) == 1 for f in fresh)
    assert len({f[0] for f in fresh}) == 40


def test_mentions_of_any_length_go_whole(documents):
    """Local parts, domains and names beyond usual lengths are entities like others."""
    local, name = "a" * 70, "B" + "b" * 45
    host = ".".join(["d" * 70] * 12)
    got = replaced(documents, [(1, f"write {local}@mail.example.com now"), (2, f"to Mr {name} now"), (3, f"at x@{host}.org.")])
    assert [got[i][0] for i in (1, 2, 3)] == [1, 1, 1]
    assert local not in got[1][1] and name[-5:] not in got[2][1] and "ddd" not in got[3][1]
    assert got[1][1].startswith("write ") and got[1][1].endswith(" now") and got[2][1].endswith(" now") and got[3][1].endswith(".")
