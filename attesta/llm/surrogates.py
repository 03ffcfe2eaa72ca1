"""Surrogates for personal data: keyed, type-consistent replacements that keep distinctness and coreference.

Detected entities are e-mail and IPv4 addresses, card, phone and social-security numbers, and names after a form of
address. A replacement depends on the key, the type and the entity's normal form alone (digits of numbers, lower case of
the rest), so every mention of an entity gets the same one in its own formatting. Numbers keep their separators, cards a
valid check digit, addresses their shape; a name keeps its form of address and gets a first name of the gender that this
says and a surname, both in the script of the original.

Surnames are settled first, in a table of their own: distinct ones stay distinct and none is an original, so a person
named with and without the first name keeps one surname. A full name that collides draws only its first name again.

Distinct entities stay distinct: the table of all of them is searched for equal replacements and for replacements that
are originals elsewhere. Of equal ones the smallest entity keeps its own, the others draw again with the next attempt,
until nothing collides. Where the space of a shape is so dense that MOST_ATTEMPTS rounds leave some over (phone numbers of
five digits), these get the unused values of their shape, one each, in keyed order; if there are too few, that is an
error. Only entities that drew again need their attempt looked up; all others are replaced in place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read_table, small_enough, stored, text_or_empty

KEY = "surrogate-key-1"
MOST_ATTEMPTS = 50
#: A name's attempt holds that of its surname, times this, and that of its first name.
SURNAMES = 1000

_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"
_CARD = r"(?<![0-9])(?:[0-9]{16}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])"
_SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
_PHONE = r"(?<![0-9A-Za-z+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])"
#: Forms of address by gender.
_MALE, _FEMALE, _ANY = ("Mr", "Herr", "Monsieur", "Sr", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Mme", "Sra", "г-жа"), ("Dr", "Prof")
_ADDRESS = "(?:" + "|".join(sorted((*_MALE, *_FEMALE, *_ANY), key=len, reverse=True)) + r")\.?"
_NAME = r"(?<![\p{L}])" + _ADDRESS + r" \p{Lu}\p{L}++(?: \p{Lu}\p{L}++)?"
PATTERN = "|".join((_EMAIL, _IP, _CARD, _SSN, _PHONE, _NAME))

#: First names by script and gender, and the syllables of surnames.
_FIRST = {
    ("latin", "m"): "Adam Ben Carl David Emil Frank Hugo Ivan Jonas Karl Leo Martin Noah Oscar Paul Simon".split(),
    ("latin", "f"): "Alma Berta Clara Dora Elsa Flora Greta Helen Irma Julia Karin Laura Marta Nora Olga Rosa".split(),
    ("cyrillic", "m"): "Андрей Борис Виктор Денис Иван Максим Николай Олег".split(),
    ("cyrillic", "f"): "Анна Вера Галина Дарья Елена Ирина Мария Ольга".split(),
}
_SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha ho ka ke ko la le lo ma me mo na ne no ra re ro sa se so ta to".split(),
    "cyrillic": "ба бо ва во га го да до жа за зо ка ко ла ло ма мо на но па по ра ро са со та то фа хо ча ша ло".split(),
}
_LETTERS, _CYRILLIC = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя"


def entity_type(match: Column) -> Column:
    full = lambda p: match.rlike(f"^(?:{p})$")
    return F.when(match.contains("@"), "email").when(full(_IP), "ip").when(full(_CARD), "card").when(full(_SSN), "ssn").when(full(_PHONE), "phone").otherwise("name")


def normal_form(match: Column) -> Column:
    """What makes two mentions one entity."""
    digits = F.regexp_replace(match, "[^0-9+]", "")
    return F.when(entity_type(match).isin("card", "ssn", "phone"), digits).otherwise(F.lower(F.regexp_replace(match, r"\. ", " ")))


def _bytes(match: Column, attempt: Column, key: str, salt: str = "") -> Column:
    """64 keyed bytes in hex, by type and normal form."""
    return F.sha2(F.concat_ws("|", F.lit(key + salt), entity_type(match), normal_form(match), attempt.cast("string")), 512)


def _byte(draw: Column, place: Column) -> Column:
    """The byte at a place (taken modulo 60) as a number, a little over one byte wide so that remainders are even."""
    return F.conv(F.substr(draw, (place % 60) * 2 + 1, F.lit(8)), 16, 10).cast("long")


def _shaped(text: Column, draw: Column) -> Column:
    """Digits become digits, letters letters of their case and script; the rest stays. Numbers count digits alone."""
    chars = F.split(text, "")

    def one(c: Column, i: Column) -> Column:
        n = _byte(draw, i)
        letter = F.substr(F.lit(_LETTERS), (n % 26 + 1).cast("int"), F.lit(1))
        cyrillic = F.substr(F.lit(_CYRILLIC), (n % len(_CYRILLIC) + 1).cast("int"), F.lit(1))
        return F.when(c.rlike("[0-9]"), (n % 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).when(c.rlike(r"\p{IsCyrillic}"), cyrillic).otherwise(c)

    return F.array_join(F.transform(chars, one), "")


def _renumbered(text: Column, draw: Column, attempt: Column, checked: bool) -> Column:
    """Keyed digits in the formatting of ``text``; with a Luhn check digit if ``checked``.

    A negative attempt names a value: -1 is the number 0.
    """
    digits = F.regexp_replace(text, "[^0-9]", "")
    places = F.sequence(F.lit(1), F.length(digits))
    fresh = F.transform(places, lambda i: _byte(draw, i) % 10)
    if checked:
        head = F.slice(fresh, 1, F.size(fresh) - 1)
        doubled = F.transform(F.reverse(head), lambda d, i: F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
        total = F.aggregate(doubled, F.lit(0).cast("long"), lambda s, d: s + d)
        fresh = F.concat(head, F.array((10 - total % 10) % 10))
    else:
        named = F.lpad((-1 - attempt).cast("string"), F.length(digits), F.lit("0"))
        fresh = F.when(attempt < 0, F.transform(F.split(named, ""), lambda d: d.cast("long"))).otherwise(fresh)
    # every character with the number of digits up to it
    chars = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.struct(F.substr(text, i, F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substr(text, F.lit(1), i), "[^0-9]", "")).alias("n")))
    return F.array_join(F.transform(chars, lambda x: F.when(x["c"].rlike("[0-9]"), F.element_at(fresh, x["n"]).cast("string")).otherwise(x["c"])), "")


def _syllables(draw: Column, count: Column, script: str, place: int) -> Column:
    """So many keyed syllables, of bytes five places apart; at most 12."""
    pick = lambda i: F.element_at(F.array(*map(F.lit, _SYLLABLES[script])), (_byte(draw, i * 5 + place) % 32 + 1).cast("int"))
    return F.array_join(F.transform(F.sequence(F.lit(1), count), pick), "")


def _of_word(word: Column, attempt: Column, key: str) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lower(word), attempt.cast("string")), 512)


def _surname(word: Column, attempt: Column, key: str) -> Column:
    """A surname in the script of the word, by the word and its attempt alone; one syllable more each attempt."""
    draw, count = _of_word(word, attempt, key + "last"), F.least(attempt + 4, F.lit(12)).cast("int")
    return F.initcap(F.when(word.rlike(r"\p{IsCyrillic}"), _syllables(draw, count, "cyrillic", 0)).otherwise(_syllables(draw, count, "latin", 0)))


def _named(match: Column, attempt: Column, key: str) -> Column:
    """Form of address, first name by its gender, surname; the surname depends on the surname and its own attempt alone,
    so that a person named with and without the first name keeps it. First names drawn again are longer."""
    address = F.regexp_extract(match, f"^{_ADDRESS}", 0)
    words = F.split(F.trim(F.substr(match, F.length(address) + 1)), " ")
    family = F.element_at(words, -1)
    cyrillic = family.rlike(r"\p{IsCyrillic}")
    title = F.regexp_replace(address, r"\.", "")
    own = attempt % SURNAMES
    first = _of_word(F.element_at(words, 1), own, key + "first")
    pick = lambda names: F.element_at(F.array(*map(F.lit, names)), (_byte(first, F.lit(1)) % len(names) + 1).cast("int"))
    by_gender = lambda s: F.when(title.isin(*_MALE), pick(_FIRST[s, "m"])).when(title.isin(*_FEMALE), pick(_FIRST[s, "f"])).otherwise(pick(_FIRST[s, "m"] + _FIRST[s, "f"]))
    longer = lambda s: F.when(own > 0, _syllables(first, F.least(own, F.lit(10)).cast("int"), s, 1)).otherwise("")
    given = F.when(cyrillic, F.concat(by_gender("cyrillic"), longer("cyrillic"))).otherwise(F.concat(by_gender("latin"), longer("latin")))
    return F.concat_ws(" ", address, F.when(F.size(words) > 1, given), _surname(family, F.floor(attempt / SURNAMES), key))


def _address(n: Column) -> Column:
    """The n-th IPv4 address of octets from 1 to 254."""
    return F.concat_ws(".", *((F.floor(n / F.lit(254**i)) % 254 + 1).cast("string") for i in (3, 2, 1, 0)))


def surrogate(match: Column, attempt: Column, key: str = KEY) -> Column:
    """The replacement of a mention, in its own formatting."""
    draw = _bytes(match, attempt, key)
    local = F.substring_index(match, "@", 1)
    kind = entity_type(match)
    octets = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (_byte(draw, i * 7) % 254 + 1).cast("string")), ".")
    octets = F.when(attempt < 0, _address(-1 - attempt)).otherwise(octets)
    return (
        F.when(kind == "email", F.concat(_shaped(local, draw), F.lit("@"), _shaped(F.lit("aaaaaaaa"), _bytes(match, attempt, key, "host")), F.lit(".example")))
        .when(kind == "ip", octets)
        .when(kind == "card", _renumbered(match, draw, attempt, True))
        .when(kind.isin("ssn", "phone"), _renumbered(match, draw, attempt, False))
        .otherwise(_named(match, attempt, key))
    )


def _colliding(drawn: DataFrame, originals: DataFrame) -> DataFrame:
    """(normal) of the rows of (normal, attempt, fresh) whose replacement is an original or another row's."""
    # the entity that keeps a replacement: an earlier one if any, else the smallest
    taken = drawn.groupBy("fresh").agg(F.min(F.struct("attempt", "normal")).alias("first"), F.count(F.lit(1)).alias("n"))
    bad = drawn.join(taken.where("n > 1"), "fresh").where("normal <> first.normal").select("normal")
    return stored(bad.unionByName(drawn.join(originals, "fresh", "left_semi").select("normal")).distinct(), "colliding")


def _spread(now: DataFrame) -> DataFrame:
    """Dealt by normal into all shuffle partitions: few bytes of entities cost many draws."""
    return now.repartition(int(now.sparkSession.conf.get("spark.sql.shuffle.partitions")), "normal")


def _settled(now: DataFrame, fresh: Column, originals: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``now`` with fresh and the attempt it comes from, and (normal) of what MOST_ATTEMPTS draws leave colliding."""
    drawn = stored(_spread(now).withColumn("fresh", fresh), "drawn")
    for _ in range(MOST_ATTEMPTS):
        bad = _colliding(drawn, originals)
        if not bad.limit(1).count():
            break
        again = _spread(drawn.join(bad, "normal", "left_semi")).withColumn("attempt", F.col("attempt") + 1).withColumn("fresh", fresh)
        drawn = stored(drawn.join(bad, "normal", "left_anti").unionByName(again.select(drawn.columns)), "drawn")
    else:
        bad = _colliding(drawn, originals)
    return drawn, bad


def _ranked(values: DataFrame, key: str) -> DataFrame:
    """``values`` with rank, from 1 in the keyed order of normal; ranks are counted in 4096 parts."""
    mixed = F.sha2(F.concat_ws("|", F.lit(key + "rank"), "normal"), 256)
    rows = stored(values.withColumn("mixed", mixed).withColumn("part", F.substring("mixed", 1, 3)), "ranked")
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n")
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", before.alias("before"))
    own = F.row_number().over(Window.partitionBy("part").orderBy("mixed", "normal"))
    return rows.join(F.broadcast(sizes), "part").withColumn("rank", own + F.col("before")).drop("mixed", "part", "before")


def _assigned(drawn: DataFrame, bad: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """(normal, attempt) of the entities of ``bad``: unused values of their shape, by negative attempts.

    Draws leave something over only where about a third of a shape's values are taken, so listing all is in proportion.
    """
    kind = entity_type(F.col("mention"))
    shape = F.when(kind == "ip", "ip").when(kind.isin("ssn", "phone"), F.regexp_replace("normal", "[0-9]", "0")).otherwise(kind)
    left = stored(drawn.join(bad, "normal", "left_semi").select("normal", shape.alias("shape")), "left")
    used = drawn.join(bad, "normal", "left_anti").select("fresh").unionByName(originals)
    found = None
    for r in left.groupBy("shape").agg(F.count(F.lit(1)).alias("n")).orderBy("shape").collect():
        digits = r["shape"].count("0")
        if r["shape"] != "ip" and not 0 < digits <= 18:
            raise ValueError(f"{r.n} entities of the type {r['shape']} collide after {MOST_ATTEMPTS} draws")
        spark = drawn.sparkSession
        if r["shape"] == "ip":
            values = spark.range(254**4).withColumn("fresh", _address(F.col("id")))
        else:
            values = spark.range(10**digits).withColumn("fresh", F.concat(F.lit(r["shape"].rstrip("0")), F.lpad(F.col("id").cast("string"), digits, "0")))
        free = _ranked(values.join(used, "fresh", "left_anti").select("id", F.col("fresh").alias("normal")), key)
        own = _ranked(left.where(F.col("shape") == r["shape"]).select("normal"), key)
        dealt = stored(own.join(free.select("id", "rank"), "rank").select("normal", (-1 - F.col("id")).alias("attempt")), "dealt")
        if dealt.count() < r.n:
            raise ValueError(f"{r.n} entities of the shape {r['shape']} have only {dealt.count()} unused values left")
        found = dealt if found is None else found.unionByName(dealt)
    return found


def attempts(entities: DataFrame, key: str = KEY) -> DataFrame:
    """(normal, attempt) of the entities whose first replacement is taken; ``entities`` has normal and mention, one row each."""
    originals = entities.select(F.col("normal").alias("fresh"))
    surname = F.when(entity_type(F.col("mention")) == "name", F.substring_index("normal", " ", -1))
    surnames = entities.select(surname.alias("normal")).where("normal IS NOT NULL").distinct()
    surnames = stored(surnames.withColumn("attempt", F.lit(0).cast("long")), "surnames")
    family, bad = _settled(surnames, F.lower(_surname(F.col("normal"), F.col("attempt"), key)), surnames.select(F.col("normal").alias("fresh")))
    if bad.limit(1).count():
        raise ValueError(f"{bad.count()} surnames collide after {MOST_ATTEMPTS} draws")
    redrawn = small_enough(stored(family.where("attempt > 0").select(F.col("normal").alias("surname"), (F.col("attempt") * SURNAMES).alias("attempt")), "redrawn"))
    now = entities.withColumn("surname", surname).join(redrawn, "surname", "left").select("normal", "mention", F.coalesce("attempt", F.lit(0).cast("long")).alias("attempt"))
    drawn, bad = _settled(now, normal_form(surrogate(F.col("mention"), F.col("attempt"), key)), originals)
    again = drawn.where("attempt > 0").select("normal", "attempt")
    if bad.limit(1).count():
        again = again.join(bad, "normal", "left_anti").unionByName(_assigned(drawn, bad, originals, key))
    return again


def replaced(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's text with surrogates: doc_id, n_entities, text.

    Null and empty texts stay as empty text without entities. Repeated rows are replaced alike; no rows give no rows;
    other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    has = F.col("text").rlike(PATTERN)
    plain = rows.where(~has).select("doc_id", F.lit(0).alias("n_entities"), "text")
    found = rows.where(has).withColumn("mentions", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).withColumn("row", F.monotonically_increasing_id())
    found = stored(found, "mentioned")
    each = found.select("row", F.explode("mentions").alias("mention")).withColumn("normal", normal_form(F.col("mention")))
    entities = stored(each.groupBy("normal").agg(F.min("mention").alias("mention")), "entities")
    again = stored(attempts(entities, key), "attempts")
    if again.limit(1).count():
        own = each.join(small_enough(again), "normal").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("normal", "attempt"))).alias("redrawn"))
        found = found.join(own, "row", "left")
    else:
        found = found.withColumn("redrawn", F.lit(None).cast("map<string,bigint>"))
    attempt = lambda m: F.coalesce(F.try_element_at(F.col("redrawn"), normal_form(m)), F.lit(0).cast("long"))
    fresh = F.transform("mentions", lambda m: surrogate(m, attempt(m), key))
    gaps = F.split("text", PATTERN, -1)
    woven = F.concat(F.array_join(F.zip_with(F.slice(gaps, 1, F.size("mentions")), fresh, lambda g, s: F.concat(g, s)), ""), F.element_at(gaps, -1))
    return plain.unionByName(found.select("doc_id", F.size("mentions").alias("n_entities"), woven.alias("text")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replaced(read_table(spark, sf_dir, "documents"))
