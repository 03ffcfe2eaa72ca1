"""Secret scan: fixed patterns, and a randomness test battery over the tokens that no pattern knows.

Patterns give the kinds ``assign``, ``access`` and ``hex``. Besides them, every run of 20 or more characters of the
base-64 alphabets that mixes digits and letters is a candidate of kind ``random``. Its encoding is inferred from its
characters, and three statistics are computed over the symbols of that encoding:

* chi-squared of the symbol counts against a uniform alphabet;
* runs above and below the middle of the alphabet (Wald-Wolfowitz);
* lag-one serial correlation of the symbol values.

The null hypothesis is a token of prose, whose symbols repeat as those of text do: its chi-squared is noncentral, with a
noncentrality that grows with the length. A token is evidence against it if its chi-squared is small for that, so long
random strings get tiny p-values and short ones none, which is how length enters. Tokens with too few or many runs, or
correlated neighbours, are not random at all and drop out. Of the rest, the Benjamini-Hochberg procedure, run within
length bands over all documents at once, keeps the false discovery rate at ``FDR``. It works on counts of binned
p-values (at most BANDS x BINS rows), so no task sees all tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import read_table, stored, text_or_empty

#: The three patterns of the base kinds, in the order of the kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"

FDR = 0.01
#: Length bands of the false-discovery control: up to each bound, and beyond the last.
BANDS = (24, 32, 48, 64)
#: Bins of -log10(p), BIN_WIDTH wide; the last holds all smaller p-values.
BINS = 1200
BIN_WIDTH = 0.05
#: |z| beyond which runs or serial correlation speak against randomness (two-sided 0.001).
STRUCTURE_Z = 3.29
#: Chance that two symbols of prose are equal, by which counts of prose symbols exceed uniform ones.
PROSE_COINCIDENCE = 0.066

SPAN = "array<struct<kind:int,start:int,stop:int>>"


def _ends(gaps: Column, found: Column) -> Column:
    """Where each match ends, in code points: the lengths of all gaps and matches up to it."""
    steps = F.zip_with(F.slice(gaps, 1, F.size(found)), found, lambda g, m: F.length(g) + F.length(m))
    return F.aggregate(
        steps,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends")),
        lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")),
        lambda s: s["ends"],
    )


def _matches(text: str, pattern: str, kind: int, least: Column | None = None) -> Column:
    """Spans of a pattern's leftmost, non-overlapping matches; ``least`` maps text and pattern to lengths to keep."""
    column = F.col(text)
    found = F.regexp_extract_all(column, F.lit(pattern), F.lit(0))
    ends = _ends(F.split(column, pattern, -1), found)
    spans = F.zip_with(found, ends, lambda m, e: F.struct(F.lit(kind).alias("kind"), (e - F.length(m)).alias("start"), e.alias("stop")))
    if least is not None:
        spans = F.transform(F.filter(F.arrays_zip(spans.alias("span"), least.alias("n")), lambda x: x["n"] >= 6), lambda x: x["span"])
    return F.when(column.rlike(pattern), spans).otherwise(F.array().cast(SPAN))


def base_spans(text: str) -> Column:
    """All spans of the base kinds (0 assign, 1 access, 2 hex), by start and then kind."""
    values = F.transform(F.regexp_extract_all(F.col(text), F.lit(ASSIGN), F.lit(2)), lambda v: F.length(v))
    spans = F.concat(_matches(text, ASSIGN, 0, values), _matches(text, ACCESS, 1), _matches(text, HEX, 2))
    return F.transform(
        F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))),
        lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop")),
    )


def _normal_cdf(z: Column) -> Column:
    """By the error function's approximation of Abramowitz and Stegun, 7.1.26."""
    x = F.abs(z) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * x)
    tail = 0.5 * t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-x * x)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def _encoding(alphabet: str, excess: float | None = None) -> Column:
    """An alphabet, and by how much the chi-squared of prose in it exceeds that of random symbols, per symbol."""
    return F.struct(F.lit(alphabet).alias("alphabet"), F.lit(len(alphabet) * PROSE_COINCIDENCE - 1 if excess is None else excess).alias("excess"))


def inferred_encoding(token: Column) -> Column:
    """The smallest alphabet that holds the token. Hexadecimal prose is taken to be decimal digits."""
    return (
        F.when(token.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), _encoding("0123456789abcdef", 0.6))
        .when(token.rlike("^[A-Z2-7]+=*$"), _encoding("abcdefghijklmnopqrstuvwxyz234567"))
        .when(token.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$"), _encoding("0123456789abcdefghijklmnopqrstuvwxyz"))
        .otherwise(_encoding("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"))
    )


def battery(tokens: DataFrame, token: str = "token") -> DataFrame:
    """Adds ``p``, the p-value of a table's tokens as prose (null: has structure, so isn't random), and ``band``."""
    word = F.col(token)
    plain = F.translate(F.regexp_replace(word, "=+$", ""), "-_", "+/")
    alphabet, k = F.col("_e.alphabet"), F.length("_e.alphabet").cast("double")
    folded = F.when(k < 64, F.lower(plain)).otherwise(plain)
    places = F.filter(F.transform(F.split(folded, ""), lambda c: F.instr(F.col("_e.alphabet"), c) - 1), lambda i: i >= 0)
    df = tokens.withColumn("_e", inferred_encoding(word)).withColumn("_x", places).withColumn("_n", F.size("_x").cast("double"))
    n = F.col("_n")
    squares = F.aggregate(F.sequence(F.lit(0), F.length(alphabet) - 1), F.lit(0.0), lambda s, i: s + F.pow(F.size(F.filter("_x", lambda x: x == i)).cast("double"), F.lit(2.0)))
    df = df.withColumn("_chi", squares * k / n - n)
    # runs of the upper and lower half of the alphabet
    high = F.transform("_x", lambda x: x * 2 >= F.length(F.col("_e.alphabet")))
    df = df.withColumn("_h", high).withColumn("_n1", F.size(F.filter("_h", lambda h: h)).cast("double"))
    turns = F.zip_with(F.slice("_h", 2, F.size("_h")), F.slice("_h", 1, F.greatest(F.size("_h") - 1, F.lit(0))), lambda a, b: (a != b).cast("int"))
    n1, n2 = F.col("_n1"), n - F.col("_n1")
    mean_runs = 2 * n1 * n2 / n + 1
    spread = F.sqrt(F.greatest((mean_runs - 1) * (mean_runs - 2) / F.greatest(n - 1, F.lit(1.0)), F.lit(1e-9)))
    df = df.withColumn("_runs_z", (F.aggregate(turns, F.lit(1), lambda s, t: s + t) - mean_runs) / spread)
    # serial correlation of neighbours, in units of its standard deviation 1 / sqrt(n)
    mean = F.aggregate("_x", F.lit(0.0), lambda s, x: s + x) / n
    df = df.withColumn("_d", F.transform("_x", lambda x: x - mean))
    cross = F.zip_with(F.slice("_d", 2, F.size("_d")), F.slice("_d", 1, F.greatest(F.size("_d") - 1, F.lit(0))), lambda a, b: a * b)
    power = F.aggregate("_d", F.lit(0.0), lambda s, x: s + x * x)
    df = df.withColumn("_serial_z", F.aggregate(cross, F.lit(0.0), lambda s, x: s + x) / F.greatest(power, F.lit(1e-9)) * F.sqrt(n))
    # lower tail of the noncentral chi-squared, by the cube-root approximation of Abdel-Aty
    free, beyond = k - 1, n * F.col("_e.excess")
    centre, shape = free + beyond, 2 * (free + 2 * beyond) / (9 * F.pow(free + beyond, F.lit(2.0)))
    z = (F.pow(F.greatest(F.col("_chi"), F.lit(0.0)) / centre, F.lit(1 / 3)) - (1 - shape)) / F.sqrt(shape)
    random = (F.abs("_runs_z") < STRUCTURE_Z) & (F.abs("_serial_z") < STRUCTURE_Z)
    band = sum((F.length(word) > b).cast("int") for b in BANDS)
    return df.withColumn("p", F.when(random, _normal_cdf(z))).withColumn("band", band).drop("_e", "_x", "_n", "_chi", "_h", "_n1", "_runs_z", "_d", "_serial_z")


def false_discovery_bins(tokens: DataFrame, rate: float = FDR) -> DataFrame:
    """(band, least_bin): the Benjamini-Hochberg threshold of every length band, from (band, bin) of all tokens.

    Tokens with structure count among the tests (their bin is null). A bin passes if the largest p-value in it is at
    most rate * rank / tests, where rank counts all tokens up to it; this is the exact procedure but for the rounding
    of p-values up to the bin's edge.
    """
    counts = tokens.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    tests = F.sum("n").over(Window.partitionBy("band"))
    rank = F.sum("n").over(Window.partitionBy("band").orderBy(F.col("bin").desc_nulls_last()))
    passed = counts.withColumn("tests", tests).withColumn("rank", rank).where(F.pow(F.lit(10.0), -BIN_WIDTH * F.col("bin")) <= rate * F.col("rank") / F.col("tests"))
    return passed.groupBy("band").agg(F.min("bin").alias("least_bin"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = FDR) -> DataFrame:
    """One row per row of ``docs``: doc_id, spans (array of kind, start, stop; code points, end exclusive).

    Kinds are 0 assign, 1 access, 2 hex and 3 random; spans are ordered by start, then kind. Random tokens that overlap
    a base span are part of it and not listed again. Null and empty texts have no spans; repeated rows are scanned each;
    other columns are ignored; no rows give no rows.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    found = rows.withColumn("base", base_spans("text")).select("doc_id", "base", _candidates("text", F.col("base")).alias("tokens"))
    found = stored(found.withColumn("row", F.monotonically_increasing_id()), "scanned")
    tokens = battery(found.where(F.size("tokens") > 0).select("row", F.inline("tokens")))
    bin_of = F.when(F.col("p").isNotNull(), F.least(F.floor(-F.log10(F.greatest("p", F.lit(1e-300))) / BIN_WIDTH), F.lit(BINS))).cast("int")
    tested = stored(tokens.withColumn("bin", bin_of).select("row", "start", "stop", "band", "bin"), "tested")
    secret = tested.join(F.broadcast(false_discovery_bins(tested, rate)), "band").where(F.col("bin") >= F.col("least_bin"))
    extra = secret.groupBy("row").agg(F.collect_list(F.struct(F.lit(3).alias("kind"), "start", "stop")).alias("extra"))
    spans = F.array_sort(F.transform(F.concat("base", F.coalesce("extra", F.array().cast(SPAN))), lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop"))))
    return found.join(extra, "row", "left").select("doc_id", F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["stop"].alias("stop"))).alias("spans"))


def _candidates(text: str, base: Column) -> Column:
    """Runs of token characters with digits and letters, outside base spans: (token, start, stop)."""
    column = F.col(text)
    found = F.regexp_extract_all(column, F.lit(CANDIDATE), F.lit(0))
    ends = _ends(F.split(column, CANDIDATE, -1), found)
    spans = F.zip_with(found, ends, lambda m, e: F.struct(m.alias("token"), (e - F.length(m)).alias("start"), e.alias("stop")))
    mixed = F.filter(spans, lambda s: s["token"].rlike("[0-9]") & s["token"].rlike("[A-Za-z]"))
    outside = F.filter(mixed, lambda s: ~F.exists(base, lambda b: (b["start"] < s["stop"]) & (s["start"] < b["stop"])))
    return F.when(column.rlike(CANDIDATE), outside).otherwise(F.array().cast("array<struct<token:string,start:int,stop:int>>"))


KINDS = ("assign", "access", "hex", "random")


def _joined(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read_table(spark, sf_dir, "documents"))
    number = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        number(0).alias("n_assign"),
        number(1).alias("n_access"),
        number(2).alias("n_hex"),
        F.sha2(_joined(F.filter("spans", lambda s: s["kind"] < 3)), 256).alias("base_sha256"),
        _joined(F.col("spans")).alias("spans"),
        number(3).alias("n_random"),
    )
