"""Target-distribution importance resampling, with features counted once for every distinct line.

Features are single words and pairs of neighbouring words, hashed to buckets. Texts are cut into lines at newlines, which
no word contains. Equal lines are brought together first; the buckets of a distinct line are computed once and count as
often as the line occurs. Pairs of words across a line's end belong to no line, so they are added document by document.
The same table gives each line's sum of gains once, which its occurrences fetch by the line's key.

The gain of a bucket compares how often it occurs in the target with how often it does in all documents; a document's
weight is the mean gain of its features, and Gumbel noise on top of it draws a share of the documents. Only functions of
the JVM are used. A line may hold any share of all lines: counts are summed before they are shuffled, and lines of more
than one in HOT_SHARE occurrences are joined by broadcast.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import HOT_SHARE, read_table, stored

BUCKETS = 10_000
SHARE, SEED, LEAST_WORDS = 25, 7, 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Java patterns: a character of a word and one between words, of lower-cased text.
INSIDE, OUTSIDE = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]", r"[\x00-\x2F\x3A-\x60\x7B-\x7F]"


def lowered(text: Column) -> Column:
    """A to Z alone in lower case; texts of ASCII characters only take the faster way."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _bucket(feature: Column) -> Column:
    return (F.crc32(feature.cast("binary")) % BUCKETS).cast("int")


def _pairs(left: Column, right: Column) -> Column:
    return F.zip_with(left, right, lambda a, b: _bucket(F.concat(a, F.lit(" "), b)))


def lines_of(texts: DataFrame) -> DataFrame:
    """k1, k2 (hashes of the line), occurrences, n_words and buckets of every distinct line with a word; written."""
    lines = texts.select(F.explode(F.split(lowered(F.col("text")), "\n")).alias("line")).where(F.col("line").rlike(INSIDE))
    distinct = lines.groupBy("line").agg(F.count(F.lit(1)).alias("occurrences"))
    words = distinct.select(*_keys("line"), "occurrences", F.array_remove(F.split("line", f"{OUTSIDE}+"), "").alias("words"))
    n = F.size("words")
    pairs = _pairs(F.slice("words", 1, n - 1), F.slice("words", 2, n - 1))
    return stored(words.select("k1", "k2", "occurrences", n.cast("long").alias("n_words"), F.concat(F.transform("words", _bucket), pairs).alias("buckets")), "lines")


def _keys(line: str) -> tuple[Column, Column]:
    return F.xxhash64(line).alias("k1"), F.xxhash64(F.lit(SEED), line).alias("k2")


def across(text: Column) -> Column:
    """Buckets of the pairs of words with a line's end in between: the last word of a line and the first of the next."""

    def pairs(lines: Column) -> Column:
        n = F.greatest(F.size(lines) - 1, F.lit(0))
        last = F.transform(F.slice(lines, 1, n), lambda x: F.reverse(F.regexp_extract(F.reverse(x), f"{INSIDE}+", 0)))
        return _pairs(last, F.transform(F.slice(lines, 2, n), lambda x: F.regexp_extract(x, f"{INSIDE}+", 0)))

    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(INSIDE))
    return F.get(F.transform(F.array(lines), pairs), 0)


def bucket_counts(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """How often features of ``texts`` fall into each bucket: bucket, n. ``lines`` are the distinct lines of ``texts``."""
    within = lines.select(F.explode("buckets").alias("bucket"), F.col("occurrences").alias("n"))
    between = texts.select(F.explode(across(lowered(F.col("text")))).alias("bucket"), F.lit(1).cast("long").alias("n"))
    return within.unionByName(between).groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(raw: DataFrame, target: DataFrame) -> list[int]:
    """Thousandths of the log ratio of every bucket in target and raw counts, add-one smoothed and floored."""
    table = raw.sparkSession.range(BUCKETS).withColumnRenamed("id", "bucket")
    both = table.join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0, ["s", "t"])
    both = stored(both, "buckets")  # BUCKETS rows
    s, t = both.agg(F.sum("s"), F.sum("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(s + BUCKETS))
    down = (F.col("s") + 1).cast("double") * F.lit(float(t + BUCKETS))
    rows = both.select("bucket", F.floor(1000 * F.log(up / down)).cast("long").alias("gain")).collect()
    return [r.gain for r in sorted(rows)]


def _sum_of(table: list[int], buckets: Column) -> Column:
    values = F.split(F.lit(",".join(map(str, table))), ",").cast("array<long>")
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, bucket: total + F.get(values, bucket))


def weighed(docs: DataFrame, lines: DataFrame, table: list[int]) -> DataFrame:
    """doc_id, text_key, copies (rows with both the same), and words, features and gain of one of them."""
    sums = stored(lines.select("k1", "k2", "occurrences", F.col("n_words").alias("words"), _sum_of(table, F.col("buckets")).alias("gain")), "gains")
    total = sums.agg(F.sum("occurrences")).first()[0] or 0
    is_hot = F.col("occurrences") * HOT_SHARE > F.lit(total)
    hot = F.broadcast(sums.where(is_hot).select("k1", "k2", F.col("words").alias("hot_words"), F.col("gain").alias("hot_gain")))
    cold = sums.where(~is_hot).drop("occurrences")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), lowered(F.col("text")).alias("text"))
    lined = rows.select("doc_id", "text_key", F.posexplode(F.split("text", "\n")).alias("place", "line")).where(F.col("line").rlike(INSIDE))
    keyed = lined.select("doc_id", "text_key", "place", *_keys("line")).join(hot, ["k1", "k2"], "left")
    # what is settled by a hot line keeps away from that line's partition
    spread = keyed.withColumn("k1", F.when(F.col("hot_words").isNull(), F.col("k1")).otherwise(F.xxhash64("doc_id", "text_key", "place")))
    found = spread.join(cold, ["k1", "k2"], "left")
    zero = F.lit(0).cast("long")
    inner = found.select("doc_id", "text_key", zero.alias("copies"), F.coalesce("hot_words", "words").alias("words"), zero.alias("pairs"), F.coalesce("hot_gain", "gain").alias("gain"), F.lit(1).cast("long").alias("lines"))
    ends = rows.select("doc_id", "text_key", across(F.col("text")).alias("buckets"))
    outer = ends.select("doc_id", "text_key", F.lit(1).cast("long").alias("copies"), zero.alias("words"), F.size("buckets").cast("long").alias("pairs"), _sum_of(table, F.col("buckets")).alias("gain"), zero.alias("lines"))
    summed = inner.unionByName(outer).groupBy("doc_id", "text_key").agg(*(F.sum(c).alias(c) for c in ("copies", "words", "pairs", "gain", "lines")))
    # within a line there is a pair less than words
    features = 2 * F.col("words") - F.col("lines") + F.col("pairs")
    return summed.select("doc_id", "text_key", "copies", *(F.expr(f"{c} div copies").alias(c) for c in ("words", "gain")), features.alias("features")).withColumn("features", F.expr("features div copies"))


def noise(seed: int) -> Column:
    """Thousandths of Gumbel noise that depends on the seed and doc_id alone, floored; of no doc_id, on the seed."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def ranked(scored: DataFrame, eligible: Column, share: int) -> DataFrame:
    """``scored`` with ``rank`` of the ``share`` percent highest scores among the eligible rows, null elsewhere.

    Scores are integers between about -80,000 and 80,000 whatever the data, so the counts of all scores, which tell how
    many rows each score has above it, are a table of bounded size. Rows are ordered within their score alone.
    """
    scores = stored(scored.where(eligible).groupBy("score").agg(F.count(F.lit(1)).alias("n")), "scores")
    above = F.sum("n").over(Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1))
    scores = stored(scores.select("score", F.coalesce(above, F.lit(0)).alias("above")), "above")
    drawn = scored.where(eligible).count() * share // 100
    inside = scores.where(F.col("above") < drawn)
    line = inside.agg(F.min("score")).first()[0]
    in_reach = eligible & F.coalesce(F.col("score") >= F.lit(line).cast("long"), F.lit(False))
    place = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("doc_id"), "text_key"))
    upper = scored.where(in_reach).join(F.broadcast(inside), "score").withColumn("rank", F.col("above") + place).drop("above")
    upper = upper.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")).cast("long"))
    return upper.unionByName(scored.where(~in_reach).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, seed: int = SEED, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every row of ``docs`` (doc_id, text); ``target`` has texts.

    Null and empty texts, and those without words, have no features and weight 0. Rows that share an identifier are
    weighed each by its own text and ordered by a hash of it where their scores tie; equal rows get ranks one after the
    other. A null identifier is one, too, and comes last among ties. If documents or target are empty, the other alone
    makes the gains. Other columns are ignored; no rows give no rows.
    """
    texts = docs.select("text")
    goal = target.select("text")
    lines = lines_of(texts)
    table = gains(bucket_counts(texts, lines), bucket_counts(goal, lines_of(goal)))
    mean = F.expr("CASE WHEN features = 0 THEN 0L ELSE (gain - pmod(gain, features)) div features END")
    rows = weighed(docs, lines, table).withColumn("weight", mean).withColumn("score", F.col("weight") + noise(seed))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    scored = stored(rows.select("doc_id", "text_key", "words", F.col("features").alias("n_features"), "weight", "score"), "scored")
    return ranked(scored, F.col("words") >= least_words, share).select("doc_id", "n_features", "weight", "score", "rank")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: Remainders of CRC-32's reflected polynomial by byte, which zlib gives up to its starting and final values.
REMAINDERS = [zlib.crc32(bytes([b ^ 0xFF])) ^ 0xFF000000 for b in range(256)]

SQL = rf"""
WITH words AS (
  SELECT src, id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT 's' AS src, doc_id AS id, text FROM documents UNION ALL SELECT 't', item_id, text FROM benchmark)
),
features AS (
  SELECT src, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS f FROM words
),
hashed AS (
  SELECT f, xor(list_reduce(list_transform(range(1, length(h) // 2 + 1), lambda i: ('0x' || substr(h, 2 * i - 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, ({REMAINDERS}::BIGINT[])[xor(c, b) % 256 + 1]), 4294967295::BIGINT), 4294967295) % {BUCKETS} AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features))
),
counts AS (
  SELECT bucket, count(*) FILTER (src = 's') AS s, count(*) FILTER (src = 't') AS t FROM features JOIN hashed USING (f) GROUP BY bucket
),
totals AS (SELECT sum(s)::DOUBLE AS big_s, sum(t)::DOUBLE AS big_t FROM counts),
gains AS (
  SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (big_s + {BUCKETS}) / ((s + 1)::DOUBLE * (big_t + {BUCKETS}))))::BIGINT AS gain FROM counts, totals
),
sums AS (
  SELECT id, count(*)::BIGINT AS n, sum(gain)::BIGINT AS total FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE src = 's' GROUP BY id
),
scored AS (
  SELECT id AS doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features,
    CASE WHEN n IS NULL THEN 0 ELSE ((total - ((total % n) + n) % n) // n)::BIGINT END AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS noise
  FROM words LEFT JOIN sums USING (id) WHERE src = 's'
),
drawn AS (
  SELECT doc_id, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS place, count(*) OVER () * {SHARE} // 100 AS most
  FROM scored WHERE n_words >= {LEAST_WORDS}
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN place <= most THEN place END::BIGINT AS rank
FROM scored LEFT JOIN drawn USING (doc_id)
"""
