"""Near-duplicate documents: bottom-k sketches of one hash function, inverted lists, exact verification.

A document's set is its distinct word shingles, each hashed to 64 bits; its sketch is the ``SKETCH`` smallest. Rows with
equal sets become one class at once, named by its first row, so that identifiers may be null or occur with several texts.
Two sets with a Jaccard similarity of at least the threshold share nearly all retained values, so the inverted lists are
kept over runs of ``RUN`` consecutive retained values: such sets share a run almost surely (missing one has a chance
below 1e-8 at a similarity of 0.85), while a passage that many documents share rarely fills a run. Small sets that could
miss each other are listed by shorter runs too (at 0.8 those of 4 and 5 values, by runs of two), so that of sets of up to
SKETCH values no pair is missed at any threshold.

Long lists are never expanded into all pairs at once:

1. every member is compared with the leader of its list, the member with the smallest name;
2. in lists of over ``LONG`` members that rounds of contracting these links leave apart, every member is compared with
   up to ``LEADERS`` more leaders, each the first of a share of the list, in two of its lists;
3. members who are apart even then are compared with each other inside the join, at the first of neighbouring runs that
   they share. Lists beyond ``BLOCK`` members are dealt into shares, and every two shares meet in a task's group of their
   own, so each pair meets once and no group exceeds two blocks.

A pair must pass three tests, the dear ones last: sizes and the parity signature (1024 bits, each toggled by the shingles
that fall on it; two sets cannot differ in fewer shingles than their signatures differ in bits, so no link is lost), then
the union sketch (the smallest SKETCH values of both sketches estimate the similarity; the margin is six standard
deviations), then the full sets. Only what passes the first two is joined with full sets.

Joins are between written tables or plain shuffles of them, which adaptive execution splits where a key is hot.
Components of the links come from star contractions, each round written to the shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from .store import attach_groups, read_table, settled, small_enough, stored
from .textvec import buffers, mix64, shingle_hashes, slices, word_hashes

SKETCH = 40
RUN = 3
WORDS = 16
LONG = 32
LEADERS = 32
BLOCK = 2048
_MARKS = ["n", *(f"p{i}" for i in range(WORDS))]
_FEATURES = "doc_id long, text_key long, n long, set_a long, set_b long, sketch array<long>, parity array<long>"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _sets(batch, width: int):
    """Per row, the sorted distinct shingle hashes, of 63 bits so that Spark orders them alike."""
    words, starts = word_hashes(*buffers(batch.column(1)))
    shingles, at = shingle_hashes(words, starts, width)
    shingles >>= np.uint64(1)
    return (np.unique(shingles[at[i] : at[i + 1]]) for i in range(batch.num_rows))


def _ragged(parts: list[np.ndarray]) -> pa.Array:
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(at), pa.array(_signed(np.concatenate(parts)) if parts else np.zeros(0, np.int64)))


def _parity(values: np.ndarray) -> np.ndarray:
    odd = (np.bincount((values >> np.uint64(13)).astype(np.int64) % (64 * WORDS), minlength=64 * WORDS) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.uint64)


def features(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, n, set_a, set_b, sketch, parity): a hash of the text, the set's size and 128-bit hash, and what
    pairs are found by."""

    def work(batches):
        for batch in slices(batches):
            n, a, b, sketch, parity = [], [], [], [], []
            for values in _sets(batch, width):
                mixed = mix64(values)
                n.append(len(values))
                a.append(int(_signed(mixed.sum(dtype=np.uint64, keepdims=True))[0]))
                b.append(int(_signed(mix64(mixed + np.uint64(0xD1B54A32D192ED03)).sum(dtype=np.uint64, keepdims=True))[0]))
                sketch.append(values[:SKETCH])
                parity.append(_parity(values))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(n, pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), _ragged(sketch), _ragged(parity)], names=["doc_id", "text_key", "n", "set_a", "set_b", "sketch", "parity"])

    return _keyed_texts(docs, id_col, text_col).mapInArrow(work, _FEATURES)


def _keyed_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("text_key"))


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of all rows of (class, text)."""

    def work(batches):
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), _ragged(list(_sets(batch, width)))], names=["class", "shingles"])

    return texts.select("class", "text").mapInArrow(work, "class long, shingles array<long>")


def _may_link(percent: int, a: str, b: str) -> Column:
    """Necessary for a link: sizes within the threshold, and few enough differing bits."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    bits = sum(F.bit_count(F.col(f"{a}.p{i}").bitwiseXOR(F.col(f"{b}.p{i}"))) for i in range(WORDS))
    return (100 * F.least(na, nb) >= percent * F.greatest(na, nb)) & (bits * (100 + percent) <= (100 - percent) * (na + nb))


def _estimate(a: Column, b: Column) -> Column:
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, SKETCH)
    return F.size(F.array_intersect(F.array_intersect(union, a), b)) / F.size(union)


def _likely(pairs: DataFrame, heads: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b, ...) that pass sizes, parity and the estimate of their union sketch, written."""
    least = percent / 100 - 6 * (percent / 100 * (1 - percent / 100) / SKETCH) ** 0.5
    x, y = heads.alias("x"), heads.alias("y")
    met = pairs.join(x, F.col("a") == F.col("x.class")).join(y, F.col("b") == F.col("y.class"))
    return stored(met.where(_may_link(percent, "x", "y")).where(_estimate(F.col("x.sketch"), F.col("y.sketch")) >= least).select(pairs.columns), "likely")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The rows of ``pairs`` whose a and b are linked by their full sets."""
    whole = lambda x: sets.select(F.col("class").alias(x), F.col("shingles").alias(f"w{x}"))
    common = F.size(F.array_intersect("wa", "wb"))
    exact = 100 * common >= percent * (F.size("wa") + F.size("wb") - common)
    return pairs.join(whole("a"), "a").join(whole("b"), "b").where(exact).select(pairs.columns)


def _lowest(edges: DataFrame) -> DataFrame:
    """(node, m): the smallest b of every a."""
    return stored(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")), "lowest")


def contracted(edges: DataFrame, rounds: int | None = None) -> DataFrame:
    """Edges (a, b), a > b, with the same components, after so many rounds, or until every a points at its smallest node.

    A round is a large-star and a small-star contraction: every node's larger, then its smaller neighbours are linked to
    its smallest one. A node that is the smallest of its neighbours changes nothing in the first step, so the hub of a
    star is looked up and never gathered. A round that moves nothing is the last; about log(diameter) are needed.
    """
    now = stored(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    if now.isEmpty():
        return now
    done = 0
    while rounds is None or done < rounds:
        low, up, down = _lowest(now), Observation(), Observation()
        raised = now.join(low, now["b"] == low["node"], "left").observe(up, F.count("m").alias("n"))
        raised = raised.select("a", F.coalesce("m", "b").alias("b")).unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
        large = stored(raised, "large")
        low = _lowest(large)
        moved = large.join(low, large["a"] == low["node"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = moved.observe(down, F.count("a").alias("n")).unionByName(low.select(F.col("node").alias("a"), F.col("m").alias("b")))
        now = stored(small.distinct(), "edges")
        done += 1
        if not up.get["n"] and not down.get["n"]:
            break
    return now


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of (a, b) edges; the component is its smallest node."""
    stars = contracted(edges)
    return stars.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(stars.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def near_rows(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs``: doc_id, text_key, n, component (an identifier) and stays, true for one row of a component."""
    rows = stored(features(docs, width, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "features")
    key = ["n", "set_a", "set_b"]
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    classes = stored(rows.where("n > 0").groupBy(*key).agg(F.min("row").alias("class"), best.alias("best"), F.count(F.lit(1)).alias("members")), "classes")
    found = stored(components(_links(_keyed_texts(docs, id_col, text_col), rows, classes, width, percent)), "found")
    named = stored(classes.join(found.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class")), "named")
    least = stored(named.groupBy("component").agg(F.min("best").alias("best"), F.sum("members").alias("size")).where("size > 1"), "least")
    groups = stored(named.select(*key, "members", "component").join(least.select("component", F.col("best.doc_id").alias("least_id"), F.col("best.row").alias("first_row")), "component"), "groups")
    joined = attach_groups(rows.select("doc_id", "text_key", "row", *key), groups, key, "members", rows.count())
    alone = F.col("first_row").isNull()
    return joined.select("doc_id", "text_key", "n", F.when(alone, F.col("doc_id")).otherwise(F.col("least_id")).alias("component"), (alone | (F.col("row") == F.col("first_row"))).alias("stays"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with the smallest identifier reachable over links: doc_id, n_shingles, component_id, kept.

    Words are runs without ASCII white space, A-Z lower-cased; a set holds the distinct runs of ``width`` words, or the
    whole sequence of a shorter text. Sets are linked if 100 * intersection >= ``percent`` * union. Null texts and texts
    without words have an empty set and link with nothing. Rows are told apart even where they repeat an identifier:
    each is returned, with the component of its own text. Null identifiers lose against any other; a component that has
    no other keeps one of its rows and has a null component_id. No rows give no rows; other columns are ignored.
    """
    found = near_rows(docs, width, percent, id_col, text_col)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("component") == F.col("doc_id"), F.col("stays")).alias("kept"))


def _shorter_runs(percent: int) -> dict[int, list[int]]:
    """The sizes of the sets that need runs of fewer than RUN values, by the length of the run.

    Of ``common`` values that ``other`` ones cut into at most other + 1 parts, the largest part has at least
    (common - 1) // (other + 1) + 1; a run of that length is shared wherever the others lie.
    """
    sizes: dict[int, set[int]] = {}
    for common in range(1, SKETCH + 1):
        for other in range(1, SKETCH + 1):
            length = (common - 1) // (other + 1) + 1
            if 100 * common >= percent * (common + other) and length < RUN:
                sizes.setdefault(length, set()).update(range(common, min(common + other, SKETCH) + 1))
    return {length: sorted(found) for length, found in sizes.items()}


def _keyed(heads: DataFrame, percent: int, name: str = "doc_id") -> DataFrame:
    """(name, key, before) of every run of (name, n, sketch): its hash and that of the run one value earlier."""

    def runs(length: int) -> Column:
        last = F.greatest(F.size("sketch") - length + 1, F.lit(1))
        run = lambda i: F.xxhash64(F.slice(F.col("sketch"), i, length))
        return F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(run(i).alias("key"), F.when(i > 1, run(F.greatest(i - 1, F.lit(1)))).alias("before")))

    every = runs(RUN)
    for length, sizes in _shorter_runs(percent).items():
        every = F.when(F.col("n").isin(sizes), F.concat(every, runs(length))).otherwise(every)
    return heads.select(name, F.inline(every))


def _links(texts: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Links (a, b) between classes, enough of them that every link's ends are connected."""
    firsts = rows.join(classes.select("class"), F.col("row") == F.col("class")).where(F.col("n") * (100 - percent) >= percent)
    heads = stored(firsts.select("class", "doc_id", "text_key", "n", "sketch", *(F.col("parity")[i].alias(f"p{i}") for i in range(WORDS))), "heads")
    keyed = _keyed(heads, percent, "class")
    leaders = stored(keyed.groupBy("key").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("length")).where("length > 1"), "leaders")
    listed = stored(keyed.join(leaders, "key"), "lists")
    starred = stored(listed.select(F.col("class").alias("a"), F.col("leader").alias("b")).where("a <> b").distinct(), "starred")
    sets = stored(_sets_of(texts, heads, listed, width), "sets")
    first = stored(_verified(_likely(starred, heads, percent), sets, percent), "links")

    # rounds of contracting join most of what belongs together; equal labels always do
    joined = contracted(first, 2)
    apart = stored(_apart(listed, joined), "apart")
    if apart.where(F.col("length") > LONG).limit(1).count():
        more = _verified(_likely(_with_leaders(apart, _labelled(heads, joined), percent), heads, percent), sets, percent)
        joined = contracted(joined.unionByName(more.select(F.col("la").alias("a"), F.col("lb").alias("b"))), 2)
        apart = stored(_apart(apart, joined), "apart")
    crossed = stored(_crossed(apart.join(_labelled(heads, joined), "class"), percent), "crossed")
    between = _verified(_likely(crossed, heads, percent), sets, percent)
    return joined.unionByName(between.select(F.greatest("la", "lb").alias("a"), F.least("la", "lb").alias("b")).distinct())


def _sets_of(texts: DataFrame, heads: DataFrame, listed: DataFrame, width: int) -> DataFrame:
    """(class, shingles) of the listed classes, from the text of the row that names each."""
    known = stored(heads.select("class", "doc_id", "text_key").join(listed.select("class").distinct(), "class", "left_semi"), "listed")
    k, t = small_enough(known).alias("k"), texts.alias("t")
    own = t.join(k, F.col("t.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("t.text_key") == F.col("k.text_key")))
    return full_sets(own.select(F.col("k.class").alias("class"), F.col("t.text").alias("text")), width).dropDuplicates(["class"])


def _labelled(heads: DataFrame, joined: DataFrame) -> DataFrame:
    """class and marks of ``heads`` with l, a node that contracted edges connect the class with; itself if there is none."""
    label = _lowest(joined).select(F.col("node").alias("class"), F.col("m").alias("l"))
    marks = [c for c in heads.columns if c in ("class", "key", *_MARKS)]
    return heads.select(marks).join(label, "class", "left").withColumn("l", F.coalesce("l", "class"))


def _apart(listed: DataFrame, joined: DataFrame) -> DataFrame:
    """(class, key, before, length) of the lists that hold several labels. Of two members, one led the other before."""
    labels = _labelled(listed.select("class", "key"), joined)
    mixed = labels.groupBy("key").agg(F.min("l").alias("least"), F.max("l").alias("most"), F.count(F.lit(1)).alias("length")).where("least <> most AND length > 2")
    return listed.select("class", "key", "before").join(stored(mixed.select("key", "length"), "mixed"), "key")


def _with_leaders(apart: DataFrame, labelled: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, la, lb) that may link, of members of long lists and leaders with other labels.

    A class takes part in its longest list and in that of its smallest key, which similar documents mostly share. The
    members of a list are dealt into shares of about ``BLOCK``, each of which meets a copy of the leaders.
    """
    long = apart.where(F.col("length") > LONG)
    chosen = long.groupBy("class").agg(F.max(F.struct("length", "key")).alias("longest"), F.min(F.struct("key", "length")).alias("least"))
    lists = F.array_distinct(F.array(*(F.struct(F.col(f"{x}.key").alias("key"), F.col(f"{x}.length").alias("length")) for x in ("longest", "least"))))
    own = stored(chosen.select("class", F.inline(lists)).join(labelled, "class").withColumn("shares", F.ceil(F.col("length") / BLOCK).cast("int")), "long")
    turn = F.pmod(F.xxhash64("class", "key"), F.lit(LEADERS)).alias("turn")
    first = own.groupBy("key", turn).agg(F.min(F.struct("class", "l", "shares", *_MARKS)).alias("first"))
    first = stored(first.select("key", "first.*").withColumn("share", F.explode(F.sequence(F.lit(0), F.col("shares") - 1))), "first")
    x, y = own.withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")).alias("x"), first.alias("y")
    same = (F.col("x.key") == F.col("y.key")) & (F.col("x.share") == F.col("y.share"))
    pairs = x.join(y, same & (F.col("x.class") != F.col("y.class")) & (F.col("x.l") != F.col("y.l")) & _may_link(percent, "x", "y"))
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.l").alias("la"), F.col("y.l").alias("lb")).distinct()


def _crossed(members: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, la, lb) that may link, of members of one list with different labels.

    A list of up to BLOCK members is one block; a longer one is dealt into shares, and every two of them are a block.
    """
    dealt = stored(members.withColumn("shares", F.ceil(F.col("length") / BLOCK).cast("int")).withColumn("share", F.pmod(F.xxhash64("class"), F.col("shares")).cast("int")), "members")
    x = dealt.withColumn("i", F.col("share")).withColumn("j", F.explode(F.sequence(F.col("share"), F.col("shares") - 1))).alias("x")
    y = dealt.withColumn("j", F.col("share")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("share")))).alias("y")
    block = (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    once = (F.col("x.i") != F.col("x.j")) | (F.col("x.class") < F.col("y.class"))
    begins = ~F.coalesce(F.col("x.before") == F.col("y.before"), F.lit(False))
    pairs = x.join(y, block & once & (F.col("x.l") != F.col("y.l")) & begins & _may_link(percent, "x", "y"))
    return pairs.select(F.col("x.class").alias("a"), F.col("y.class").alias("b"), F.col("x.l").alias("la"), F.col("y.l").alias("lb")).distinct()


def drop_near_copies(docs: DataFrame, **options) -> DataFrame:
    """The documents that stay, one row of each component, with all their columns.

    Which one stays: the smallest identifier, of equal ones the first row. Null and empty texts all stay; rows that
    share an identifier are decided each by its own text; no rows give no rows.
    """
    return settled(docs, near_rows(docs, **options))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"), width=3, percent=85)
