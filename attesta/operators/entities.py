"""Entity registry: identifiers, aliases, and resolution of names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.functions import derive


def register(rows: DataFrame, kind: str, name: str, key: str) -> DataFrame:
    """(entity_id, kind, name, normal_name), one row per entity."""
    ids = rows.select(derive.short_id(kind, F.col(key), F.col(name)).alias("entity_id"), F.lit(kind).alias("kind"), F.col(name).alias("name")).distinct()
    return ids.withColumn("normal_name", derive.normal_name("name"))


def attach_identifiers(claims: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected (namespace, identifier, entity_id) claims: an identifier of several entities is refused."""
    owners = claims.groupBy("namespace", "identifier").agg(F.count_distinct("entity_id").alias("owners"), F.min("entity_id").alias("entity_id"))
    accepted = owners.where("owners = 1").select("namespace", "identifier", "entity_id")
    return accepted, owners.where("owners > 1").select("namespace", "identifier", "owners")


def attach_aliases(aliases: DataFrame) -> DataFrame:
    """Aliases of an entity, one for each normal form (the smallest)."""
    named = aliases.withColumn("normal_name", derive.normal_name("alias"))
    return named.where("normal_name <> ''").groupBy("entity_id", "normal_name").agg(F.min("alias").alias("alias"))


def crosswalk(rows: DataFrame, identifiers: DataFrame, namespaces: list[str], columns: list[str]) -> DataFrame:
    """Provider codes to entities: the first namespace that knows its column's code wins; unresolved rows have null."""
    found = []
    for i, (space, column) in enumerate(zip(namespaces, columns, strict=True)):
        own = identifiers.where(F.col("namespace") == space).select(F.col("identifier").alias(f"_c{i}"), F.col("entity_id").alias(f"_e{i}"))
        rows = rows.join(own, F.col(column) == F.col(f"_c{i}"), "left").drop(f"_c{i}")
        found.append(F.col(f"_e{i}"))
    return rows.withColumn("entity_id", F.coalesce(*found)).drop(*(f"_e{i}" for i in range(len(found))))


#: Length of the pieces of names in the index; shorter queries are pieces themselves.
PIECE = 3


def _pieces(text: str, least: int) -> Column:
    """Distinct substrings of a text of ``least`` to PIECE characters."""
    one = lambda n: F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(F.col(text), i, F.lit(n))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.flatten(F.array(*(F.coalesce(one(n), none) for n in range(least, PIECE + 1)))))


def containing(asked: DataFrame, entities: DataFrame) -> DataFrame:
    """query, n, first_entity: how many entities' normal names contain the query's ``q``, and the smallest of their ids.

    An inverted index lists the entities of every piece of up to PIECE characters. A query of that length is answered by
    its own list's count; a longer one reads the list of its rarest piece and every name on it is verified, so the work
    follows the rarest piece and no entity is compared with all queries.
    """
    names = entities.select("entity_id", F.col("normal_name").alias("name")).distinct()
    pieces = names.select("entity_id", "name", F.explode(_pieces("name", 1)).alias("piece"))
    counts = pieces.groupBy("piece").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("first_entity"))
    short = asked.where(F.length("q") <= PIECE).join(counts.withColumnRenamed("piece", "q"), "q").select("query", "n", "first_entity")
    long_ = asked.where(F.length("q") > PIECE).select("query", "q", F.explode(_pieces("q", PIECE)).alias("piece"))
    known = long_.join(counts.select("piece", "n"), "piece", "left").groupBy("query", "q")
    rarest = known.agg(F.min(F.struct(F.coalesce("n", F.lit(0).cast("long")).alias("n"), "piece")).alias("r")).where("r.n > 0").select("query", "q", F.col("r.piece").alias("piece"))
    found = rarest.join(pieces, "piece").where(F.contains("name", "q")).groupBy("query").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("first_entity"))
    return short.unionByName(found)


def resolve(queries: DataFrame, entities: DataFrame, aliases: DataFrame, substring_confidence: float = 0.65) -> DataFrame:
    """(query, outcome, n_candidates, best_entity, confidence) of every query text.

    Names and aliases that equal the query's normal form count fully; only queries without any are searched as a
    substring of names. An empty normal form is not found. Several entities of the highest confidence are ambiguous.
    """
    asked = queries.select("query").distinct().withColumn("q", derive.normal_name("query"))
    names = entities.select("entity_id", F.col("normal_name").alias("q")).unionByName(aliases.select("entity_id", F.col("normal_name").alias("q"))).distinct()
    exact = asked.where("q <> ''").join(names, "q").groupBy("query").agg(F.count_distinct("entity_id").alias("n"), F.min("entity_id").alias("first_entity")).withColumn("confidence", F.lit(1.0))
    open_ = asked.where("q <> ''").join(exact, "query", "left_anti")
    top = exact.unionByName(containing(open_, entities).withColumn("confidence", F.lit(substring_confidence)))
    joined = asked.join(top, "query", "left").withColumn("n_candidates", F.coalesce("n", F.lit(0).cast("long")))
    outcome = F.when(F.col("n_candidates") == 0, "not-found").when(F.col("n_candidates") == 1, "resolved").otherwise("ambiguous")
    return joined.select("query", outcome.alias("outcome"), "n_candidates", F.when(F.col("n_candidates") == 1, F.col("first_entity")).alias("entity_id"), "confidence")
