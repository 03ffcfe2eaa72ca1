"""Identifiers and mapping transforms against plain Python and literals."""

import hashlib
import json
import re

import pytest
from pyspark.sql import functions as F

from attesta.functions import derive
from attesta.sources.payloads import mapped


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


@pytest.mark.parametrize("parts", [("  North Sea ", "X1"), ("", "Ré\"sumé"), ("", ""), ("a/b\\c",)])
def test_stable_id_hashes_the_list_of_parts(spark, parts):
    plain = [p.strip().lower() for p in parts]
    anchor = re.sub("[^a-z0-9]+", "-", next((p for p in plain if p), "entity")).strip("-")[:64] or "unspecified"
    want = f"entity:{anchor}:{hashlib.sha256(json.dumps(plain, separators=(',', ':'), ensure_ascii=False).encode()).hexdigest()[:12]}"
    assert one(spark, derive.stable_id("entity", *map(F.lit, parts))) == want


def test_short_id_keeps_case_and_counts_null_as_empty(spark):
    want = "node:" + hashlib.sha256(b"A ||b").hexdigest()[:32]
    assert one(spark, derive.short_id("node", F.lit("A "), F.lit(None), F.lit("b"))) == want


@pytest.mark.parametrize(
    "text, steps, want",
    [("-3.5", ["integer"], "-3"), ("x", ["float"], None), (" a | |b ", ["split"], '["a","b"]'), ("a-b", [("split", {"delimiter": "-", "at": 1})], "b"), (" ", [("coalesce", {"value": "z"})], " "), ("", [("coalesce", {"value": "z"})], "z"), ("3", [("multiply", {"value": 2})], "6.0"), ("On ", ["boolean"], "true")],
)
def test_transforms(spark, text, steps, want):
    assert one(spark, derive.transformed(F.lit(text), steps)) == want


def test_division_by_zero_is_refused():
    with pytest.raises(ValueError, match="zero"):
        derive.TRANSFORMS["divide"](None, 0)


def test_failed_transforms_and_missing_values_are_errors(spark):
    rows = spark.createDataFrame([(1, {"a": "x", "b": "1"}), (2, {"a": "2"}), (3, None)], "k int, row map<string,string>")
    spec = {"n": {"source": "a", "transforms": ["float"]}, "m": {"source": "b", "required": True}}
    found = {r.k: r.errors for r in mapped(rows, spec, "row").collect()}
    assert found == {1: ["n cannot be transformed"], 2: ["m is required"], 3: ["m is required"]}
