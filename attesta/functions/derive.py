"""Derived values of measurement records, as Column builders.

All rates round half away from zero, like SQL; integer scores round half to even. Null in, null out, unless stated.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING_SOURCE = "Unspecified source"
NEEDS_EVIDENCE, CAUTION = 40, 70


def percent_change(baseline: Column, current: Column) -> Column:
    """Change in percent of the baseline's magnitude, two places; null for a missing or zero baseline."""
    return F.when(baseline != 0, F.round((current - baseline) / F.abs(baseline) * 100, 2))


def source_is_missing(name: Column) -> Column:
    trimmed = F.trim(F.coalesce(name, F.lit("")))
    return trimmed.isin("", MISSING_SOURCE)


def classify_review(confidence: Column, missing: Column) -> Column:
    """Null for a source without a confidence."""
    return (
        F.when(missing, "missing source")
        .when(confidence < NEEDS_EVIDENCE, "needs evidence")
        .when(confidence < CAUTION, "reviewable with caution")
        .when(confidence >= CAUTION, "reviewable")
    )


def classify_signal(change: Column, direction: Column) -> Column:
    """From the rounded change: a move that rounds to nothing is unchanged. A move without a direction is null."""
    better = ((direction == "higher") & (change > 0)) | ((direction == "lower") & (change < 0))
    return F.when(change.isNull(), "indeterminate").when(change == 0, "unchanged").when(direction == "neutral", "descriptive").when(better, "improving").when(direction.isNotNull(), "declining")


def classify_signal_raw(baseline: Column, current: Column, direction: Column) -> Column:
    """The SQL contract's twin: unchanged only if the values are equal."""
    better = ((direction == "higher") & (current > baseline)) | ((direction == "lower") & (current < baseline))
    return (
        F.when(baseline.isNull() | (baseline == 0) | current.isNull(), "indeterminate")
        .when(current == baseline, "unchanged")
        .when(direction == "neutral", "descriptive")
        .when(better, "improving")
        .when(direction.isNotNull(), "declining")
    )


def slug(text: Column) -> Column:
    plain = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", "-")
    short = F.substring(F.regexp_replace(plain, "^-+|-+$", ""), 1, 64)
    return F.when(short == "", "unspecified").otherwise(short)


def stable_id(kind: str, *parts: Column) -> Column:
    """kind:slug:12 digits, by the JSON list of the trimmed, lower-cased parts; the slug is that of the first part with a
    text, else of the kind. Null parts count as empty."""
    plain = [F.lower(F.trim(F.coalesce(p.cast("string"), F.lit("")))) for p in parts]
    anchor = F.coalesce(*(F.nullif(p, F.lit("")) for p in plain), F.lit(kind))
    return F.concat_ws(":", slug(F.lit(kind)), slug(anchor), F.substring(F.sha2(F.to_json(F.array(*plain)), 256), 1, 12))


def short_id(prefix: str, *parts: Column) -> Column:
    """prefix:32 digits, by the unchanged parts joined by bars; null parts count as empty."""
    return F.concat_ws(":", F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256), 1, 32))


def payload_hash(*names: str) -> Column:
    """SHA-256 of the named columns as JSON, in the order of their names, nulls kept."""
    return F.sha2(F.to_json(F.struct(*sorted(names)), {"ignoreNullFields": "false"}), 256)


#: Texts that stand for a missing number, by family of providers, and whether commas group thousands.
NULL_TOKENS = {
    "statistics": (("", "na", "n/a", "null"), False),
    "national": (("", "na", "n/a", "null", "--", "(na)"), True),
    "earth": (("", "na", "n/a", "null", "nan", "--"), True),
}


def numeric_value(text: Column, family: str) -> Column:
    """The finite number in a text, or null."""
    tokens, commas = NULL_TOKENS[family]
    plain = F.trim(text)
    number = F.regexp_replace(plain, ",", "") if commas else plain
    fits = number.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$")
    return F.when(~F.lower(plain).isin(*tokens) & fits, number.try_cast("double"))


def text_value(text: Column, family: str) -> Column:
    """What is neither a number nor a missing one."""
    plain = F.trim(text)
    return F.when(numeric_value(text, family).isNull() & ~F.lower(plain).isin(*NULL_TOKENS[family][0]), plain)


#: What counts as true, by family.
TRUTHS = {"space": ("1", "true", "yes", "y"), "connector": ("1", "true", "yes", "on"), "archive": ("1", "true", "yes")}


def truthy(text: Column, family: str) -> Column:
    return F.lower(F.trim(F.coalesce(text, F.lit("")))).isin(*TRUTHS[family])


def text_list(text: Column) -> Column:
    """Parts between semicolons, bars or line feeds, trimmed, without empties and repeats, in order."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), "[;|\n]"), lambda p: F.trim(p))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


def json_text(payload: Column) -> Column:
    """Plain text of a JSON value: of an object its value, name, title or description, of a list its items joined."""
    kinds = F.coalesce(*(F.get_json_object(payload, f"$.{k}") for k in ("value", "name", "title", "description")))
    items = F.array_join(F.from_json(payload, "array<string>"), "; ")
    return F.when(payload.startswith("{"), kinds).when(payload.startswith("["), items).otherwise(F.get_json_object(F.concat(F.lit('{"v":'), payload, F.lit("}")), "$.v"))


def utc_seconds(text: Column) -> Column:
    """ISO-8601 text as UTC with seconds and Z; a time without offset is UTC (with the session in UTC)."""
    return F.date_format(F.date_trunc("second", text.try_cast("timestamp")), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def convert_unit(value: Column, factor: Column, offset: Column, to_factor: Column, to_offset: Column, same: Column) -> Column:
    """Through the canonical unit, twelve places; null unless dimension and basis are the same."""
    return F.when(same, F.round((value * factor + offset - to_offset) / to_factor, 12))


def freshness(stamp: Column, as_of: Column) -> Column:
    age = F.floor((F.unix_seconds(as_of) - F.unix_seconds(stamp.cast("timestamp"))) / 86400)
    return F.when(age.isNull(), "unknown").when(age <= 30, "fresh").when(age <= 90, "aging").otherwise("stale")


def redact(uri: Column) -> Column:
    return F.regexp_replace(uri, r"(?i)([?&](?:api_?key|key|token|userid|registrationkey)=)[^&#]*", "$1REDACTED")


def period_type(label: Column) -> Column:
    return F.when(label.rlike("^[0-9]{4}$"), "year").when(F.upper(label).contains("Q"), "quarter").otherwise("custom")


def identity_key(mapping: Column) -> Column:
    pairs = F.transform(F.map_entries(mapping), lambda e: F.concat_ws(":", e["key"], F.coalesce(e["value"], F.lit(""))))
    return F.array_join(F.array_sort(pairs), ";")


@F.pandas_udf(T.StringType())
def normal_name(names: pd.Series) -> pd.Series:
    """Compatibility decomposition, case folding, no accents; runs of a-z and 0-9 joined by a space."""
    plain = names.fillna("").map(lambda s: "".join(c for c in unicodedata.normalize("NFKD", s).casefold() if not unicodedata.combining(c)))
    return plain.str.findall("[a-z0-9]+").str.join(" ")


OBJECT = "{"


def _paths(value, path: str = ""):
    """(path, value) of everything below a JSON value, objects before what they hold; lists are whole."""
    for key in value:
        at = f"{path}.{key}" if path else key
        yield at, value[key]
        if isinstance(value[key], dict):
            yield from _paths(value[key], at)


def _parsed(text: str | None):
    try:
        return json.loads(text) if text else None
    except ValueError:
        return None


@F.pandas_udf(T.MapType(T.StringType(), T.StringType()))
def json_entries(texts: pd.Series) -> pd.Series:
    """Dotted paths of a JSON object of any depth: a value's JSON text with sorted keys, and OBJECT for objects.

    Null for what is no JSON object.
    """
    plain = lambda v: OBJECT if isinstance(v, dict) else json.dumps(v, sort_keys=True, ensure_ascii=False, separators=(",", ":"))
    parsed = texts.map(_parsed)
    return parsed.map(lambda v: {path: plain(x) for path, x in _paths(v)} if isinstance(v, dict) else None)


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_types(texts: pd.Series) -> pd.Series:
    """path:type of everything in a JSON object, of a list's first element as path[]; null values have no type."""

    def types(value, path: str = ""):
        if isinstance(value, list):
            yield from types(value[0], f"{path}[]") if value else ()
        elif isinstance(value, dict):
            for key, x in value.items():
                at = f"{path}.{key}" if path else key
                if x is not None:
                    yield f"{at}:{'object' if isinstance(x, dict) else type(x).__name__}"
                yield from types(x, at)

    return texts.map(_parsed).map(lambda v: sorted(set(types(v))))


def _boolean(c: Column) -> Column:
    return truthy(c, "connector").cast("string")


def _split(c: Column, delimiter: str = "|", at: int | None = None) -> Column:
    items = F.filter(F.transform(F.split(c, f"\\Q{delimiter}\\E"), lambda x: F.trim(x)), lambda x: x != "")
    return F.to_json(items) if at is None else F.get(items, at)


def _divide(c: Column, value: float = 1.0) -> Column:
    if float(value) == 0:
        raise ValueError("a transform cannot divide by zero")
    return (c.try_cast("double") / float(value)).cast("string")


#: The transforms that a mapping may name; each takes the column as text and the transform's arguments. What cannot be
#: transformed is null. Integers are cut towards zero; a split gives its items as a JSON list, or one of them.
TRANSFORMS = {
    "identity": lambda c: c,
    "trim": lambda c: F.trim(c),
    "lower": lambda c: F.lower(c),
    "upper": lambda c: F.upper(c),
    "float": lambda c: c.try_cast("double").cast("string"),
    "integer": lambda c: c.try_cast("double").try_cast("long").cast("string"),
    "string": lambda c: c,
    "boolean": _boolean,
    "split": _split,
    "multiply": lambda c, value=1.0: (c.try_cast("double") * float(value)).cast("string"),
    "divide": _divide,
    "replace": lambda c, old="", new="": F.replace(c, F.lit(old), F.lit(new)),
    "coalesce": lambda c, value="": F.when(F.coalesce(c, F.lit("")) == "", F.lit(value)).otherwise(c),
}


def transformed(column: Column, steps: Sequence) -> Column:
    """Applies named transforms in order; a step is a name or (name, arguments)."""
    for step in steps:
        name, options = (step, {}) if isinstance(step, str) else step
        column = TRANSFORMS[name](column, **options)
    return column
