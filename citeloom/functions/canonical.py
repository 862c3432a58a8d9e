"""Canonical JSON, fingerprints, name-based identifiers and the projections that reports are compared by."""

from __future__ import annotations

import json
from json.decoder import scanstring

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"


def canonical_object(**fields: Column) -> Column:
    """Compact JSON of the fields in name order, nulls kept; for ASCII values it is what sorted compact JSON is."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]), {"ignoreNullFields": "false"})


@F.pandas_udf(T.StringType())
def canonical_json(text: pd.Series) -> pd.Series:
    """Any JSON with keys sorted at every depth, no blanks and non-ASCII escaped."""
    return text.map(lambda s: None if s is None else json.dumps(json.loads(s), sort_keys=True, separators=(",", ":")))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def fingerprint(*parts: Column) -> Column:
    """The parts, one a line; a null part is an empty line."""
    return F.concat_ws("\n", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based identifier (version 5) of `name`: the same name has the same identifier everywhere."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), name.cast("binary")))
    piece = lambda a, n: F.substring(h, a, n)
    variant = F.translate(piece(17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(piece(1, 8), F.lit("-"), piece(9, 4), F.lit("-5"), piece(14, 3), F.lit("-"), variant, piece(18, 3), F.lit("-"), piece(21, 12))


def string_values(text: str | None) -> list[str] | None:
    """The string values of a JSON text in order. In JSON a quote opens or closes a string and nothing else, so the text is read from
    string to string by the decoder of the standard library, without recursion, and a string before a colon is a key."""
    if text is None:
        return None
    found, at = [], text.find('"')
    while at >= 0:
        value, end = scanstring(text, at + 1)
        at = text.find('"', end)
        if text[end : end + 1] != ":" and not text[end : at if at >= 0 else len(text)].lstrip().startswith(":"):
            found.append(value)
    return found


@F.pandas_udf(T.ArrayType(T.StringType()))
def json_strings(text: pd.Series) -> pd.Series:
    """All string values of a JSON text, escapes decoded, at any depth and of any length, keys left out. A text with a string that does not end is an error; null gives null."""
    return text.map(string_values)


def next_up(x: Column) -> Column:
    """The least double above x."""
    return F.reflect(F.lit("java.lang.Math"), F.lit("nextUp"), x.cast("double")).cast("double")


def without(report: DataFrame, dropped: dict[str, list[str]]) -> DataFrame:
    """`report` (struct columns) without the fields named by column: what runs of one input must agree on."""
    return report.withColumns({c: F.col(c).dropFields(*fields) for c, fields in dropped.items()})


def differing_fields(a: DataFrame, b: DataFrame, key: str, allowed: list[str]) -> DataFrame:
    """key, field: where two provenances (one row a key) differ in a field that is not in `allowed`; missing rows differ in all."""
    names = [c for c in a.columns if c != key and c not in allowed]
    left, right = (x.select(F.col(key), F.struct(*[F.col(n).cast("string").alias(n) for n in names]).alias(s)) for x, s in ((a, "l"), (b, "r")))
    both = left.join(right, key, "full_outer")
    said = F.array_compact(F.array(*[F.when(~F.col(f"l.{n}").eqNullSafe(F.col(f"r.{n}")) | F.col("l").isNull() | F.col("r").isNull(), F.lit(n)) for n in names]))
    return both.select(key, F.explode(said).alias("field"))
