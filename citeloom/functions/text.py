"""Text functions as column expressions; `exact_fold` and `compose` alone need Python."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import STOP_WORDS

EDGE_MARKS = ".,!?;:()[]{}"


@F.pandas_udf(T.StringType())
def exact_fold(text: pd.Series) -> pd.Series:
    """NFKC and full case folding, where the native `fold` is not enough."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFKC", s).casefold())


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """NFC."""
    return text.map(lambda s: None if s is None else unicodedata.normalize("NFC", s))


def full_fold(text: Column) -> Column:
    """NFKC and full case folding: lower case where a text is ASCII, `exact_fold` for the others only."""
    plain = text.rlike(r"^[\x00-\x7f]*$")
    return F.when(plain, F.lower(text)).otherwise(exact_fold(F.when(~plain, text)))


def fold(text: Column) -> Column:
    """Case folding for texts in Latin script: lower case, sharp s as ss."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def newlines(text: Column) -> Column:
    """CRLF and CR as LF."""
    return F.regexp_replace(text, "\r\n?", "\n")


def tokens(text: Column, folded: bool = False) -> Column:
    """All tokens in order: folded, with punctuation, separators, controls and symbols as blanks."""
    plain = F.regexp_replace(text if folded else fold(text), r"[\p{P}\p{Z}\p{C}\p{S}]", " ")
    return F.filter(F.split(plain, " +"), lambda t: t != "")


def is_lexeme(token: Column) -> Column:
    return ~token.isin(*STOP_WORDS) & token.rlike(r"^[\p{L}\p{N}]+$")


def lexemes(text: Column, folded: bool = False) -> Column:
    """Distinct search lexemes in order of first occurrence."""
    return F.array_distinct(F.filter(tokens(text, folded), is_lexeme))


def omitted(text: Column, folded: bool = False) -> Column:
    """Distinct tokens that are no lexemes, in order of first occurrence."""
    return F.array_distinct(F.filter(tokens(text, folded), lambda t: ~is_lexeme(t)))


def word_set(text: Column, folded: bool = False) -> Column:
    """Folded whitespace tokens without marks at their edges, as a set; a token of marks only is the empty string."""
    words = F.filter(F.split(text, r"\s+"), lambda t: t != "")
    return F.array_distinct(F.transform(words, lambda t: F.btrim(t if folded else fold(t), F.lit(EDGE_MARKS))))


def word_characters(text: Column, folded: bool = False) -> Column:
    r"""Runs of word characters (\w, Unicode), folded."""
    return F.regexp_extract_all(text if folded else fold(text), F.lit(r"[\p{L}\p{N}\p{M}_]+"), F.lit(0))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?])\s+")


def page_text(text: Column) -> Column:
    """A page with LF ends, no control characters, single blanks, trimmed lines and at most one empty line."""
    clean = F.regexp_replace(F.replace(newlines(text), F.lit("\u00a0"), F.lit(" ")), r"[\x00-\x08\x0b-\x1f\x7f-\x9f]", "")
    lines = F.transform(F.split(clean, "\n"), lambda x: F.btrim(F.regexp_replace(x, r"[ \t\x0b\f]+", " ")))
    return F.regexp_replace(F.regexp_replace(F.array_join(lines, "\n"), "\n{3,}", "\n\n"), r"^[ \n]+|[ \n]+$", "")


def markers(answer: Column) -> Column:
    """Well-formed citation markers [[E1]] in order."""
    return F.regexp_extract_all(answer, F.lit(r"\[\[(E[1-9][0-9]*)\]\]"), F.lit(1))


def markers_well_formed(answer: Column) -> Column:
    """Whether every opening [[ closes around a valid marker."""
    rest = F.regexp_replace(answer, r"\[\[E[1-9][0-9]*\]\]", "")
    return ~rest.contains("[[")


def chunk_reference(source_key: Column, ordinal: Column) -> Column:
    return F.concat_ws("#", source_key, ordinal.cast("string"))


def parse_reference(reference: Column) -> tuple[Column, Column]:
    """(source key, ordinal) at the last #."""
    return F.regexp_extract(reference, r"(?s)^(.*)#([0-9]+)$", 1), F.regexp_extract(reference, r"(?s)^(.*)#([0-9]+)$", 2).cast("long")


def line_of(text: Column, offset: Column) -> Column:
    """The 1-based line of a character offset."""
    return F.length(F.substring(text, F.lit(1), offset)) - F.length(F.replace(F.substring(text, F.lit(1), offset), F.lit("\n"), F.lit(""))) + 1


def basename(path: Column) -> Column:
    return F.substring_index(F.replace(path, F.lit("\\"), F.lit("/")), "/", -1)


def safe_path(path: Column) -> Column:
    """Relative, without drive, backslash, empty or parent parts."""
    return ~path.rlike(r"^/|^[A-Za-z]:|\\|(^|/)\.\.(/|$)|//|^$")
