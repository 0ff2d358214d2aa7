"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from parlance.functions.fixed import ASCII_PUNCTUATION


def round2(value: Column) -> Column:
    """Two decimals, halves to even."""
    return F.rint(value * 100) / 100


# Blank characters of any script.
BLANK = r"[\s\x0B\x1C-\x1F\x85\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def collapse_whitespace(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def split_words(text: Column) -> Column:
    """Words of a text; no word for an empty text."""
    return F.filter(F.split(collapse_whitespace(text), " ", -1), lambda w: w != "")


def normalize_compare(word: Column) -> Column:
    """Lower case without ASCII punctuation: the form in which two hypotheses are compared."""
    return F.translate(F.lower(word), ASCII_PUNCTUATION, "")


def contains_alphanum(text: Column) -> Column:
    """True if a letter or digit occurs."""
    return text.rlike(r"[\p{L}\p{N}]")
