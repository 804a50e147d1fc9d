"""Turning text into terms, with built-in column functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates terms: everything but alphabetic characters and numbers.
SEPARATOR = "[^\\p{IsAlphabetic}\\p{N}]+"


def tokens(text: Column) -> Column:
    """The terms of a text in order: lower-cased runs of letters and numbers; none for null.

    Capital dotted I becomes i, and capital sigma always the medial one, so
    that every character has one lower-case character.
    """
    plain = F.lower(F.translate(F.coalesce(text, F.lit("")), "İΣ", "iσ"))
    return F.filter(F.split(plain, SEPARATOR), lambda t: t != "")


def field_tokens(fields: list[str]) -> Column:
    """The terms of several text fields, one after the other."""
    each = [tokens(F.col(f"`{f}`")) for f in fields]
    return each[0] if len(each) == 1 else F.concat(*each)


def positions(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, position, term), positions from 0."""
    return df.select(F.col(key), F.posexplode(tokens(F.col(text))).alias("position", "term"))
