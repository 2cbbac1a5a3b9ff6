"""Tokens and previews as column expressions.

A token is a maximal run of letters and digits (Unicode categories L and N) of the lower-cased text that isn't a stop word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

STOPWORDS = tuple("a an and are as at be by for from has have he her his i in is it its of on or she that the their them this to was we were will with you your".split())
TOKEN = r"([\p{L}\p{N}]+)"
SPACES = r"(?U)[\s\x1c-\x1f]+"


def raw_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(1))


def tokens(text: Column) -> Column:
    """array<string>, in the text's order, repeats included; null text has none."""
    return F.filter(F.coalesce(raw_tokens(text), F.expr("cast(array() as array<string>)")), lambda t: ~t.isin(*STOPWORDS))


def text_column(df: DataFrame, name: str = "text") -> Column:
    """The column, which must be of strings."""
    if not isinstance(df.schema[name].dataType, T.StringType):
        raise TypeError(f"{name} must hold strings, not {df.schema[name].dataType.simpleString()}")
    return F.col(name)


def query_terms(query: str) -> list[str]:
    """The tokens of a query, on the driver, by the same rules."""
    if not isinstance(query, str):
        raise TypeError("a query must be a string")
    spaced = "".join(c if c.isalnum() else " " for c in query.lower())
    return [t for t in spaced.split() if t not in STOPWORDS]


def preview(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def one_line(text: Column, n: int = 68) -> Column:
    flat = F.trim(F.regexp_replace(text, SPACES, " "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)
