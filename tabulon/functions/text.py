"""Text orders, masks and n-grams."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DOTS = "••••"


def fold(text: str) -> str:
    """Decomposed, without combining marks, each code point in lower case by itself."""
    plain = (c for c in unicodedata.normalize("NFD", text) if unicodedata.category(c) != "Mn")
    return "".join(c.lower() for c in plain)


def natural(text: str) -> str:
    """A key whose code-point order is the natural order: digit runs by value, before other text."""
    out = []
    for digits, other in re.findall(r"([0-9]+)|([^0-9]+)", text):
        if digits:
            value = digits.lstrip("0")
            out.append(f"\x01{len(value):04d}{value}{len(digits):04d}")
        else:
            out.append(f"\x02{other}\x00")
    return "".join(out)


@F.pandas_udf(T.StringType())
def fold_text(text: pd.Series) -> pd.Series:
    return text.map(fold, na_action="ignore")


@F.pandas_udf(T.StringType())
def natural_key(text: pd.Series) -> pd.Series:
    return text.map(natural, na_action="ignore")


def sort_key(column: Column, nocase: bool = False, natural: bool = False, utf16: bool = False) -> list[Column]:
    """Ascending sort keys of a text column; folded equals fall back to the plain text."""
    keys, key = [], column
    if nocase:
        key = fold_text(key)
    if natural:
        key = natural_key(key)
    if nocase or natural:
        keys.append(key)
    keys.append(F.encode(column, "UTF-16BE") if utf16 else column)
    return keys


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters."""
    return F.when(F.length(text) >= 3, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - 2), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def mask(text: Column, show: str = "none", n: int = 4) -> Column:
    """What is shown of a masked value: none, last n, first and last, its format, or an e-mail's ends."""
    if show == "none":
        return F.when(text.isNotNull(), DOTS)
    if show == "last":
        return F.when(F.length(text) > n, F.concat(F.lit(DOTS), F.right(text, F.lit(n)))).when(text.isNotNull(), DOTS)
    if show == "firstLast":
        return F.when(F.length(text) > 2, F.concat(F.left(text, F.lit(1)), F.lit(DOTS), F.right(text, F.lit(1)))).when(text.isNotNull(), DOTS)
    if show == "keepFormat":
        hidden = F.regexp_replace(F.regexp_replace(text, r"\p{Nd}", "0"), r"\p{Lu}", "X")
        return F.regexp_replace(hidden, r"[\p{L}&&[^X]]", "x")
    if show == "email":
        at = F.instr(text, "@")
        return F.when(at > 1, F.concat(F.left(text, F.lit(1)), F.lit(DOTS), F.substring(text, at, F.length(text)))).when(text.isNotNull(), DOTS)
    raise ValueError(f"unknown mask {show!r}")


def iso_time(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
