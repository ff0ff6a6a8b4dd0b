"""Text expressions used by rules and queries; all but the Arrow functions stay in the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import similarity as ratcliff

cloudpickle.register_pickle_by_value(ratcliff)  # it goes with the tasks: executors need no path to this package

WORD = r"([\p{L}\p{Nl}\p{No}]{2,})"
#: White space as Python's str.split() sees it, the plain space aside.
_WHITE = "".join(chr(i) for i in range(0x3001) if chr(i).isspace() and chr(i) != " ")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends; null becomes empty."""
    plain = F.translate(F.coalesce(c, F.lit("")), _WHITE, " " * len(_WHITE))
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def blank(c: Column) -> Column:
    return collapse(c) == ""


def words(c: Column) -> Column:
    """Runs of two or more letters (text should be NFKC-normalised where that matters)."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD), F.lit(1))


def furniture_key(c: Column) -> Column:
    """Lower case, no digits, white space collapsed: what stays alike in running headers and footers."""
    return collapse(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\p{Nd}+", ""))


def letters(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[^a-z0-9]", "")


def shown(c: Column, width: int) -> Column:
    """Collapsed and cut with an ellipsis."""
    t = collapse(c)
    return F.when(F.length(t) > width, F.concat(F.substring(t, 1, width), F.lit("…"))).otherwise(t)


def sample(items: Column, n: int = 3, width: int = 60) -> Column:
    """The first n items of an array of texts, each cut, joined by semicolons."""
    return F.concat_ws("; ", F.transform(F.slice(items, 1, n), lambda x: shown(x, width)))


def mostly(x: Column, default: Column) -> Column:
    return F.coalesce(x, default)


@F.pandas_udf(T.StringType())
def nfkc(texts: pd.Series) -> pd.Series:
    """Compatibility normalisation, which Spark has no function for."""
    import unicodedata

    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


@F.pandas_udf(T.StringType())
def casefold(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else t.casefold())


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts."""
    return pd.Series([None if x is None or y is None else ratcliff.ratio(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.IntegerType())
def longest_increasing(items: pd.Series) -> pd.Series:
    """Length of the longest strictly increasing subsequence of an array of numbers."""
    from bisect import bisect_left

    def one(values):
        tails: list = []
        for v in () if values is None else values:
            at = bisect_left(tails, v)
            tails[at : at + 1] = [v]
        return len(tails)

    return items.map(one).astype("int32")
