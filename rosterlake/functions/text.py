"""Column expressions over text: rule chains, title case, folding of abbreviations, similarity."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import rules


def any_of(c: Column, words: list[str]) -> Column:
    """True where the text contains one of the words as a substring: one pattern for all keeps the generated code small."""
    return c.rlike("|".join(re.escape(w) for w in words))


def first_match(c: Column, classes: dict[str, list[str]]) -> Column:
    """The first class one of whose keywords occurs; null where none does."""
    out: Column | None = None
    for name, words in classes.items():
        out = F.when(any_of(c, words), name) if out is None else out.when(any_of(c, words), name)
    return out


def most_matches(c: Column, classes: dict[str, list[str]]) -> Column:
    """The class with the most keywords found, the earlier one on ties; null where none is found."""
    scored = [F.struct(reduce(lambda a, b: a + b, (c.contains(w).cast("int") for w in ws)).alias("n"), F.lit(-k).alias("k"), F.lit(name).alias("name")) for k, (name, ws) in enumerate(classes.items())]
    best = F.array_max(F.array(*scored))
    return F.when(best["n"] > 0, best["name"])


def fold_words(c: Column, words: dict[str, str]) -> Column:
    """Whole words replaced in order."""
    for a, b in words.items():
        c = F.regexp_replace(c, rf"\b{a}\b", b)
    return c


def title_case(c: Column) -> Column:
    """Each run of letters starts with a capital and goes on in lower case, also after signs within a word."""
    parts = F.regexp_extract_all(c, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.concat(F.upper(x.substr(1, 1)), F.lower(x.substr(F.lit(2), F.length(x))))), "")


def lookup(c: Column, variants: dict[str, list[str]]) -> Column:
    """The canonical value of a known variant, else null."""
    pairs = [(v, k) for k, vs in variants.items() for v in vs]
    return F.create_map(*[F.lit(x) for p in pairs for x in p])[c]


def without_dates(c: Column) -> Column:
    """Dates blanked, blanks squeezed, lower case."""
    for p in rules.DATE_PATTERNS:
        c = F.regexp_replace(c, p, " ")
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def _lcs(a: str, b: str) -> int:
    """Letters of the longest common subsequence: one word of bits holds a row of the programme, a letter costs one step."""
    places: dict[str, int] = {}
    for k, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << k
    whole = (1 << len(a)) - 1
    row = whole
    for y in b:
        met = row & places.get(y, 0)
        row = (row + met | row - met) & whole
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> int:
    """Similarity in percent: twice the longest common subsequence over both lengths, rounded; empty text has none."""
    if not a or not b:
        return 0
    return round(200 * _lcs(a, b) / (len(a) + len(b)))


@F.pandas_udf(T.IntegerType())
def fuzzy_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b)], dtype="int32")


def find_all(c: Column, patterns: list[str]) -> Column:
    """The distinct texts of the first group of each pattern, in order of the alphabet, without regard to case; null gives null."""
    found = [F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(1)) for p in patterns]
    return F.array_sort(F.array_distinct(F.transform(F.flatten(F.array(*found)), lambda x: F.lower(F.trim(x)))))


def length_bound(a: Column, b: Column, percent: float) -> Column:
    """Lossless filter: only texts of near lengths can reach the similarity."""
    return 200 * F.least(F.length(a), F.length(b)) >= (percent - 0.5) * (F.length(a) + F.length(b))
