"""Usability of free-typed values: stand-ins for a missing value and values visibly broken off."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words typed where a value is missing.
STAND_INS = ["n/a", "na", "none", "null", "nil", "nan", "unknown", "not specified", "not available", "not given", "not provided", "unspecified", "undefined", "tbd", "tba", "missing", "blank", "no data", "xxx"]

#: A value that ends in one of these words was cut off.
DANGLING = ["of", "for", "the", "to", "at", "and", "with", "in", "an", "&"]

_BROKEN_END = r"(?:\.\.|…|,)$|(?:^|\s)(?:" + "|".join(DANGLING) + r")$"
_OPEN_PAREN = r"\([^)]*$"


def squeeze(c: Column) -> Column:
    """Outer blanks removed, inner runs of blanks made one."""
    return F.trim(F.regexp_replace(c, r"[\s ]+", " "))


def is_stand_in(c: Column) -> Column:
    """True for null, for text without letter or digit, and for words that only stand for a missing value."""
    s = F.lower(squeeze(c))
    return F.coalesce(~s.rlike(r"[\p{L}\p{N}]") | s.isin(STAND_INS), F.lit(True))


def is_broken_off(c: Column) -> Column:
    """True where the text ends in dots, a comma, a dangling word or an unclosed bracket; null counts as not broken."""
    s = F.lower(squeeze(c))
    return F.coalesce(s.rlike(_BROKEN_END) | s.rlike(_OPEN_PAREN), F.lit(False))


def is_usable(c: Column) -> Column:
    """Neither null nor stand-in nor visibly broken off."""
    return ~is_stand_in(c) & ~is_broken_off(c)


def stand_in(s: str | None) -> bool:
    """The rule of `is_stand_in` for one Python value."""
    if s is None:
        return True
    t = re.sub(r"[\s ]+", " ", s).strip().lower()
    return not any(ch.isalnum() for ch in t) or t in STAND_INS


def broken_off(s: str) -> bool:
    """The rule of `is_broken_off` for one Python value."""
    t = re.sub(r"[\s ]+", " ", s).strip().lower()
    return bool(re.search(_BROKEN_END, t) or re.search(_OPEN_PAREN, t))
