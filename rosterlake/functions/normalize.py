"""Normalisation of record fields: companies, places, titles, years, hashes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rosterlake.functions import rules
from rosterlake.functions.text import fold_words, lookup, ratio, title_case


def company_cleaned(c: Column) -> Column:
    out = F.lower(F.trim(c))
    for pattern, by in rules.COMPANY_PATTERNS:
        out = F.regexp_replace(out, pattern, by)
    return out


def company(c: Column, fuzzy: bool = False) -> Column:
    """Canonical company; with `fuzzy` a name at least 85 percent like a canonical one is that one. Null and '' give ''."""
    cleaned = company_cleaned(c)
    known = lookup(cleaned, rules.COMPANY_VARIANTS)
    rest = F.coalesce(nearest_company(cleaned), title_case(cleaned)) if fuzzy else title_case(cleaned)
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(known, rest))


@F.pandas_udf(T.StringType())
def nearest_company(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The canonical company most like the text, from 85 percent on; each distinct text is compared once."""
    seen: dict[str, str | None] = {}
    for s in parts:
        for v in s.dropna().unique():
            if v not in seen:
                score, name = max(((ratio(v, k), k) for k in rules.COMPANY_VARIANTS), key=lambda x: x[0])
                seen[v] = name if score >= 85 else None
        yield s.map(seen, na_action="ignore").astype(object).where(s.notna(), None)


def location(c: Column) -> Column:
    """Canonical place: country suffix off, known variant, known city before the comma, else title case. Null and '' give ''."""
    low = F.regexp_replace(F.lower(F.trim(c)), rules.COUNTRY_SUFFIX, "")
    city = F.trim(F.split(low, ",")[0])
    return F.when(c.isNull() | (c == ""), "").otherwise(F.coalesce(lookup(low, rules.LOCATION_VARIANTS), F.when(low.contains(","), lookup(city, rules.LOCATION_VARIANTS)), title_case(c)))


def title_spaces(c: Column) -> Column:
    """Blanks squeezed, dashes between blanks."""
    return F.when(c.isNull(), "").otherwise(F.trim(F.regexp_replace(F.regexp_replace(c, r"\s*[-–—]\s*", " - "), r"\s+", " ")))


def title(c: Column) -> Column:
    """Lower case, abbreviations expanded, special signs out."""
    out = fold_words(F.lower(F.trim(c)), rules.TITLE_ABBREVIATIONS)
    out = F.regexp_replace(out, r"(?U)[^\w\s\-&/]", " ")
    return F.coalesce(F.trim(F.regexp_replace(out, r"\s+", " ")), F.lit(""))


def title_short(c: Column) -> Column:
    """Articles out, blanks squeezed, eight abbreviations expanded."""
    out = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), r"\b(the|a|an)\b", ""), r"\s+", " "))
    return fold_words(out, rules.RULES_ABBREVIATIONS)


def year(c: Column) -> Column:
    """The first year from 1900 to 2099 in a text (or number); null where there is none."""
    return F.regexp_extract(c.cast("string"), r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def record_hash(name: Column, employer: Column, year_: Column) -> Column:
    """md5 of name in lower case, company and year, joined by underscores; nulls count as empty."""
    return F.md5(F.concat_ws("_", F.lower(F.coalesce(name, F.lit(""))), F.coalesce(employer, F.lit("")), F.coalesce(year_.cast("string"), F.lit(""))))


def fallback_id(name: Column) -> Column:
    """A reproducible id for rows without one."""
    return F.xxhash64(name).cast("string")
