"""Entities tagged in titles and places, by rules compiled to column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import normalize, rules
from rosterlake.functions.text import any_of, first_match, most_matches, title_case


def seniority(c: Column) -> tuple[Column, Column]:
    """(name, level): the longest word of rank contained, else a pattern, else null and 0."""
    name: Column | None = None
    for word in sorted(rules.SENIORITY, key=lambda x: -len(x)):
        name = F.when(c.contains(word), word) if name is None else name.when(c.contains(word), word)
    levels = dict(rules.SENIORITY)
    for pattern, word, n in rules.SENIORITY_PATTERNS:
        name = name.when(c.rlike(pattern), word)
        levels[word] = n
    return name, F.coalesce(F.create_map(*[F.lit(x) for kv in levels.items() for x in kv])[name], F.lit(0))


def title_tokens(c: Column) -> Column:
    """Words of a normalised title without stop words."""
    return F.filter(F.split(c, r"\s+"), lambda x: (x != "") & ~x.isin(rules.TITLE_STOPWORDS))


def title_entities(df: DataFrame, column: str) -> DataFrame:
    """normalized, seniority, seniority_level, role_type, specialization, department, industry_focus beside the columns of `df`.

    A null title reads as ''; columns of `df` that bear one of these names are replaced."""
    # titles repeat: the rules run once for each distinct one, and the few distinct titles are joined back
    t = F.col("normalized")
    name, level = seniority(t)
    each = df.where(F.col(column).isNotNull()).select(column, normalize.title(F.col(column)).alias("normalized")).distinct()
    each = each.select(column, t, name.alias("seniority"), level.alias("seniority_level"), most_matches(t, rules.ROLE_TYPES).alias("role_type"), first_match(t, rules.SPECIALIZATIONS).alias("specialization"), first_match(t, rules.DEPARTMENTS).alias("department"), first_match(t, rules.INDUSTRY_FOCUS).alias("industry_focus"))
    own = [c for c in df.columns if c == column or c not in each.columns]
    joined = df.select(*own).join(each, column, "left")
    return joined.select(*own, F.coalesce("normalized", F.lit("")).alias("normalized"), "seniority", F.coalesce("seniority_level", F.lit(0)).alias("seniority_level"), "role_type", "specialization", "department", "industry_focus")


def title_variations(c: Column) -> Column:
    """Other ways to write a title: abbreviated, without rank, developer for engineer and back."""
    swaps = [c, F.regexp_replace(c, "software engineer", "swe"), F.regexp_replace(c, "product manager", "pm"), F.trim(F.regexp_replace(c, r"\b(senior|junior|lead|principal|staff)\b\s*", "")), F.regexp_replace(c, "developer", "engineer"), F.regexp_replace(c, "engineer", "developer")]
    return F.array_distinct(F.filter(F.array(*swaps), lambda x: x != ""))


def location_parts(c: Column) -> Column:
    """struct(city, state, country, metro_area): metropolitan area, else place abroad, else "City, State"."""
    low = F.regexp_replace(F.lower(F.trim(c)), rules.COUNTRY_SUFFIX, "")
    none = F.lit(None).cast("string")

    def part(city: Column, state: Column, country: Column, metro: Column) -> Column:
        return F.struct(city.alias("city"), state.alias("state"), country.alias("country"), metro.alias("metro_area"))

    out: Column | None = None
    for name, state, cities in rules.METROS:
        hit = any_of(low, cities)
        city: Column | None = None
        for x in sorted(cities, key=lambda y: -len(y)):
            city = F.when(low.contains(x), x.title()) if city is None else city.when(low.contains(x), x.title())
        value = part(city, F.lit(state), F.lit("United States"), F.lit(name))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    for city_name, country, variants in rules.ABROAD:
        out = out.when(any_of(low, variants), part(F.lit(city_name), none, F.lit(country), none))
    first, second = F.trim(F.split(c, ",")[0]), F.trim(F.try_element_at(F.split(c, ","), F.lit(2)))
    state = F.create_map(*[F.lit(x) for kv in rules.STATES.items() for x in kv])[F.lower(second)]
    return out.when(c.contains(","), part(first, F.coalesce(state, second), F.when(state.isNotNull(), "United States"), none)).otherwise(part(none, none, none, none))


def location_entities(df: DataFrame, column: str) -> DataFrame:
    """city, state, country and metro_area beside the columns of `df`; the rules run once for each distinct place."""
    each = df.where(F.col(column).isNotNull()).select(column, location_parts(F.col(column)).alias("__place")).distinct()
    names = ["city", "state", "country", "metro_area"]
    own = [c for c in df.columns if c == column or c not in names]
    return df.select(*own).join(each, column, "left").select(*own, *(F.col("__place")[n].alias(n) for n in names))


def location_display(parts: Column, raw: Column) -> Column:
    """Metropolitan area, "City, State", "City, Country" abroad, city, else the text in title case."""
    p = parts
    abroad = F.when(p["country"] != "United States", F.concat_ws(", ", p["city"], p["country"]))
    return F.coalesce(p["metro_area"], F.when(p["state"].isNotNull(), F.concat_ws(", ", p["city"], p["state"])), abroad, p["city"], title_case(raw), F.lit(""))


def rule_entities(df: DataFrame, column: str, employer: str) -> DataFrame:
    """The second rule set: five first-match classes (industry from the company), normalised title and confidence."""
    t, e = F.lower(F.trim(F.col(column))), F.lower(F.col(employer))
    rules_of = {"normalized_title": normalize.title_short(F.col(column)), "seniority": first_match(t, rules.RULES_SENIORITY), "role_type": first_match(t, rules.RULES_ROLE), "specialization": first_match(t, rules.RULES_SPECIALIZATION), "department": first_match(t, rules.RULES_DEPARTMENT), "industry_focus": first_match(e, rules.RULES_INDUSTRY)}
    own = [c for c in df.columns if c not in rules_of]
    each = df.select(column, employer, *(x.alias(k) for k, x in rules_of.items())).distinct()
    back = df.select(*own).alias("d").join(each.alias("e"), F.col(f"d.{column}").eqNullSafe(F.col(f"e.{column}")) & F.col(f"d.{employer}").eqNullSafe(F.col(f"e.{employer}")), "left")
    out = back.select(*(F.col(f"d.{c}").alias(c) for c in own), *(F.col(f"e.{k}").alias(k) for k in rules_of))
    score = reduce(lambda a, b: a + b, (F.when(F.col(k).isNotNull(), F.lit(w)).otherwise(0.0) for k, w in rules.RULES_WEIGHTS.items()))
    return out.withColumn("confidence", F.round(score, 6))


def confidence_gate(df: DataFrame, threshold: float = 0.7, backend=None, key: str = "person_id") -> DataFrame:
    """extraction_method and confidence after the gate: rows below the threshold go to `backend` (DataFrame ->
    DataFrame with the same columns, one row for each and the key `key`); what it leaves null stays as the rules have it, and
    the higher confidence counts. Without a back end they keep their entities as `ai_fallback` with confidence 0.1 at least.
    Only gated rows ever reach a back end."""
    if backend is None:
        method = F.when(F.col("confidence") >= threshold, "rules").otherwise("ai_fallback")
        return df.withColumn("extraction_method", method).withColumn("confidence", F.greatest("confidence", F.when(F.col("confidence") >= threshold, 0.0).otherwise(0.1)))
    sure = df.where(F.col("confidence") >= threshold).withColumn("extraction_method", F.lit("rules"))
    rest = df.where(F.col("confidence") < threshold)
    found = ["seniority", "role_type", "specialization", "department", "industry_focus"]
    theirs = backend(rest).select(key, "normalized_title", *found, "confidence").withColumnsRenamed({c: f"__{c}" for c in ("normalized_title", *found, "confidence")})
    merged = rest.join(theirs, key, "left").withColumns({"normalized_title": F.coalesce("__normalized_title", "normalized_title"), "confidence": F.greatest("confidence", "__confidence"), **{c: F.coalesce(F.nullif(F.col(f"__{c}"), F.lit("")), c) for c in found}})
    return sure.unionByName(merged.select(*rest.columns, F.lit("hybrid").alias("extraction_method")))
