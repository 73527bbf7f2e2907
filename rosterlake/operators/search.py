"""Retrieval and ranking of profiles: weighted substring search, filters, full text, facets, scores, highlights."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rosterlake.functions import rules
from rosterlake.functions.text import any_of

WIDE = ["current_position", "current_company", "industry", "skills", "function"]


def has(c: str, t: str) -> Column:
    return F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False))


def term_filter(terms: list[tuple[str, float]]) -> Column | None:
    """High terms (0.8 and more, at most 10) in any of four fields AND medium terms (0.5 to 0.8, at most 8) in any of
    three; finance queries look at `function` instead of `skills` for their own terms and must show a finance trait."""
    words = [t for t, _ in terms]
    finance = any(t in words for t in rules.FINANCE_TRIGGERS)
    high, medium = [t for t, w in terms if w >= 0.8][:10], [t for t, w in terms if 0.5 <= w < 0.8][:8]
    # one pattern a field: the plan stays small however many terms there are
    any_ = lambda by: reduce(lambda a, b: a | b, (F.coalesce(any_of(F.lower(c), ts), F.lit(False)) for c, ts in by.items() if ts))
    fields = ("current_position", "current_company", "industry")
    parts = []
    if high:
        aside = [t for t in high if finance and t in rules.FINANCE_FIELD_TERMS]
        parts.append(any_({**dict.fromkeys(fields, high), "function": aside, "skills": [t for t in high if t not in aside]}))
    if medium:
        parts.append(any_(dict.fromkeys(fields, medium)))
    if parts and finance:
        parts.append(any_(rules.FINANCE_GUARD))
    return reduce(lambda a, b: a & b, parts) if parts else None


#: Slots of the base score: field and points of each pattern in turn.
SLOTS = [("current_position", (15, 12, 10)), ("current_company", (12, 10, 8)), ("industry", (8, 6)), ("skills", (6, 4)), ("function", (5,))]


def base_score(terms: list[tuple[str, float]], compat: bool = True) -> Column:
    """Points by the first five terms in eleven slots. With `compat` a slot without a term matches any non-null value."""
    words: list[str | None] = [t for t, _ in terms][:5]
    words += [None] * (11 - len(words))
    at = 0
    total: Column = F.lit(0)
    for field, points in SLOTS:
        chain: Column | None = None
        for p in points:
            t = words[at]
            at += 1
            if t is None and not compat:
                continue
            hit = has(field, t) if t is not None else F.col(field).isNotNull()
            chain = F.when(hit, p) if chain is None else chain.when(hit, p)
        total = total + (chain.otherwise(0) if chain is not None else F.lit(0))
    y = F.col("graduation_year")
    return total + F.when(y >= 2020, 3).when(y >= 2015, 2).when(y >= 2010, 1).otherwise(0)


def weighted_search(wide: DataFrame, terms: list[tuple[str, float]], limit: int, compat: bool = True) -> DataFrame:
    """The `limit` best profiles by base score, then year (unknown first), name and id. No condition, no rows."""
    cond = term_filter(terms)
    if cond is None:
        return wide.withColumn("relevance_score", F.lit(0)).limit(0)
    return wide.where(cond).withColumn("relevance_score", base_score(terms, compat)).where("relevance_score > 0").orderBy(F.desc("relevance_score"), F.desc_nulls_first("graduation_year"), F.asc_nulls_first("name"), "person_id").limit(limit)


def rescore(hits: DataFrame, terms: list[tuple[str, float]], domains: dict[str, float], k: int) -> DataFrame:
    """final_score and explanation of the hits, the best k: base / 50 * 0.6 + share of strong terms found * 0.4, raised
    by up to half for companies and roles of the query's domains."""
    field = lambda c: F.coalesce(F.lower(F.col(c)), F.lit(""))
    short = F.concat_ws(" ", field("current_position"), field("current_company"), field("industry"))
    text = F.concat_ws(" ", short, field("skills"))
    inside = lambda c, words: F.filter(F.array(*map(F.lit, words)).cast("array<string>"), lambda x: c.contains(x))
    found = inside(text, [t for t, w in terms if w >= 0.7])
    boost: Column = F.lit(0.0)
    for d, w in domains.items():
        boost = boost + F.size(inside(short, rules.DOMAINS[d]["companies"])) * (w * 0.3) + F.size(inside(short, rules.DOMAINS[d]["roles"])) * (w * 0.2)
    df = hits.withColumn("semantic", found).withColumn("domain_boost", F.least(boost, F.lit(0.5)))
    score = F.least(F.lit(1.0), (F.col("relevance_score") / 50.0 * 0.6 + F.size("semantic") / float(max(len(terms), 1)) * 0.4) * (1 + F.col("domain_boost")))
    first = lambda c, name: F.concat(F.lit(f"{name}: '"), F.get(inside(field(c), [t for t, _ in terms]), F.lit(0)), F.lit("'"))
    in_position, in_company = first("current_position", "position"), first("current_company", "company")
    top = f"domain: {max(domains, key=domains.get)}" if domains else None
    why = F.concat_ws("; ", in_position, in_company, F.when(F.size("semantic") > 0, F.concat(F.lit("semantic: "), F.array_join(F.slice("semantic", 1, 2), ", "))), F.lit(top))
    return df.withColumn("final_score", F.round(score, 6)).withColumn("explanation", F.when(why == "", "general match").otherwise(why)).orderBy(F.desc("final_score"), F.desc("relevance_score"), F.desc_nulls_first("graduation_year"), F.asc_nulls_first("name"), "person_id").limit(k)


def entity_filter(df: DataFrame, companies: list[str] | None = None, locations: list[str] | None = None, seniority: list[str] | None = None, least_level: int | None = None) -> DataFrame:
    """Rows of the given companies (now or before), places (metropolitan area, normalised or city), ranks and least level."""
    if companies:
        past = F.arrays_overlap("experience_companies", F.array(*map(F.lit, companies))) if "experience_companies" in df.columns else F.lit(False)
        df = df.where(F.col("normalized_company").isin(companies) | F.coalesce(past, F.lit(False)))
    if locations:
        df = df.where(reduce(lambda a, b: a | b, (F.col(c).isin(locations) for c in ("metro_area", "normalized_location", "city") if c in df.columns)))
    if seniority:
        df = df.where(F.col("seniority").isin(seniority))
    if least_level is not None:
        df = df.where(F.col("seniority_level") >= least_level)
    return df


def analyze(c: Column) -> Column:
    """Words of a text in lower case without stop words (no stemming)."""
    return F.filter(F.split(F.lower(c), r"[^a-z0-9]+"), lambda x: (x != "") & ~x.isin(rules.TITLE_STOPWORDS))


def full_text(df: DataFrame, query: str, fields: list[str]) -> DataFrame:
    """Rows that hold every word of the query in one of the fields; a query of stop words alone finds nothing."""
    words = [w for w in "".join(ch if ch.isalnum() else " " for ch in query.lower()).split() if w not in rules.TITLE_STOPWORDS]
    if not words:
        return df.limit(0)
    q = F.array(*map(F.lit, words))
    return df.where(reduce(lambda a, b: a | b, (F.coalesce(F.size(F.array_except(q, analyze(F.col(c)))) == 0, F.lit(False)) for c in fields)))


def facets(df: DataFrame, columns: dict[str, int]) -> DataFrame:
    """(facet, value, n): the most frequent values of each column over the matched rows, all columns in one pass."""
    long = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("facet"), F.col(c).cast("string").alias("value")) for c in columns))).alias("x")).select("x.*").where("value is not null and value <> ''")
    counted = long.groupBy("facet", "value").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    top = F.create_map(*[F.lit(x) for kv in columns.items() for x in kv])
    return counted.withColumn("r", F.row_number().over(Window.partitionBy("facet").orderBy(F.desc("n"), "value"))).where(F.col("r") <= top[F.col("facet")]).drop("r")


def _share(c: Column, terms: list[str]) -> Column:
    low = F.coalesce(F.lower(c), F.lit(""))
    return reduce(lambda a, b: a + b, (low.contains(t).cast("int") for t in terms)) / float(len(terms))


def normalized_score(df: DataFrame, terms: list[str], related: dict[str, float], as_of_year: int, locations: list[str] = (), seniority: list[str] = (), education: list[str] = ()) -> DataFrame:
    """exact, cooccurrence and final_score (0 to 1) from current_title, current_company, skills and experience (texts),
    a semantic similarity column `semantic` if there is one, and modifiers with diminishing returns."""
    w = rules.EXACT_WEIGHTS
    text = lambda c: F.col(c) if c in df.columns else F.lit("")
    exact = _share(text("current_title"), terms) * w["title"] + _share(text("current_company"), terms) * w["company"] + _share(text("skills"), terms) * w["skills"] + _share(text("experience"), terms) * w["experience"] if terms else F.lit(0.0)
    everything = [F.coalesce(F.lower(text(c)), F.lit("")) for c in ("current_title", "current_company", "normalized_title", "skills")]
    cooc = reduce(lambda a, b: a + b, (F.when(reduce(lambda p, q: p | q, (x.contains(t) for x in everything)), c).otherwise(0.0) for t, c in related.items())) / float(len(related)) if related else F.lit(0.0)
    sem = F.coalesce(F.col("semantic"), F.lit(0.0)) if "semantic" in df.columns else F.lit(0.0)
    s = rules.SCORE_WEIGHTS
    base = exact * s["exact"] + sem * s["semantic"] + F.least(cooc, F.lit(1.0)) * s["cooccurrence"]
    years = F.lit(as_of_year) - F.col("graduation_year")
    mod = F.when(years <= 10, 0.2 * (10 - years) / 10).otherwise(0.0)
    if locations:
        mod = mod + F.when(F.col("metro_area").isin(list(locations)), 0.1).otherwise(0.0)
    if seniority:
        mod = mod + F.when(F.col("seniority").isin(list(seniority)), 0.1).otherwise(0.0)
    if education:
        mod = mod + F.when(any_of(F.lower("education_school"), list(education)), 0.1).otherwise(0.0)
    df = df.withColumn("modifier", F.coalesce(mod, F.lit(0.0))).withColumn("exact", exact).withColumn("cooccurrence", F.least(cooc, F.lit(1.0)))
    return df.withColumn("final_score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), base + (1 - base) * mod * 0.5)), 4))


def score_explanation(df: DataFrame) -> Column:
    """The score and its parts in words, from the columns of `normalized_score`: one line a part, in percent."""
    percent = lambda c: F.format_string("%.2f%%", F.bround(F.coalesce(c, F.lit(0.0)), 4) * 100)
    s = rules.SCORE_WEIGHTS
    names = {"exact": "Exact match score", "semantic": "Semantic similarity", "cooccurrence": "Co-occurrence match score"}
    parts = [F.concat(F.lit(f"  - {names[k]}: "), percent(F.col(k)), F.lit(f" (weight: {w:.0%})")) for k, w in s.items() if k in df.columns]
    bonus = F.when(F.col("modifier") > 0, F.concat(F.lit("Score Modifiers: +"), percent(F.col("modifier"))))
    return F.concat_ws("\n", F.concat(F.lit("Final Score: "), percent(F.col("final_score"))), F.lit("Score Components:"), *parts, bonus)


def legacy_score(df: DataFrame, terms: list[str], as_of_year: int, boosts: dict[str, float] | None = None, seniority: list[str] = (), locations: list[str] = ()) -> DataFrame:
    """The additive score: one hit a field, one a matching skill and past title, ranks and places asked for, recency,
    divided by ln(1 + length of the main fields). Columns that `df` lacks add nothing."""
    w, boosts = rules.LEGACY_WEIGHTS, boosts or {}
    hit = lambda c: reduce(lambda a, b: a | b, (F.coalesce(F.lower(F.col(c)), F.lit("")).contains(t) for t in terms))
    parts = {k: F.when(hit(c), w[k]).otherwise(0.0) for k, c in (("exact_title", "current_title"), ("exact_company", "current_company"), ("normalized_title", "normalized_title"), ("normalized_company", "normalized_company"))}
    if "skill_list" in df.columns:
        parts["skill"] = F.size(F.filter("skill_list", lambda s: reduce(lambda a, b: a | b, (F.lower(s).contains(t) for t in terms)))) * w["skill"]
    if "experience_titles" in df.columns:
        parts["experience"] = F.coalesce(F.size(F.filter("experience_titles", lambda s: any_of(F.lower(s), terms))), F.lit(0)) * w["experience"]
    if seniority:
        parts["seniority"] = F.when(F.col("seniority").isin(list(seniority)), w["seniority"]).otherwise(0.0)
    if locations:
        parts["location"] = F.when(F.col("metro_area").isin(list(locations)), w["location"]).otherwise(0.0)
    years = F.lit(as_of_year) - F.col("graduation_year")
    parts["recency"] = F.when(years <= 10, w["recency"] * (10 - years) / 10).otherwise(0.0)
    total = reduce(lambda a, b: a + b, (v * boosts.get(k, 1.0) for k, v in parts.items()))
    size = F.length(F.concat(*(F.coalesce(F.col(c), F.lit("")) for c in ("current_title", "current_company", "normalized_title"))))
    return df.withColumn("score", F.when(size > 0, total / F.log(1.0 + size)).otherwise(total))


def hybrid(keyword: DataFrame, semantic: DataFrame, k: int, weight: float = 0.3, union_semantic: bool = False, key: str = "person_id") -> DataFrame:
    """(key, score): keyword score plus weighted similarity; hits of the semantic side alone are dropped unless asked for."""
    both = keyword.select(key, "score").join(semantic.select(key, "similarity"), key, "full" if union_semantic else "left")
    return both.select(key, F.round(F.coalesce("score", F.lit(0.0)) + F.coalesce("similarity", F.lit(0.0)) * weight, 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def page(ranked: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows `offset` to `offset + limit` of the order; an offset past the end gives none."""
    return ranked.orderBy(*order).offset(offset).limit(limit)


def condition(terms: list[str], expansions: dict[str, float], least: float = 0.5) -> list[str]:
    """The terms of a widened full-text condition: the asked ones and expansions above `least` without their prefix."""
    return list(dict.fromkeys([*terms, *(t.split(":", 1)[-1] for t, c in expansions.items() if c > least)]))


def any_full_text(df: DataFrame, terms: list[str], fields: list[str]) -> DataFrame:
    """Rows that hold every word of one of the terms in one of the fields; no term asks for nothing and keeps all rows."""
    if not terms:
        return df
    asked = [[w for w in "".join(ch if ch.isalnum() else " " for ch in t.lower()).split() if w not in rules.TITLE_STOPWORDS] for t in terms]
    hit = [F.coalesce(F.size(F.array_except(F.array(*map(F.lit, q)), analyze(F.col(c)))) == 0, F.lit(False)) for q in asked if q for c in fields]
    return df.where(reduce(lambda a, b: a | b, hit)) if hit else df.limit(0)


def highlight(c: Column, terms: list[str]) -> Column:
    """Terms in <mark> tags, in whatever case they are written."""
    for t in sorted(terms, key=len, reverse=True):
        quoted = "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in t)
        c = F.regexp_replace(c, f"(?i)({quoted})", "<mark>$1</mark>")
    return c
