"""Term documents, frequencies and co-occurrence of terms, kept as long tables (document, term)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions import entities, rules
from rosterlake.functions.text import without_dates
from rosterlake.session import cut


def _long(df: DataFrame, key: str, terms: list[tuple[str, Column]]) -> DataFrame:
    """One row per non-empty (prefix, value), in lower case."""
    values = F.array(*(F.when(c.isNotNull() & (c != ""), F.concat(F.lit(f"{p}:"), F.lower(c))) for p, c in terms))
    return df.select(key, F.explode(F.filter(values, lambda x: x.isNotNull())).alias("term"))


def term_documents(people: DataFrame, skills: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, term): company, whole title, rank, role, specialisation, department, industry, place and skills, distinct."""
    e = entities.location_entities(entities.title_entities(people, "current_title"), "location")
    place = F.struct("city", "state", "country", "metro_area")
    where = F.when(F.col("location").isNotNull(), entities.location_display(place, F.col("location")))
    mine = _long(e, key, [("company", F.col("normalized_company")), ("title", F.col("normalized")), ("seniority", F.col("seniority")), ("role", F.col("role_type")), ("spec", F.col("specialization")), ("dept", F.col("department")), ("industry", F.col("industry_focus")), ("location", where)])
    known = skills.join(people.select(key).distinct(), key, "left_semi")
    return mine.unionByName(_long(known, key, [("skill", F.trim("skill"))])).distinct()


def keep_term(c: Column) -> Column:
    """True for a cleaned term that is no time word, number or punctuation and at least two letters long."""
    return (F.length(c) >= 2) & ~c.isin(rules.TEMPORAL_TERMS) & ~c.rlike(r"^[0-9]+$") & (F.length(F.regexp_replace(c, r"[^\w\s]", "")) >= F.length(c) * 0.5)


def split_documents(people: DataFrame, key: str = "person_id") -> DataFrame:
    """(key, term) of rows with a title: title words, rank, role, specialisation, industry and company, without time
    words; documents of fewer than two terms and terms rarer than max(2, documents / 1000) are left out."""
    e = cut(entities.title_entities(people.where("current_title is not null and current_title <> ''").select(key, "current_title", "normalized_company"), "current_title"))
    words = e.select(key, F.explode(F.split(without_dates(F.col("normalized")), " ")).alias("w")).where(F.length("w") > 2).select(key, F.lit("title").alias("p"), F.col("w").alias("v"))
    rest = e.select(key, F.explode(F.array(*(F.struct(F.lit(p).alias("p"), F.col(c).alias("v")) for p, c in (("seniority", "seniority"), ("role", "role_type"), ("spec", "specialization"), ("industry", "industry_focus"), ("company", "normalized_company"))))).alias("x")).select(key, "x.p", without_dates(F.col("x.v")).alias("v"))
    # read three times below: written once in the shared folder
    terms = cut(words.unionByName(rest).where(F.col("v").isNotNull() & keep_term(F.col("v"))).select(key, F.concat_ws(":", "p", "v").alias("term")).distinct())
    docs = terms.groupBy(key).count().where("count >= 2").select(key)
    terms = terms.join(docs, key, "left_semi")
    n = docs.agg(F.count("*").alias("n_docs"))
    kept = terms.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where(F.col("df") >= F.greatest(F.lit(2), F.floor(F.col("n_docs") / 1000))).select("term")
    return terms.join(kept, "term", "left_semi").select(key, "term")


def frequencies(docs: DataFrame) -> DataFrame:
    """(term, df): number of documents of each term."""
    return docs.groupBy("term").agg(F.count("*").alias("df"))


def pair_counts(docs: DataFrame, key: str, support: int = 5) -> DataFrame:
    """(term1, term2, n12, n1, n2) of the pairs term1 < term2 in at least `support` documents.

    Terms below the support leave before the self-join; no pair of theirs could reach it.
    """
    df = frequencies(docs).where(F.col("df") >= support)
    kept = docs.join(df.select("term"), "term", "left_semi")
    a, b = kept.select(key, F.col("term").alias("term1")), kept.select(key, F.col("term").alias("term2"))
    pairs = a.join(b, key).where("term1 < term2").groupBy("term1", "term2").agg(F.count("*").alias("n12")).where(F.col("n12") >= support)
    return pairs.join(df.select(F.col("term").alias("term1"), F.col("df").alias("n1")), "term1").join(df.select(F.col("term").alias("term2"), F.col("df").alias("n2")), "term2")


def with_metrics(pairs: DataFrame, total: int, weighted: bool = False) -> DataFrame:
    """pmi (base 2; natural if weighted), npmi, lift, confidence and reverse confidence beside the counts.

    Weighted: the pair count is multiplied by the weights of both term types, so that ratios may pass 1 as documented.
    """
    n12 = F.col("n12").cast("double")
    if weighted:
        weight = F.create_map(*[F.lit(x) for kv in rules.TERM_WEIGHTS.items() for x in kv])
        n12 = n12 * F.coalesce(weight[F.split("term1", ":")[0]], F.lit(1.0)) * F.coalesce(weight[F.split("term2", ":")[0]], F.lit(1.0))
    n, n1, n2 = F.lit(float(total)), F.col("n1").cast("double"), F.col("n2").cast("double")
    ratio = n12 * n / (n1 * n2)
    pmi = F.log(ratio) if weighted else F.log2(ratio)
    log_p = F.log(n12 / n) if weighted else F.log2(n12 / n)
    return pairs.withColumn("w12", n12).withColumn("pmi", pmi).withColumn("npmi", F.try_divide(pmi, -log_p)).withColumn("lift", ratio).withColumn("confidence", n12 / n1).withColumn("reverse_confidence", n12 / n2)


def significant(metrics: DataFrame, lift: float = 2.0, confidence: float = 0.3, npmi: float = 0.2) -> DataFrame:
    """Pairs whose lift, confidence and npmi are above their bounds and that are not passed over."""
    return metrics.where((F.col("lift") > lift) & (F.col("confidence") > confidence) & (F.col("npmi") > npmi) & ~skip_pair())


def skip_pair() -> Column:
    """Pairs passed over: same field but for titles, place with company, and generic terms."""
    p, q = F.split("term1", ":")[0], F.split("term2", ":")[0]
    both = F.array_sort(F.array(p, q))
    return ((p == q) & (p != "title")) | (both == F.array(F.lit("company"), F.lit("location"))) | F.col("term1").isin(rules.GENERIC_TERMS) | F.col("term2").isin(rules.GENERIC_TERMS)


def expansions(metrics: DataFrame, k: int = 10, lift: float = 2.0, confidence: float = 0.3) -> DataFrame:
    """(term, expansion, weight, rank): the k expansions of each term with the highest confidence in that direction."""
    both = metrics.select(F.col("term1").alias("term"), F.col("term2").alias("expansion"), F.col("confidence").alias("weight"), "lift").unionByName(metrics.select(F.col("term2").alias("term"), F.col("term1").alias("expansion"), F.col("reverse_confidence").alias("weight"), "lift"))
    order = Window.partitionBy("term").orderBy(F.desc(F.round("weight", 9)), "expansion")
    return both.where((F.col("lift") >= lift) & (F.col("weight") >= confidence)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("lift")


def associations(metrics: DataFrame, word: str, k: int = 10) -> DataFrame:
    """(term, associated, pmi): what goes with a word under any of the usual prefixes, the strongest first."""
    forms = [word, *(f"{p}:{word}" for p in ("title", "company", "skill", "role", "industry"))]
    both = metrics.select(F.col("term1").alias("term"), F.col("term2").alias("associated"), "pmi").unionByName(metrics.select(F.col("term2").alias("term"), F.col("term1").alias("associated"), "pmi"))
    return both.where(F.col("term").isin(forms)).orderBy(F.desc(F.round("pmi", 9)), "associated").limit(k)


def synonyms(pairs: DataFrame, least: float = 0.7) -> DataFrame:
    """(term1, term2, cosine) of terms of one type whose document vectors are at least so similar."""
    cosine = F.col("n12") / F.sqrt(F.col("n1").cast("double") * F.col("n2"))
    return pairs.where(F.split("term1", ":")[0] == F.split("term2", ":")[0]).select("term1", "term2", cosine.alias("cosine")).where(F.col("cosine") >= least)


def tfidf(docs: DataFrame, key: str, text: str, min_df: int = 5, max_share: float = 0.8, features: int = 10_000) -> DataFrame:
    """(key, term, tf, tfidf) of the most frequent words that are neither too rare nor too common; idf = ln((N+1)/(df+1)).

    Words are runs of two or more letters of any alphabet, in lower case. The number of terms kept is the feature."""
    words = docs.where(F.col(text).isNotNull()).select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}{2,})"), F.lit(1))).alias("term"))
    tf = words.groupBy(key, "term").agg(F.count("*").alias("tf"))
    n = docs.agg(F.count("*").alias("n_docs"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n)).where((F.col("df") >= min_df) & (F.col("df") <= max_share * F.col("n_docs"))).orderBy(F.desc("df"), "term").limit(features)
    return tf.join(df, "term").select(key, "term", "tf", (F.col("tf") * F.log((F.col("n_docs") + 1) / (F.col("df") + 1))).alias("tfidf"))
