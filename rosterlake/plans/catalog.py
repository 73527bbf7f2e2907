"""Registry of the core queries and of the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import entities, normalize, rules
from rosterlake.functions.text import find_all, first_match, most_matches, without_dates
from rosterlake.operators import dedup, expand, packed, quality, relations, search, terms, texts, vectors
from rosterlake.plans import query, sql
from rosterlake.session import cut
from rosterlake.sources import sinks
from rosterlake.sources.fixtures import view

Query = Callable[[SparkSession, str], DataFrame]
ASK = "data scientist at a bank"
FINANCE_ASK = "investment analyst wall st"
AS_OF = date(1999, 1, 1)
AS_OF_YEAR = 2024
WORDS = ["analyst", "bank", "legal"]
RELATED = {"manager": 0.6, "health": 0.4, "planning": 0.5}


def _title():
    return F.lower(F.col("current_title"))


def _people(spark, d):
    return view(spark, d, "alumni")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: values packed in one field."""
    return packed.profile_lists(view(spark, d, "enhanced_search_result"))


# ---- search


def weighted_like_search(spark, d):
    return search.weighted_search(view(spark, d, "enhanced_search_result"), query.process(ASK).terms, 30).select("person_id", "name", "graduation_year", "relevance_score")


def finance_search(spark, d):
    return search.weighted_search(view(spark, d, "enhanced_search_result"), query.process(FINANCE_ASK).terms, 30).select("person_id", "name", "graduation_year", "relevance_score")


def domain_rescore_topk(spark, d):
    p = query.process(ASK)
    hits = search.weighted_search(view(spark, d, "enhanced_search_result"), p.terms, 30)
    return search.rescore(hits, p.terms, p.domains, 10).select("person_id", "relevance_score", "final_score", "explanation")


def _skill_lists(spark, d):
    s = view(spark, d, "skills").where("skill is not null and trim(skill) <> ''")
    return s.groupBy("person_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("skill")))).alias("skill_list"))


def _fanin(spark, d):
    return _people(spark, d).join(_skill_lists(spark, d), "person_id", "left").withColumn("skill_list", F.coalesce("skill_list", F.array().cast("array<string>")))


def profile_fanin_collect(spark, d):
    return _fanin(spark, d).select("person_id", F.size("skill_list").alias("n_skills"), F.array_join("skill_list", "|").alias("skills"))


def skill_exists_semijoin(spark, d):
    known = view(spark, d, "skills").where(F.lower(F.trim("skill")) == "stakeholder management").select("person_id")
    return _people(spark, d).join(known, "person_id", "left_semi").select("person_id", "graduation_year")


def entity_filters(spark, d):
    e = entities.title_entities(_people(spark, d), "current_title")
    return search.entity_filter(e, seniority=["manager", "director", "principal"], least_level=5).select("person_id", "seniority", "seniority_level")


def fulltext_all_terms(spark, d):
    return search.full_text(_people(spark, d), "manager of marketing", ["current_title", "normalized_title"]).select("person_id", "current_title")


def facets(spark, d):
    e = entities.title_entities(_people(spark, d).where(search.has("current_title", "manager")), "current_title")
    return search.facets(e, {"normalized_company": 20, "seniority": 10, "role_type": 10})


def suggestions(spark, d):
    a = quality.top(_people(spark, d), "current_company", 5).select(F.concat(F.lit("company: "), "value").alias("suggestion"), "n")
    b = quality.top(_people(spark, d), "current_title", 5).select(F.concat(F.lit("role: "), "value").alias("suggestion"), "n")
    return a.unionByName(b)


def _scored(spark, d):
    return _fanin(spark, d).withColumn("skills", F.array_join("skill_list", " "))


def normalized_score(spark, d):
    return search.normalized_score(_scored(spark, d), WORDS, RELATED, AS_OF_YEAR).select("person_id", F.round("exact", 6).alias("exact"), F.round("cooccurrence", 6).alias("cooccurrence"), F.round("final_score", 3).alias("final_score"))


def legacy_score(spark, d):
    return search.legacy_score(_scored(spark, d), WORDS, AS_OF_YEAR, {"exact_title": 1.5}).select("person_id", F.round("score", 6).alias("score"))


def hybrid_merge(spark, d):
    kw = search.legacy_score(_scored(spark, d), WORDS, AS_OF_YEAR).where("score > 0").select("person_id", "score")
    e = F.col("embedding")
    rows = view(spark, d, "profile_embeddings").where((F.size(e) == 384) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    q = F.array(*(F.lit(x) for x in _query_vector(384)))
    sem = rows.select("person_id", F.round(vectors.dot(e, q), 6).alias("s")).groupBy("person_id").agg(F.max("s").alias("similarity"))
    return search.hybrid(kw, sem, 50)


# ---- records


def company_normalize_regex(spark, d):
    return _people(spark, d).select("person_id", normalize.company_cleaned(F.col("current_company")).alias("cleaned"))


def company_normalize(spark, d):
    return _people(spark, d).select("person_id", normalize.company(F.col("current_company"), fuzzy=True).alias("normalized"))


def location_normalize(spark, d):
    low = F.regexp_replace(F.lower(F.trim("location")), rules.COUNTRY_SUFFIX, "")
    return _people(spark, d).select("person_id", low.alias("low"), normalize.location(F.col("location")).alias("normalized"))


def record_hash_dedup(spark, d):
    h = _people(spark, d).withColumn("h", normalize.record_hash(F.col("name"), F.col("current_company"), F.col("graduation_year")))
    return dedup.exact(h, "h", ["created_at", "person_id"]).select("person_id", "h")


def fuzzy_dedup(spark, d):
    return dedup.greedy(_people(spark, d), "person_id", "name", "current_company", [])


def year_parse(spark, d):
    return view(spark, d, "documents").select("doc_id", normalize.year(F.regexp_replace("text", r"\s+", " ")).alias("year"))


def _ordering(spark, d):
    return view(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).distinct()


def upsert_touch(spark, d):
    c = view(spark, d, "customer").select("c_custkey", "c_name", F.lit("old").alias("stamp"))
    return sinks.upsert_touch(c, c.join(_ordering(spark, d), "c_custkey", "left_semi"), "c_custkey", "stamp", F.lit("touched"))


def upsert_replace(spark, d):
    c = view(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return sinks.upsert_replace(c, c.join(_ordering(spark, d), "c_custkey", "left_semi").withColumn("c_name", F.upper("c_mktsegment")), ["c_custkey"])


# ---- entities


def seniority_extract(spark, d):
    name, level = entities.seniority(_title())
    return _people(spark, d).where("current_title is not null").select("person_id", name.alias("seniority"), level.alias("level"))


def role_type_argmax(spark, d):
    return _people(spark, d).where("current_title is not null").select("person_id", most_matches(_title(), rules.ROLE_TYPES).alias("role_type"))


def specialization_first_match(spark, d):
    return _people(spark, d).where("current_title is not null").select("person_id", first_match(_title(), rules.SPECIALIZATIONS).alias("specialization"))


def title_entities(spark, d):
    return entities.title_entities(_people(spark, d).where("current_title is not null").select("person_id", "current_title"), "current_title").drop("current_title")


def location_components(spark, d):
    return entities.location_entities(_people(spark, d).where("location is not null").select("person_id", "location"), "location").drop("location")


def rule_confidence_gate(spark, d):
    e = entities.rule_entities(_people(spark, d).where("current_title is not null").select("person_id", "current_title", "current_company"), "current_title", "current_company")
    return entities.confidence_gate(e).select("person_id", "seniority", "role_type", "specialization", "department", "industry_focus", "confidence", "extraction_method")


def extraction_stats(spark, d):
    return rule_confidence_gate(spark, d).groupBy("extraction_method").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("role_type").isNotNull().cast("double")), 6).alias("role_rate"))


def title_variations(spark, d):
    t = normalize.title(F.col("current_title"))
    return _people(spark, d).where("current_title is not null").select("person_id", F.array_join(F.array_sort(entities.title_variations(t)), "|").alias("variations"))


def place_display(spark, d):
    return _people(spark, d).where("location is not null").select("person_id", entities.location_display(entities.location_parts(F.col("location")), F.col("location")).alias("display"))


def record_fields(spark, d):
    c = F.col
    return _people(spark, d).select("person_id", normalize.title_spaces(c("current_title")).alias("spaced"), normalize.title_short(c("current_title")).alias("short"), normalize.company(c("current_company")).alias("company"))


# ---- quality


def quality_report(spark, d):
    return quality.report(_people(spark, d), view(spark, d, "skills"))


def top_companies(spark, d):
    return quality.top(_people(spark, d), "current_company", 10)


def year_distribution(spark, d):
    return _people(spark, d).where("graduation_year is not null").groupBy("graduation_year").agg(F.count("*").alias("n"))


def token_frequency(spark, d):
    return quality.token_frequency(_people(spark, d), "current_title")


def temporal_term_filter(spark, d):
    w = view(spark, d, "documents").where("text is not null").select("doc_id", F.explode(F.split(F.lower("text"), r"[^a-z0-9-]+")).alias("term")).where(terms.keep_term(F.col("term")))
    return w.groupBy("doc_id").agg(F.count("*").alias("n"), F.count_distinct("term").alias("n_distinct"))


def temporal_clean(spark, d):
    return view(spark, d, "documents").where("text is not null").select("doc_id", F.md5(without_dates(F.col("text"))).alias("digest"))


# ---- terms


def _docs(spark, d):
    return view(spark, d, "doc_terms")


def term_documents_v1(spark, d):
    return terms.term_documents(_people(spark, d), view(spark, d, "skills")).groupBy("term").agg(F.count("*").alias("n"))


def term_documents_v2(spark, d):
    return terms.split_documents(_people(spark, d)).groupBy("person_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), "|").alias("terms"))


def doc_frequency(spark, d):
    return terms.frequencies(_docs(spark, d))


def _metrics(spark, d, weighted=False):
    docs = cut(_docs(spark, d))
    return terms.with_metrics(terms.pair_counts(docs, "person_id"), docs.select("person_id").distinct().count(), weighted)


def _rounded(df):
    return df.select("term1", "term2", "n12", "n1", "n2", *(F.round(c, 6).alias(c) for c in ("pmi", "npmi", "lift", "confidence", "reverse_confidence")))


def cooccurrence_pmi(spark, d):
    return _rounded(_metrics(spark, d))


def cooccurrence_weighted(spark, d):
    return _rounded(_metrics(spark, d, True).where(~terms.skip_pair()))


def expansion_topk(spark, d):
    return terms.expansions(_metrics(spark, d), 10, 1.0, 0.05).select("term", "expansion", F.round("weight", 6).alias("weight"), "rank")


def cooccurrence_significant(spark, d):
    return _rounded(terms.significant(_metrics(spark, d), 1.0, 0.05, 0.0))


def one_hop_expansion(spark, d):
    return expand.one_hop(terms.expansions(_metrics(spark, d), 10, 1.0, 0.05), "building").select("expansion", F.round("weight", 6).alias("weight"))


def engine_expansion(spark, d):
    t = cut(terms.expansions(_metrics(spark, d), 10, 1.0, 0.05))
    return expand.multi_hop(t, t.select("term").distinct(), least=0.03, k=20).select("start", "expansion", F.round("weight", 6).alias("weight"), "hop")


def expansion_types(spark, d):
    return expand.by_type(terms.expansions(_metrics(spark, d), 10, 1.0, 0.05))


def term_nodes(spark, d):
    words = _people(spark, d).select(F.explode(F.split(F.lower("current_title"), r"[^a-z0-9]+")).alias("word")).unionByName(spark.sql("SELECT explode(array('machinery', 'Europe', 'economy', 'building', 'skill:brand#11')) AS word"))
    return expand.nodes_of(words.where("word <> ''"), _docs(spark, d).select("term"))


def expansion_idf(spark, d):
    docs = _docs(spark, d)
    n = docs.select("person_id").distinct().agg(F.count("*").alias("total"))
    df = docs.select("person_id", F.substring_index("term", ":", -1).alias("term")).distinct().groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))
    return expand.idf_weighted(terms.expansions(_metrics(spark, d), 10, 1.0, 0.05), df).select("term", "expansion", F.round("weight", 6).alias("weight"))


def term_associations(spark, d):
    return terms.associations(_metrics(spark, d), "machinery").select("term", "associated", F.round("pmi", 6).alias("pmi"))


def synonyms_cosine(spark, d):
    return terms.synonyms(terms.pair_counts(_docs(spark, d), "person_id"), 0.05).select("term1", "term2", F.round("cosine", 6).alias("cosine"))


def tfidf_terms(spark, d):
    return terms.tfidf(view(spark, d, "documents"), "doc_id", "text").groupBy("term").agg(F.sum("tf").alias("tf"), F.round(F.sum("tfidf"), 4).alias("weight"))


def multi_hop_expansion(spark, d):
    t = cut(terms.expansions(_metrics(spark, d), 10, 1.0, 0.05))
    return expand.multi_hop(t, t.select("term").distinct()).select("start", "expansion", F.round("weight", 6).alias("weight"), "hop")


def graph_expansion(spark, d):
    m = _metrics(spark, d)
    return expand.graph_expand(expand.graph_edges(m, 0.05, 1.0), m.select(F.col("term1").alias("term")).distinct(), least=0.01).withColumn("score", F.round("score", 6))


# ---- relations and careers


def _overlaps(spark, d):
    return relations.overlaps(view(spark, d, "stints"), AS_OF, 0.0)


def colleague_overlap(spark, d):
    return _overlaps(spark, d).groupBy("company").agg(F.count("*").alias("n"), F.round(F.sum("months"), 4).alias("months"), F.min("overlap_start").alias("first"), F.max("overlap_end").alias("last"))


def relationship_score(spark, d):
    return relations.strength(relations.overlaps(view(spark, d, "stints"), AS_OF)).groupBy("person1").agg(F.count("*").alias("n"), F.round(F.sum("final_score"), 4).alias("score"), F.round(F.max("final_score"), 6).alias("best"))


def connections(spark, d):
    edges = relations.strength(relations.overlaps(view(spark, d, "stints"), AS_OF, of=[1]))
    return relations.connections(edges, 1).select("other", F.round("final_score", 6).alias("score"))


def mutual_connectors(spark, d):
    edges = relations.strength(relations.overlaps(view(spark, d, "stints"), AS_OF, of=[1, 2]))
    return relations.connectors(edges, 1, 2).select("connector", F.round("score", 6).alias("score"), F.round("years_ago", 6).alias("years_ago"))


def career_lead(spark, d):
    return relations.next_steps(view(spark, d, "stints"))


def transition_matrix(spark, d):
    from pyspark.sql import Window

    nxt = F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    steps = view(spark, d, "events").select("event_type", nxt.alias("nx"))
    return relations.transitions(steps, "event_type", "nx").withColumn("p", F.round("p", 6))


def transition_patterns(spark, d):
    return relations.transitions(relations.next_steps(view(spark, d, "stints")), "company", "next_company").where("n >= 5").orderBy(F.desc("n"), "from_state", "to_state").limit(20).withColumn("p", F.round("p", 6))


# ---- vectors


def _query_vector(n: int) -> list[float]:
    return [((i * 7) % 11 - 5) / 10 for i in range(n)]


def vector_topk(spark, d):
    return vectors.top_k(view(spark, d, "embeddings"), _query_vector(64))


def similar_items(spark, d):
    e = view(spark, d, "embeddings")
    return vectors.similar_to_all(e, e.where("vec_id % 50 = 0"))


def _aspects(spark, d):
    parts = F.array(*(F.struct(F.lit(a).alias("aspect"), F.slice("embedding", 16 * i + 1, 16).alias("embedding")) for i, a in enumerate(vectors.ASPECTS)))
    return view(spark, d, "embeddings").select("vec_id", F.explode(parts).alias("x")).select("vec_id", "x.*").withColumn("embedding", vectors.normalized(F.col("embedding")))


def aspect_topk(spark, d):
    return vectors.aspect_top_k(_aspects(spark, d), "skills", _query_vector(16), 10)


def stored_aspects(spark, d):
    a = vectors.aspects_from_json(view(spark, d, "multi_aspect_embeddings"))
    return a.groupBy("person_id", "aspect").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"), F.max("text").alias("text"))


def stored_aspects_by_id(spark, d):
    ids = [r[0] for r in _people(spark, d).select("person_id").orderBy("person_id").limit(500).collect()]  # the feature: a list of ids
    return vectors.aspects_from_json(view(spark, d, "multi_aspect_embeddings"), ids=ids).groupBy("aspect").agg(F.count("*").alias("n"))


def profile_summaries(spark, d):
    f = _fanin(spark, d)
    told = texts.aspect_texts(f).groupBy("person_id").pivot("aspect", vectors.ASPECTS).agg(F.first("text"))
    told = told.withColumn("m", F.when(F.col("skills").isNotNull(), F.array(F.lit("skills"), F.lit("education"))).otherwise(F.array(F.lit("current_role"))))
    return told.select("person_id", texts.profile_summary(told, "m").alias("summary"))


def multi_aspect_topk(spark, d):
    q = _query_vector(16)
    return vectors.multi_aspect(_aspects(spark, d), {a: q for a in vectors.ASPECTS}, dict(zip(vectors.ASPECTS, (0.4, 0.3, 0.2, 0.1))), 10)


def profile_texts(spark, d):
    f = _fanin(spark, d)
    return f.select("person_id", *(texts.profile_text(f, t).alias(f"{t}_text") for t in texts.TEMPLATES))


def aspect_texts(spark, d):
    return texts.aspect_texts(_fanin(spark, d))


def _careers(spark, d):
    """Profiles with their stints, the latest first."""
    jobs = F.sort_array(F.collect_list(F.struct("start_date", "company", "title")), asc=False)
    past = view(spark, d, "stints").groupBy("person_id").agg(jobs.alias("j"))
    past = past.select("person_id", F.transform("j", lambda x: F.struct(x["title"].alias("title"), x["company"].alias("company"))).alias("experience"), F.transform("j", lambda x: x["title"]).alias("experience_titles"), F.transform("j", lambda x: x["company"]).alias("experience_companies"))
    return view(spark, d, "profiles").join(past, "person_id", "left")


def experience_fanin(spark, d):
    c = _careers(spark, d)
    return c.select("person_id", F.coalesce(F.size("experience"), F.lit(0)).alias("n"), F.array_join(F.slice("experience_companies", 1, 3), "|").alias("latest"))


def experience_texts(spark, d):
    return texts.aspect_texts(_careers(spark, d)).where("aspect = 'experience'").select("person_id", "text")


def career_texts(spark, d):
    c = _careers(spark, d)
    return c.select("person_id", texts.profile_text(c, "career_focused").alias("text"))


def past_employers(spark, d):
    c = _careers(spark, d).withColumn("normalized_company", F.col("current_company"))
    asked = ["Supplier#000000001", "Supplier#000000007"]
    return search.entity_filter(c, companies=asked, locations=["EUROPE", "ASIA"]).select("person_id", "current_company", "metro_area")


def experience_score(spark, d):
    c = _careers(spark, d).withColumn("normalized_title", F.lit("")).withColumn("normalized_company", F.lit(""))
    return search.legacy_score(c, ["steel", "brass"], 2000, locations=["EUROPE"]).select("person_id", F.round("score", 6).alias("score"))


def company_location_filter(spark, d):
    e = entities.location_entities(entities.title_entities(_people(spark, d), "current_title"), "location")
    names, places = ([r[0] for r in quality.top(_people(spark, d), c, 5).collect()] for c in ("normalized_company", "normalized_location"))  # five each
    return search.entity_filter(e, companies=names, locations=places).select("person_id", "normalized_company", "city", "metro_area")


def ranked_filters_score(spark, d):
    e = entities.location_entities(entities.title_entities(_scored(spark, d), "current_title"), "location")
    return search.legacy_score(e, WORDS, AS_OF_YEAR, seniority=["manager", "director"], locations=["New York City Metro"]).select("person_id", F.round("score", 6).alias("score"))


def paged_search(spark, d):
    s = search.legacy_score(_scored(spark, d), WORDS, AS_OF_YEAR).where("score > 0").withColumn("score", F.round("score", 6))
    return search.page(s.select("person_id", "score"), [F.desc("score"), "person_id"], 20, 10)


def score_explanations(spark, d):
    s = search.normalized_score(_scored(spark, d), WORDS, RELATED, AS_OF_YEAR)
    return s.select("person_id", search.score_explanation(s).alias("explanation"))


def widened_full_text(spark, d):
    terms_ = search.condition(["auditor"], {"title:analyst": 0.6, "role:finance": 0.4, "skill:risk": 0.51})
    return search.any_full_text(_people(spark, d), terms_, ["current_title", "normalized_title"]).select("person_id", "current_title")


def title_patterns(spark, d):
    t = F.col("current_title")
    return _people(spark, d).where("current_title is not null").select("person_id", *(F.array_join(find_all(t, rules.QUERY_PATTERNS[k]), "|").alias(k) for k in ("titles", "seniority", "education")))


def parse_queries(spark, d):
    asks = ["software engineers at Google in San Francisco", "senior analyst with 5 years of experience", "former consultants who studied economics at stanford", "product manager in new york", "recent phd data scientist"]
    rows = [(a, kind, str(v)) for a in asks for kind, vs in query.parse(a)["entities"].items() for v in vs]
    return spark.createDataFrame(rows, "query string, kind string, value string")


_QUERIES = [p3_found, weighted_like_search, finance_search, domain_rescore_topk, profile_fanin_collect, skill_exists_semijoin, entity_filters, fulltext_all_terms, facets, suggestions, normalized_score, legacy_score, hybrid_merge, company_normalize_regex, company_normalize, location_normalize, record_hash_dedup, fuzzy_dedup, year_parse, upsert_touch, upsert_replace, seniority_extract, role_type_argmax, specialization_first_match, title_entities, location_components, rule_confidence_gate, extraction_stats, title_variations, quality_report, top_companies, year_distribution, token_frequency, temporal_term_filter, temporal_clean, term_documents_v1, term_documents_v2, doc_frequency, cooccurrence_pmi, cooccurrence_weighted, expansion_topk, term_associations, synonyms_cosine, tfidf_terms, multi_hop_expansion, graph_expansion, colleague_overlap, relationship_score, connections, mutual_connectors, career_lead, transition_matrix, transition_patterns, vector_topk, similar_items, multi_aspect_topk, profile_texts, aspect_texts, parse_queries, aspect_topk, stored_aspects, stored_aspects_by_id, profile_summaries, experience_fanin, experience_texts, career_texts, past_employers, experience_score, company_location_filter, ranked_filters_score, paged_search, score_explanations, widened_full_text, cooccurrence_significant, one_hop_expansion, engine_expansion, expansion_types, term_nodes, expansion_idf, place_display, record_fields, title_patterns]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in _QUERIES}


def oracle_sql() -> dict[str, str]:
    return sql.statements(query.process(ASK), query.process(FINANCE_ASK), WORDS, RELATED, AS_OF, AS_OF_YEAR, _query_vector)
