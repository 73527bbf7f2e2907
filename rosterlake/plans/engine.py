"""The engine behind one object: ingest, search, similar people, analytics, health; and its command line."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.functions import entities, normalize
from rosterlake.operators import dedup, quality, relations, search, terms, texts, vectors
from rosterlake.plans import query
from rosterlake.plans.graph import GraphExpansion, graph_source
from rosterlake.session import cut, exists, replace_table, settle
from rosterlake.sources import readers, sinks

#: A model that makes vectors: a text column to a column of arrays.
Embedder = Callable[[Column], Column]


class ProfileEngine:
    """Tables are parquet folders under `home`, on any storage Spark reads. Verbs that build store what they build."""

    def __init__(self, spark: SparkSession, home: str, config: readers.EngineConfig | None = None):
        self.spark, self.home, self.config = spark, home, config or readers.EngineConfig()
        self.cache = sinks.ResultCache(self.config.cache_ttl)

    def path(self, name: str) -> str:
        return f"{self.home}/{self.config.tables.get(name, f'{name}.parquet')}"

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))

    def parse_records(self, raw: DataFrame) -> DataFrame:
        """Typed, normalised records of raw ones, with record_hash."""
        y = normalize.year(F.col("graduation_year"))
        return raw.select(F.coalesce("id", normalize.fallback_id(F.col("name"))).alias("person_id"), "name", "current_title", "current_company", normalize.company(F.col("current_company")).alias("normalized_company"), normalize.title_spaces(F.col("current_title")).alias("normalized_title"), "location", normalize.location(F.col("location")).alias("normalized_location"), y.alias("graduation_year"), "degree", "major", normalize.record_hash(F.col("name"), normalize.company(F.col("current_company")), y).alias("record_hash"), F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))

    def setup_database(self) -> list[str]:
        """Empty tables of the engine where they lack; the names of those made."""
        made = []
        for name, schema in readers.TABLES.items():
            settle(self.spark, self.path(name))
            if not exists(self.spark, self.path(name)):
                self.spark.createDataFrame([], schema).write.parquet(self.path(name))
                made.append(name)
        return made

    def ingest(self, paths: list[str], out: str | None = None) -> DataFrame:
        """Read, parse and upsert record files into the table of people (or into `out`, from which the next call goes on)."""
        raw = readers.read_files(self.spark, paths)
        if raw is None:
            raise ValueError("no readable file")
        target = out or self.path("alumni")
        settle(self.spark, target)
        new = dedup.exact(self.parse_records(raw), "record_hash", ["person_id"])
        source = target if exists(self.spark, target) else self.path("alumni") if exists(self.spark, self.path("alumni")) else None
        known = sinks.upsert_touch(self.spark.read.parquet(source), new, "record_hash", "updated_at", F.current_timestamp()) if source else new
        done = replace_table(known, target)
        for nested in ("experience", "education", "skills"):
            if nested in raw.columns:
                rows = sinks.child_rows(raw.withColumn("person_id", F.coalesce("id", normalize.fallback_id(F.col("name")))), "person_id", nested)
                rows = rows.withColumnRenamed("skills", "skill") if nested == "skills" else rows
                own = self.path(nested) if out is None else f"{out}.{nested}"
                settle(self.spark, own)
                replace_table(sinks.upsert_replace(self.spark.read.parquet(own), rows, ["person_id"]) if exists(self.spark, own) else rows, own)
        return done

    def people(self) -> DataFrame:
        """People with their skills, and past jobs where there is such a table."""
        skills = self.table("skills").where("skill is not null and trim(skill) <> ''").groupBy("person_id").agg(F.array_sort(F.collect_set(F.lower(F.trim("skill")))).alias("skill_list"))
        p = self.table("alumni").join(skills, "person_id", "left").withColumn("skill_list", F.coalesce("skill_list", F.array().cast("array<string>"))).withColumn("skills", F.array_join("skill_list", " "))
        if not exists(self.spark, self.path("experience")):
            return p
        jobs = F.sort_array(F.collect_list(F.struct("start_date", "title", "company")), asc=False)
        past = self.table("experience").groupBy("person_id").agg(jobs.alias("j")).select("person_id", F.transform("j", lambda x: F.struct(x["title"].alias("title"), x["company"].alias("company"))).alias("experience"))
        p = p.join(past, "person_id", "left").withColumn("experience_titles", F.transform("experience", lambda x: x["title"])).withColumn("experience_companies", F.transform("experience", lambda x: x["company"]))
        return p

    def build_entities(self) -> DataFrame:
        return entities.title_entities(self.table("alumni").select("person_id", "current_title"), "current_title")

    def run_ai_entity_extraction(self, backend=None) -> DataFrame:
        """Entities of all titles by rules, those below the threshold through `backend`; stored as `entities`."""
        rows = self.table("alumni").where("trim(current_title) <> ''").select("person_id", "current_title", "current_company")
        found = entities.confidence_gate(entities.rule_entities(rows, "current_title", "current_company"), self.config.ai_threshold, backend if self.config.use_ai_extraction else None)
        return replace_table(found, self.path("entities"))

    def build_semantic_index(self, embed: Embedder | None = None) -> DataFrame:
        """Embeddings of profile texts (hashed words, or those of `embed`: text column -> array column); stored."""
        p = self.people()
        rows = p.select("person_id", texts.profile_text(p).alias("profile_text"))
        made = rows.withColumn("embedding", (embed or texts.hashed_embedding)(F.col("profile_text"))).withColumn("created_at", F.current_timestamp())
        return replace_table(made, self.path("profile_embeddings"))

    def build_multi_aspect_index(self, embed: Embedder | None = None) -> DataFrame:
        """Vectors of each person's aspects, as JSON; people who are in the table get new ones, others stay."""
        rows = texts.aspect_texts(self.people()).withColumn("embedding", (embed or texts.hashed_embedding)(F.col("text")))
        new = vectors.aspects_to_json(rows).withColumn("created_at", F.current_timestamp()).withColumn("updated_at", F.current_timestamp())
        path = self.path("multi_aspect_embeddings")
        settle(self.spark, path)
        return replace_table(sinks.upsert_replace(self.spark.read.parquet(path), new, ["person_id"]) if exists(self.spark, path) else new, path)

    def build_enhanced_relationships(self, as_of: date | None = None) -> DataFrame:
        """Colleagues with the strength of their tie, upserted by both people and company; stored as `relationships`."""
        edges = relations.strength(relations.overlaps(self.table("experience"), as_of or date.today()))
        path = self.path("relationships")
        settle(self.spark, path)
        return replace_table(sinks.upsert_replace(self.spark.read.parquet(path), edges, ["person1", "person2", "company"]) if exists(self.spark, path) else edges, path)

    def build_terms(self) -> None:
        """Term tables of the chosen kind (switch use_enhanced_cooccurrence), exported for the graph."""
        people, skills = self.table("alumni"), self.table("skills")
        docs = cut(terms.split_documents(people) if self.config.use_enhanced_cooccurrence else terms.term_documents(people, skills))
        m = cut(terms.with_metrics(terms.pair_counts(docs, "person_id"), docs.select("person_id").distinct().count(), self.config.use_enhanced_cooccurrence))
        m = terms.significant(m) if self.config.use_enhanced_cooccurrence else m
        sinks.export_terms(m, terms.frequencies(docs), terms.expansions(m), self.home)

    def search(self, text: str, limit: int | None = None, offset: int = 0) -> list[dict]:
        """The light path: weighted search with re-scoring of three times the page's end; pages are cached."""
        k = limit or self.config.max_results
        ask = {"text": text, "limit": k, "offset": offset}
        if self.config.use_cache and (hit := self.cache.get(ask)) is not None:
            return hit
        plan = query.process(text)
        hits = search.weighted_search(self.table("enhanced_search_result"), plan.terms, 3 * (offset + k))
        page = search.rescore(hits, plan.terms, plan.domains, offset + k).offset(offset)
        rows = [r.asDict(recursive=True) for r in page.collect()]  # at most k rows
        self.cache.put(ask, rows)
        return rows

    def ranked_search(self, text: str, limit: int | None = None, offset: int = 0, as_of_year: int | None = None) -> DataFrame:
        """The full path by the switches: words and graph expansions, normalised or additive score, similarity of the text
        to profiles (semantic_weight), one page with the explanation of each score."""
        k = limit or self.config.max_results
        ask = query.request(text)
        year = as_of_year or date.today().year
        related: dict[str, float] = {}
        if self.config.use_graph_expansion:
            found = GraphExpansion(graph_source(self.spark, self.home)).expand(text)["expansions"]
            related = {t.split(":", 1)[-1]: w for t, w in found.items()}
        people = self.people()
        if self.config.use_semantic and exists(self.spark, self.path("profile_embeddings")):
            stored = self.table("profile_embeddings")
            q = self.spark.range(1).select(texts.hashed_embedding(F.lit(text)).alias("q")).first()[0] or []
            asked = F.array(*map(F.lit, q)).cast("array<double>")
            near = stored.where(F.col("embedding").isNotNull() & (F.size("embedding") == len(q))).groupBy("person_id").agg(F.max_by("embedding", "created_at").alias("e"))
            people = people.join(near.select("person_id", F.greatest(F.lit(0.0), vectors.dot(F.col("e"), asked)).alias("semantic")), "person_id", "left")
        if "experience_titles" in people.columns:
            people = people.withColumn("experience", F.array_join("experience_titles", " "))
        words = ask["terms"] or query.words_of(text)
        if not words:
            return people.limit(0)
        if self.config.use_normalized_scoring:
            s = search.normalized_score(people, words, related, year).where("final_score > 0")
            s = s.withColumn("explanation", search.score_explanation(s)).withColumnRenamed("final_score", "score")
        else:
            s = search.legacy_score(people, words, year, ask["boosts"]).where("score > 0").withColumn("explanation", F.lit(None).cast("string"))
            if "semantic" in s.columns:
                s = s.withColumn("score", F.col("score") + F.coalesce("semantic", F.lit(0.0)) * self.config.semantic_weight)
        return search.page(s.select("person_id", "name", "current_title", "current_company", "score", "explanation"), [F.desc(F.round("score", 9)), "person_id"], offset, k)

    def multi_aspect_search(self, asked: dict[str, str], weights: dict[str, float] | None = None, k: int = 10, embed=None) -> DataFrame:
        """(person_id, score, matched, summary) of the people whose aspects are most like the asked texts."""
        path = self.path("multi_aspect_embeddings")
        if not exists(self.spark, path):
            raise ValueError("build_multi_aspect_index first")
        long = vectors.aspects_from_json(self.table("multi_aspect_embeddings"))
        make = embed or texts.hashed_embedding
        row = self.spark.range(1).select(*(make(F.lit(t)).alias(a) for a, t in asked.items())).first()
        found = vectors.multi_aspect(long, {a: list(row[a]) for a in asked}, weights or dict.fromkeys(asked, 1.0), k, key="person_id")
        told = long.join(found.select("person_id"), "person_id", "left_semi").groupBy("person_id").pivot("aspect", vectors.ASPECTS).agg(F.first("text"))
        both = found.join(told, "person_id").withColumn("m", F.filter(F.split("matched", ","), lambda x: x != ""))
        return both.select("person_id", "score", "matched", texts.profile_summary(both, "m").alias("summary")).orderBy(F.desc("score"), "person_id")

    def similar(self, person_id: str, k: int = 10) -> DataFrame:
        if not exists(self.spark, self.path("profile_embeddings")):
            raise ValueError("build_semantic_index first")
        stored = self.table("profile_embeddings").where("embedding is not null")
        own = stored.where(F.col("person_id") == person_id).agg(F.max(F.size("embedding"))).first()[0] or 0
        rows = stored.where(F.size("embedding") == own)
        return vectors.similar_to(rows, person_id, k, "person_id", "embedding")

    def analytics(self) -> DataFrame:
        return quality.report(self.table("alumni"), self.table("skills"))

    def health(self) -> dict:
        """healthy if all tables are there, degraded if the vectors lack, unhealthy without people."""
        have = {n: exists(self.spark, self.path(n)) for n in ("alumni", "skills", "profile_embeddings")}
        state = "healthy" if all(have.values()) else "degraded" if have["alumni"] else "unhealthy"
        return {"status": state, "tables": have, "cache": {"hits": self.cache.hits, "misses": self.cache.misses}}


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("--home", required=True)
    p.add_argument("--config")
    p.add_argument("--ingest", nargs="+")
    p.add_argument("--out")
    for name in ("search", "ranked-search", "similar", "multi-aspect-search"):
        p.add_argument(f"--{name}")
    for name in ("setup", "build-semantic-index", "build-multi-aspect", "build-relationships", "build-terms", "run-ai-extraction", "analytics", "health", "show-processing"):
        p.add_argument(f"--{name}", action="store_true")
    p.add_argument("--limit", type=int, default=10)
    p.add_argument("--offset", type=int, default=0)
    a = p.parse_args(argv)
    engine = ProfileEngine(SparkSession.builder.getOrCreate(), a.home, readers.EngineConfig.from_json(a.config) if a.config else None)
    if a.setup:
        print(engine.setup_database())
    if a.ingest:
        print(engine.ingest(a.ingest, a.out).count())
    for on, build in ((a.build_semantic_index, engine.build_semantic_index), (a.build_multi_aspect, engine.build_multi_aspect_index), (a.build_relationships, engine.build_enhanced_relationships), (a.run_ai_extraction, engine.run_ai_entity_extraction)):
        if on:
            print(build().count())
    if a.build_terms:
        engine.build_terms()
    if a.search:
        if a.show_processing:
            print(query.process(a.search))
        print(json.dumps(engine.search(a.search, a.limit, a.offset), default=str, indent=2))
    if a.ranked_search:
        engine.ranked_search(a.ranked_search, a.limit, a.offset).show(truncate=False)
    if a.multi_aspect_search:
        engine.multi_aspect_search(json.loads(a.multi_aspect_search), k=a.limit).show(truncate=False)
    if a.similar:
        engine.similar(a.similar, a.limit).show()
    if a.analytics:
        engine.analytics().show()
    if a.health:
        print(json.dumps(engine.health()))


if __name__ == "__main__":
    main()
