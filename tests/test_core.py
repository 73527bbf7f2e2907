import json
import math
import random
from datetime import date

import pytest
from pyspark.sql import functions as F

from rosterlake.functions import entities, normalize, quality, rules
from rosterlake.functions.text import fuzzy_ratio, ratio, title_case
from rosterlake.operators import dedup, expand, relations, search, terms, vectors
from rosterlake import session
from rosterlake.plans import catalog, query
from rosterlake.plans.engine import ProfileEngine
from rosterlake.plans.graph import GraphExpansion, graph_source
from rosterlake.sources import sinks
from rosterlake.sources.readers import EngineConfig, read_any, read_files, read_mappings
from rosterlake.streaming.ingest import latest_version, merge_stream


def one(spark, expr, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(expr(F.col("c"))).first()[0]


@pytest.mark.parametrize("v,stand,broken", [(None, True, False), ("", True, False), (" -- ", True, False), ("N/A", True, False), ("Poet", False, False), ("Sen...", False, True), ("Law..", False, True), ("Head of", False, True), ("Tester (reg", False, True), ("Manager,", False, True), ("Head of Mktg.", False, False)])
def test_usability(spark, v, stand, broken):
    assert one(spark, quality.is_stand_in, v) is stand and one(spark, quality.is_broken_off, v) is broken
    assert quality.stand_in(v) is stand and (v is None or quality.broken_off(v) is broken)


def test_normalise(spark):
    assert one(spark, normalize.company, "The Blackstone Group Inc.") == "blackstone"
    assert one(spark, lambda c: normalize.company(c, True), "Morgan Stanlye") == "morgan stanley"
    assert one(spark, normalize.company, None) == ""
    assert one(spark, title_case, "o'neil at&t") == "O'Neil At&T"
    assert one(spark, normalize.location, "NYC, USA") == "new york"
    assert one(spark, normalize.year, "class of 1999, left 2003") == 1999
    assert one(spark, normalize.year, "none") is None


def test_ratio(spark):
    assert ratio("abc", "abc") == 100 and ratio("", "a") == 0 and ratio("abcd", "abxd") == 75
    assert one(spark, lambda c: fuzzy_ratio(c, F.lit("abcd")), "abxd") == 75


def test_entities(spark):
    df = spark.createDataFrame([(1, "Senior VP of Data"), (2, None), (3, "")], "id int, t string")
    rows = {r["id"]: r for r in entities.title_entities(df, "t").collect()}
    assert rows[1]["seniority"] == "senior vice president" or rows[1]["seniority"] == "vice president"
    assert rows[2]["seniority"] is None and rows[2]["seniority_level"] == 0
    place = spark.createDataFrame([("Oakland, CA",), ("Bath, UT",), ("tokyo",), ("x",)], "c string").select(entities.location_parts(F.col("c")).alias("p")).select("p.*").collect()
    assert place[0]["metro_area"] == "San Francisco Bay Area" and place[1]["state"] == "Utah" and place[2]["country"] == "Japan" and place[3]["city"] is None


def test_relationship_goldens(spark):
    met = spark.createDataFrame([(1, 2, "Google", 3.0, 2.0), (1, 3, "Goldman Sachs", 24.0, 1.0)], "person1 int, person2 int, company string, months double, years_ago double")
    got = {r["company"]: r["final_score"] for r in relations.strength(met).collect()}
    assert abs(got["Google"] - 0.25 * 0.6 * math.exp(-0.4) * 1.2) < 1e-9 and got["Goldman Sachs"] == 1.0


def test_overlaps_open_interval(spark):
    s = spark.createDataFrame([(1, "c", date(2000, 1, 1), None), (2, "c", date(2000, 6, 1), date(2001, 1, 1)), (3, "d", None, None)], "person_id int, company string, start_date date, end_date date")
    rows = relations.overlaps(s, date(2002, 1, 1)).collect()
    assert len(rows) == 1 and rows[0]["overlap_start"] == date(2000, 6, 1)


def test_graph_golden():
    e = [("analyst", "goldman", 0.8), ("analyst", "entry", 0.7), ("goldman", "investment", 0.9), ("investment", "finance", 0.8)]
    both = [(a, b, -math.log(w)) for a, b, w in e] + [(b, a, -math.log(w)) for a, b, w in e]
    got = {n: round(s, 4) for n, s, _, _ in expand.shortest_paths(both, "analyst", 2, 0.8, 0.3)}
    assert got == {"goldman": 0.64, "entry": 0.56, "investment": 0.4608}


def test_pairs_and_npmi_of_everywhere(spark):
    docs = spark.createDataFrame([(i, t) for i in range(6) for t in ("a:x", "b:y")], "d int, term string")
    row = terms.with_metrics(terms.pair_counts(docs, "d"), 6).first()
    assert row["n12"] == 6 and row["lift"] == 1.0 and row["npmi"] is None
    assert terms.pair_counts(docs.limit(0), "d").count() == 0


def test_greedy_keeps_chain_ends(spark):
    rows = [(1, "aaaaaaaaaaaaaaaaaaaa", "co"), (2, "aaaaaaaaaaaaaaaaaaab", "co"), (3, "aaaaaaaaaaaaaaaaabbb", "co"), (4, None, "co")]
    df = spark.createDataFrame(rows, "id int, n string, c string").withColumn("blk", F.lit(1))
    assert sorted(r[0] for r in dedup.greedy(df, "id", "n", "c", ["blk"], 89, 85).collect()) == [1, 3, 4]


def test_fuzzy_dedup_asks_name_and_company_only(spark, tmp_path):
    people = [("a1", "Zoltan Dajsomgep", "Hamzek Motors", 1999, "Law"), ("a2", "zoltan dajsomgep", "hamzek motors", 1999, None), ("a3", "Zoltan Dajsomgpe", "Hamzek Motor", 2001, "law"), ("a4", "Zoltan Dajsomgep", "Galnez Pharma", 1999, "Law"), ("a5", "Agnes Fowzekzos", None, None, None), ("a6", "Agnes Fowzekzos", None, 2003, "Art")]
    spark.createDataFrame(people, "person_id string, name string, current_company string, graduation_year int, major string").write.parquet(f"{tmp_path}/alumni.parquet")
    assert sorted(r[0] for r in catalog.fuzzy_dedup(spark, str(tmp_path)).collect()) == ["a1", "a4", "a5"]


def test_year_parse_reads_long_texts_to_their_end(spark, tmp_path):
    spark.createDataFrame([(1, "word " * 30_000 + "left in 1987, back in 2001"), (2, None), (3, "none")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, catalog.year_parse(spark, str(tmp_path)).collect())) == [(1, 1987), (2, None), (3, None)]


def test_greedy_is_whole(spark):
    r = random.Random(5)
    stems, firms = ["anna kovlek", "bela tarmos", "carla zimpet junior"], ["hamzek motors", "hamzek motor", "galnez airlines services", ""]

    def spoil(s):
        for _ in range(r.randrange(4)):
            i = r.randrange(len(s) + 1)
            s = r.choice([s[:i] + s[i + 1 :], s[:i] + r.choice("abk") + s[i:]])
        return s

    rows = [(i, spoil(r.choice(stems)), spoil(r.choice(firms))) for i in range(300)]
    same = lambda x, y, above: x == y or ratio(x, y) > above
    kept = []
    for k, n, c in rows:
        if not n or not any(same(n, m, 90) and same(c, e, 85) for _, m, e in kept):
            kept.append((k, n, c))
    df = spark.createDataFrame(rows, "id int, n string, c string")
    assert sorted(x[0] for x in dedup.greedy(df, "id", "n", "c", []).collect()) == [x[0] for x in kept]


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(map(tuple, sinks.upsert_replace(old, new, ["k"]).collect())) == [(1, "a"), (2, "c"), (3, "d")]
    assert sorted(map(tuple, sinks.upsert_touch(old, new, "k", "v", F.lit("t")).collect())) == [(1, "a"), (2, "t"), (3, "d")]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8])], "vec_id int, embedding array<float>")
    assert [r[0] for r in vectors.similar_to(v, 1, 2).collect()] == [2, 3]
    assert vectors.similar_to(v, 9).count() == 0


def test_search_without_terms(spark):
    df = spark.createDataFrame([("p", "n", 2021, "x", "y", None, None, None)], "person_id string, name string, graduation_year int, current_position string, current_company string, industry string, skills string, function string")
    assert search.weighted_search(df, [], 5).count() == 0
    assert search.weighted_search(df, [("x", 1.0)], 5).first()["relevance_score"] == 15 + 12 + 3  # the first free company slot holds for any company
    assert search.full_text(df, "of the", ["name"]).count() == 0
    assert df.select(search.highlight(F.lit("C++ and Data"), ["data", "c++"])).first()[0] == "<mark>C++</mark> and <mark>Data</mark>"


def test_query_understanding():
    p = query.process("wall st banker")
    assert "wall street" in p.phrases and "finance_domain" in p.phrases and max(p.domains, key=p.domains.get) == "finance"
    e = query.parse("swe at Google with 5 years experience")
    assert "software engineer" in e["entities"]["titles"] and e["entities"]["experience_years"] == [5]
    assert query.query_text(["software engineer"], ["Google", "Facebook"], ["ml"], ["SF"]) == "Role: software engineer Company: Google Facebook Location: SF Skills: ml"
    assert abs(sum(rules.SCORE_WEIGHTS.values()) - 1) < 1e-9


def test_readers_and_cache(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name\n1,Ann\n")
    (tmp_path / "b.txt").write_text("x")
    assert read_any(spark, str(tmp_path / "b.txt")) is None
    assert read_files(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.txt")]).first()["name"] == "Ann"
    EngineConfig.from_json(str(tmp_path / "c.json"))
    assert EngineConfig.from_json(str(tmp_path / "c.json")).max_results == 50
    c = sinks.ResultCache(size=1)
    c.put({"q": 1}, [1])
    c.put({"q": 2}, [2])
    assert c.get({"q": 1}) is None and c.get({"q": 2}) == [2] and c.invalidate() == 1


def test_stream_merge(spark, tmp_path):
    src, home = tmp_path / "in", tmp_path / "out"
    src.mkdir()
    (src / "1.json").write_text('{"k": 1, "v": "a", "t": 1}\n{"k": 1, "v": "b", "t": 2}\n')
    schema = spark.createDataFrame([], "k int, v string, t int").schema
    for text in (None, '{"k": 2, "v": "c", "t": 3}\n'):
        if text:
            (src / "2.json").write_text(text)
        merge_stream(spark, str(src), schema, str(home), ["k"], "t", str(tmp_path / "cp")).awaitTermination(60)
    rows = spark.read.parquet(str(home / f"v{latest_version(spark, str(home))}")).collect()
    assert sorted((r["k"], r["v"]) for r in rows) == [(1, "b"), (2, "c")]


def test_two_ingests_and_the_built_tables(spark, tmp_path):
    home = tmp_path / "home"
    home.mkdir()
    person = lambda i, name, title, **kw: json.dumps({"id": i, "name": name, "current_title": title, "current_company": "Hamzek Motors", "location": "Oakland, CA", "graduation_year": "2015", "skills": ["Welding", "Law"], "experience": [{"company": "Zospun Foods", "title": "Cook", "start_date": "2000-01-01", "end_date": "2003-01-01"}], **kw})
    (tmp_path / "1.json").write_text(person("a", "Ann Lee", "Senior Engineer") + "\n" + person("b", "Bob Ray", "Cook"))
    (tmp_path / "2.json").write_text(person("a", "Ann Lee", "Senior Engineer") + "\n" + person("c", "Cy Dee", "Poet"))
    engine = ProfileEngine(spark, str(home))
    assert engine.health()["status"] == "unhealthy" and set(engine.setup_database()) == {"alumni", "experience", "education", "skills"}
    assert engine.setup_database() == []
    for k, n in ((1, 2), (2, 3), (1, 3)):
        assert engine.ingest([str(tmp_path / f"{k}.json")]).count() == n
    out = str(home / "aside.parquet")
    assert [engine.ingest([str(tmp_path / f"{k}.json")], out).count() for k in (1, 2)] == [3, 3] and engine.table("alumni").count() == 3
    assert engine.table("skills").count() == 6 and engine.health()["status"] == "degraded"
    assert engine.build_semantic_index().where("profile_text like '%Background: Cook at Zospun Foods'").count() == 3
    assert engine.build_multi_aspect_index().count() == 3 and engine.build_multi_aspect_index().count() == 3
    got = engine.multi_aspect_search({"current_role": "poet at hamzek motors in oakland ca"}, k=2).collect()
    assert [r["person_id"] for r in got][0] == "c" and got[0]["summary"].startswith("Current: Poet at Hamzek Motors")
    assert engine.build_enhanced_relationships(date(2004, 1, 1)).count() == 3 and engine.build_enhanced_relationships(date(2004, 1, 1)).count() == 3
    assert {r["extraction_method"] for r in engine.run_ai_entity_extraction().collect()} <= {"rules", "ai_fallback"}
    first = engine.ranked_search("senior engineer", 2, as_of_year=2020).collect()
    assert first[0]["person_id"] == "a" and "Final Score" in first[0]["explanation"]
    assert [r["person_id"] for r in engine.ranked_search("engineer cook", 2, 1, 2020).collect()] != [first[0]["person_id"]]
    assert {r["person_id"] for r in engine.similar("a", 2).collect()} == {"b", "c"}
    for bad in (lambda: ProfileEngine(spark, str(tmp_path)).similar("a"), lambda: ProfileEngine(spark, str(tmp_path)).multi_aspect_search({"skills": "x"})):
        with pytest.raises(ValueError):
            bad()


def test_a_broken_swap_is_finished(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.range(3).write.parquet(path + ".next")
    session.settle(spark, path)
    assert spark.read.parquet(path).count() == 3 and session.replace_table(spark.read.parquet(path).unionByName(spark.range(2)), path).count() == 5


def test_aspects_as_json(spark):
    long = spark.createDataFrame([("a", "skills", "t", [0.5, 1.0]), ("a", "education", None, [1.0, 0.0]), ("b", "skills", "u", None)], "person_id string, aspect string, text string, embedding array<double>")
    stored = vectors.aspects_to_json(long).unionByName(spark.createDataFrame([("c", '{"aspects": {"sk'), ("d", ""), ("e", None), ("f", "{}")], "person_id string, embedding_data string"))
    assert sorted(map(tuple, vectors.aspects_from_json(stored).collect()), key=repr) == sorted(map(tuple, long.collect()), key=repr)
    assert vectors.aspects_from_json(stored, ids=["b"]).count() == 1 and vectors.aspects_from_json(stored.limit(0)).count() == 0


def test_similar_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(vectors, "ASKED_AT_ONCE", 2)
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.6, 0.8]), (3, [0.6, 0.8]), (4, [0.0, 1.0]), (5, None)], "vec_id int, embedding array<float>")
    got = vectors.similar_to_all(v, v, 2).collect()
    assert sorted((r["item"], r["vec_id"]) for r in got) == [(1, 2), (1, 3), (2, 3), (2, 4), (3, 2), (3, 4), (4, 2), (4, 3)]
    assert vectors.similar_to_all(v, v.limit(0)).count() == 0 == vectors.similar_to_all(v.limit(0), v.limit(0)).count()


def test_overlaps_of_some(spark):
    r = random.Random(4)
    rows = [(p, r.choice("cd"), date(1990 + (a := r.randrange(12)), 1 + r.randrange(12), 1), date(1991 + a + r.randrange(5), 3, 1)) for p in range(1, 25) for _ in range(2)]
    s = spark.createDataFrame(rows, "person_id int, company string, start_date date, end_date date")
    every = relations.overlaps(s, date(2010, 1, 1))
    want = sorted(tuple(x) for x in every.collect() if x["person1"] in (1, 2) or x["person2"] in (1, 2))
    assert want and sorted(map(tuple, relations.overlaps(s, date(2010, 1, 1), of=[1, 2]).collect())) == want
    plain = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and (min(a[3], b[3]) - max(a[2], b[2])).days / 30.44 >= 1]
    assert sorted((x["person1"], x["person2"]) for x in every.collect()) == sorted(plain)


def test_back_end_is_merged(spark):
    rows = spark.createDataFrame([("a", "Chief Poet", "x"), ("b", "", None)], "person_id string, current_title string, current_company string")
    e = entities.rule_entities(rows, "current_title", "current_company").withColumn("seniority", F.lit("by rule"))
    theirs = lambda df: df.withColumn("seniority", F.lit("")).withColumn("department", F.lit("verse")).withColumn("confidence", F.lit(0.9))
    got = {r["person_id"]: r for r in entities.confidence_gate(e, backend=theirs).collect()}
    assert got["a"]["seniority"] == "by rule" and got["a"]["department"] == "verse" and got["a"]["confidence"] == 0.9 and got["b"]["extraction_method"] == "hybrid"


def test_graph_expansion_of_a_text(spark, tmp_path):
    edges = [("title:analyst", "skill:excel", 0.8), ("skill:excel", "skill:risk", 0.9), ("title:analyst", "company:goldman", 0.7)]
    both = [(a, b, w, -math.log(w)) for x, y, w in edges for a, b in ((x, y), (y, x))]
    g = GraphExpansion(spark.createDataFrame(both, "src string, dst string, weight double, distance double"))
    got = g.expand("the analyst, unheard")
    assert got["terms"] == ["analyst", "unheard"] and list(got["expansions"]) == ["skill:excel", "company:goldman", "skill:risk"]
    assert got["paths"]["skill:risk"] == "title:analyst → skill:excel → skill:risk" and got["condition"] == ["analyst", "unheard", "excel", "goldman"]
    assert "using up to 2 hops" in got["explanation"] and GraphExpansion(graph_source(spark, str(tmp_path))).expand("analyst")["expansions"] == {}
    docs = spark.createDataFrame([(i, t) for i in range(6) for t in ("a:x", "b:y")] + [(9, "c:z")], "d int, term string")
    m = terms.with_metrics(terms.pair_counts(docs, "d"), 7)
    sinks.export_terms(m, terms.frequencies(docs), terms.expansions(m, lift=1.0), str(tmp_path))
    assert graph_source(spark, str(tmp_path)).count() == 2 and query.explain_expansion("x", {"skill:excel": 0.12345, "y": 1.0})["expansions"] == {"skill": [{"term": "excel", "score": 0.123}], "general": [{"term": "y", "score": 1.0}]}


def test_request_flags():
    assert query.request("current analysts hired recently")["filters"] == {"is_current_position": True, "recent_only": True} | {k: v for k, v in query.request("current analysts hired recently")["filters"].items() if k not in ("is_current_position", "recent_only")}


def test_mappings_fall_back(tmp_path):
    assert read_mappings(str(tmp_path / "none.json"), {"a": ["b"]}) == {"a": ["b"]}
    (tmp_path / "m.json").write_text('{"x": ["y"], "z": 3}')
    assert read_mappings(str(tmp_path / "m.json"), {}) == {"x": ["y"]}


def test_checkpoints_need_a_shared_folder_on_a_cluster():
    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    fake = type("Spark", (), {"sparkContext": Context(), "conf": type("C", (), {"get": lambda self, k, d: d})()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)
