import itertools
import json
import random
from collections import Counter
from datetime import datetime

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rosterlake.llm import canonical, fusion, knn, leaks, level, names, packing, queries, radius, together, variants
from rosterlake.llm.graph import components
from rosterlake.llm.metric import BKTree, Strings, _plain, damerau, distances
from rosterlake.llm.scan import scan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé ", max_size=9), min_size=1, max_size=8), st.booleans())
def test_distances_equal_the_plain_programme(words, swaps):
    words = [*words, "x" * 70]
    s = Strings(words)
    i, j = (np.array(x) for x in zip(*itertools.product(range(len(words)), repeat=2)))
    assert distances(s, s, i, j, swaps).tolist() == [_plain(words[a], words[b], swaps) for a, b in zip(i, j)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text("ab c", max_size=6), min_size=1, max_size=20, unique=True), st.lists(st.text("ab c", max_size=6), min_size=1, max_size=4), st.integers(0, 3))
def test_tree_returns_every_entry_in_the_radius(refs, asked, r):
    q, e, d = BKTree(refs).within(asked, r)
    assert sorted(zip(q, e, d)) == sorted((a, b, x) for a, s in enumerate(asked) for b, t in enumerate(refs) if (x := _plain(s, t, False)) <= r)


def test_components(spark):
    edges = [(i, i + 1) for i in range(30)] + [(100, 101), (101, 102), (70, 70), (None, 5)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a int, b int")).collect()}
    assert all(got[i] == 0 for i in range(31)) and got[102] == 100 and got[70] == 70
    rng = random.Random(2)
    mixed = [(x := rng.randrange(400), x + rng.choice([-7, 1, 40])) for _ in range(500)]
    top = {n: n for e in mixed for n in e}
    for _ in range(400):
        for a, b in mixed:
            top[a] = top[b] = min(top[a], top[b])
    held = components(spark.createDataFrame(mixed, "a int, b int").repartition(7)).collect()
    assert {r["node"]: r["component"] for r in held} == top and len(held) == len(top)
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0


def _damerau(a, b):
    """The plain programme of the unrestricted distance."""
    last, far = {}, len(a) + len(b)
    h = {(i, -1): far for i in range(-1, len(a) + 1)} | {(-1, j): far for j in range(-1, len(b) + 1)}
    h |= {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i in range(1, len(a) + 1):
        met = 0
        for j in range(1, len(b) + 1):
            k, m = last.get(b[j - 1], 0), met
            same = a[i - 1] == b[j - 1]
            met = j if same else met
            h[i, j] = min(h[i - 1, j - 1] + (not same), h[i - 1, j] + 1, h[i, j - 1] + 1, h[k - 1, m - 1] + i - k + j - m - 1)
        last[a[i - 1]] = i
    return h[len(a), len(b)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("abcé", max_size=8), min_size=1, max_size=8), st.text("abcé", max_size=8))
def test_damerau_equals_the_plain_programme_and_is_a_metric(words, pivot):
    s = Strings([*words, pivot])
    d = damerau(s, s.codes[-1, : s.len[-1]])
    assert d.tolist() == [_damerau(pivot, w) for w in [*words, pivot]]
    assert all(abs(d[i] - d[j]) <= _damerau(words[i], words[j]) for i in range(len(words)) for j in range(len(words)))


def _joined(spark, words, radius_of, edits, **kw):
    df = spark.createDataFrame([(b, w) for b, w in words], "block string, s string")
    place = radius.cells(df, radius_of, **kw)

    def compare(g, i, j):
        r = radius_of(np.minimum(g.rows["s"].str.len().to_numpy()[i], g.rows["s"].str.len().to_numpy()[j]))
        return g.edits("s", i, j, edits) <= r

    pairs = radius.cell_join(place, ["block", "cell"], ["s"], "s", edits, compare, "block string, a string, b string", lambda g, i, j: pd.DataFrame({"block": g["block"][i], "a": g["s"][i], "b": g["s"][j]}))
    return place, [(r["block"], *sorted((r["a"], r["b"]))) for r in pairs.collect()]


@pytest.mark.parametrize("levels,most", [(3, 1e9), (3, 1.5), (0, 8.0)])
def test_radius_cells_lose_no_pair(spark, levels, most):
    rng = random.Random(3)
    words = {(b, "".join(rng.choice("abcd") for _ in range(rng.randrange(3, 9)))) for b in ("k", "m") for _ in range(130)} | {("few", "abc"), ("few", "abd"), ("few", "")}
    radius_of = lambda n: np.where(n >= 6, 2, 1)
    place, got = _joined(spark, words, radius_of, 2, cell_rows=60, levels=levels, most=most)
    osa = lambda a, b: _plain(a, b, True)
    want = {(b, *sorted((x, y))) for (b, x), (c, y) in itertools.combinations(words, 2) if b == c and osa(x, y) <= (2 if min(len(x), len(y)) >= 6 else 1)}
    assert set(got) == want
    assert place.groupBy("block", "cell").count().agg(F.max("count")).first()[0] < 120


def test_a_hot_block_is_split(spark):
    """A third of all strings in one block: no task gets them all, and replication stays within its bound."""
    rng = random.Random(8)
    stems = ["".join(rng.choice("bdfgklmnprstvwz") + rng.choice("aeiou") for _ in range(6)) for _ in range(40)]
    ends = ["foods", "motors", "partners", "shipping", "textiles", "insurance"]
    words = {("hot", rng.choice(stems)[: rng.randrange(6, 12)] + "".join(rng.choice("aeioubdkl") for _ in range(3)) + rng.choice(ends)) for _ in range(900)}
    place, got = _joined(spark, words, lambda n: np.where(n >= 10, 2, 1), 2, cell_rows=300)
    assert len(set(got)) > 100
    sizes = [r["count"] for r in place.groupBy("cell").count().collect()]
    assert max(sizes) < 0.6 * len(words) and sum(sizes) / len(words) <= radius.REPLICATION


ALUMNI = "person_id string, name string, current_title string, current_company string, normalized_company string, normalized_title string, location string, graduation_year int, major string, record_hash string, created_at timestamp, updated_at timestamp, key string, org string"


def person(i, name, company="Dovmid Robotics Partners", year=2001, **kw):
    base = dict.fromkeys(x.split()[0] for x in ALUMNI.split(", "))
    base.update(person_id=i, name=name, current_company=company, graduation_year=year, **kw)
    return tuple(base.values())


def test_variants(spark):
    rows = [person("a", "Robert Redwafjuh"), person("b", "Redwafjuh, Bob", "Dovmid Robotics Ptnrs Ltd"), person("c", "R. Redwafjhu", "The Dovmid Robotics Partners"), person("d", "Ximena Redwafjuh"), person("e", "Robert Redwafjuh", year=2002), person("f", None), person("g", "Cher", None), person("h", "ROBERT  redwafjuh"), person("i", "Ro Bo", "n/a", None)]
    listed = spark.createDataFrame([("Ruppok Partners", "RPPKP"), ("Galjiw Foods", None), (None, None)], "company string, short_name string")
    got = {tuple(r) for r in variants.variant_pairs(spark.createDataFrame(rows, ALUMNI), listed).collect()}
    people = {r[1:] for r in got if r[0] == "person"}
    assert people == {("a", "b"), ("a", "c"), ("b", "c"), ("b", "h"), ("c", "h")}
    assert ("company", "dovmid robotics partners", "dovmid robotics ptnrs ltd") in got
    assert variants.variant_pairs(spark.createDataFrame([], ALUMNI)).count() == 0


def test_person_parts():
    assert names.person_parts("Dr. Anna M. Ketphul-Lop (née Ruk), MBA") == ("anna", "ketful", "ketphul")
    assert names.person_parts("KETFUL, A.") == ("a", "ketful", "ketful") and names.person_parts("x") is None


def test_canonical(spark):
    refs = spark.createDataFrame([(1, "Galjiw Shipping International", "GLJWI"), (2, "Ruppok Foods", "RPPKF")], "company_id int, company string, short_name string")
    values = ["The Galjiw Shiping Intl, Ltd", "Foods, Ruppok", "gljwi", "Ruppok", "Ruppok Motors", "", None]
    one = {r["value"]: r["ref_id"] for r in canonical.map_to_list(spark.createDataFrame([(v,) for v in values], "value string"), refs, "company").collect()}
    assert one == {"The Galjiw Shiping Intl, Ltd": 1, "Foods, Ruppok": 2, "gljwi": 1, "Ruppok": 2, "Ruppok Motors": 0, "": 0}
    two = {r["value"]: r["ref_id"] for r in canonical.map_to_list(spark.createDataFrame([(v,) for v in values], "value string"), refs, "company", shard_rows=1).collect()}
    assert two == one
    empty = canonical.map_to_list(spark.createDataFrame([("a",)], "value string"), refs.limit(0), "company").collect()
    assert [(r["value"], r["ref_id"]) for r in empty] == [("a", 0)]


def test_titles_and_places():
    t = canonical.TitleMatcher([(1, "Financial Analyst"), (2, "Junior Financial Analyst"), (3, "Head of Design"), (4, "Senior Auditor"), (5, "Junior Auditor")])
    asked = ["Analyst, Financial", "Fin. Analyst (Jr.)", "design head", "Head of Design at Ruppok Foods", "Senior Auditor", "Jnr Auditr - acting", "Poet"]
    assert [m[0] for m in t.match(asked)] == [1, 2, 3, 3, 4, 5, 0]
    p = canonical.PlaceMatcher([(1, "Mount Fak, Hamland", "Mount Fak", "Hamland", "HM", "Norv"), (2, "Mount Fak, Zagland", "Mount Fak", "Zagland", "ZG", "Ostr")])
    assert [m[0] for m in p.match(["Mt. Fak", "ZG / Mount Fak", "Greater Mount Fak Area", "MountFak, Ostr", "Mount Fak, Elsewhere"])] == [1, 2, 1, 2, 0]


def test_titles_of_many_short_words():
    words = [("Principal", "Prin"), ("Marketing", "Mark"), ("Analytics", "Anal"), ("Development", "Devel"), ("Product", "Produ"), ("Strategy", "Strat")]
    near = [(i + 2, " ".join(a[: len(b)] + e for a, b in words)) for i, e in enumerate(("ova", "ice"))]
    t = canonical.TitleMatcher([(1, " ".join(a for a, _ in words)), *near])
    assert t.match([" ".join(f"{b}." for _, b in words)])[0][0] in range(1, 4)
    assert len(names.title_readings(" ".join(f"{b}." for _, b in words), t.vocabulary)) <= 32
    assert names.title_key(w.lower() for w, _ in words) in {k for _, k in names.title_readings(" ".join(f"{b}." for _, b in words), t.vocabulary, t.paths)}


def test_fusion(spark):
    t = lambda d: datetime(2020, 1, d)
    rows = [person("a", "n", record_hash="h", current_title="Poet", updated_at=t(2), created_at=t(1)), person("b", "n", record_hash="h", current_title="Sen...", updated_at=t(9), created_at=t(1)), person("c", "n", record_hash="h", current_title="Cook", updated_at=t(5), created_at=t(2)), person("d", "n", record_hash="h", current_title="Baker", updated_at=t(5), created_at=t(2)), person("e", "n", record_hash="k", current_title="Poet"), person("f", "n", record_hash=None, current_title="Poet")]
    df = spark.createDataFrame(rows, ALUMNI)
    assert [(r["entity"], r["field"], r["record"]) for r in fusion.fuse(fusion.alumni_claims(df)).collect()] == [("h", "current_title", "c")]
    assert fusion.fuse(fusion.alumni_claims(df.limit(0))).count() == 0


def test_votes_of_copiers_count_less():
    assert fusion._dependence(0, 8, 2, 0.8, 0.8) > 0.9 > fusion._dependence(8, 0, 2, 0.8, 0.8)


def test_fused_votes(spark):
    rows = [(f"e{i}", "f", v, s, True, (0, f"{i}{s}"), 1) for i in range(12) for s, v in (("a", "true"), ("b", "true"), ("c", f"odd{i}"))]
    claims = spark.createDataFrame(rows, "entity string, field string, value string, source string, usable boolean, newest struct<age:long,record:string>, n long")
    accuracy, _ = fusion.estimate(claims)
    assert accuracy["a"] > 0.8 > accuracy["c"]
    assert {r["value"] for r in fusion.fuse(claims, "soft").collect()} == {"true"}


def test_together_equals_brute_force(spark):
    rng = random.Random(1)
    rows = [(b, f"i{int(rng.random() ** 2 * 30)}") for b in range(400) for _ in range(5)]
    df = spark.createDataFrame(rows, "basket int, item string").distinct()
    held: dict[int, set] = {}
    for b, i in rows:
        held.setdefault(b, set()).add(i)
    n, ab = Counter(i for s in held.values() for i in s), Counter(p for s in held.values() for p in itertools.combinations(sorted(s), 2))
    want = {(a, b, k) for (a, b), k in ab.items() if k >= 5 and k * 400 >= 1 * n[a] * n[b]}
    got = together.pairs_together(df, 400, lift=1)
    assert {(r["item_a"], r["item_b"], r["n_ab"]) for r in got.collect()} == want and got.where("llr < 0").count() == 0
    assert together.pairs_together(df.limit(0), 0).count() == 0
    split = together.pairs_together(df, 400, lift=1, basket_rows=2)  # every basket is cut into blocks
    assert sorted(map(tuple, split.collect())) == sorted(map(tuple, got.collect()))


def test_stripes_meet_by_item_and_salt(spark):
    df = spark.createDataFrame([(b, f"i{i}") for b in range(40) for i in range(12)], "basket int, item string")
    plan = together.pairs_together(df, 40, lift=0)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(item" in plan and ", salt" in plan
    assert plan.index("salt") and together.pairs_together(df, 40, lift=0).where("n_ab = 40").count() == 66


def test_long_stripes_are_folded(spark):
    rows = [(1, s, [2 * k + s for k in range(300)], [1] * 300) for s in (0, 1) for _ in range(20)]
    df = spark.createDataFrame(rows, "item long, salt long, others array<long>, counts array<long>").repartition(5)
    for at_once in (700, 10**6):
        old, together.AT_ONCE = together.AT_ONCE, at_once
        try:
            got = together.merged(df, 20).collect()
        finally:
            together.AT_ONCE = old
        assert sorted((r["salt"], len(r["others"]), set(r["counts"]) == {20}) for r in got) == [(0, 300, True), (1, 300, True)]
        assert together.merged(df, 21).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_plan_places_every_item_once(counts):
    slots, used = packing.plan(counts, 50)
    load: Counter = Counter()
    for length, n in counts.items():
        mine = sorted(s for s in slots if s[0] == length)
        assert [s[1] for s in mine] == [0, *(s[2] for s in mine)][: len(mine)] and (mine[-1][2] == n)
        for _, lo, hi, first, each in mine:
            for k in range(hi - lo):
                load[first + k // each] += length
    assert all(v <= 50 for v in load.values()) and set(load) == set(range(used))


def test_pack(spark):
    df = spark.createDataFrame([(1, 10), (2, 25), (3, 5), (3, 5), (4, None), (5, 0), (6, 20)], "doc_id long, n_tokens int")
    rows = packing.pack(df, 10).collect()
    load = Counter()
    for r in rows:
        load[r["container"]] += r["n_tokens"]
    assert max(load.values()) <= 10 and sum(load.values()) == 65 and len(load) == 7
    assert sorted((r["part"], r["start"], r["n_tokens"]) for r in rows if r["doc_id"] == 2) == [(0, 0, 10), (1, 10, 10), (2, 20, 5)]
    assert packing.pack(df.limit(0), 10).count() == 0


def test_scan():
    s = scan(pa.array(["<p>An exam-\nple&quot;s</p> text", None, "", "Ünï 3.5 — x"], pa.string()))
    words = [bytes(s.buf[a:b]).decode() for a, b in zip(s.start, s.end)]
    assert words == ["An", "example", "s", "text", "Ünï", "3", "5", "x"] and s.word_row.tolist() == [0, 0, 0, 0, 3, 3, 3, 3]


def test_leaks(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}q" for i in range(400)]
    test = [[rng.choice(vocabulary) for _ in range(30)] for _ in range(6)]
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(test)] + [(90, None), (91, "")], "item_id long, text string")
    noise = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    docs = [(1, " ".join([*noise(40), *test[0], *noise(40)])), (2, " ".join([*noise(40), *test[1][:18], *noise(40)])), (3, " ".join([*noise(40), *test[2][:8], *noise(40)])), (4, None), (5, "  "), (6, "<b>" + ",\n> ".join(w.upper() for w in test[3]) + "</b>"), (7, " ".join(noise(5000)))]
    changed = list(test[4])
    changed[5], changed[12] = "another", "word"
    docs.append((8, " ".join([*noise(10), *changed, *noise(10)])))
    docs.append((8, docs[-1][1]))
    got = sorted((r["doc_id"], r["item_id"]) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect())
    assert got == [(1, 0), (2, 1), (6, 3), (8, 4), (8, 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    key = lambda **kw: sorted(map(tuple, leaks.find_leaks(df, items, **kw).collect()))
    assert key() == key(meet=2) == key(meet=1) == key(at_once=2)
    assert leaks.find_leaks(spark.createDataFrame([], "doc_id long, text string"), items).count() == 0
    assert leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items.limit(0)).count() == 0


def test_leaks_in_capitals_with_marks(spark):
    words = "Über die Straße nach Köln ging früh am Morgen ein müder Bäcker mit élan señor Łukasz und Ωmega".split()
    items = spark.createDataFrame([(1, " ".join(words))], "item_id long, text string")
    other = "der alte Hund schläft im Garten hinter dem Haus weil es regnet"
    docs = [(1, f"{other} {' '.join(w.upper().replace('SS', 'ß') for w in words)} {other}"), (2, other)]
    assert [(r[0], r[1]) for r in leaks.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()] == [(1, 1)]
    assert leaks.words_of("ÜBER Éa ŁÓDŹ Ж").tolist() == leaks.words_of("über éA łódź ж").tolist()


def _prose(rng, lv):
    easy, hard = ["we", "saw", "the", "old", "dog", "in", "town"], ["institutional", "considerable", "administration", "characterised", "notwithstanding"]
    sentences = [" ".join(rng.choice(easy if rng.random() > (lv - 1) / 4 else hard) for _ in range(3 + 8 * (lv - 1))) + "." for _ in range(14)]
    return " ".join(sentences)


def test_levels(spark):
    rng = random.Random(2)
    samples = spark.createDataFrame([(_prose(rng, lv), "en", lv) for lv in (1, 3, 5) for _ in range(8)], "text string, lang string, level int")
    docs = [(i, _prose(rng, lv)) for i, lv in enumerate([1, 3, 5] * 6)] + [(90, None), (91, ""), (92, "* a list\n* of things"), (93, "We saw the dog.")]
    got = {r["doc_id"]: r["level"] for r in level.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), samples).collect()}
    assert got == {i: lv for i, lv in enumerate([1, 3, 5] * 6)}
    assert level.reading_levels(spark.createDataFrame([], "doc_id long, text string"), samples).count() == 0


def test_levels_of_unended_sentences(spark):
    rng = random.Random(2)
    samples = spark.createDataFrame([(_prose(rng, lv), "en", lv) for lv in (1, 3, 5) for _ in range(8)], "text string, lang string, level int")
    hard = " ".join(["institutional considerable administration characterised notwithstanding"] * 7)
    easy = " ".join(["We saw the old dog."] * 4)
    fields = "Ann Lee | " + hard
    docs = [(1, hard), (2, f"{easy}\n\n{hard}"), (3, fields), (4, ", ".join(hard.split())), (5, "* " + hard), (6, "Institutional administration")]
    got = {r["doc_id"]: r["level"] for r in level.reading_levels(spark.createDataFrame(docs, "doc_id long, text string"), samples).collect()}
    assert got == {1: 5, 2: 5}


def test_lines_among_wrapped_text():
    text = "We met a man and\nthen he went\nto town.\nWe saw the dog\nThe dog saw us\nOur town was old\n"
    _, _, words = level._profiles(scan(pa.array([text], pa.string())))
    assert words.tolist() == [10, 4, 4, 4]


def test_blank_words_count_a_lone_sign():
    assert level._blank_words(scan(pa.array(["We saw Hamzek & Sons in town.", "A & B\n\n* A & B"], pa.string()))).tolist() == [7, 0]


def test_short_forms_are_unique_in_the_whole_list(spark):
    refs = spark.createDataFrame([(1, "Hamzek Bank Group", None), (2, "Hamzek Bank Holdings", None), (3, "Zospun Foods Group", None)], "company_id int, company string, short_name string")
    values = spark.createDataFrame([("Hamzek Bank",), ("Zospun Foods",)], "value string")
    for rows in (1, 2, 100):
        assert {r["value"]: r["ref_id"] for r in canonical.map_to_list(values, refs, "company", shard_rows=rows).collect()} == {"Hamzek Bank": 0, "Zospun Foods": 3}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(40, 24))
    x = np.repeat(centres, 12, 0) + 0.25 * rng.normal(size=(480, 24))
    x[7] = x[3]  # an exact copy
    df = spark.createDataFrame([("a", f"{i:04d}", [float(v) for v in row]) for i, row in enumerate(x)], "aspect string, id string, vec array<float>")
    got = {}
    for r in knn.neighbours(df, df, 480, 5).collect():
        got.setdefault(int(r["id"]), set()).add(int(r["other"]))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = [set(np.argsort(-row)[:5].tolist()) for row in s]
    assert np.mean([len(want[i] & got.get(i, set())) / 5 for i in range(480)]) >= 0.9 and 3 in got[7] and all(len(v) == 5 for v in got.values())
    assert knn.neighbours(df.limit(0), df.limit(0), 0).count() == 0


def test_neighbours_in_more_lists_than_probes(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(60, 16)), 50, 0) + 0.3 * rng.normal(size=(3000, 16))
    x[100:200] = x[100]  # a hot point
    df = spark.createDataFrame([("a", f"{i:05d}", [float(v) for v in row]) for i, row in enumerate(x)], "aspect string, id string, vec array<float>").cache()
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    s = u @ u.T
    np.fill_diagonal(s, -9)
    want = np.sort(s, axis=1)[:, -5:].sum(1)
    for kw, least in (({"flat": 2}, 0.9), ({}, 0.9), ({"exact": True}, 0.99999)):
        got = knn.neighbours(df, df, 6_000, 5, **kw).groupBy("id").agg(F.sum("sim").alias("s"), F.count("*").alias("n")).collect()
        assert len(got) == 3000 and np.mean([r["n"] == 5 for r in got]) > 0.999
        assert np.mean([min(1, r["s"] / want[int(r["id"])]) >= 0.99 for r in got]) >= least
    books = knn.fit(u, 10**8, flat=64)
    assert len(books.coarse) == 64 and len(books.fine) * 64 > 8 * knn.PROBES and books.lists(u[:9], 8)[0].shape == (9, 8)


def test_vectors_are_sent_once_to_a_bucket_whatever_the_lists(spark):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(30, 16)), 20, 0) + 0.3 * rng.normal(size=(600, 16))
    u = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    df = spark.createDataFrame([("a", f"{i:03d}", row.tolist()) for i, row in enumerate(u)], "aspect string, id string, vec array<float>")
    book = knn.fit(u, 80_000, flat=8)
    assert len(book.fine) > 1
    near = book.lists(u, book.reach[1])[1]
    asked = (near >= near[:, :1] - book.reach[0]).sum()
    sent = [tuple(r) for r in knn._place(df, {"a": book}, 5).where("vec is not null").select("bucket", "id").collect()]
    assert len(set(sent)) == len(sent) and {i for _, i in sent} == {f"{i:03d}" for i in range(600)}
    assert asked > 1.5 * len(sent)
    book.parts = np.full(8, 3)
    ends = [book.bucket(np.arange(e * len(book.fine), (e + 1) * len(book.fine)), np.zeros(len(book.fine), np.int64)) for e in range(8)]
    assert all(len(set(b.tolist())) == 3 and (np.diff(b) >= 0).all() and b[-1] >> 20 < (e + 1) * len(book.fine) for e, b in enumerate(ends))


def test_neighbours_of_an_aspect_that_was_not_drawn(spark):
    rng = np.random.default_rng(4)
    rows = [(a, f"{i:03d}", [float(v) for v in rng.normal(size=8)]) for a, n in (("common", 300), ("rare", 12)) for i in range(n)]
    df = spark.createDataFrame(rows, "aspect string, id string, vec array<float>")
    for aspects in (None, ("common", "rare", "in no row")):
        got = knn.neighbours(df, df.where("aspect = 'common'"), 300, 5, aspects).groupBy("aspect").count().collect()
        assert sorted(map(tuple, got)) == [("common", 1500), ("rare", 60)]


def test_usable_vectors(spark):
    good, t = [0.1] * 384, datetime(2020, 1, 1)
    rows = [("a", good, t), ("b", None, t), ("c", [], t), ("d", [0.0] * 384, t), ("e", [float("nan")] * 384, t), ("f", good[:-1], t)]
    p = spark.createDataFrame(rows, "person_id string, embedding array<float>, created_at timestamp")
    assert [r["person_id"] for r in knn.usable_profiles(p).collect()] == ["a"]
    one = json.dumps({"person_id": "a", "aspects": {"skills": {"embedding": [0.5] * 64}}})
    m = spark.createDataFrame([("a", one, t), ("b", one[:-30], t), ("c", "", t), ("d", "{}", t), ("e", None, t)], "person_id string, embedding_data string, updated_at timestamp")
    assert [r["person_id"] for r in knn.usable_aspects(m).collect()] == ["a"]


@pytest.mark.parametrize("k", [0, 3])
def test_recency_ties(spark, k):
    df = spark.createDataFrame([("h", "f", "v", "s", True, (k, "b"), 1), ("h", "f", "w", "s", True, (k, "a"), 1)], "entity string, field string, value string, source string, usable boolean, newest struct<age:long,record:string>, n long")
    assert fusion.fuse(df).select(F.col("record")).first()[0] == "a"


def test_survivors_by_recency_need_no_estimate(spark, tmp_path, monkeypatch):
    rows = [("h", f"p{i:03d}", "Baker" if i % 2 else "Teacher", None if i else "Law", datetime(1901 + i, 5, 1), datetime(2020, 1, 1) if i < 7 else None) for i in range(300)]
    spark.createDataFrame(rows, "record_hash string, person_id string, current_title string, major string, created_at timestamp, updated_at timestamp").write.parquet(str(tmp_path / "alumni.parquet"))
    monkeypatch.setattr(fusion, "estimate", lambda *_: pytest.fail("estimated"))
    got = queries.p2_found(spark, str(tmp_path)).collect()  # 300 sources are more than can be told apart
    assert sorted((r["field"], r["person_id"]) for r in got) == [("current_title", "p000"), ("major", "p000")]
