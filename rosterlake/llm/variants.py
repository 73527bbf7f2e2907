"""Variant spellings of names typed by people: organisations and persons.

Organisations: every distinct spelling is read as words (names.py); spellings within the edit radius are found by
metric-space partitioning (radius.py) and tied to the nearest more frequent one; initials, acronyms and shortened
names are tied to the one organisation whose name gives them. Persons: rows of one graduation year and one
organisation are a block; family names within the radius and given names that can be one (short forms, initials,
typing errors) make a link. Links follow through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.quality import is_stand_in, squeeze
from rosterlake.llm import names
from rosterlake.llm.graph import components
from rosterlake.llm.metric import BKTree, Strings, distances
from rosterlake.llm.radius import CELL_ROWS, Rows, cell_join, cells
from rosterlake.session import broadcast_if_small, cut

#: Edits (a swap is one) between two spellings of one name.
EDITS = 1
#: Two edits tie organisations only if first words are within one edit of each other.
EDITS_APART = 2
#: Most letters by which respelled family names differ where the typed ones are one edit apart.
RESPELLED = 3
#: Weight of a listed organisation where short forms clash: above any number of rows.
LISTED = 1 << 50
#: Shortest name that may hold an edit.
LEAST_LETTERS = 5
#: A last word counts as a trade word if it follows this share of the spellings' distinct first words (at least 5).
TRADE_SHARE = 0.003
#: A typed given name is a known one if it has this share of the rows (at least 3). Both shares bound what they let
#: through: no more than 1 / 0.003 trade words and 1 / 0.0005 given names pass, whatever the number of rows.
GIVEN_SHARE = 0.0005


def _trade_words(keys: DataFrame) -> frozenset[str]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [names.company_tokens(k, frozenset())[0] for k in b["key"]]
            yield pd.DataFrame([(w[-1], w[0]) for w in ws if len(w) > 1 and len(w[-1]) > 2], columns=["last", "head"])

    n = keys.count()
    counted = keys.mapInPandas(run, "last string, head string").groupBy("last").agg(F.countDistinct("head").alias("n"))
    rows = counted.where(F.col("n") >= max(5, int(TRADE_SHARE * n))).orderBy(F.desc("n"), "last").collect()
    words: list[str] = []
    for w, k in ((r[0], r[1]) for r in rows):  # a rarer word one edit or a few letters from a kept one is a misspelling
        if not any(names._one_edit(w, x) or (len(w) < len(x) and w[0] == x[0] and (x.startswith(w) or (names.subsequence(w, x) and sum(c in "aeiou" for c in w) <= 1))) for x in words):
            words.append(w)
    return frozenset(words)


def _last_words(listed: DataFrame) -> frozenset[str]:
    """Last words of the listed names: trade words even where the spellings are too few to tell. The list is one that a
    task can hold, as in canonical.py."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ws = [names.company_tokens(k, frozenset())[0] for k in b["company"]]
            yield pd.DataFrame({"w": [w[-1] for w in ws if len(w) > 1 and len(w[-1]) > 2]})

    rows = listed.where("company is not null").select("company").mapInPandas(run, "w string").distinct().collect()
    return frozenset(r[0] for r in rows)


def company_spellings(alumni: DataFrame, column: str = "current_company") -> DataFrame:
    """(key, w): the distinct spellings in lower case with blanks squeezed, and their rows. Stand-ins are left out."""
    typed = alumni.groupBy(column).agg(F.count("*").alias("w"))
    return typed.where(~is_stand_in(F.col(column))).groupBy(F.lower(squeeze(F.col(column))).alias("key")).agg(F.sum("w").alias("w"))


def organisations(alumni: DataFrame, column: str = "current_company", listed: DataFrame | None = None) -> DataFrame:
    """(key, org): for every spelling the organisation it names, stated as the smallest reading of its cluster.

    `listed` (company, short_name) is an optional list of clean names; where several organisations share a short
    form, a listed one comes first. It makes no organisation of its own.

    Null and stand-in values are no spellings. An empty table gives no rows. Spellings that read alike are one
    organisation; of several candidates for an acronym, initials or a shortened name the most frequent wins if it is
    at least three times the next, else the spelling stays alone.
    """
    keys = cut(company_spellings(alumni, column))
    trades = _trade_words(keys) | (_last_words(listed) if listed is not None else frozenset())

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, w in zip(b["key"], b["w"]):
                kind, s = names.company_reading(k, trades)
                if not s:
                    kind, s = "x", k  # nothing left to read: the spelling stands for itself
                ws = names.company_tokens(k, trades)[0]
                forms = names.company_forms(k, trades) if kind == "n" else {}
                full = len(ws) > 1 and ws[-1] in trades
                out.append((k, w, kind, s, ws[0] if ws else "", bool(set(ws[1:]) & trades), forms.get("i") if full else None, forms.get("a") if full else None, forms.get("b") if full else None, forms.get("h") if full else None))
            yield pd.DataFrame(out, columns=["key", "w", "kind", "s", "head", "traded", "i", "a", "b", "h"])

    spelled = cut(keys.mapInPandas(read, "key string, w long, kind string, s string, head string, traded boolean, i string, a string, b string, h string"))
    strings = cut(spelled.where("kind = 'n'").groupBy("s").agg(F.sum("w").alias("w"), F.max_by("head", "w").alias("head"), F.max("traded").alias("traded"), *(F.max_by(c, F.when(F.col(c).isNotNull(), F.col("w"))).alias(c) for c in "iabh")))

    def reach(size: np.ndarray) -> np.ndarray:
        return np.where(size >= 2 * LEAST_LETTERS, EDITS_APART, EDITS)

    members = cells(strings.select(F.lit("").alias("block"), "s"), reach).join(strings.select("s", "w", "head"), "s")

    def compare(g: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = g.edits("s", i, j, EDITS_APART)
        size = g.rows["s"].str.len().to_numpy()
        short = np.minimum(size[i], size[j])
        ok = (d <= EDITS) & (short >= LEAST_LETTERS)
        two = np.flatnonzero((d == EDITS_APART) & (short >= 2 * LEAST_LETTERS))
        if len(two):
            whole, head = g["s"], g["head"]
            ok[two] = (g.edits("head", i[two], j[two], EDITS) <= EDITS) & (head[i[two]] != whole[i[two]]) & (head[j[two]] != whole[j[two]])
        return ok

    def emit(g: Rows, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        s, w = g["s"], g["w"]
        up = (w[i] < w[j]) | ((w[i] == w[j]) & (s[i] > s[j]))
        a, b = np.where(up, i, j), np.where(up, j, i)
        return pd.DataFrame({"a": s[a], "b": s[b], "d": g.edits("s", a, b, EDITS_APART), "wb": w[b]})

    near = cell_join(members, ["block", "cell"], ["s", "w", "head"], "s", EDITS_APART, compare, "a string, b string, d long, wb long", emit)
    tied = near.groupBy("a").agg(F.min(F.struct("d", F.negative("wb").alias("o"), "b")).alias("m")).select("a", F.col("m.b").alias("b"))
    root = components(tied)
    clusters = cut(strings.join(root.withColumnRenamed("node", "s"), "s", "left").withColumn("org", F.coalesce("component", "s")))

    # shortened forms: one organisation, or one at least three times as frequent as the next
    weight = clusters.groupBy("org").agg(F.sum("w").alias("ow"), F.max("traded").alias("traded"))
    forms = clusters.select("org", F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.col(c).alias("form")) for c in "iabh"))).alias("f")).select("org", "f.*").where("form is not null").distinct().join(weight.select("org", "ow"), "org").select("org", "ow", "kind", "form")
    if listed is not None:
        def formed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                out = []
                for name, short in zip(b["company"], b["short_name"]):
                    f = names.company_forms(name or "", trades)
                    out += [(f["n"], k, v) for k, v in ({**f, "a": names.fold(short)} if short else f).items() if k != "n"]
                yield pd.DataFrame(out, columns=["s", "kind", "form"])

        known = listed.select("company", "short_name").mapInPandas(formed, "s string, kind string, form string").join(clusters.select("s", "org"), "s")
        forms = forms.unionByName(known.select("org", F.lit(LISTED).alias("ow"), "kind", "form"))
    ranked = forms.groupBy("kind", "form").agg(F.max(F.struct("ow", "org")).alias("m"), F.sum("ow").alias("total")).where("m.ow >= 3 * (total - m.ow)").select("kind", "form", F.col("m.org").alias("target"), F.col("m.ow").alias("tw"))
    asked = spelled.where("kind in ('i', 'a')").select(F.concat("kind", F.lit(":"), "s").alias("node"), "kind", F.col("s").alias("form"))
    bare = weight.where("not traded").select(F.col("org").alias("node"), F.explode(F.array(F.lit("b"), F.lit("h"))).alias("kind"), F.col("org").alias("form"))
    answers = asked.distinct().unionByName(bare).join(ranked, ["kind", "form"]).where("node <> target").groupBy("node").agg(F.min(F.struct("kind", "target")).alias("m")).select("node", F.col("m.target").alias("target"))

    named = spelled.select("key", F.when(F.col("kind") == "n", F.col("s")).otherwise(F.concat("kind", F.lit(":"), "s")).alias("node0"))
    named = named.join(clusters.select(F.col("s").alias("node0"), "org"), "node0", "left").withColumn("node", F.coalesce("org", "node0")).select("key", "node")
    return named.join(answers, "node", "left").select("key", F.coalesce("target", "node").alias("org"))


def company_pairs(orgs: DataFrame) -> DataFrame:
    """(key_a, key_b): all pairs of spellings of one organisation, the smaller first."""
    return orgs.alias("x").join(orgs.alias("y"), (F.col("x.org") == F.col("y.org")) & (F.col("x.key") < F.col("y.key"))).select(F.col("x.key").alias("key_a"), F.col("y.key").alias("key_b"))


def person_classes(alumni: DataFrame, orgs: DataFrame) -> DataFrame:
    """(person_id, name, class): rows of alumni with a readable name, and the person they are.

    Blocks are graduation year (null is a year of its own) and organisation (null and stand-ins are one). A name
    without two words belongs to no one else. Rows that read alike in a block are one person.
    """
    raw = F.coalesce("current_company", F.lit(""))
    named = alumni.select(raw.alias("raw")).distinct().select("raw", F.lower(squeeze("raw")).alias("key"), is_stand_in(F.col("raw")).alias("none")).join(orgs, "key", "left")
    named = broadcast_if_small(cut(named.select("raw", F.when(F.col("none"), F.lit("-")).otherwise(F.coalesce("org", "key")).alias("employer"))))
    rows = alumni.select("person_id", "name", "graduation_year", raw.alias("raw")).where("name is not null and person_id is not null").join(named, "raw")
    rows = rows.select("person_id", "name", F.concat_ws("|", F.coalesce(F.col("graduation_year").cast("string"), F.lit("")), "employer").alias("block"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = [names.person_parts(x) for x in b["name"]]
            yield b.assign(given=[p[0] if p else None for p in parts], family=[p[1] if p else None for p in parts], typed=[p[2] if p else None for p in parts])

    parsed = cut(rows.mapInPandas(read, "person_id string, name string, block string, given string, family string, typed string").where("given is not null and family <> ''"))
    n = parsed.count()
    frequent = parsed.groupBy("given").count().where((F.col("count") >= max(3, int(GIVEN_SHARE * n))) & (F.length("given") > 2)).orderBy(F.desc("count"), "given").collect()
    # misspellings repeat too: a known name within one edit of one twenty times as frequent is none
    freq = {r[0]: r[1] for r in frequent}
    known = [k for k in freq if k in names._FORMAL or not any(freq[o] > 20 * freq[k] and names._one_edit(k, o) for o in freq)]
    words = sorted({*known, *names._FORMAL})

    def stand_for(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, have = BKTree(words or [""]), set(words)
        for b in batches:
            gs = b["given"].tolist()
            odd = [g for g in gs if g not in have and len(g) > 2]
            near: dict[str, set[str]] = {}
            if odd and words:
                q, e, _ = tree.within(odd, 2)
                d = distances(Strings(odd, tree.refs.table), tree.refs, q, e, swaps=True)
                for a, k, x in zip(q, e, d):
                    if x <= 1:
                        near.setdefault(odd[a], set()).add(words[k])
            yield pd.DataFrame({"given": gs, "formal": ["|".join(sorted({f for y in {g, *near.get(g, ())} for f in names.formal_names(y)})) for g in gs]})

    formal = parsed.select("given").distinct().mapInPandas(stand_for, "given string, formal string")
    entries = parsed.select("block", "given", "family", "typed").distinct().join(broadcast_if_small(formal), "given")
    # numbered once, in the written table: links and classes then travel as numbers
    entries = cut(entries.select(F.monotonically_increasing_id().alias("entry"), "block", "given", "family", "typed", "formal"))
    keyed = entries.withColumn("letter", F.explode(F.array_distinct(F.transform(F.split("formal", r"\|"), lambda x: x.substr(1, 1))))).withColumn("block", F.concat_ws("|", "block", "letter"))
    keyed = cut(keyed)
    large = cut(keyed.groupBy("block").count().where(F.col("count") > CELL_ROWS).select("block"))
    members = keyed.select("*", F.col("family").alias("s"), F.lit(0).cast("long").alias("cell"), F.lit(0).alias("away"))
    if large.limit(1).count():
        # a typed edit may change more letters of the respelled name: both are placed in the space
        both = keyed.join(large, "block").withColumn("s", F.explode(F.array_distinct(F.array("family", "typed"))))
        placed = cells(both.select("block", "s").distinct(), lambda size: np.full(len(size), EDITS))
        members = members.join(large, "block", "left_anti").unionByName(both.join(placed.drop("copies"), ["block", "s"]).select(*members.columns))

    def compare(g: Rows, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        d = np.minimum(g.edits("family", i, j, EDITS), g.edits("typed", i, j, EDITS))
        size = g.rows["family"].str.len().to_numpy()
        ok = (d == 0) | ((d <= EDITS) & (np.minimum(size[i], size[j]) >= LEAST_LETTERS))
        at = np.flatnonzero(ok)
        given, sets = g["given"], g.sets("formal")
        for k in at:
            a, b = i[k], j[k]
            ok[k] = bool(sets[a] & sets[b]) or (len(given[a]) == 1 and any(x[0] == given[a] for x in sets[b])) or (len(given[b]) == 1 and any(x[0] == given[b] for x in sets[a]))
        return ok

    def emit(g: Rows, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"a": g["entry"][i], "b": g["entry"][j]})

    links = cell_join(members, ["block", "cell"], ["s", "family", "typed", "given", "formal", "entry"], "s", RESPELLED, compare, "a long, b long", emit).where("a <> b")
    classes = components(links)
    named = parsed.join(entries.select("block", "given", "family", "typed", "entry"), ["block", "given", "family", "typed"])
    return named.join(classes.withColumnRenamed("node", "entry"), "entry", "left").select("person_id", "name", F.coalesce("component", "entry").alias("class"))


def person_pairs(classes: DataFrame) -> DataFrame:
    """(key_a, key_b): pairs of rows of one person whose names differ by more than letter case and blanks. Rows of
    equal id are one."""
    h = F.xxhash64(F.lower(squeeze("name")))  # only compared within a class
    keyed = classes.groupBy("person_id", "class").agg(F.min(h).alias("lo"), F.max(h).alias("hi"))
    several = keyed.groupBy("class").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).where("lo <> hi").select("class")
    keyed = cut(keyed.join(several, "class", "left_semi"))
    differ = (F.col("x.lo") != F.col("y.hi")) | (F.col("x.hi") != F.col("y.lo"))
    return keyed.alias("x").join(keyed.alias("y"), (F.col("x.class") == F.col("y.class")) & (F.col("x.person_id") < F.col("y.person_id")) & differ).select(F.col("x.person_id").alias("key_a"), F.col("y.person_id").alias("key_b"))


def variant_pairs(alumni: DataFrame, listed: DataFrame | None = None) -> DataFrame:
    """(kind, key_a, key_b) of both kinds."""
    orgs = cut(organisations(alumni, listed=listed))
    people = person_pairs(person_classes(alumni, orgs)).select(F.lit("person").alias("kind"), "key_a", "key_b")
    return people.unionByName(company_pairs(orgs).select(F.lit("company").alias("kind"), "key_a", "key_b"))
