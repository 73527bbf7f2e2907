"""Free-typed values mapped to the entry of a canonical list, unmatched values reported.

Each distinct value is read in several ways (names.py); a BK-tree over the reference keys, built on a true edit
metric, returns every entry within the threshold, and the best reading wins. The keys of a long list are split into
trees of bounded size, asked one after the other; words, sectors and unique short forms are those of the whole list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.functions.quality import is_usable, squeeze
from rosterlake.llm import names
from rosterlake.llm.metric import BKTree, Strings, distances
from rosterlake.session import broadcast_if_small, cut

#: Most reference keys in one tree; a longer list has several.
SHARD_ROWS = 20_000
#: Most entries of a canonical list; each task holds all of them (about 100 bytes an entry).
MAX_LIST = 1_000_000
#: Metric radius of the tree search; it holds every pair within MAX_EDITS edits where a swap counts as one.
RADIUS, MAX_EDITS = 4, 2


def allowed_edits(n: int) -> int:
    """Edits (a swap is one) that a key of n letters may show: none below 5 letters, one below 10, else two."""
    return 0 if n < 5 else 1 if n < 10 else MAX_EDITS


class KeyIndex:
    """Reference keys with their ids, looked up within the allowed edits."""

    def __init__(self, keys: list[tuple[str, int]], tree_rows: int = SHARD_ROWS):
        self.ids: dict[str, list[int]] = {}
        for k, i in keys:
            if k:
                self.ids.setdefault(k, []).append(i)
        distinct = list(self.ids)
        self.trees = [BKTree(distinct[lo : lo + tree_rows]) for lo in range(0, len(distinct), tree_rows)]

    def lookup(self, queries: list[str]) -> list[list[tuple[int, str]]]:
        """Per query the (edits, key) of every reference key within the allowed edits, best first."""
        out: list[list[tuple[int, str]]] = [[] for _ in queries]
        if not self.ids or not queries:
            return out
        for tree in self.trees:
            q, e, _ = tree.within(queries, RADIUS)
            qs = Strings(queries, tree.refs.table)
            d = distances(qs, tree.refs, q, e, swaps=True)
            for a, b, k in zip(q.tolist(), e.tolist(), d.tolist()):
                key = tree.refs.values[b]
                if k <= min(allowed_edits(len(key)), allowed_edits(len(queries[a]))):
                    out[a].append((k, key))
        for x in out:
            x.sort()
        return out


class CompanyMatcher:
    """Rows: company_id, company, short_name."""

    def __init__(self, rows: list[tuple], tree_rows: int = SHARD_ROWS):
        words = [names.company_tokens(r[1], frozenset())[0] for r in rows]
        self.sectors = frozenset(w for ws in words for w in ws[-1:] if len(ws) > 1)
        forms = [(names.company_forms(r[1], self.sectors), r) for r in rows]
        self.index = {k: KeyIndex([(f[k], r[0]) for f, r in forms if k in f], tree_rows) for k in "nbhi"}
        self.heads = {f["n"]: f.get("h", f["n"]) for f, _ in forms if f}
        self.acronyms: dict[str, int] = {}
        for _, r in forms:
            if r[2]:
                self.acronyms.setdefault(names.fold(r[2]), r[0])

    def _heads_agree(self, value: str, key: str) -> bool:
        """Two edits are one too many within a first word: they may make another organisation."""
        words = names.company_tokens(value, self.sectors)[0]
        return len(words) > 1 and names._one_edit(words[0], self.heads[key])

    def match(self, values: list[str]) -> list[tuple[int, float]]:
        read = [names.company_reading(v, self.sectors) for v in values]
        best = [(0, 99.0)] * len(values)
        for kind in "ni":
            at = [k for k, r in enumerate(read) if r[0] == kind]
            for k, hits in zip(at, self.index[kind].lookup([read[k][1] for k in at])):
                if kind == "n":
                    hits = [h for h in hits if h[0] < 2 or self._heads_agree(values[k], h[1])]
                if hits and (kind == "n" or hits[0][0] <= 1):
                    best[k] = (min(self.index[kind].ids[hits[0][1]]), hits[0][0])
        # the last word or all but the first left out: only where no whole name fits, and one entry does
        for form in "bh":
            at = [k for k, r in enumerate(read) if r[0] == "n" and not best[k][0] and not self.sectors & set(names.company_tokens(values[k], self.sectors)[0][1:])]
            for k, hits in zip(at, self.index[form].lookup([read[k][1] for k in at])):
                if hits and hits[0][0] <= 1 and len(self.index[form].ids[hits[0][1]]) == 1:
                    best[k] = (self.index[form].ids[hits[0][1]][0], hits[0][0] + 0.5)
        for k, (kind, key) in enumerate(read):
            if not best[k][0] and key in self.acronyms:
                best[k] = (self.acronyms[key], 0.5)
        return best


class TitleMatcher:
    """Rows: title_id, title."""

    def __init__(self, rows: list[tuple], tree_rows: int = SHARD_ROWS):
        words = [names.title_words(names.fold(r[1])) for r in rows]
        self.vocabulary = frozenset(w for ws in words for w in ws)
        self.paths = names.title_paths(words)
        self.index = KeyIndex([(names.title_key(ws), r[0]) for ws, r in zip(words, rows)], tree_rows)

    def match(self, values: list[str]) -> list[tuple[int, float]]:
        at, rank, keys = [], [], []
        for k, v in enumerate(values):
            for r, key in names.title_readings(v, self.vocabulary, self.paths):
                at.append(k)
                rank.append(r)
                keys.append(key)
        best = [(0, 99.0)] * len(values)
        for k, r, hits in zip(at, rank, self.index.lookup(keys)):
            if hits:
                cand = (min(self.index.ids[hits[0][1]]), 10.0 * r + hits[0][0])
                if (cand[1], cand[0]) < (best[k][1], best[k][0] or 1 << 60):
                    best[k] = cand
        return best


class PlaceMatcher:
    """Rows: location_id, location, city, region, region_code, country. A city named twice is the first listed unless
    the value names its region or country; a named region that is not the city's own means another place."""

    def __init__(self, rows: list[tuple], tree_rows: int = SHARD_ROWS):
        self.rows = {r[0]: tuple(names.fold(x or "") for x in r[2:6]) for r in rows}
        self.index = KeyIndex([(v[0].replace(" ", ""), i) for i, v in sorted(self.rows.items())], tree_rows)

    def _context(self, part: str, row: tuple) -> bool:
        p = part.strip(" .")
        return p in row[1:] or any(len(x) > 4 and abs(len(x) - len(p)) <= 1 and self._near(p, x) for x in (row[1], row[3]))

    @staticmethod
    def _near(a: str, b: str) -> bool:
        s = Strings([a, b])
        return bool(distances(s, s, np.array([0]), np.array([1]), swaps=True)[0] <= 1)

    def match(self, values: list[str]) -> list[tuple[int, float]]:
        at, rests, keys = [], [], []
        for k, v in enumerate(values):
            for city, rest in names.place_readings(v):
                at.append(k)
                rests.append(rest)
                keys.append(city)
        best = [(0, 99.0)] * len(values)
        for k, rest, hits in zip(at, rests, self.index.lookup(keys)):
            for edits, key in hits:
                for i in self.index.ids[key]:
                    good = [self._context(p, self.rows[i]) for p in rest]
                    if all(good):
                        cand = (i, float(edits))
                        if (cand[1], cand[0]) < (best[k][1], best[k][0] or 1 << 60):
                            best[k] = cand
        return best


MATCHERS = {"company": CompanyMatcher, "title": TitleMatcher, "place": PlaceMatcher}


def map_to_list(values: DataFrame, refs: DataFrame, kind: str, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(value, ref_id, score) for each distinct non-null value of the one column `value`; ref_id 0 where none fits.

    `refs` has the columns of the matcher of `kind`, in order, id first. Score: edits, plus 10 where a remark was cut
    off and 0.5 where the name was shortened. Ties go to the smaller id. An empty list leaves every value unmatched.
    Every task holds the list, as trees of `shard_rows` keys: a list above MAX_LIST entries is refused.
    """
    distinct = values.select("value").where(F.col("value").isNotNull()).distinct()
    rows = [tuple(r) for r in refs.orderBy(refs.columns[0]).limit(MAX_LIST + 1).collect()]
    if len(rows) > MAX_LIST:
        raise ValueError(f"a canonical list of more than {MAX_LIST} entries: map to its parts and keep the best score of each value")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = MATCHERS[kind](rows, shard_rows) if rows else None
        for b in batches:
            v = b["value"].tolist()
            m = matcher.match(v) if matcher else [(0, 99.0)] * len(v)
            yield pd.DataFrame({"value": v, "ref_id": [int(x[0]) for x in m], "score": [float(x[1]) for x in m]})

    return distinct.mapInPandas(run, "value string, ref_id int, score double")


def alumni_to_lists(alumni: DataFrame, companies: DataFrame, titles: DataFrame, locations: DataFrame) -> DataFrame:
    """(field, person_id, ref_id) of every usable value of the four free-typed fields that is not already listed.

    Null, stand-in and broken-off values and values equal to a listed one but for case and blanks give no row.
    """
    spec = {
        "current_company": ("company", companies.select("company_id", "company", "short_name"), "company"),
        "normalized_company": ("company", companies.select("company_id", "company", "short_name"), "company"),
        "current_title": ("title", titles.select("title_id", "title"), "title"),
        "location": ("place", locations.select("location_id", "location", "city", "region", "region_code", "country"), "location"),
    }
    kinds = {f: k for f, (k, _, _) in spec.items()}
    each = F.array(*(F.struct(F.lit(f).alias("field"), F.lit(kinds[f]).alias("kind"), F.col(f).alias("typed")) for f in spec))
    long = alumni.select("person_id", F.explode(each).alias("x")).select("person_id", "x.*").where("typed is not null")
    # values repeat: rules, lookup and matching see each distinct one once
    values = long.select("kind", "typed").distinct().where(is_usable(F.col("typed"))).withColumn("value", squeeze("typed")).withColumn("low", F.lower("value"))
    listed = None
    for k in dict.fromkeys(kinds.values()):
        _, refs, col = next(v for v in spec.values() if v[0] == k)
        one = refs.select(F.lit(k).alias("kind"), F.lower(squeeze(F.col(col))).alias("low"))
        listed = one if listed is None else listed.unionByName(one)
    values = cut(values.join(listed.distinct(), ["kind", "low"], "left_anti").select("kind", "typed", "value"))
    mapped = None
    for k in dict.fromkeys(kinds.values()):
        _, refs, _ = next(v for v in spec.values() if v[0] == k)
        one = map_to_list(values.where(F.col("kind") == k).select("value"), refs, k).select(F.lit(k).alias("kind"), "value", "ref_id")
        mapped = one if mapped is None else mapped.unionByName(one)
    answers = broadcast_if_small(cut(values.join(mapped, ["kind", "value"]).select("kind", "typed", "ref_id")))
    return long.join(answers, ["kind", "typed"]).select("field", "person_id", "ref_id")
