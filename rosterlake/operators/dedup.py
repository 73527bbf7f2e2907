"""Duplicate records: exact by hash, then greedy by similarity."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.functions.text import fuzzy_ratio
from rosterlake.session import cut


def exact(df: DataFrame, hash_column: str, order: list[str]) -> DataFrame:
    """The first row of each hash by the given order; rows without a hash are all kept."""
    first = df.where(F.col(hash_column).isNotNull()).withColumn("__r", F.row_number().over(Window.partitionBy(hash_column).orderBy(*order))).where("__r = 1").drop("__r")
    return first.unionByName(df.where(F.col(hash_column).isNull()))


def _bound(letters: int, above: float) -> int:
    """Most insertions and deletions between two texts of so many letters together whose similarity is above `above`."""
    return int(letters * (99.5 - above) / 100 + 1e-9)


def _pieces(above: float, probe: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (k, g, s) with the pieces under which the shorter text (`probe`) of an alike pair meets the longer one.

    The longer text is cut into one piece more than the edits allowed. Some piece is then untouched with as many edits
    before it as there are pieces before it, which leaves few places where the shorter text can hold it.
    """

    def places(la: int, lb: int) -> list[tuple[int, int, int, list[int]]]:
        d = _bound(la + lb, above)
        d -= (d - (lb - la)) % 2
        if d < lb - la:
            return []
        gone, new = (d + lb - la) // 2, (d - lb + la) // 2
        out = []
        for i in range(d + 1):
            at, end = i * lb // (d + 1), (i + 1) * lb // (d + 1)
            shifts = [i - 2 * x for x in range(i + 1) if x <= gone and i - x <= new]
            out.append((i, at, end, [at + x for x in shifts if at + x >= 0 and end + x <= la]))
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[int, list] = {}
        for b in batches:
            out = []
            for row, s in enumerate(b["s"]):
                n = len(s)
                if n not in known:
                    others = range(n, 1 + next(m for m in range(n, 1000 * n + 1000) if not places(n, m + 1))) if probe else [m for m in range(1, n + 1) if places(m, n)]
                    known[n] = [(min(n, m), max(n, m), *p) for m in others for p in places(min(n, m), max(n, m))]
                for la, lb, i, at, end, starts in known[n]:
                    for x in starts if probe else (at,):
                        out.append((row, la, lb, i, s[x : x + end - at]))
            rows = [x[0] for x in out]
            yield pd.DataFrame({"k": b["k"].to_numpy()[rows], "g": b["g"].to_numpy()[rows], "s": b["s"].to_numpy()[rows], "piece": [f"{la},{lb},{i},{t}" for _, la, lb, i, t in out]})

    return run


def alike(texts: DataFrame, above: int) -> DataFrame:
    """(a, b) of all pairs of (k, g, s) with one g whose texts s are more similar than `above` percent; a < b."""
    kind = {f.name: f.dataType.simpleString() for f in texts.schema}
    out = f"k {kind['k']}, g {kind['g']}, s string, piece string"
    cols = texts.select("k", "g", "s").where("s <> ''")
    short, long = (cols.mapInPandas(_pieces(above, p), out).select(F.xxhash64("g", "piece").alias("h"), *(F.col(c).alias(f"{x}_{c}") for c in ("k", "g", "s"))) for p, x in ((True, "a"), (False, "b")))
    first = (F.length("a_s") < F.length("b_s")) | (F.col("a_k") < F.col("b_k"))
    edits = F.levenshtein("a_s", "b_s") <= (F.length("a_s") + F.length("b_s")) * (99.5 - above) / 100 + 1e-9
    met = short.join(long, "h").where((F.col("a_g") == F.col("b_g")) & (F.col("a_k") != F.col("b_k")) & first & edits)
    met = met.select("a_k", "b_k", "a_s", "b_s").distinct()
    met = met.where((F.col("a_s") == F.col("b_s")) | (fuzzy_ratio("a_s", "b_s") > above))
    return met.select(F.least("a_k", "b_k").alias("a"), F.greatest("a_k", "b_k").alias("b"))


def _groups(edges: DataFrame) -> DataFrame:
    """(k, g) of the ends of edges (a, b): one g for all that hang together, the least of them."""
    both = cut(edges.select(F.col("a").alias("k"), F.col("b").alias("o")).union(edges.select("b", "a")))
    label = cut(both.groupBy("k").agg(F.least("k", F.min("o")).alias("g")))
    while True:
        least = both.join(label.select(F.col("k").alias("o"), F.col("g").alias("og")), "o").groupBy("k").agg(F.min("og").alias("og"))
        near = label.join(least, "k").select("k", F.col("g").alias("was"), F.least("g", "og").alias("g"))
        nxt = cut(near.join(label.select(F.col("k").alias("g"), F.col("g").alias("gg")), "g").select("k", "was", F.least("g", "gg").alias("g")))
        label = nxt.select("k", "g")
        if not nxt.where("g <> was").limit(1).count():
            return label


def greedy(df: DataFrame, key: str, name: str, employer: str, block: list[str], name_above: int = 90, employer_above: int = 85) -> DataFrame:
    """(key) of the rows kept when each row in the order of `key` is dropped if an earlier kept one is alike.

    Alike: both similarities above their bounds, and equal in the columns of `block` if there are any. No employer is
    the empty one, and equal ones are alike. Rows without a name or with a null in a block column are alike to none.
    Rows of equal name and employer are folded into their first, which decides for all of them. The others meet by
    pieces of the name among employers that hang together by similarity; no alike pair is left out. The kept set is
    found by rounds: a row is kept once all earlier neighbours are dropped, and dropped once an earlier one is kept.
    """
    rows = df.select(F.col(key).alias("k"), F.lower(name).alias("n"), F.lower(F.coalesce(employer, F.lit(""))).alias("e"), F.to_json(F.struct(*block)).alias("block") if block else F.lit("").alias("block"), *(F.col(c).alias(f"__{i}") for i, c in enumerate(block)))
    for i in range(len(block)):
        rows = rows.where(F.col(f"__{i}").isNotNull())
    rows = rows.where("n <> ''").select("k", "n", "e", "block")
    first = cut(rows.groupBy("n", "e", "block").agg(F.min("k").alias("k")))
    employers = first.select(F.col("e").alias("k"), F.lit(0).alias("g"), F.col("e").alias("s")).distinct()
    kin = cut(alike(employers, employer_above))
    hang = _groups(kin).withColumnsRenamed({"k": "e", "g": "root"})
    placed = cut(first.join(hang, "e", "left").select("k", "n", "e", F.concat_ws("\n", F.coalesce("root", "e"), "block").alias("g")))
    near = alike(placed.select("k", "g", F.col("n").alias("s")), name_above)
    e = placed.select("k", "e")
    met = near.join(e.withColumnsRenamed({"k": "a", "e": "ea"}), "a").join(e.withColumnsRenamed({"k": "b", "e": "eb"}), "b")
    pair = kin.select(F.col("a").alias("lo"), F.col("b").alias("hi"), F.lit(True).alias("kin"))
    met = met.withColumns({"lo": F.least("ea", "eb"), "hi": F.greatest("ea", "eb")}).join(pair, ["lo", "hi"], "left").where((F.col("ea") == F.col("eb")) | F.col("kin"))
    edges = cut(met.select("a", "b"))
    state = cut(edges.select(F.col("b").alias("k")).union(edges.select("a")).distinct().withColumn("kept", F.lit(None).cast("boolean")))
    while True:
        seen = edges.join(state.withColumnsRenamed({"k": "a", "kept": "ka"}), "a").groupBy(F.col("b").alias("k")).agg(F.max(F.coalesce("ka", F.lit(False))).alias("any_kept"), F.min(F.when(F.col("ka").isNull(), 0).otherwise(1)).alias("settled"))
        nxt = state.join(seen, "k", "left").select("k", F.when(F.col("kept").isNotNull(), F.col("kept")).when(F.coalesce("any_kept", F.lit(False)), False).when(F.coalesce("settled", F.lit(1)) == 1, True).alias("kept"))
        state = cut(nxt)
        if not state.where("kept is null").limit(1).count():
            break
    folded = rows.join(first.withColumnRenamed("k", "f"), ["n", "e", "block"]).where("k <> f").select("k")
    dropped = state.where("kept = false").select("k").union(folded).withColumnRenamed("k", key)
    return df.select(key).join(dropped, key, "left_anti")
