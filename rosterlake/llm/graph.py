"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut

MAX_ROUNDS = 40
#: Edges that a task contracts at once.
AT_ONCE = 200_000


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Edges (u, v) of the same components within the share of a task, each node tied to the smallest it reaches."""

    def stars(held: list[pd.DataFrame]) -> pd.DataFrame:
        top: dict = {}

        def root(x):
            while (y := top.setdefault(x, x)) != x:
                top[x] = top[y]
                x = top[x]
            return x

        for b in held:
            for u, v in zip(b["u"].tolist(), b["v"].tolist()):
                a, c = root(u), root(v)
                if a != c:
                    top[max(a, c)] = min(a, c)
        rows = [(x, root(x)) for x in list(top)]
        return pd.DataFrame([r for r in rows if r[0] != r[1]], columns=["u", "v"])

    held, n = [], 0
    for b in batches:
        held.append(b)
        n += len(b)
        if n >= AT_ONCE:
            yield stars(held)
            held, n = [], 0
    if n:
        yield stars(held)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node of each connected component, for every node that an edge names.

    Edges are contracted to stars where they lie, then large-star and small-star rounds alternate: each round is two
    aggregations over the edges, the number of rounds grows with the logarithm of the longest chain, and no node's
    neighbours are ever gathered in one list. Lineage is cut in the shared checkpoint folder after every round. Null
    ends are ignored; a node of loops alone is its own component.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    kind = {f.name: f.dataType.simpleString() for f in e.schema}
    own = cut(e)
    loops = own.where("u = v").select(F.col("u").alias("node")).distinct()
    e = own.where("u <> v").mapInPandas(_contract, f"u {kind['u']}, v {kind['v']}")
    for k in range(MAX_ROUNDS):
        e = cut(e.distinct())
        # settled when no node has two parents and no parent has a parent
        sides = e.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        if not sides.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or (up = 1 and down = 1)").limit(1).count():
            break
        if k == MAX_ROUNDS - 1:
            raise RuntimeError("components did not settle")
        # large star: every neighbour above u is tied to the smallest node around u
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.where("u > m").select("u", F.col("m").alias("v"))).distinct()
        # small star: every neighbour below u, and u itself, is tied to the smallest of them
        least = large.where("u > v").groupBy("u").agg(F.min("v").alias("m"))
        small = large.where("u > v").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        e = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    named = e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    return named.unionByName(loops.join(named.select("node"), "node", "left_anti").select("node", F.col("node").alias("component")))
