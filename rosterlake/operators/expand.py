"""Expansion of query terms over the table of associations and over the term graph."""

from __future__ import annotations

import heapq
import math

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Prefixes under which a bare word is looked up.
PREFIXES = ["", "title:", "company:", "skill:", "role:", "industry:", "seniority:", "spec:", "location:", "dept:"]
#: Most edges of a graph that is walked from single terms: the strongest pairs are the graph, as a stated feature of it.
MAX_EDGES = 10_000


def one_hop(table: DataFrame, word: str, per_form: int = 5, k: int = 5) -> DataFrame:
    """(expansion, weight) of a word under every prefix: at most `per_form` of each, the best k altogether."""
    hits = table.where(F.col("term").isin([p + word for p in PREFIXES]) & (F.col("rank") <= per_form))
    return hits.groupBy("expansion").agg(F.max("weight").alias("weight")).orderBy(F.desc("weight"), "expansion").limit(k)


def multi_hop(table: DataFrame, starts: DataFrame, hops: int = 2, decay: float = 0.5, per_term: int = 5, least: float = 0.0, k: int | None = None) -> DataFrame:
    """(start, expansion, weight, hop): terms reached in at most `hops` joins, each with its best weight w*c*decay^hop.

    With `least` weaker ones are left out, with `k` each start keeps its k best (ties by term). A term reached on several ways keeps the highest weight and, at equal weight, the fewest hops.
    """
    edges = table.where(F.col("rank") <= per_term).select("term", "expansion", F.col("weight").alias("c"))
    frontier = starts.select(F.col("term").alias("start"), "term", F.lit(1.0).alias("w"))
    found = None
    for hop in range(1, hops + 1):
        nxt = frontier.join(edges, "term").where(F.col("expansion") != F.col("start")).groupBy("start", "expansion").agg(F.max(F.col("w") * F.col("c") * decay**hop).alias("w"))
        one = nxt.select("start", "expansion", F.col("w").alias("weight"), F.lit(hop).alias("hop"))
        found = one if found is None else found.unionByName(one)
        frontier = nxt.select("start", F.col("expansion").alias("term"), F.col("w"))
    best = found.groupBy("start", "expansion").agg(F.min(F.struct(F.negative("weight").alias("w"), "hop")).alias("m"))
    best = best.select("start", "expansion", F.negative("m.w").alias("weight"), F.col("m.hop").alias("hop")).where(F.col("weight") >= least)
    if k is None:
        return best
    order = Window.partitionBy("start").orderBy(F.desc(F.round("weight", 9)), "expansion")
    return best.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


#: Prefixes under which a word of a query is sought in the graph, after the bare word.
NODE_PREFIXES = ["title:", "company:", "skill:", "seniority:", "role:"]


def nodes_of(words: DataFrame, nodes: DataFrame) -> DataFrame:
    """(word, node): the bare word if it is a node, else its first prefixed form that is one, else the word itself.

    words: (word); nodes: (term). Words are trimmed and in lower case; null words give no row."""
    low = F.lower(F.trim("word"))
    forms = F.posexplode(F.array(low, *(F.concat(F.lit(p), low) for p in NODE_PREFIXES))).alias("k", "node")
    asked = words.where("word is not null").select(low.alias("word")).distinct()
    met = asked.select("word", forms).join(nodes.select(F.col("term").alias("node")).distinct(), "node").groupBy("word").agg(F.min(F.struct("k", "node")).alias("m"))
    return asked.join(met, "word", "left").select("word", F.coalesce("m.node", "word").alias("node"))


def by_type(expanded: DataFrame, term: str = "expansion", score: str = "weight") -> DataFrame:
    """(type, n, terms): expansions grouped by the prefix of their term ('general' without one), the best first."""
    typed = F.when(F.col(term).contains(":"), F.split(term, ":")[0]).otherwise("general")
    one = expanded.select(typed.alias("type"), F.round(score, 3).alias("s"), F.substring_index(term, ":", -1).alias("t"))
    best = one.groupBy("type", "t").agg(F.max("s").alias("s"))
    listed = F.array_sort(F.collect_list(F.struct(F.negative("s").alias("o"), "t")))
    return best.groupBy("type").agg(F.count("*").alias("n"), F.transform(listed, lambda x: x["t"]).alias("l")).select("type", "n", F.array_join("l", "|").alias("terms"))


def idf_weighted(expanded: DataFrame, df: DataFrame, term: str = "expansion", score: str = "weight") -> DataFrame:
    """`expanded` with score * (.5 + .5 * idf / largest idf), idf = ln((1 + N) / (1 + df)) + 1 of the word after the
    prefix in `df` (term, df, total); words that are not in it keep their score."""
    idf = df.select(F.col("term").alias("__w"), (F.log((1.0 + F.col("total")) / (1.0 + F.col("df"))) + 1.0).alias("__idf"))
    top = idf.agg(F.max("__idf").alias("__top"))  # one row
    joined = expanded.withColumn("__w", F.substring_index(term, ":", -1)).join(idf, "__w", "left").crossJoin(F.broadcast(top))
    return joined.withColumn(score, F.when(F.col("__idf").isNull(), F.col(score)).otherwise(F.col(score) * (0.5 + 0.5 * F.col("__idf") / F.col("__top")))).drop("__w", "__idf", "__top")


def graph_edges(metrics: DataFrame, confidence: float = 0.3, lift: float = 2.0) -> DataFrame:
    """(src, dst, weight, distance) in both directions; the weight is the higher of both confidences."""
    w = F.greatest("confidence", "reverse_confidence")
    e = metrics.where((F.col("lift") > lift) & (w > confidence)).orderBy(F.desc("lift"), "term1", "term2").limit(MAX_EDGES).select("term1", "term2", w.alias("weight"))
    both = e.select(F.col("term1").alias("src"), F.col("term2").alias("dst"), "weight").unionByName(e.select(F.col("term2").alias("src"), F.col("term1").alias("dst"), "weight"))
    return both.withColumn("distance", -F.log(F.greatest("weight", F.lit(0.01))))


def shortest_paths(edges: list[tuple[str, str, float]], start: str, hops: int, decay: float, least: float) -> list[tuple[str, float, int, list[str]]]:
    """(node, score, hops, path) of nodes whose nearest path from `start` has at most `hops` edges and score enough."""
    near: dict[str, list[tuple[str, float]]] = {}
    for a, b, d in edges:
        near.setdefault(a, []).append((b, d))
    done: set[str] = set()
    out = []
    heap = [(0.0, 0, start, [start])]
    while heap:
        d, n, node, path = heapq.heappop(heap)
        if node in done:
            continue
        done.add(node)
        if n > hops:  # reached, but too far to count or to go on from
            continue
        if node != start and (score := math.exp(-d) * decay**n) >= least:
            out.append((node, score, n, path))
        for b, w in near.get(node, []):
            if b not in done:
                heapq.heappush(heap, (d + w, n + 1, b, [*path, b]))
    return out


def graph_expand(edges: DataFrame, starts: DataFrame, hops: int = 2, decay: float = 0.8, least: float = 0.3) -> DataFrame:
    """(start, expansion, score, hops, path): shortest-distance expansion from each start term.

    The edge table is bounded (MAX_EDGES pairs) and goes to every task; starts are spread.
    """
    held = [(r[0], r[1], r[2]) for r in edges.select("src", "dst", "distance").orderBy("src", "dst").limit(2 * MAX_EDGES).collect()]

    def walk(batches):
        for b in batches:
            rows = [(s, *x[:3], " → ".join(x[3])) for s in b["term"] for x in shortest_paths(held, s, hops, decay, least)]
            yield pd.DataFrame(rows, columns=["start", "expansion", "score", "hops", "path"])

    return starts.select("term").mapInPandas(walk, "start string, expansion string, score double, hops int, path string")


def merge_scores(expanded: DataFrame, df: DataFrame, total: int, k: int = 10) -> DataFrame:
    """(expansion, score): best score over all starts, weighted by ln(N / (1 + df)) floored at 0, the best k."""
    best = expanded.groupBy("expansion").agg(F.max("score").alias("score"))
    idf = F.greatest(F.lit(0.0), F.log(F.lit(float(total)) / (1 + F.coalesce("df", F.lit(0)))))
    return best.join(df.withColumnRenamed("term", "expansion"), "expansion", "left").select("expansion", (F.col("score") * idf).alias("score")).orderBy(F.desc("score"), "expansion").limit(k)
