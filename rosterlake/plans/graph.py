"""Graph-based expansion of queries: source of the graph, look-up of words, merged scores with paths, condition and words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rosterlake.operators import expand, search
from rosterlake.plans import query
from rosterlake.session import exists
from rosterlake.sources import readers


def graph_source(spark: SparkSession, home: str) -> DataFrame:
    """(src, dst, weight, distance): edges from the expansion lists under `home`, else its table of pairs, else none."""
    if exists(spark, f"{home}/expansion_lookup"):
        e = readers.read_expansions(spark, f"{home}/expansion_lookup").select(F.col("term").alias("src"), F.col("expansion").alias("dst"), "weight")
        both = e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
        return both.groupBy("src", "dst").agg(F.max("weight").alias("weight")).withColumn("distance", -F.log(F.greatest("weight", F.lit(0.01))))
    if exists(spark, f"{home}/cooccurrence_results"):
        pairs = spark.read.schema("term1 string, term2 string, lift double, confidence double, reverse_confidence double, pmi double").json(f"{home}/cooccurrence_results")
        return expand.graph_edges(pairs)
    return spark.createDataFrame([], "src string, dst string, weight double, distance double")


class GraphExpansion:
    """Expansion of queries over one graph; `df` (term, df) and `total` weigh terms by rarity, without them none is weighed."""

    def __init__(self, edges: DataFrame, df: DataFrame | None = None, total: int = 1):
        self.edges, self.df, self.total = edges, df, total

    def expand(self, text: str, hops: int = 2, per_word: int = 10) -> dict:
        """The text's words and their nodes, at most `per_word` expansions a word with score and path, the terms of the
        widened condition, and the explanation in words."""
        spark = self.edges.sparkSession
        words = query.words_of(text)
        asked = spark.createDataFrame([(w,) for w in words], "word string")
        nodes = expand.nodes_of(asked, self.edges.select(F.col("src").alias("term")))
        starts = nodes.select(F.col("node").alias("term")).distinct()
        reached = expand.graph_expand(self.edges, starts, hops).join(starts.select(F.col("term").alias("expansion")), "expansion", "left_anti")
        best = reached.groupBy("expansion").agg(F.max(F.struct("score", F.negative("hops").alias("h"), "path")).alias("m")).select("expansion", F.col("m.score").alias("score"), "m.path", F.negative("m.h").alias("hops"))
        if self.df is not None:
            weighed = expand.merge_scores(best.select("expansion", "score"), self.df, self.total, per_word * max(1, len(words)))
            best = weighed.join(best.drop("score"), "expansion")
        rows = best.orderBy(F.desc("score"), "expansion").limit(per_word * max(1, len(words))).collect()  # a bounded page
        found = {r["expansion"]: r["score"] for r in rows}
        paths = {r["expansion"]: r["path"] for r in rows}
        lines = ["Query Expansion Results:", f"Original terms: {', '.join(words)}", f"Found {len(rows)} expansions using up to {max((r['hops'] for r in rows), default=0)} hops", "", "Top Expansions:"]
        lines += [f"  {t}: {s:.3f} (path: {paths[t]})" for t, s in list(found.items())[:10]]
        return {"query": text, "terms": words, "expansions": found, "paths": paths, "condition": search.condition(words, found), "explanation": "\n".join(lines)}
