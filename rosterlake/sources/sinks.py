"""Writers: upserts as joins, child tables, JSON exports, a cache of results."""

from __future__ import annotations

import hashlib
import json
import time
from collections import OrderedDict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert_replace(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of `new` replace rows of `old` with the same keys; the rest of `old` stays. Keys that are null match nothing."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_touch(old: DataFrame, new: DataFrame, key: str, stamp: str, at: Column) -> DataFrame:
    """Rows of `old` whose key occurs in `new` only get a new stamp; rows of `new` with an unknown key are added."""
    seen = new.select(key).distinct().withColumn("__hit", F.lit(True))
    touched = old.join(seen, key, "left").withColumn(stamp, F.when(F.col("__hit"), at).otherwise(F.col(stamp))).drop("__hit")
    return touched.unionByName(new.join(old.select(key), key, "left_anti"), allowMissingColumns=True)


def child_rows(records: DataFrame, key: str, nested: str) -> DataFrame:
    """One row per element of a nested list: the key and the element's fields (or the element, named as the list)."""
    one = records.select(key, F.explode(nested).alias("__x"))
    return one.select(key, "__x.*") if "struct" in dict(one.dtypes)["__x"] else one.withColumnRenamed("__x", nested)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines, one folder of parts."""
    df.write.mode("overwrite").json(path)


def export_terms(metrics: DataFrame, df: DataFrame, expansions: DataFrame, home: str, top: int = 1000) -> None:
    """JSON of the term tables: the `top` pairs by pmi and terms by frequency (reports), the vocabulary with numbers, the
    expansions of each term as an adjacency list."""
    write_json(metrics.orderBy(F.desc(F.round("pmi", 9)), "term1", "term2").limit(top), f"{home}/cooccurrence_results")
    write_json(df.orderBy(F.desc("df"), "term").limit(top), f"{home}/term_frequencies")
    write_json(df.select("term", F.xxhash64("term").alias("number")), f"{home}/vocabulary")
    listed = F.array_sort(F.collect_list(F.struct("rank", F.struct("expansion", "weight").alias("x"))))
    write_json(expansions.groupBy("term").agg(listed.alias("l")).select("term", F.transform("l", lambda r: r["x"]).alias("expansions")), f"{home}/expansion_lookup")


class ResultCache:
    """Collected pages by configuration: the key is the md5 of the sorted JSON of all that shapes the result, paging
    included; entries end after `ttl` seconds and the least recently used go first."""

    def __init__(self, ttl: int = 3600, size: int = 256):
        self.ttl, self.size, self.rows, self.hits, self.misses = ttl, size, OrderedDict(), 0, 0

    @staticmethod
    def key(config: dict) -> str:
        return "search:" + hashlib.md5(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest()

    def get(self, config: dict):
        k = self.key(config)
        at, value = self.rows.get(k, (0.0, None))
        if value is None or time.time() - at > self.ttl:
            self.rows.pop(k, None)
            self.misses += 1
            return None
        self.rows.move_to_end(k)
        self.hits += 1
        return value

    def put(self, config: dict, value) -> None:
        self.rows[self.key(config)] = (time.time(), value)
        while len(self.rows) > self.size:
            self.rows.popitem(last=False)

    def invalidate(self, prefix: str = "search:") -> int:
        gone = [k for k in self.rows if k.startswith(prefix)]
        for k in gone:
            del self.rows[k]
        return len(gone)
