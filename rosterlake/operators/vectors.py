"""Vector search by exact inner products, on columns of arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed in double."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def normalized(a: Column) -> Column:
    """The vector at unit length; null where it has none."""
    return F.when(dot(a, a) > 0, F.transform(a, lambda x: x.cast("double") / F.sqrt(dot(a, a))))


def top_k(vectors: DataFrame, query: list[float], k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(key, score) of the k vectors with the highest inner product with the query; ties go to the smaller key."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return vectors.select(key, F.round(dot(F.col(column), q), 6).alias("score")).orderBy(F.desc("score"), key).limit(k)


def similar_to(vectors: DataFrame, item, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """The k vectors most similar to a stored one, without itself; an unknown item gives no rows."""
    found = vectors.where(F.col(key) == item).select(column).limit(1).collect()
    return top_k(vectors.where(F.col(key) != item), list(found[0][0]), k, key, column) if found else vectors.limit(0).select(key, F.lit(0.0).alias("score"))


def aspect_top_k(long: DataFrame, aspect: str, query: list[float], k: int = 20, key: str = "vec_id") -> DataFrame:
    """(key, score) of the k vectors of one aspect with the highest inner product; an unknown aspect gives no rows."""
    return top_k(long.where(F.col("aspect") == aspect), query, k, key)


#: Asked vectors that are scored in one pass over all vectors.
ASKED_AT_ONCE = 2048


def similar_to_all(vectors: DataFrame, asked: DataFrame, k: int = 10, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(item, key, score): for each of the asked vectors (rows of the same form) its k most similar vectors, without itself.

    Asked vectors go in blocks against all vectors: a task scores its share against one block and keeps k of each asked
    one, so that what is shuffled is k rows a task and asked vector. Ties go to the smaller key, no rows give none."""
    kind = "string" if dict(vectors.dtypes)[key] == "string" else "long"
    to = pa.string() if kind == "string" else pa.int64()
    rows = vectors.where(F.col(column).isNotNull()).select(F.col(key).cast(kind).alias("k"), F.col(column).cast("array<double>").alias("v"))
    found = vectors.sparkSession.createDataFrame([], f"item {kind}, {key} {kind}, score double")
    blocks = -(-asked.count() // ASKED_AT_ONCE)
    for n in range(blocks):
        block = asked.where((F.pmod(F.xxhash64(key), F.lit(blocks)) == n) & F.col(column).isNotNull()).select(F.col(key).cast(kind), F.col(column).cast("array<double>")).collect()
        if not block:
            continue
        names, q = np.array([r[0] for r in block], dtype=object), np.array([r[1] for r in block], float)

        def score(batches: Iterator[pa.RecordBatch], names: np.ndarray = names, q: np.ndarray = q) -> Iterator[pa.RecordBatch]:
            best, ids = np.zeros((len(names), 0)), np.zeros((len(names), 0), dtype=object)
            for b in batches:
                if not b.num_rows:
                    continue
                who = np.array(b.column(0).to_pylist(), dtype=object)
                x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(who), -1)
                by_key = np.argsort(who, kind="stable")
                s = np.round(q @ x[by_key].T, 6)
                s[names[:, None] == who[by_key][None, :]] = -np.inf
                best, ids = np.concatenate([best, s], 1), np.concatenate([ids, np.broadcast_to(who[by_key], s.shape)], 1)
                o = np.argsort(ids, axis=1, kind="stable")
                best, ids = np.take_along_axis(best, o, 1), np.take_along_axis(ids, o, 1)
                o = np.argsort(-best, axis=1, kind="stable")[:, :k]
                best, ids = np.take_along_axis(best, o, 1), np.take_along_axis(ids, o, 1)
            ok = np.isfinite(best)
            item = np.broadcast_to(names[:, None], best.shape)[ok]
            yield pa.RecordBatch.from_arrays([pa.array(item.tolist(), to), pa.array(ids[ok].tolist(), to), pa.array(best[ok])], names=["item", key, "score"])

        found = found.unionByName(rows.mapInArrow(score, f"item {kind}, {key} {kind}, score double"))
    order = Window.partitionBy("item").orderBy(F.desc("score"), key)
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


#: Aspects of a person that have vectors of their own.
ASPECTS = ["current_role", "experience", "skills", "education"]


def aspects_from_json(stored: DataFrame, column: str = "embedding_data", aspects: list[str] = ASPECTS, ids: list | None = None) -> DataFrame:
    """(person_id, aspect, text, embedding) of rows that hold aspects as JSON, of all people or those of `ids`.

    Null, empty and broken JSON and aspects that lack give no row."""
    one = "struct<text:string,embedding:array<double>>"
    schema = "person_id string, aspects struct<" + ",".join(f"{a}:{one}" for a in aspects) + ">, _corrupt_record string"
    rows = stored.where(F.col(column).isNotNull())
    rows = rows.where(F.col("person_id").isin(list(ids))) if ids is not None else rows
    parsed = rows.select("person_id", F.from_json(column, schema, {"columnNameOfCorruptRecord": "_corrupt_record"}).alias("j")).where("j is not null and j._corrupt_record is null")
    each = F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(f"j.aspects.{a}").alias("x")) for a in aspects))
    return parsed.select("person_id", F.explode(each).alias("e")).where("e.x is not null").select("person_id", "e.aspect", "e.x.text", "e.x.embedding")


def aspects_to_json(long: DataFrame) -> DataFrame:
    """(person_id, embedding_data): one row a person from (person_id, aspect, text, embedding); of repeated aspects one stands."""
    entry = F.struct(F.col("aspect"), F.struct(F.col("aspect").alias("aspect_type"), "text", "embedding").alias("x"))
    held = long.dropDuplicates(["person_id", "aspect"]).groupBy("person_id").agg(F.map_from_entries(F.collect_list(entry)).alias("aspects"))
    return held.select("person_id", F.to_json(F.struct("person_id", "aspects")).alias("embedding_data"))


def multi_aspect(long: DataFrame, query: dict[str, list[float]], weights: dict[str, float], k: int = 10, least: float = 0.5, key: str = "vec_id") -> DataFrame:
    """(key, score, matched): weighted mean of the inner products over the aspects an item has; `matched` lists the
    aspects above `least`. long: (key, aspect, embedding)."""
    score = None
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    for a, q in query.items():
        one = dot(F.col("embedding"), F.array(*(F.lit(float(x)) for x in q)))
        score = F.when(F.col("aspect") == a, one) if score is None else score.when(F.col("aspect") == a, one)
    scored = long.where(F.col("aspect").isin(list(query))).withColumn("s", score).withColumn("w", weight[F.col("aspect")])
    out = scored.groupBy(key).agg(F.round(F.sum(F.col("s") * F.col("w")) / F.sum("w"), 6).alias("score"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("s") > least, F.col("aspect")))), ",").alias("matched"))
    return out.orderBy(F.desc("score"), key).limit(k)
