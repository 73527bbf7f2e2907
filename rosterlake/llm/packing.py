"""Filling fixed-capacity containers with items: best fit planned over a histogram of lengths.

The plan sees counts of lengths, never items: its size depends on the capacity alone. Items then take the planned
slots by their rank within their length. Ranks are counted within salts of a length and offset by the counts of the
salts before, so that a length held by a third of all items is never ordered in one task.
"""

from __future__ import annotations

import base64
import bisect
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import cut, shuffle_width

#: Tokens of a container.
CAPACITY = 2048
#: Vocabulary of a public tokenizer as ranks, and the fixed pattern that parts its texts.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=2)
def _coder(path: str):
    """The tokenizer of a vocabulary file; a worker process reads it once."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens) of every document whose text is not null or blank. Whole texts are tokenised.

    The vocabulary file is read where the driver runs and shipped with the job."""
    documents.sparkSession.sparkContext.addFile(vocabulary)
    name = os.path.basename(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(SparkFiles.get(name))
        for b in batches:
            n = [len(coder.encode_ordinary(t)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32())], names=["doc_id", "n_tokens"])

    kept = documents.select("doc_id", "text").where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"\S"))
    return kept.mapInArrow(run, "doc_id long, n_tokens int")


def plan(counts: dict[int, int], capacity: int, first: int = 0) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts of lengths: ([(length, rank from, rank to, container, items each)], containers).

    Items of rank from..to-1 of the length fill containers from `container` on, `each` in every one. A group of equal
    containers is one entry of the plan, however many it holds.
    """
    slots: list[tuple[int, int, int, int, int]] = []
    room: dict[int, list[tuple[int, int]]] = {}  # room left -> (first container, number)
    rooms: list[int] = []
    nxt = first

    def put(space: int, start: int, n: int) -> None:
        if n <= 0 or space <= 0:
            return
        if space not in room:
            room[space] = []
            bisect.insort(rooms, space)
        room[space].append((start, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                full, rest = divmod(left, each)
                for n, k in ((full, each), (1 if rest else 0, rest)):
                    if n:
                        slots.append((length, rank, rank + n * k, nxt, k))
                        put(capacity - k * length, nxt, n)
                        rank += n * k
                        nxt += n
                left = 0
                break
            space = rooms[at]
            start, n = room[space].pop()
            if not room[space]:
                del room[space]
                rooms.pop(at)
            each = space // length
            full = min(n, left // each)
            if full:
                slots.append((length, rank, rank + full * each, start, each))
                put(space - each * length, start, full)
                rank += full * each
                left -= full * each
            rest = min(left, each) if full < n else 0
            if rest:
                slots.append((length, rank, rank + rest, start + full, rest))
                put(space - rest * length, start + full, 1)
                rank += rest
                left -= rest
            used = full + (1 if rest else 0)
            put(space, start + used, n - used)
    return slots, nxt


def pack(sizes: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, part, start, n_tokens, container) from (doc_id, n_tokens): which tokens of an item go where.

    An item within the capacity is one part and never cut; a longer one fills containers of its own from its start on
    and its rest is placed like an item. Items without tokens take no slot; null sizes are left out; of repeated ids
    each row is an item. Containers are numbered from 0, those of whole parts last.
    """
    spark = sizes.sparkSession
    sizes = cut(sizes.where(F.col("n_tokens") > 0).select("doc_id", "n_tokens", F.monotonically_increasing_id().alias("__row")))
    salts = 4 * shuffle_width(spark)
    rest = sizes.withColumn("length", F.pmod("n_tokens", F.lit(capacity))).where("length > 0").withColumn("salt", F.pmod(F.xxhash64("doc_id", "__row"), F.lit(salts)))
    by_salt = cut(rest.groupBy("length", "salt").agg(F.count("*").alias("n")))
    histogram = {r[0]: r[1] for r in by_salt.groupBy("length").agg(F.sum("n")).collect()}  # at most `capacity` rows
    slots, used = plan(histogram, capacity)
    before = by_salt.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = rest.withColumn("r", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "__row")) - 1).join(F.broadcast(before) if len(histogram) * salts <= 500_000 else before, ["length", "salt"]).withColumn("rank", F.col("r") + F.col("before"))
    # a length's slots are in order of rank: one sorted key for all of them, searched by halves
    slot = np.array(sorted((s[0], s[1], s[3], s[4]) for s in slots) or [(0, 0, 0, 1)], np.int64)
    begin = slot[:, 0] << 44 | slot[:, 1]

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column(3).to_numpy().astype(np.int64), b.column(4).to_numpy()
            k = np.searchsorted(begin, length << 44 | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(slot[k, 2] + (rank - slot[k, 1]) // slot[k, 3])], names=["doc_id", "part", "start", "n_tokens", "container"])

    placed = ranked.select("doc_id", F.floor(F.col("n_tokens") / capacity).cast("int").alias("part"), (F.col("n_tokens") - F.col("length")).cast("int").alias("start"), F.col("length").cast("int").alias("n_tokens"), F.col("rank").cast("long"))
    placed = placed.mapInArrow(take, f"doc_id {dict(sizes.dtypes)['doc_id']}, part int, start int, n_tokens int, container long")
    # whole parts of long items: a container each, numbered within salts
    long = sizes.where(F.col("n_tokens") >= capacity).withColumn("parts", F.floor(F.col("n_tokens") / capacity).cast("long")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "__row"), F.lit(salts)))
    totals = long.groupBy("salt").agg(F.sum("parts").alias("parts"))
    offset = totals.withColumn("before", F.coalesce(F.sum("parts").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("parts")  # one row per salt
    order = Window.partitionBy("salt").orderBy("doc_id", "__row")
    numbered = long.withColumn("own", F.sum("parts").over(order) - F.col("parts")).join(F.broadcast(offset), "salt")
    whole = numbered.select("doc_id", F.col("own"), F.col("before"), F.posexplode(F.sequence(F.lit(1).cast("long"), F.col("parts"))).alias("part", "x")).select("doc_id", "part", (F.col("part") * capacity).cast("int").alias("start"), F.lit(capacity).cast("int").alias("n_tokens"), (F.lit(used) + F.col("before") + F.col("own") + F.col("part")).cast("long").alias("container"))
    return placed.unionByName(whole)
