"""Items that appear together far more often than chance: stripes with log-likelihood ratio.

Each task folds its baskets into stripes - per item the array of its neighbours and their counts, cut into pieces by a
salt of the neighbour - before anything is shuffled. Stripes meet by (item, salt), where their arrays are merged by
key: a hot item's stripe is never gathered in one task, and only neighbours that reach the support leave it. Items
below the support cannot be in a case and leave the baskets first. A basket of very many items is cut into blocks, and
each pair of blocks is a unit of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.session import cut, shuffle_width

#: Least number of common baskets, and least ratio of the common baskets to those expected by chance.
SUPPORT, LIFT = 5, 3
#: Pairs or stripe entries a task holds before it folds them.
AT_ONCE = 4_000_000
#: Pieces of a stripe, and items of a basket above which it is cut into blocks of that many.
SALTS, BASKET_ROWS = 16, 2048


def baskets_of(alumni: DataFrame, skills: DataFrame) -> DataFrame:
    """(basket, item), distinct: companies, titles and skills of each person of alumni, trimmed and in lower case."""
    def items(df: DataFrame, kind: str, col: str) -> DataFrame:
        v = F.lower(F.trim(F.col(col)))
        return df.where(F.col("person_id").isNotNull() & F.col(col).isNotNull() & (v != "") & (v != "-")).select(F.col("person_id").alias("basket"), F.concat(F.lit(f"{kind}:"), v).alias("item"))

    mine = alumni.select("person_id", "normalized_company", "normalized_title")
    known = skills.select("person_id", "skill").join(alumni.select("person_id").distinct(), "person_id", "left_semi")
    return items(mine, "company", "normalized_company").unionByName(items(mine, "title", "normalized_title")).unionByName(items(known, "skill", "skill")).distinct()


def units_of(coded: DataFrame, basket_rows: int = BASKET_ROWS) -> DataFrame:
    """(these, those) of (basket, id): each pair of a basket's items comes up once, within `these` where `those` is
    empty, else between both. Only baskets above `basket_rows` are cut into blocks."""
    hot = cut(coded.groupBy("basket").agg(F.count("*").alias("n")).where(F.col("n") > basket_rows).withColumn("blocks", F.ceil(F.col("n") / basket_rows).cast("int")).drop("n"))
    listed = lambda df: df.groupBy("basket").agg(F.sort_array(F.collect_list("id")).alias("these")).where(F.size("these") > 1).select("these", F.array().cast("array<long>").alias("those"))
    if not hot.limit(1).count():
        return listed(coded)
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    cut_up = coded.join(hot, "basket").withColumn("block", block).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    unit = ["basket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi")]
    first = F.when(F.col("block") <= F.col("other"), F.col("id"))
    second = F.when(F.col("block") > F.col("other"), F.col("id"))
    pieces = cut_up.groupBy(*unit).agg(F.sort_array(F.collect_list(first)).alias("these"), F.sort_array(F.collect_list(second)).alias("those"))
    alone = pieces.where("lo = hi and size(these) > 1").select("these", "those")
    across = pieces.where("lo < hi and size(these) > 0 and size(those) > 0").select("these", "those")
    return listed(coded.join(hot, "basket", "left_anti")).unionByName(alone).unionByName(across)


_STRIPES = pa.schema([("item", pa.int64()), ("salt", pa.int64()), ("others", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64()))])


def _striped(x: np.ndarray, y: np.ndarray, n: np.ndarray, salts: int) -> Iterator[pa.RecordBatch]:
    """Stripes of pairs (x, y) with their counts, distinct and in order of x."""
    salt = ((y * 0x9E3779B1) >> 7) % salts
    o = np.lexsort((y, salt, x))
    x, y, n, salt = x[o], y[o], n[o], salt[o]
    first = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (salt[1:] != salt[:-1])])
    off = pa.array(np.r_[first, len(x)].astype(np.int32))
    batch = pa.RecordBatch.from_arrays([pa.array(x[first]), pa.array(salt[first]), pa.ListArray.from_arrays(off, pa.array(y)), pa.ListArray.from_arrays(off, pa.array(n))], schema=_STRIPES)
    for lo in range(0, len(first), 50_000):
        yield batch.slice(lo, 50_000)


def stripes(units: DataFrame, salts: int = SALTS) -> DataFrame:
    """(item, salt, others, counts): per task and item the neighbours that have a higher number and their common baskets."""

    def fold(a: list[np.ndarray], b: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        x, y = np.concatenate(a), np.concatenate(b)
        x, y = np.minimum(x, y), np.maximum(x, y)
        o = np.lexsort((y, x))
        x, y = x[o], y[o]
        at = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        yield from _striped(x[at], y[at], np.diff(np.r_[at, len(x)]), salts)

    def expand(flat: np.ndarray, reps: np.ndarray, begin: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Each element of `flat` with `reps` of `other` from `begin` on, in bounded pieces."""
        total, lo = np.cumsum(reps), 0
        while lo < len(flat):
            hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
            n = reps[lo:hi]
            i = np.repeat(np.arange(lo, hi), n)
            j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + begin[i]
            yield flat[i], other[j]
            lo = hi

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a: list[np.ndarray] = []
        b: list[np.ndarray] = []
        held = 0
        for batch in batches:
            (off, flat), (off2, flat2) = ((c.offsets.to_numpy().astype(np.int64) - c.offsets[0].as_py(), c.flatten().to_numpy(zero_copy_only=False)) for c in batch.columns)
            size, size2 = np.diff(off), np.diff(off2)
            row = np.repeat(np.arange(len(size)), size)
            alone = size2[row] == 0
            at = np.arange(len(flat))
            reps = np.where(alone, off[row + 1] - at - 1, size2[row])
            for which, begin, other in ((alone, at + 1, flat), (~alone, off2[row], flat2)):
                for x, y in expand(flat[which], reps[which], begin[which], other):
                    a.append(x)
                    b.append(y)
                    held += len(x)
                    if held >= AT_ONCE:
                        yield from fold(a, b)
                        a, b, held = [], [], 0
        if held:
            yield from fold(a, b)

    return units.select("these", "those").mapInArrow(run, "item long, salt long, others array<long>, counts array<long>")


def merged(striped: DataFrame, support: int) -> DataFrame:
    """(item, salt, others, counts): one stripe for each item and salt, of the neighbours with at least `support`."""

    def fold(held: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
        """Entries (item, salt, neighbour, count) in order, equal ones added up."""
        item, salt, x, n = (np.concatenate([h[k] for h in held]) for k in range(4))
        o = np.lexsort((x, salt, item))
        item, salt, x, n = item[o], salt[o], x[o], n[o]
        at = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (x[1:] != x[:-1])])
        return item[at], salt[at], x[at], np.add.reduceat(n, at)

    def stripes_from(item: np.ndarray, salt: np.ndarray, x: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = n >= support
        if keep.any():
            item, salt, x, n = item[keep], salt[keep], x[keep], n[keep]
            first = np.flatnonzero(np.r_[True, (item[1:] != item[:-1]) | (salt[1:] != salt[:-1])])
            off = pa.array(np.r_[first, len(x)].astype(np.int32))
            yield pa.RecordBatch.from_arrays([pa.array(item[first]), pa.array(salt[first]), pa.ListArray.from_arrays(off, pa.array(x)), pa.ListArray.from_arrays(off, pa.array(n))], schema=_STRIPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        size = 0
        for b in batches:
            off = b.column(2).offsets.to_numpy()
            x, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (2, 3))
            item, salt = (np.repeat(b.column(k).to_numpy(), np.diff(off)) for k in (0, 1))
            if len(x):
                held.append((item, salt, x, n))
                size += len(x)
            if size > AT_ONCE:  # all but the open stripe are whole; that one shrinks to its distinct neighbours
                item, salt, x, n = fold(held)
                whole = int(np.argmax((item == held[-1][0][-1]) & (salt == held[-1][1][-1])))
                yield from stripes_from(item[:whole], salt[:whole], x[:whole], n[:whole])
                held, size = [(item[whole:], salt[whole:], x[whole:], n[whole:])], len(x) - whole
        if held:
            yield from stripes_from(*fold(held))

    placed = striped.repartition(shuffle_width(striped.sparkSession), "item", "salt").sortWithinPartitions("item", "salt")
    return placed.mapInArrow(run, "item long, salt long, others array<long>, counts array<long>")


def pairs_together(baskets: DataFrame, total: int, support: int = SUPPORT, lift: float = LIFT, basket_rows: int = BASKET_ROWS) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, lift, llr) of the pairs with n_ab >= support and n_ab * total >= lift * n_a * n_b.

    `baskets`: distinct (basket, item); `total`: number of baskets, also those without items. llr is the
    log-likelihood ratio of the pair's two-by-two table. Null items must have been left out; no rows give none.
    """
    baskets = cut(baskets)
    # items are numbered in the written table of counts and travel as numbers
    counts = cut(baskets.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= support).withColumn("id", F.monotonically_increasing_id()))
    coded = baskets.join(counts.select("item", "id"), "item").select("basket", "id")
    found = merged(stripes(units_of(coded, basket_rows)), support)
    pairs = found.select("item", F.explode(F.arrays_zip("others", "counts")).alias("z")).select("item", F.col("z.others").alias("other"), F.col("z.counts").alias("n_ab"))
    a = counts.select(F.col("id").alias("item"), F.col("item").alias("x"), F.col("n").alias("nx"))
    b = counts.select(F.col("id").alias("other"), F.col("item").alias("y"), F.col("n").alias("ny"))
    full = pairs.join(a, "item").join(b, "other").where(F.col("n_ab") * F.lit(total) >= F.lit(lift) * F.col("nx") * F.col("ny"))
    swap = F.col("x") > F.col("y")
    full = full.select(F.least("x", "y").alias("item_a"), F.greatest("x", "y").alias("item_b"), F.when(swap, F.col("ny")).otherwise(F.col("nx")).alias("n_a"), F.when(swap, F.col("nx")).otherwise(F.col("ny")).alias("n_b"), "n_ab")
    n = F.lit(float(total))
    cell = lambda k, row, col: F.when(k > 0, k * F.log(k * n / (row * col))).otherwise(0.0)
    na, nb, k = F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("n_ab").cast("double")
    llr = 2 * (cell(k, na, nb) + cell(na - k, na, n - nb) + cell(nb - k, n - na, nb) + cell(n - na - nb + k, n - na, n - nb))
    return full.withColumn("lift", k * n / (na * nb)).withColumn("llr", llr)


def alumni_pairs(alumni: DataFrame, skills: DataFrame) -> DataFrame:
    return pairs_together(baskets_of(alumni, skills), alumni.count())
