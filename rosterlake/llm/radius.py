"""Radius join under a true edit metric by metric-space partitioning.

A block of many strings is cut into cells: a string is at home with its nearest pivot and is replicated to the cell of
every later pivot that is at most twice the radius farther away and whose home strings it can reach (both by the
triangle inequality). Each pair within the radius then meets in exactly one cell, the later home of the two. Cells that
are still large are cut again by pivots of their own; replication is counted, and a cell that pivots cannot cut within
the bound goes to an exact join on deletion neighbourhoods instead. Exact joins run inside the cells. The metric is the
Damerau-Levenshtein distance, in which a swap counts one, so that the radius is the number of edits allowed.

Pivots are drawn and used where their cell lies: nothing is collected, and no task holds more than the pivots of one
cell and a share of its strings.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.metric import Strings, damerau, distances
from rosterlake.session import cut, shuffle_width

#: Cells up to this many strings are joined as they are.
CELL_ROWS = 4096
#: Pivots of a cell, strings they are chosen from, and strings of a cell that one task measures.
PIVOTS, CANDIDATES, TASK_ROWS = 32, 256, 2_000
#: Most levels of pivots, and mean number of cells of a string beyond which cells are keyed by deletions instead.
LEVELS, REPLICATION = 3, 8.0
#: Pairs compared at once in a task.
AT_ONCE = 1 << 20

#: The radius of each string by its length: a pair is within the smaller of both.
Radius = Callable[[np.ndarray], np.ndarray]


def runs(b: pd.DataFrame, keys: list[str]) -> Iterator[tuple[tuple, int, int]]:
    """(key, from, to) of the runs of equal keys."""
    if not len(b):
        return
    cols = [b[k].to_numpy() for k in keys]
    new = np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in cols])]
    at = [*np.flatnonzero(new).tolist(), len(b)]
    for lo, hi in zip(at[:-1], at[1:]):
        yield tuple(c[lo] for c in cols), lo, hi


def choose(values: list[str], most: int = PIVOTS) -> list[str]:
    """Pivots far from each other, the one with the fewest strings nearest to it first: replicas go to later pivots,
    so the largest cells come last and send out none."""
    s = Strings(values)
    every = np.arange(len(values))
    taken, near = [0], distances(s, s, every, np.zeros(len(values), np.int64), swaps=True)
    home = np.zeros(len(values), np.int64)
    while len(taken) < most and near.max() > 0:
        p = int(near.argmax())
        d = distances(s, s, every, np.full(len(values), p), swaps=True)
        home = np.where(d < near, len(taken), home)
        near = np.minimum(near, d)
        taken.append(p)
    order = np.argsort(np.bincount(home, minlength=len(taken)), kind="stable")
    return [values[taken[k]] for k in order]


def _pivots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for g in grouped(batches, ["block", "cell"], 4 * CANDIDATES):
        rows = [(*key, choose(g["s"].iloc[lo:hi].tolist())) for key, lo, hi in runs(g, ["block", "cell"])]
        yield pd.DataFrame(rows, columns=["block", "cell", "pivots"])


def _assign(radius: Radius) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, pivots = None, []
        for b in batches:
            for key, lo, hi in runs(b, ["block", "cell", "salt"]):
                if key != now:
                    now, pivots = key, []
                part = b.iloc[lo:hi]
                if part["s"].iloc[0] is None:
                    pivots, part = list(part["pivots"].iloc[0]), part.iloc[1:]
                if not len(part):
                    continue
                s = Strings(part["s"].tolist())
                of = Strings(pivots or [""], s.table)
                d = np.stack([damerau(s, of.codes[k, : of.len[k]]) for k in range(len(of.values))], 1)
                home, near, r = d.argmin(1), d.min(1), radius(s.len)
                row, sub = np.nonzero((d <= (near + 2 * r)[:, None]) & (np.arange(d.shape[1])[None, :] >= home[:, None]))
                out = part.iloc[row][["block", "cell", "s", "away", "copies"]].reset_index(drop=True)
                yield out.assign(sub=sub, replica=sub != home[row], d=d[row, sub], r=r[row])

    return run


def _keys(radius: Radius) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Each string under all that is left of it after as many deletions as its radius: strings within the radius of
    each other share one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            size = radius(np.fromiter((len(s) for s in b["s"]), np.int64, len(b)))
            rows, keys = [], []
            for k, (s, r) in enumerate(zip(b["s"], size)):
                left = {s}
                for _ in range(int(r)):
                    left |= {x[:i] + x[i + 1 :] for x in left for i in range(len(x))}
                rows += [k] * len(left)
                keys += left
            yield b.iloc[rows].reset_index(drop=True).assign(key=keys)

    return run


def cells(strings: DataFrame, radius: Radius, cell_rows: int = CELL_ROWS, levels: int = LEVELS, most: float = REPLICATION) -> DataFrame:
    """(block, s, cell, away, copies) of distinct (block, s): the cells of each string.

    `away` has a bit for each level at which the string is a replica; a pair belongs to the cell in which at every
    level one of the two is at home, so that it is found once (in cells keyed by deletions possibly several times).
    `copies` is the mean number of cells that the strings of the cell have got by pivots. Null strings are left out.
    """
    width = shuffle_width(strings.sparkSession)
    at = ["block", "cell"]
    state = strings.where("s is not null").select("block", "s", F.lit(0).cast("long").alias("cell"), F.lit(0).cast("int").alias("away"), F.lit(1.0).alias("copies"))
    done: list[DataFrame] = []
    keyed: list[DataFrame] = []
    for level in range(levels + 1):
        state = cut(state)
        large = cut(state.groupBy(*at).agg(F.count("*").alias("n")).where(F.col("n") > cell_rows))
        if not large.limit(1).count():
            done.append(state)
            break
        done.append(state.join(large, at, "left_anti"))
        full = state.join(large, at)
        if level == levels:
            keyed.append(full.drop("n"))
            break
        salts = F.ceil(F.col("n") / TASK_ROWS)
        drawn = full.where(F.pmod(F.xxhash64("s", F.lit(level)), F.greatest(F.lit(1), F.floor(F.col("n") / CANDIDATES))) == 0)
        pivots = drawn.select(*at, "s").repartition(width, *at).sortWithinPartitions(*at, "s").mapInPandas(_pivots, "block string, cell long, pivots array<string>")
        lead = pivots.join(large, at).select(*at, F.explode(F.sequence(F.lit(0).cast("long"), salts - 1)).alias("salt"), F.lit(None).cast("string").alias("s"), F.lit(0).alias("away"), F.lit(1.0).alias("copies"), "pivots")
        rows = full.select(*at, F.pmod(F.xxhash64("s"), salts).alias("salt"), "s", "away", "copies", F.lit(None).cast("array<string>").alias("pivots"))
        placed = lead.unionByName(rows).repartition(width, *at, "salt").sortWithinPartitions(*at, "salt", F.asc_nulls_first("s"))
        split = cut(placed.mapInPandas(_assign(radius), "block string, cell long, s string, away int, copies double, sub int, replica boolean, d long, r long"))
        reach = split.where("not replica").groupBy(*at, "sub").agg(F.max("d").alias("reach"))
        kept = split.join(reach, [*at, "sub"]).where("d <= reach + r")
        size = kept.groupBy(*at, "sub").agg(F.count("*").alias("m")).groupBy(*at).agg(F.sum("m").alias("all"), F.max("m").alias("top"))
        fits = cut(size.join(large, at).where((F.col("top") <= 0.9 * F.col("n"))).select(*at, (F.col("all") / F.col("n")).alias("more")))
        good = kept.join(fits, at).where(F.col("copies") * F.col("more") <= most)
        keyed.append(full.drop("n").join(fits, at, "left").where(F.col("more").isNull() | (F.col("copies") * F.col("more") > most)).drop("more"))
        away = F.col("away").bitwiseOR(F.when(F.col("replica"), 1 << level).otherwise(0))
        state = good.select("block", "s", F.xxhash64("cell", "sub").alias("cell"), away.alias("away"), (F.col("copies") * F.col("more")).alias("copies"))
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    for x in keyed:
        spread = x.mapInPandas(_keys(radius), "block string, s string, cell long, away int, copies double, key string")
        out = out.unionByName(spread.select("block", "s", F.xxhash64("cell", "key").alias("cell"), "away", "copies"))
    return out


def grouped(batches: Iterator[pd.DataFrame], keys: list[str], most: int) -> Iterator[pd.DataFrame]:
    """Rows sorted by `keys`, regathered so that no group is cut; several groups come together up to `most` rows."""
    held: list[pd.DataFrame] = []
    rows = 0
    for b in batches:
        if not len(b):
            continue
        if rows >= most:
            last = held[-1].iloc[-1]
            first = int(np.logical_and.reduce([(b[k] == last[k]).to_numpy() for k in keys]).sum())
            if first < len(b):  # the group that was open ends in this batch
                yield pd.concat([*held, b.iloc[:first]], ignore_index=True)
                held, rows = [], 0
                b = b.iloc[first:]
        held.append(b)
        rows += len(b)
    if rows:
        yield pd.concat(held, ignore_index=True)


class Rows:
    """Rows of some whole cells; the letters of a string column are read once for all comparisons."""

    def __init__(self, rows: pd.DataFrame):
        self.rows = rows
        self._columns: dict[str, np.ndarray] = {}
        self._read: dict[str, tuple] = {}

    def __getitem__(self, c: str) -> np.ndarray:
        if c not in self._columns:
            self._columns[c] = self.rows[c].to_numpy()
        return self._columns[c]

    def sets(self, c: str) -> list[frozenset]:
        """The words of a column, joined by |, as sets."""
        if c not in self._read:
            code, uniq = pd.factorize(self.rows[c])
            each = [frozenset(x.split("|")) for x in uniq]
            self._read[c] = ([each[k] for k in code],)
        return self._read[c][0]

    def edits(self, c: str, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
        """Edits (a swap is one) of the strings at i and j, radius + 1 where lengths or letters already rule them out."""
        if c not in self._read:
            code, uniq = pd.factorize(self.rows[c])
            s = Strings(uniq.tolist())
            bits = np.zeros(len(uniq), np.uint64)
            for k in range(s.codes.shape[1]):
                x = s.codes[:, k]
                bits |= np.where(x > 0, np.uint64(1) << (x % 64).astype(np.uint64), np.uint64(0))
            self._read[c] = (code, s, s.masks(), bits)
        code, s, masks, bits = self._read[c]
        a, b = code[i], code[j]
        out = np.where(a == b, 0, radius + 1)
        near = np.flatnonzero((a != b) & (np.abs(s.len[a] - s.len[b]) <= radius) & (np.bitwise_count(bits[a] ^ bits[b]) <= 2 * radius))
        out[near] = distances(s, s, a[near], b[near], swaps=True, masks=masks)
        return out


def cell_join(members: DataFrame, keys: list[str], cols: list[str], column: str, slack: int, compare: Callable[[Rows, np.ndarray, np.ndarray], np.ndarray], out: str, emit: Callable[[Rows, np.ndarray, np.ndarray], pd.DataFrame]) -> DataFrame:
    """Exact join inside cells: the pairs that belong to a cell and differ in the length of `column` by at most `slack`
    go through `compare` in chunks."""
    placed = members.select(*keys, *cols, "away").repartition(shuffle_width(members.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in grouped(batches, keys, 20_000):
            code = np.zeros(len(g), np.int64)
            for n, (_, lo, hi) in enumerate(runs(g, keys)):
                code[lo:hi] = n
            order = code * (1 << 20) + g[column].str.len().to_numpy()
            o = np.argsort(order, kind="stable")
            order, rows = order[o], Rows(g.iloc[o].reset_index(drop=True))
            away = rows["away"]
            reps = np.searchsorted(order, order + slack, "right") - np.arange(len(g)) - 1
            total = np.cumsum(reps)
            lo = 0
            while lo < len(g):
                hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
                n = reps[lo:hi]
                i = np.repeat(np.arange(lo, hi), n)
                j = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n) + i + 1
                lo = hi
                ok = (away[i] & away[j]) == 0
                i, j = i[ok], j[ok]
                if len(i):
                    keep = compare(rows, i, j)
                    if keep.any():
                        yield emit(rows, i[keep], j[keep])

    return placed.mapInPandas(run, out)
