"""A true edit metric over many string pairs at once, and searches that prune by the triangle inequality.

Levenshtein distance (a metric) is computed bit-parallel for whole arrays of pairs: one 64-bit word per pair holds a
column of the dynamic programme, so a pair costs a few vector operations per letter. Strings above 64 letters go
through a plain programme. The optimal-string-alignment count (one swap of neighbours is one edit) serves only as a
check after a metric search: it lies between half the metric and the metric. The unrestricted Damerau-Levenshtein
distance counts a swap as one edit and is a metric still, so that cells cut by it need the smallest radius.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

WORD = 64
CHUNK = 1 << 17


class Strings:
    """Strings as a matrix of letter codes (0 = past the end) with their lengths; letters share one code table."""

    def __init__(self, values: Sequence[str], table: dict[str, int] | None = None):
        self.values = list(values)
        self.table = {} if table is None else table
        self.len = np.fromiter((len(v) for v in self.values), np.int64, len(self.values))
        width = int(self.len.max()) if len(self.values) else 0
        self.codes = np.zeros((len(self.values), max(1, width)), np.int32)
        if self.values and width:
            flat = np.frombuffer("".join(self.values).encode("utf-32-le"), np.uint32)
            letters, inv = np.unique(flat, return_inverse=True)
            ids = np.array([self.table.setdefault(chr(c), len(self.table) + 1) for c in letters], np.int32)
            rows = np.repeat(np.arange(len(self.values)), self.len)
            cols = np.arange(len(flat)) - np.repeat(np.cumsum(self.len) - self.len, self.len)
            self.codes[rows, cols] = ids[inv]

    def masks(self) -> np.ndarray:
        """Per string and letter code the word of its positions (strings up to 64 letters)."""
        size = len(self.table) + 1
        out = np.zeros((len(self.values), size), np.uint64)
        for j in range(min(WORD, self.codes.shape[1])):
            c = self.codes[:, j]
            out[np.arange(len(c)), c] |= np.uint64(1) << np.uint64(j)
        out[:, 0] = 0
        return out


def _plain(a: str, b: str, swaps: bool) -> int:
    two, one = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(one[j] + 1, row[-1] + 1, one[j - 1] + (x != y))
            if swaps and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, two[j - 2] + 1)
            row.append(d)
        two, one = one, row
    return one[-1]


def distances(left: Strings, right: Strings, i: np.ndarray, j: np.ndarray, swaps: bool = False, masks: np.ndarray | None = None) -> np.ndarray:
    """Edit distance of left[i] and right[j], pair by pair. Both must share one code table; `swaps` counts a swap as one."""
    out = np.zeros(len(i), np.int64)
    if not len(i):
        return out
    masks = left.masks() if masks is None else masks
    long = (left.len[i] > WORD) | (left.len[i] == 0)
    for k in np.flatnonzero(long):
        out[k] = _plain(left.values[i[k]], right.values[j[k]], swaps)
    todo = np.flatnonzero(~long)
    one = np.uint64(1)
    for lo in range(0, len(todo), CHUNK):
        at = todo[lo : lo + CHUNK]
        a, b = i[at], j[at]
        m = left.len[a]
        top = one << (m - 1).astype(np.uint64)
        pv = np.full(len(at), ~np.uint64(0))
        mv = np.zeros(len(at), np.uint64)
        score = m.copy()
        d0 = np.zeros(len(at), np.uint64)
        eq_old = np.zeros(len(at), np.uint64)
        n = right.len[b]
        for col in range(int(n.max()) if len(n) else 0):
            live = col < n
            eq = masks[a, right.codes[b, np.minimum(col, right.codes.shape[1] - 1)]]
            tr = ((~d0 & eq) << one) & eq_old if swaps else np.uint64(0)
            d0 = ((((eq & pv) + pv) ^ pv) | eq | mv | tr)
            ph, mh = mv | ~(d0 | pv), pv & d0
            score = score + np.where(live, ((ph & top) != 0).astype(np.int64) - ((mh & top) != 0).astype(np.int64), 0)
            ph, mh = (ph << one) | one, mh << one
            pv, mv = mh | ~(d0 | ph), ph & d0
            eq_old = eq
        out[at] = score
    return out


def damerau(texts: Strings, pivot: np.ndarray, step: int = 2048) -> np.ndarray:
    """Damerau-Levenshtein distance (a metric) of every text to one string, given by the codes of its letters."""
    out = np.zeros(len(texts.values), np.int64)
    m = len(pivot)
    for lo in range(0, len(out), step):
        codes, size = texts.codes[lo : lo + step], texts.len[lo : lo + step]
        n, width = len(size), int(size.max())
        far = np.int16(m + width + 1)
        # cost[i, j]: first i - 1 letters of the pivot against the first j - 1 of each text; row and column 0 are walls
        cost = np.full((m + 2, width + 2, n), far, np.int16)
        cost[1, 1:] = np.arange(width + 1, dtype=np.int16)[:, None]
        cost[1:, 1] = np.arange(m + 1, dtype=np.int16)[:, None]
        seen = np.zeros(len(texts.table) + 2, np.int64)  # last row of each letter of the pivot
        for i, letter in enumerate(pivot.tolist(), 1):
            met = np.zeros(n, np.int64)  # last column of this letter in each text
            for j in range(1, width + 1):
                x = codes[:, j - 1]
                same = x == letter
                v = np.minimum(cost[i, j] + ~same, np.minimum(cost[i + 1, j], cost[i, j + 1]) + np.int16(1))
                row = seen[x]
                at = np.flatnonzero((row > 0) & (met > 0))
                if len(at):
                    r, c = row[at], met[at]
                    v[at] = np.minimum(v[at], cost[r, c, at] + (i - r) + (j - c) - 1)
                cost[i + 1, j + 1] = v
                met[same] = j
            seen[letter] = i
        out[lo : lo + step] = cost[m + 1, size + 1, np.arange(n)]
    return out


class BKTree:
    """Burkhard-Keller tree over reference strings; answers whole arrays of queries level by level."""

    def __init__(self, values: Sequence[str]):
        self.refs = Strings(values)
        n = len(self.refs.values)
        self.parent, self.edge = np.full(n, -1), np.zeros(n, np.int64)
        children: list[dict[int, int]] = [{} for _ in range(n)]
        # insert level by level: every entry walks down until it finds a free edge
        pending, node = np.arange(1, n), np.zeros(max(0, n - 1), np.int64)
        masks = self.refs.masks()
        while len(pending):
            d = distances(self.refs, self.refs, pending, node, masks=masks)
            rest, at = [], []
            for e, p, k in zip(pending.tolist(), node.tolist(), d.tolist()):
                if k in children[p]:
                    rest.append(e)
                    at.append(children[p][k])
                else:
                    children[p][k] = e
            pending, node = np.array(rest, np.int64), np.array(at, np.int64)
        self.start = np.zeros(n + 1, np.int64)
        self.kids, self.kid_edge = [], []
        for p in range(n):
            for k, e in sorted(children[p].items()):
                self.kids.append(e)
                self.kid_edge.append(k)
            self.start[p + 1] = len(self.kids)
        self.kids, self.kid_edge = np.array(self.kids, np.int64), np.array(self.kid_edge, np.int64)
        self.visited = 0

    def within(self, queries: Sequence[str], radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, entry, distance) of every entry within `radius` of each query."""
        q = Strings(queries, self.refs.table)
        masks = q.masks()
        i = np.arange(len(q.values)) if len(self.refs.values) else np.zeros(0, np.int64)
        node = np.zeros(len(i), np.int64)
        found = []
        while len(i):
            d = distances(q, self.refs, i, node, masks=masks)
            self.visited += len(i)
            hit = d <= radius
            found.append((i[hit], node[hit], d[hit]))
            size = self.start[node + 1] - self.start[node]
            who = np.repeat(np.arange(len(i)), size)
            kid = np.arange(len(who)) - np.repeat(np.cumsum(size) - size, size) + self.start[node][who]
            ok = np.abs(self.kid_edge[kid] - d[who]) <= radius
            i, node = i[who[ok]], self.kids[kid[ok]]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found))


def pairs_within(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs i < j inside consecutive groups of the given sizes."""
    start = np.cumsum(sizes) - sizes
    pos = np.arange(int(sizes.sum())) - np.repeat(start, sizes)
    end = np.repeat(start + sizes, sizes)
    reps = end - (np.arange(len(pos)) + 1)
    i = np.repeat(np.arange(len(pos)), reps)
    j = np.arange(len(i)) - np.repeat(np.cumsum(reps) - reps, reps) + i + 1
    return i, j
