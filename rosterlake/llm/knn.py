"""Most similar vectors for every vector: additive quantisation, lookup-table scoring, exact reranking.

Full-dimensional codebooks are fitted on a bounded sample: a coarse one and, above FLAT lists, a fine one of its
residuals, whose sums name the lists in which vectors are searched, so that lists grow in number with the vectors and
not in length; then residual ones. Every vector is encoded by beam search over the residual codebooks and stored with
the norm of its reconstruction. A query visits its own list and those whose entry is almost as close; inside a list
lookup tables (one product of the query with each codebook) score all codes, and the best are reranked by exact
products. The lists of one coarse entry lie in one bucket, to which a vector is sent once: at home it is base and query
in one row, elsewhere a query with the names of the lists it visits. So what is shuffled follows the coarse entries near
a vector and not the lists. Lists longer than a block are split, exact copies are folded before they are shuffled.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rosterlake.session import shuffle_width

#: Most vectors of an aspect that codebooks are fitted on (drawn by hash of the id); all vectors are encoded.
SAMPLE = 16_000
#: An aspect with fewer vectors than this in the sample is drawn anew from all vectors.
LEAST_DRAWN = 256
#: Vectors per list aimed at, lists named by the coarse codebook alone, most entries of the fine one (lists are at most
#: the product: 4,194,304, of LIST_ROWS up to 671 million vectors an aspect), residual codebooks and their entries, width
#: of the beam.
LIST_ROWS, FLAT, FINE, STAGES, ENTRIES, BEAM = 160, 1024, 4096, 4, 64, 4
#: A query visits every list whose entry is within MARGIN of the closest by cosine, at most PROBES.
MARGIN, PROBES = 0.045, 8
#: The same where lists are named by two codebooks, whose sums fit the vectors less well.
FINE_MARGIN, FINE_PROBES = 0.08, 24
#: Candidates of a list that are reranked, base vectors of one block, queries scored at once.
RERANK, BLOCK, CHUNK = 64, 4096, 256
#: Share (one in so many ids) by which the lengths of lists are estimated, which only say where a list is split; most
#: lists that may be split.
COUNTED, MOST_SPLIT = 16, 100_000
#: Vectors aimed at in one bucket, for a task holds it whole: the lists of a coarse entry with more lie in several.
BUCKET_ROWS = 32_768


@dataclass
class Codebooks:
    dim: int
    coarse: np.ndarray  # entries x dim
    fine: np.ndarray  # entries x dim, of the residuals of `coarse`; a single zero where lists are few
    stages: list[np.ndarray]  # each entries x dim
    split: dict[int, int]  # blocks of each list that has more than one
    rerank: int = RERANK
    parts: np.ndarray | None = None  # buckets of the lists of each coarse entry, where any has more than one

    def blocks(self, lists: np.ndarray) -> np.ndarray:
        return np.fromiter((self.split.get(x, 1) for x in lists.tolist()), np.int64, len(lists)) if self.split else np.ones(len(lists), np.int64)

    def bucket(self, lists: np.ndarray, block: np.ndarray) -> np.ndarray:
        """Where lists lie: together with others of their coarse entry, under the first of them; split ones by block."""
        entry, at = np.divmod(lists.astype(np.int64), len(self.fine))
        parts = np.ones(1, np.int64) if self.parts is None else self.parts[entry]
        first = -(-(at * parts // len(self.fine)) * len(self.fine) // parts)
        return np.where(self.blocks(lists) > 1, (lists << 20) + 1 + block, (entry * len(self.fine) + first) << 20)

    @property
    def reach(self) -> tuple[float, int]:
        return (MARGIN, PROBES) if len(self.fine) == 1 else (FINE_MARGIN, FINE_PROBES)

    def centre(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def lists(self, x: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
        """(list, closeness) of the `most` closest lists of each unit vector, the home first. Closeness is the product
        with the list's centre less half its squared norm: for unit centres, the cosine less a half."""
        sims = x @ self.coarse.T - 0.5 * (self.coarse**2).sum(1)
        at = np.arange(len(x))[:, None]
        top = min(most, len(self.coarse))
        first = np.argpartition(-sims, top - 1, axis=1)[:, :top] if top < len(self.coarse) else np.broadcast_to(np.arange(top), sims.shape)
        if len(self.fine) == 1:
            lists, near = first, sims[at, first]
        else:
            cross = self.coarse @ self.fine.T + 0.5 * (self.fine**2).sum(1)
            near = (sims[at, first][:, :, None] + (x @ self.fine.T)[:, None, :] - cross[first]).reshape(len(x), -1)
            lists = (first[:, :, None] * len(self.fine) + np.arange(len(self.fine))).reshape(len(x), -1)
            keep = np.argpartition(-near, most - 1, axis=1)[:, :most] if most < near.shape[1] else np.broadcast_to(np.arange(near.shape[1]), near.shape)
            lists, near = lists[at, keep], near[at, keep]
        o = np.argsort(-near, axis=1, kind="stable")
        return lists[at, o], near[at, o]


def _kmeans(x: np.ndarray, k: int, rounds: int, seed: int, unit: bool) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        a = (x @ c.T - 0.5 * (c * c).sum(1)).argmax(1)
        n = np.bincount(a, minlength=len(c)).astype(np.float32)
        order = np.argsort(a, kind="stable")
        at = np.flatnonzero(n)
        sums = np.add.reduceat(x[order], np.r_[0, np.cumsum(n)[:-1]].astype(int)[at], axis=0)
        c[at] = sums / n[at, None]
        if unit:
            c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def _side_by_side(c: np.ndarray) -> np.ndarray:
    """The entries in an order in which close ones are near each other: halved along their widest direction."""
    if len(c) < 3:
        return c
    o = np.argsort((c - c.mean(0)) @ np.linalg.svd(c - c.mean(0), full_matrices=False)[2][0], kind="stable")
    return np.concatenate([_side_by_side(c[o[: len(c) // 2]]), _side_by_side(c[o[len(c) // 2 :]])])


def fit(sample: np.ndarray, total: int, seed: int = 7, flat: int = FLAT) -> Codebooks:
    """Codebooks from unit vectors `sample`, for about `total` vectors; the number of lists follows `total`."""
    wanted = 2 ** round(np.log2(max(1, total / LIST_ROWS)))
    lists = int(np.clip(wanted, 1, min(flat, max(1, len(sample) // 4))))
    coarse = _kmeans(sample, lists, 6, seed, True)
    rest = sample - coarse[(sample @ coarse.T).argmax(1)]
    fine = np.zeros((1, sample.shape[1]), sample.dtype)
    if wanted > lists >= flat:
        fine = _side_by_side(_kmeans(rest, int(min(wanted // lists, FINE, max(1, len(sample) // 4))), 6, seed + 100, False))
    books = Codebooks(sample.shape[1], coarse, fine, [], {})
    rest = sample - books.centre(books.lists(sample, 1)[0][:, 0])
    for s in range(STAGES):
        c = _kmeans(rest, ENTRIES, 4, seed + s + 1, False)
        books.stages.append(c)
        rest = rest - c[(rest @ c.T - 0.5 * (c * c).sum(1)).argmax(1)]
    return books


def exact_books(dim: int, total: int) -> Codebooks:
    """One list of all vectors, every one of which is reranked: the exact search."""
    return Codebooks(dim, np.zeros((1, dim), np.float32), np.zeros((1, dim), np.float32), [np.zeros((1, dim), np.float32)] * STAGES, {0: max(1, -(-total // BLOCK))}, 1 << 30)


def encode(x: np.ndarray, home: np.ndarray, books: Codebooks) -> tuple[np.ndarray, np.ndarray]:
    """(codes n x stages, squared norm of the reconstruction): beam search over the residual codebooks."""
    n = len(x)
    made = books.centre(home)[:, None, :]
    codes = np.zeros((n, 1, 0), np.uint8)
    for c in books.stages:
        rest = x[:, None, :] - made
        cost = ((rest * rest).sum(2))[:, :, None] - 2 * (rest.reshape(-1, books.dim) @ c.T).reshape(n, -1, len(c)) + (c * c).sum(1)
        flat = cost.reshape(n, -1)
        keep = min(BEAM, flat.shape[1])
        best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
        beam, entry = best // len(c), best % len(c)
        made = np.take_along_axis(made, beam[:, :, None], 1) + c[entry]
        codes = np.concatenate([np.take_along_axis(codes, beam[:, :, None], 1), entry[:, :, None].astype(np.uint8)], 2)
    rest = x[:, None, :] - made
    pick = (rest * rest).sum(2).argmin(1)
    at = np.arange(n)
    return codes[at, pick], (made[at, pick] ** 2).sum(1)


def _floats(col: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a non-null list or binary column as an n x dim matrix."""
    if pa.types.is_binary(col.type):
        off = np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]
        return np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.float32).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.float32)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _place(vectors: DataFrame, books: dict[str, Codebooks], k: int) -> DataFrame:
    """Rows for the search: bucket, id, vec, kind (0 base, 1 query from elsewhere, 2 copy of a query), home (list of a
    base vector), lists (those of the bucket that the vector asks, as int32), codes, norm, lead. No vector is in a bucket twice."""
    names = sorted(books)
    fields = [("bucket", pa.int64()), ("id", pa.string()), ("vec", pa.binary()), ("kind", pa.int8()), ("home", pa.int64()), ("lists", pa.binary()), ("codes", pa.binary()), ("norm", pa.float32()), ("lead", pa.string())]

    def packed(flat: np.ndarray, off: np.ndarray) -> pa.Array:
        """Binary values: the items of `flat` from each offset to the next."""
        flat = np.ascontiguousarray(flat[off[0] : off[-1]])
        return pa.Array.from_buffers(pa.binary(), len(off) - 1, [None, pa.py_buffer(((off - off[0]) * flat.itemsize).astype(np.int32)), pa.py_buffer(flat)])

    def raw(m: np.ndarray) -> pa.Array:
        return packed(m.ravel(), np.arange(len(m) + 1) * m.shape[1])

    def rows(bucket, ids, kind, **more):
        known = {"bucket": pa.array(bucket, pa.int64()), "id": pa.array(ids, pa.string()), "kind": pa.array(np.full(len(ids), kind, np.int8))} | more
        return pa.RecordBatch.from_arrays([known[f] if f in known else pa.nulls(len(ids), t) for f, t in fields], names=[f for f, _ in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            aspects = b.column(0).to_pylist()
            for number, aspect in enumerate(names):
                at = np.array([i for i, a in enumerate(aspects) if a == aspect], np.int64)
                if not len(at):
                    continue
                book = books[aspect]
                part = b.take(pa.array(at))
                ids = np.array(part.column(1).to_pylist(), dtype=object)
                x = _floats(part.column(2), book.dim).astype(np.float32)
                order = np.argsort(ids)
                ids, x = ids[order], x[order]
                x = x / np.maximum(np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True), 1e-300).astype(np.float32)
                # exact copies: the first of a batch asks for all, and k + 1 of them suffice as answers
                _, first, inv = np.unique(np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * 4))).ravel(), return_index=True, return_inverse=True)
                inv = inv.ravel()
                leader = first[inv]
                rank = np.zeros(len(ids), np.int64)
                if len(first) < len(ids):
                    o = np.argsort(inv, kind="stable")
                    s = inv[o]
                    starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                    rank[o] = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
                margin, probes = book.reach
                top, score = book.lists(x, probes)
                home = top[:, 0].astype(np.int64)
                sub = book.blocks(home)
                for p in np.flatnonzero(sub > 1):
                    sub[p] = zlib.crc32(ids[p].encode()) % sub[p]
                own = (number << 44) + book.bucket(home, sub)
                # lists asked by the first of each set of copies, put together by bucket
                lead = np.flatnonzero(leader == np.arange(len(ids)))
                q, j = np.nonzero((score >= score[:, :1] - margin)[lead])
                q, cell = lead[q], top[lead][q, j].astype(np.int64)
                reps = book.blocks(cell)
                q, cell = np.repeat(q, reps), np.repeat(cell, reps)
                bucket = (number << 44) + book.bucket(cell, np.arange(len(q)) - np.repeat(np.cumsum(reps) - reps, reps))
                o = np.lexsort((bucket, bucket != own[q], q))  # the home bucket of each before its others
                q, cell, bucket = q[o], cell[o].astype(np.int32), bucket[o]
                starts = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (bucket[1:] != bucket[:-1])])
                q, bucket, ends = q[starts], bucket[starts], np.r_[starts[1:], len(cell)]
                begin, end = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
                here = np.flatnonzero(bucket == own[q])
                begin[q[here]], end[q[here]] = starts[here], ends[here]
                base = np.flatnonzero(rank <= k)
                for lo in range(0, len(base), 1024):
                    sl = base[lo : lo + 1024]
                    codes, norm = encode(x[sl], home[sl], book)
                    n = end[sl] - begin[sl]
                    off = np.r_[0, np.cumsum(n)]
                    asked = cell[np.arange(off[-1]) + np.repeat(begin[sl] - off[:-1], n)]
                    yield rows(own[sl], ids[sl], 0, vec=raw(x[sl]), home=pa.array(home[sl]), lists=packed(asked, off), codes=raw(codes), norm=pa.array(norm.astype(np.float32)))
                away = np.flatnonzero(bucket != own[q])
                for lo in range(0, len(away), 2048):
                    w = away[lo : lo + 2048]
                    off = np.r_[0, np.cumsum(ends[w] - starts[w])]
                    asked = cell[np.arange(off[-1]) + np.repeat(starts[w] - off[:-1], np.diff(off))]
                    yield rows(bucket[w], ids[q[w]], 1, vec=raw(x[q[w]]), lists=packed(asked, off))
                copies = np.flatnonzero(leader != np.arange(len(ids)))
                if len(copies):  # to the buckets of the first one
                    lo, hi = np.searchsorted(q, leader[copies]), np.searchsorted(q, leader[copies], "right")
                    w = np.repeat(copies, hi - lo)
                    to = bucket[np.arange(len(w)) + np.repeat(lo - np.r_[0, np.cumsum(hi - lo)[:-1]], hi - lo)]
                    for lo in range(0, len(w), 8192):
                        sl = w[lo : lo + 8192]
                        yield rows(to[lo : lo + 8192], ids[sl], 2, lead=pa.array(ids[leader[sl]], pa.string()))

    return vectors.mapInArrow(run, "bucket long, id string, vec binary, kind byte, home long, lists binary, codes binary, norm float, lead string")


def _search_list(q: np.ndarray, x: np.ndarray, codes: np.ndarray, norm: np.ndarray, own: np.ndarray, book: Codebooks, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(vector, cosine) of the best k + 1 of the list's vectors for each query, but for the one at `own`; -inf: none."""
    keep = min(book.rerank, len(x))
    if len(x) > keep:
        score = np.broadcast_to(-0.5 * norm, (len(q), len(x))).copy()
        for m, c in enumerate(book.stages):
            score += (q @ c.T)[:, codes[:, m]]
        best = np.argpartition(-score, keep - 1, axis=1)[:, :keep]
        exact = np.einsum("qd,qkd->qk", q, x[best], optimize=True)
    else:
        best = np.broadcast_to(np.arange(len(x)), (len(q), len(x)))
        exact = q @ x.T
    exact = np.where(best == own[:, None], -np.inf, exact)
    n = min(k + 1, exact.shape[1])
    pick = np.argpartition(-exact, n - 1, axis=1)[:, :n]
    return np.take_along_axis(best, pick, 1), np.take_along_axis(exact, pick, 1)


def _search_group(t: pa.Table, book: Codebooks, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query id, neighbour id, cosine) of the best k + 1 of the bucket's base vectors for each of its queries."""
    kind = t.column("kind").to_numpy()
    ids = t.column("id").to_numpy(zero_copy_only=False)
    full = np.flatnonzero(kind < 2)
    base = np.flatnonzero(kind == 0)
    if not len(base):
        return
    home = t.column("home").take(pa.array(base)).to_numpy()
    order = np.argsort(home, kind="stable")
    base, home = base[order], home[order]
    place = np.full(len(kind), -1, np.int64)  # of a row among the vectors of its list
    starts = np.flatnonzero(np.r_[True, home[1:] != home[:-1]])
    spans = dict(zip(home[starts].tolist(), zip(starts.tolist(), np.r_[starts[1:], len(home)].tolist())))
    place[base] = np.arange(len(base)) - np.repeat(starts, np.diff(np.r_[starts, len(home)]))
    codes = np.frombuffer(b"".join(t.column("codes").take(pa.array(base)).to_pylist()), np.uint8).reshape(len(base), -1)
    norm = t.column("norm").take(pa.array(base)).to_numpy()
    own_list = np.full(len(kind), -1, np.int64)
    own_list[base] = home
    asked = t.column("lists").take(pa.array(full)).to_pylist()
    who = np.repeat(full, [len(a) // 4 for a in asked])
    lists = np.frombuffer(b"".join(asked), np.int32)
    if not len(who):
        return
    vec = t.column("vec").take(pa.array(full)).combine_chunks()
    x = _floats(vec.chunk(0) if isinstance(vec, pa.ChunkedArray) else vec, book.dim)
    row = np.cumsum(kind < 2) - 1  # of a row among those with a vector
    o = np.argsort(lists, kind="stable")
    who, lists = who[o], lists[o]
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    cuts = np.r_[0, np.flatnonzero(np.diff(lists)) + 1, len(lists)]
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        name = int(lists[lo])
        if name not in spans:
            continue
        a, b = spans[name]
        there = x[row[base[a:b]]]
        for c in range(lo, hi, CHUNK):
            at = who[c : min(hi, c + CHUNK)]
            best, sim = _search_list(x[row[at]], there, codes[a:b], norm[a:b], np.where(own_list[at] == name, place[at], -1), book, k)
            ok = np.isfinite(sim)
            found.append((np.repeat(at, ok.sum(1)), base[a + best[ok]], sim[ok]))
    if not found:
        asks, others, sims = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    else:
        asks, others, sims = (np.concatenate(f) for f in zip(*found))
        o = np.lexsort((-sims, asks))
        asks, others, sims = asks[o], others[o], sims[o]
        starts = np.flatnonzero(np.r_[True, asks[1:] != asks[:-1]])
        ok = np.arange(len(asks)) - np.repeat(starts, np.diff(np.r_[starts, len(asks)])) <= k
        asks, others, sims = asks[ok], others[ok], sims[ok]
    for lo in range(0, len(asks), 8192):
        sl = slice(lo, lo + 8192)
        yield ids[asks[sl]], ids[others[sl]], sims[sl]
    copy = np.flatnonzero(kind == 2)
    if not len(copy):
        return
    lead = t.column("lead").to_numpy(zero_copy_only=False)
    at = dict(zip(ids[full].tolist(), full.tolist()))
    for c in copy:  # a copy has its leader's neighbours, and the leader itself
        i = at[lead[c]]
        sl = slice(np.searchsorted(asks, i), np.searchsorted(asks, i, "right"))
        near = ids[others[sl]]
        good = near != ids[c]
        yield np.repeat(np.array([ids[c]], dtype=object), good.sum()), near[good], sims[sl][good]
        if kind[i] == 0:
            yield np.array([ids[c]], dtype=object), np.array([lead[c]], dtype=object), np.ones(1)


def _split(vectors: DataFrame, books: dict[str, Codebooks], total: int) -> None:
    """Say into how many blocks each long list is split, and into how many buckets the lists of each coarse entry, from
    the lists of one in COUNTED ids."""
    names = sorted(books)
    block = max(BLOCK, -(-total * len(names) // MOST_SPLIT))  # so that no more than MOST_SPLIT lists are longer

    def homes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            aspects = np.array(b.column(0).to_pylist(), dtype=object)
            for number, aspect in enumerate(names):
                at = np.flatnonzero(aspects == aspect)
                if len(at):
                    x = _floats(b.column(1).take(pa.array(at)), books[aspect].dim).astype(np.float32)
                    home = books[aspect].lists(x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30), 1)[0][:, 0]
                    lists, n = np.unique(home, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(lists), number)), pa.array(lists // len(books[aspect].fine), pa.int64()), pa.array(lists.astype(np.int64)), pa.array(n.astype(np.int64))], names=["number", "entry", "list", "n"])

    part = vectors.where((F.pmod(F.xxhash64("id", F.lit(3)), F.lit(COUNTED)) == 0) & F.col("aspect").isin(names)).select("aspect", "vec")
    counts = part.mapInArrow(homes, "number long, entry long, list long, n long").groupBy("number", "entry", "list").agg((F.sum("n") * COUNTED).alias("n"))
    long = F.col("n") > block
    counts = counts.groupBy("number", "entry").agg(F.collect_list(F.when(long, F.struct("list", "n"))).alias("long"), F.coalesce(F.sum(F.when(~long, F.col("n"))), F.lit(0)).alias("rest"))
    for r in counts.where((F.size("long") > 0) | (F.col("rest") > BUCKET_ROWS)).collect():
        book = books[names[r["number"]]]
        book.split.update((x["list"], -(-x["n"] // block)) for x in r["long"])
        if r["rest"] > BUCKET_ROWS:
            book.parts = np.ones(len(book.coarse), np.int64) if book.parts is None else book.parts
            book.parts[r["entry"]] = min(len(book.fine), -(-r["rest"] // BUCKET_ROWS))


def neighbours(vectors: DataFrame, sample: DataFrame, total: int, k: int = 5, aspects: tuple[str, ...] | None = None, exact: bool = False, flat: int = FLAT) -> DataFrame:
    """(aspect, id, other, sim): for each of `vectors` (aspect, id, vec array<float>) its k most similar others.

    Vectors are usable (one length within an aspect, finite, not all zero) and ids distinct within an aspect; others
    of equal similarity go by id. `sample` has rows of the same form for the codebooks, `total` is about the number of
    ids; aspects rare in the sample, or not in it, are drawn from `vectors`. `aspects` names those that may occur and
    saves a pass to find them. A vector alone in its aspect has no neighbour; an empty table gives no rows. `exact`
    compares every vector with all of its aspect, block by block: the reference by which recall is measured.
    """
    drawn: dict[str, list[np.ndarray]] = {}

    def draw(df: DataFrame) -> None:
        for r in df.select("aspect", "vec").toArrow().to_batches():
            names = r.column(0).to_pylist()
            for a in sorted(set(names)):
                part = r.column(1).take(pa.array([i for i, n in enumerate(names) if n == a]))
                drawn.setdefault(a, []).append(part.flatten().to_numpy(zero_copy_only=False).reshape(len(part), -1).astype(np.float32))

    draw(sample)
    known = aspects or [r[0] for r in vectors.select("aspect").where("aspect is not null").distinct().collect()]
    rare = sorted(a for a in known if sum(len(x) for x in drawn.get(a, ())) < LEAST_DRAWN)
    for a in rare:
        drawn.pop(a, None)
        draw(vectors.where(F.col("aspect") == a).orderBy(F.xxhash64("id"), "id").limit(SAMPLE))
    books = {}
    for a, xs in drawn.items():
        x = np.concatenate(xs)
        # all vectors of a rare aspect were drawn, so that its lists follow its own number
        n = len(x) if a in rare and len(x) < SAMPLE else total
        books[a] = exact_books(x.shape[1], n) if exact else fit(x / np.linalg.norm(x, axis=1, keepdims=True), n, flat=flat)
    names = sorted(books)
    if books and not exact:
        _split(vectors, books, total)
    placed = _place(vectors.where(F.col("aspect").isin(names)) if names else vectors.limit(0), books, k)
    placed = placed.repartition(shuffle_width(vectors.sparkSession), "bucket").sortWithinPartitions("bucket")
    schema = pa.schema([("aspect", pa.string()), ("id", pa.string()), ("other", pa.string()), ("sim", pa.float64())])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        current = None
        out: list[pa.RecordBatch] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if held:
                aspect = names[current >> 44]
                for a, b, s in _search_group(pa.concat_tables(held), books[aspect], k):
                    if len(a):
                        out.append(pa.RecordBatch.from_arrays([pa.array([aspect] * len(a)), pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(s.astype(np.float64))], schema=schema))
            if sum(o.num_rows for o in out) > 20_000:
                yield from pa.Table.from_batches(out).combine_chunks().to_batches()
                out.clear()

        for b in batches:
            keys = b.column(0).to_numpy()
            starts = np.r_[0, np.flatnonzero(np.diff(keys)) + 1, len(keys)]
            for lo, hi in zip(starts[:-1], starts[1:]):
                if keys[lo] != current:
                    yield from flush()
                    held, current = [], int(keys[lo])
                held.append(pa.Table.from_batches([b.slice(lo, hi - lo)]))
        yield from flush()
        if out:
            yield from pa.Table.from_batches(out).combine_chunks().to_batches()

    found = placed.mapInArrow(search, "aspect string, id string, other string, sim double")
    order = Window.partitionBy("aspect", "id").orderBy(F.desc("sim"), "other")
    return found.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")


def usable_profiles(embeddings: DataFrame, dim: int = 384) -> DataFrame:
    """(person_id, at, aspect, vec): rows whose vector has `dim` finite numbers, not all zero."""
    v = F.col("embedding")
    ok = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return embeddings.where(F.col("person_id").isNotNull() & v.isNotNull() & F.coalesce(ok, F.lit(False))).select("person_id", F.col("created_at").alias("at"), F.lit("profile").alias("aspect"), v.cast("array<float>").alias("vec"))


def usable_aspects(multi: DataFrame, aspects: tuple[str, ...] = ("current_role", "experience", "skills", "education"), dim: int = 64) -> DataFrame:
    """(person_id, at, one array<float> per aspect, null where it lacks): rows whose JSON parses and has aspects."""
    one = "struct<embedding:array<float>>"
    parsed = F.from_json("embedding_data", "aspects struct<" + ",".join(f"{a}:{one}" for a in aspects) + ">, _corrupt_record string", {"columnNameOfCorruptRecord": "_corrupt_record"})
    rows = multi.where("person_id is not null and embedding_data is not null").select("person_id", F.col("updated_at").alias("at"), parsed.alias("j")).where("j is not null and j._corrupt_record is null and j.aspects is not null")
    def vec(a):
        v = F.col(f"j.aspects.{a}.embedding")
        return F.when((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)) & F.exists(v, lambda x: x != 0), v).alias(a)
    return rows.select("person_id", "at", *(vec(a) for a in aspects)).where(" or ".join(f"{a} is not null" for a in aspects))


def people_neighbours(profiles: DataFrame, multi: DataFrame, k: int = 5, **how) -> DataFrame:
    """(aspect, id, other, sim) over the latest usable row of each person in both tables; `how` as in `neighbours`."""
    n = max(profiles.count(), multi.count())
    part = F.pmod(F.xxhash64("person_id"), F.lit(max(1, -(-n // SAMPLE)))) == 0
    aspects = ("current_role", "experience", "skills", "education")

    def latest(df: DataFrame, cols: list[str]) -> DataFrame:
        newest = F.max(F.struct(F.col("at").isNotNull(), "at", *cols))
        return df.groupBy("person_id").agg(newest.alias("m")).select("person_id", *(F.col(f"m.{c}").alias(c) for c in cols))

    def long(df: DataFrame) -> DataFrame:
        return df.select("person_id", F.explode(F.array(*(F.struct(F.lit(a).alias("aspect"), F.col(a).alias("vec")) for a in aspects))).alias("x")).select("x.aspect", F.col("person_id").alias("id"), "x.vec").where("vec is not null")

    sample = usable_profiles(profiles.where(part)).select("aspect", F.col("person_id").alias("id"), "vec").unionByName(long(usable_aspects(multi.where(part))))
    vectors = latest(usable_profiles(profiles), ["aspect", "vec"]).select("aspect", F.col("person_id").alias("id"), "vec").unionByName(long(latest(usable_aspects(multi), list(aspects))))
    return neighbours(vectors, sample, n, k, ("profile", *aspects), **how)


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """(aspect, person_a, person_b), each unordered pair once, the smaller id first."""
    return found.select("aspect", F.least("id", "other").alias("person_a"), F.greatest("id", "other").alias("person_b")).distinct()
