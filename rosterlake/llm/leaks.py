"""Evaluation texts leaking into training text: a distributed positional inverted index.

The index holds postings by term: for every word that a test item uses the documents and the positions at which it
stands, built in one pass over whole texts and written in the shared folder. Corpus counts of the terms name the
rarest terms of every window of a test item. Their postings are looked up by term, shifted by the term's place in the
item and intersected: postings of one document and item on nearly the same diagonal, from enough places of the item,
make a candidate. An exact check follows: the words of the candidate's document around that place are compared with
the item's, and a window of the item must be there in order, all but a few single words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.scan import chunks, scan, words_of
from rosterlake.session import broadcast_if_small, cut, shuffle_width

#: Words of a passage that counts, and how many of them must be there next to another one that is.
WINDOW, MATCHED = 15, 12
#: Words by which a passage may drift off the places at which its rarest terms were found.
DRIFT = 3
#: Share of a window's rarity (sum of log inverse frequencies) that its found words must hold: sentences of one make
#: share common words and differ in the rare ones, a retyped passage loses words at random.
RARE_SHARE = 0.8
#: Rarest terms of each window that are looked up, least number that must meet, and words by which they may shift. A
#: window with WINDOW - MATCHED words changed keeps at least RAREST - (WINDOW - MATCHED) = 4 of its rarest, and those lie
#: within DRIFT of the diagonals between which the window is found: asking for 4 leaves out none that asking for 1 finds.
RAREST, MEET, SHIFT = 7, 4, 8
#: Items looked up together; more go in further rounds over the same index.
ITEMS_AT_ONCE = 20_000


@dataclass
class Items:
    """ids and words of each item, as numbers of the vocabulary's terms."""

    ids: np.ndarray
    words: list[np.ndarray]


def vocabulary(items: DataFrame) -> np.ndarray:
    """The sorted hashes of all words of the test items. It grows like the words of a language, not like the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for _, col in chunks(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(scan(col).hashes()).view(np.int64))], names=["h"])

    rows = items.where("item_id is not null and text is not null").select("text").mapInArrow(run, "h long").distinct().toArrow()
    return np.sort(rows.column(0).to_numpy().astype(np.int64).view(np.uint64))


def read_items(items: DataFrame, terms: np.ndarray) -> Items:
    """The items of one round with at least one word."""
    rows = items.select("item_id", "text").where("item_id is not null and text is not null").collect()
    hashed = [(r[0], words_of(r[1])) for r in sorted(rows, key=lambda r: r[0])]
    hashed = [(i, h) for i, h in hashed if len(h)]
    return Items(np.array([i for i, _ in hashed], np.int64), [np.searchsorted(terms, h).astype(np.int32) for _, h in hashed])


def _numbers(h: np.ndarray, terms: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number of the term) of the words that are among `terms`."""
    at = np.flatnonzero(low[(h & np.uint64(0xFFFF)).astype(np.int64)])
    k = np.minimum(np.searchsorted(terms, h[at]), len(terms) - 1)
    ok = terms[k] == h[at]
    return at[ok], k[ok].astype(np.int32)


def _low(terms: np.ndarray) -> np.ndarray:
    low = np.zeros(1 << 16, bool)
    low[(terms & np.uint64(0xFFFF)).astype(np.int64)] = True
    return low


def build_index(documents: DataFrame, terms: np.ndarray) -> DataFrame:
    """(term, docs array<long>, positions array<int>): the postings of each of the given terms, in pieces."""
    low = _low(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, col in chunks(b.column(1)):
                s = scan(col)
                at, k = _numbers(s.hashes(), terms, low)
                docs, pos = b.column(0).take(pa.array(s.word_row[at].astype(np.int64) + lo)).to_numpy(), s.ordinals()[at].astype(np.int32)
                o = np.argsort(k, kind="stable")
                have, size = np.unique(k, return_counts=True)
                if len(have):
                    off = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(have), pa.ListArray.from_arrays(off, pa.array(docs[o])), pa.ListArray.from_arrays(off, pa.array(pos[o]))], names=["term", "docs", "positions"])

    return documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(run, "term int, docs array<long>, positions array<int>")


def term_counts(index: DataFrame, n: int) -> np.ndarray:
    """Postings of each of the n terms over the whole corpus."""
    out = np.zeros(n, np.int64)
    for r in index.groupBy("term").agg(F.sum(F.size("positions")).alias("n")).collect():
        out[r[0]] = r[1]
    return out


def anchors(words: np.ndarray, counts: np.ndarray, window: int = WINDOW, rarest: int = RAREST) -> np.ndarray:
    """Places of an item's words that are among the rarest of some window of it."""
    c = counts[words]
    keep = np.zeros(len(words), bool)
    for lo in range(max(1, len(words) - window + 1)):
        part = c[lo : lo + window]
        keep[lo + np.argsort(part, kind="stable")[:rarest]] = True
    return np.flatnonzero(keep)


def look_up(index: DataFrame, places: list[np.ndarray], words: list[np.ndarray]) -> DataFrame:
    """(doc_id, item, diag, place): the postings of the items' anchor terms; diag is the position less the place."""
    spark = index.sparkSession
    by_term: dict[int, tuple[list[int], list[int]]] = {}
    for i, (p, w) in enumerate(zip(places, words)):
        for x in p.tolist():
            held = by_term.setdefault(int(w[x]), ([], []))
            held[0].append(i)
            held[1].append(x)
    rows = spark.createDataFrame([(t, *v) for t, v in by_term.items()], "term int, items array<int>, places array<int>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, many = (np.diff(b.column(k).offsets.to_numpy()).astype(np.int64) for k in (0, 2))
            docs, pos, items, place = (c.flatten().to_numpy(zero_copy_only=False) for c in b.columns)
            total = size * many
            row = np.repeat(np.arange(len(size)), total)
            n = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
            p = n // many[row] + (np.cumsum(size) - size)[row]
            a = n % many[row] + (np.cumsum(many) - many)[row]
            yield pa.RecordBatch.from_arrays([pa.array(docs[p]), pa.array(items[a]), pa.array((pos[p].astype(np.int64) - place[a]).astype(np.int32)), pa.array(place[a])], names=["doc_id", "item", "diag", "place"])

    joined = index.join(broadcast_if_small(rows, len(by_term)), "term")
    return joined.select("docs", "positions", "items", "places").mapInArrow(run, "doc_id long, item int, diag int, place int")


def intersect(hits: DataFrame, least: np.ndarray) -> DataFrame:
    """(doc_id, item, first, last): diagonals between which postings of at least `least`[item] places of an item meet."""

    def met(doc: np.ndarray, item: np.ndarray, diag: np.ndarray, place: np.ndarray) -> pa.RecordBatch:
        gap = np.r_[True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (diag[1:].astype(np.int64) - diag[:-1] > SHIFT)]
        first = np.flatnonzero(gap)
        number = np.cumsum(gap) - 1
        pairs = np.unique(number * (1 << 24) + place) >> 24
        good = np.flatnonzero(np.bincount(pairs, minlength=len(first)) >= least[item[first]])
        last = np.r_[first[1:], len(doc)] - 1
        f, z = first[good], last[good]
        return pa.RecordBatch.from_arrays([pa.array(doc[f]), pa.array(item[f]), pa.array(diag[f]), pa.array(diag[z])], names=["doc_id", "item", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            cols = [c.to_numpy() for c in b.columns]
            if not len(cols[0]):
                continue
            new = np.flatnonzero(np.diff(cols[0])) + 1
            if not len(new):  # all of one document
                held.append(cols)
                continue
            held.append([c[: new[-1]] for c in cols])
            yield met(*(np.concatenate([h[k] for h in held]) for k in range(4)))
            held = [[c[new[-1] :] for c in cols]]
        if held:
            yield met(*(np.concatenate([h[k] for h in held]) for k in range(4)))

    placed = hits.repartition(shuffle_width(hits.sparkSession), "doc_id").sortWithinPartitions("doc_id", "item", "diag")
    return placed.mapInArrow(run, "doc_id long, item int, first int, last int")


def passage_score(item: np.ndarray, doc: np.ndarray, low: int, high: int, weight: np.ndarray, window: int = WINDOW) -> int:
    """Most words of a window of the item that stand in `doc` (term numbers, -1 for other words) next to another one,
    `low` to `high` places later than in the item. Windows whose rare words are missing do not count: questions of one
    make share their common words. `weight` has the rarity of each word of the item."""
    eq = np.zeros((len(item) + 2, len(doc) + 2), bool)
    later = np.arange(len(doc))[None, :] - np.arange(len(item))[:, None]
    eq[1:-1, 1:-1] = (item[:, None] == doc[None, :]) & (later >= low) & (later <= high)
    hit = (eq[1:-1, 1:-1] & (eq[:-2, :-2] | eq[2:, 2:])).any(1)
    w = min(window, len(item))
    total, mass, whole = (np.r_[0, np.cumsum(x)] for x in (hit, hit * weight, weight))
    words = total[w:] - total[:-w]
    return int(np.where(mass[w:] - mass[:-w] >= RARE_SHARE * (whole[w:] - whole[:-w]), words, 0).max())


def confirm(documents: DataFrame, candidates: DataFrame, items: Items, terms: np.ndarray, weights: list[np.ndarray], matched: int) -> DataFrame:
    """(doc_id, item_id, score) of the candidates (doc_id, item, first, last) whose document holds the passage."""
    low = _low(terms)
    need = np.array([matched if len(w) >= WINDOW else -(-matched * len(w) // WINDOW) for w in items.words])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: list[tuple[int, int, int]] = []
            for lo, col in chunks(b.column(1)):
                s = scan(col)
                at, k = _numbers(s.hashes(), terms, low)
                term = np.full(len(s.start), -1, np.int32)
                term[at] = k
                begin = np.searchsorted(s.word_row, np.arange(s.n + 1))
                for d in range(s.n):
                    text = term[begin[d] : begin[d + 1]]
                    best: dict[int, int] = {}
                    for c in b.column(2)[lo + d].as_py():
                        i, first, last = c["item"], c["first"], c["last"]
                        words = items.words[i]
                        if best.get(i, 0) >= min(WINDOW, len(words)):
                            continue
                        a = max(0, first - SHIFT)
                        part = text[a : max(0, last + len(words) + SHIFT + 1)]
                        if (part >= 0).sum() >= need[i]:
                            best[i] = max(best.get(i, 0), passage_score(words, part, first - a - DRIFT, last - a + DRIFT, weights[i]))
                    found += [(b.column(0)[lo + d].as_py(), int(items.ids[i]), n) for i, n in best.items() if n >= need[i]]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64()), pa.array([f[2] for f in found], pa.int32())], names=["doc_id", "item_id", "score"])

    by_doc = cut(candidates.groupBy("doc_id").agg(F.collect_list(F.struct("item", "first", "last")).alias("at")))
    held = documents.select("doc_id", "text").where("text is not null").join(broadcast_if_small(by_doc), "doc_id")
    return held.select("doc_id", "text", "at").mapInArrow(run, "doc_id long, item_id long, score int")


def find_leaks(documents: DataFrame, items: DataFrame, matched: int = MATCHED, meet: int = MEET, at_once: int = ITEMS_AT_ONCE) -> DataFrame:
    """(doc_id, item_id, score): documents that hold an item or a passage of at least WINDOW words of it.

    score is the number of words of the best window that were found in place. Items shorter than a window must be
    there but for the same share of words. Null and blank texts match nothing, repeated texts each count.
    """
    spark = documents.sparkSession
    terms = vocabulary(items)
    out = spark.createDataFrame([], "doc_id long, item_id long, score int")
    if not len(terms):
        return out
    index = cut(build_index(documents, terms))
    counts = term_counts(index, len(terms))
    rarity = np.log1p(counts.sum() / (1.0 + counts))
    rounds = -(-items.count() // at_once)
    for k in range(rounds):
        test = read_items(items.where(F.pmod(F.xxhash64("item_id"), F.lit(rounds)) == k), terms)
        if not len(test.ids):
            continue
        places = [anchors(w, counts) for w in test.words]
        least = np.minimum(meet, np.array([len(p) for p in places]))
        candidates = intersect(look_up(index, places, test.words), least)
        out = out.unionByName(confirm(documents, candidates, test, terms, [rarity[w] for w in test.words], matched))
    return out
