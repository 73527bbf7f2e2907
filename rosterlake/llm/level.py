"""Reading level of each document by harmonic propagation over a document-profile graph.

Sentences of alike measure - language, words, letters a word, long words, commas - share a profile node; a document is tied
to the profiles of its sentences by the words they hold. Profiles of graded sentences are clamped to their level; all
others take, round by round until nothing moves, the mean of the documents they occur in, and documents the mean of
their profiles. The level of a document is the one at which most of its words are written.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rosterlake.llm.scan import BREAK, Scan, chunks, scan
from rosterlake.session import cut

#: Least number of blank-separated words of running text, and of words of a sentence.
LEAST_WORDS, LEAST_SENTENCE = 30, 3
#: Least number of words of a sentence that a text or paragraph ends without a mark; headings and by-lines have fewer.
LEAST_OPEN = 12
#: Width and number of the steps of a profile: words, letters a word (in tenths), long words; and number of commas told apart.
WORD_STEP, WORD_STEPS, LETTER_STEP, LETTER_STEPS, LONG_STEP, LONG_STEPS, COMMAS = 4, 16, 10, 20, 2, 16, 3
#: Letters of a long word.
LONG = 10
#: The change of a profile's level below which propagation has settled, and rounds after which it has failed to.
SETTLED, ROUNDS = 0.002, 500
#: Words that name a language must be in this many of its samples and in none of another.
IN_SAMPLES = 2
#: Most graded samples read to the driver.
MAX_SAMPLES = 20_000
LEVELS = 5


def _sentences(s: Scan) -> tuple[np.ndarray, np.ndarray]:
    """(sentence number of each word or -1 where it is no running text, row of each sentence)."""
    buf, row = s.buf, s.row
    blank = np.isin(buf, [9, 10, 11, 12, 13, 32])
    nl = buf == 0x0A
    # lines that are list entries
    line_start = np.r_[True, nl[:-1]]
    idx = np.arange(len(buf))
    nxt_text = np.minimum.accumulate(np.where(~blank, idx, len(buf))[::-1])[::-1]
    at = nxt_text[np.flatnonzero(line_start)]
    ends = np.flatnonzero(nl)
    line_of_start = np.arange(len(at))
    inside = at < len(buf)
    lead = np.where(inside, buf[np.minimum(at, len(buf) - 1)], 0)
    follow = buf[np.minimum(at + 1, len(buf) - 1)]
    dash = np.isin(lead, [0x2A, 0x2D, 0x2B]) & np.isin(follow, [32, 9])
    dot = ((lead == 0xE2) & (follow == 0x80) & np.isin(buf[np.minimum(at + 2, len(buf) - 1)], [0xA2, 0xA3])) | ((lead == 0xC2) & (follow == 0xB7))
    listed = (dash | dot) & inside & (at <= ends[line_of_start])
    line = np.cumsum(np.r_[False, nl[:-1]])
    in_list = listed[line]
    # ends of sentences: a mark before a blank, empty lines, block tags
    mark = np.isin(buf, [0x2E, 0x21, 0x3F])
    nxt_blank = np.r_[blank[1:], True]
    closing = np.isin(np.r_[buf[1:], [0]], [0x22, 0x27, 0x29]) & np.r_[blank[2:], True, True]
    stop = mark & (nxt_blank | closing)
    text_end = np.r_[row[1:] != row[:-1], True]
    # where nearly every line starts with a capital, each line is a sentence; else lines are wrapped
    upper = inside & (((lead >= 65) & (lead <= 90)) | (lead == 0xC2) | ((lead == 0xC3) & (follow < 0x9F)))
    later = ~np.r_[True, row[np.flatnonzero(line_start)][1:] != row[np.flatnonzero(line_start)][:-1]] & inside & (at <= ends[line_of_start])
    line_row = row[np.flatnonzero(line_start)]
    plain = np.bincount(line_row[later & upper], minlength=s.n) >= 0.9 * np.maximum(1, np.bincount(line_row[later], minlength=s.n))
    prev_text = np.maximum.accumulate(np.where(~blank, idx, -1))
    gap_nl = np.cumsum(nl)
    # an empty line: two line ends with only blanks between
    before = np.r_[-1, prev_text[:-1]]
    empty = nl & (gap_nl - np.where(before >= 0, gap_nl[np.maximum(before, 0)], 0) >= 2)
    cut_at = stop | empty | (buf == BREAK) | text_end | (nl & (plain[row] | in_list))
    number = np.cumsum(np.r_[False, cut_at[:-1]])
    # lines among others that each are a sentence, though not nearly all of the text: no mark, and all start with a capital
    begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    ended = np.zeros(len(begin), bool)
    ended[number[stop]] = True
    own = np.flatnonzero(inside & (at <= ends[line_of_start]))
    own = own[at[own] > nxt_text[begin[number[at[own]]]]]
    more = np.bincount(number[at[own]], minlength=len(begin))
    lined = ~ended & ~plain[row[begin]] & (more >= 2) & (np.bincount(number[at[own]], weights=upper[own], minlength=len(begin)) >= 0.9 * more)
    by_line = lined[number]
    number = np.cumsum(np.r_[False, (cut_at | (nl & by_line))[:-1]])
    w = number[s.start]
    total = int(number[-1]) + 1 if len(number) else 0
    begin = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
    ended = np.zeros(total, bool)
    ended[number[stop]] = True
    bad = np.zeros(total, bool)
    bad[number[in_list & ~blank]] = True
    count = np.bincount(w, minlength=total)
    # the end of a text or paragraph ends a sentence without a mark, unless it is short or reads as fields or a list
    fields = np.zeros(total, bool)
    fields[number[buf == 0x7C]] = True
    commas = np.bincount(number[buf == 0x2C], minlength=total)
    open_end = (count >= LEAST_OPEN) & ~fields & (4 * commas <= count)
    has_mark = ended | plain[row[begin]] | by_line[begin] | open_end
    good = has_mark & ~bad & (count >= LEAST_SENTENCE)
    return np.where(good[w], w, -1), row[begin]


def _numbered(s: Scan) -> np.ndarray:
    """Sentence number of each word, -1 where it is no running text."""
    return _sentences(s)[0] if len(s.start) else np.zeros(0, np.int64)


def _profiles(s: Scan, sent: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, profile without language, words) of each sentence of running text."""
    sent = _numbered(s) if sent is None else sent
    ok = sent >= 0
    sent, letters, rows = sent[ok], s.letters()[ok], s.word_row[ok]
    if not len(sent):
        return (np.zeros(0, np.int64),) * 3
    first = np.flatnonzero(np.r_[True, sent[1:] != sent[:-1]])
    n = np.diff(np.r_[first, len(sent)])
    chars = np.add.reduceat(letters, first)
    long = np.add.reduceat((letters >= LONG).astype(np.int64), first)
    a = np.minimum(n // WORD_STEP, WORD_STEPS - 1)
    b = np.minimum(chars * 10 // n // LETTER_STEP, LETTER_STEPS - 1)
    c = np.minimum(long // LONG_STEP, LONG_STEPS - 1)
    begin, stop = s.start[ok][first], s.start[ok][np.r_[first[1:], len(sent)] - 1]
    comma = np.r_[0, np.cumsum(s.buf == 0x2C)]
    d = np.minimum(comma[stop] - comma[begin], COMMAS - 1)
    return rows[first], ((a * LETTER_STEPS + b) * LONG_STEPS + c) * COMMAS + d, n


PROFILES = WORD_STEPS * LETTER_STEPS * LONG_STEPS * COMMAS


def _blank_words(s: Scan, sent: np.ndarray | None = None) -> np.ndarray:
    """Blank-separated words of running text in each text."""
    sent = _numbered(s) if sent is None else sent
    ok = sent >= 0
    if not ok.any():
        return np.zeros(s.n, np.int64)
    blank = np.isin(s.buf, [9, 10, 11, 12, 13, 32])
    piece = np.cumsum(blank)[s.start[ok]]
    rows = s.word_row[ok]
    new = np.r_[True, (piece[1:] != piece[:-1]) | (rows[1:] != rows[:-1])]
    # a lone & between two words of a sentence is a blank-separated word too
    sign = np.flatnonzero((s.buf == 0x26) & np.r_[False, blank[:-1]] & np.r_[blank[1:], False])
    after = np.searchsorted(s.start, sign)
    sign_at = after[(after > 0) & (after < len(s.start))]
    sign_at = sign_at[(sent[sign_at] >= 0) & (sent[sign_at] == sent[sign_at - 1])]
    return np.bincount(rows[new], minlength=s.n) + np.bincount(s.word_row[sign_at], minlength=s.n)


class Languages:
    """Languages of the samples, told by words that only one of them uses."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.names = sorted(set(langs))
        seen: dict[int, dict[int, int]] = {}
        s = scan(pa.array(texts, pa.string()))
        h, r = s.hashes(), s.word_row
        for row, x in set(zip(r.tolist(), h.tolist())):
            d = seen.setdefault(x, {})
            k = self.names.index(langs[row])
            d[k] = d.get(k, 0) + 1
        own = {x: next(iter(d)) for x, d in seen.items() if len(d) == 1 and next(iter(d.values())) >= IN_SAMPLES}
        self.words = np.array(sorted(own), np.uint64)
        self.lang = np.array([own[x] for x in sorted(own)], np.int64)
        self.low = np.zeros(1 << 16, bool)
        self.low[(self.words & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, s: Scan) -> np.ndarray:
        """Number of the language of each text, -1 where no word tells."""
        n = len(self.names)
        if not len(s.start) or not len(self.words):
            return np.full(s.n, -1)
        h = s.hashes()
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.words, h[at]), len(self.words) - 1)
        ok = self.words[k] == h[at]
        votes = np.bincount(s.word_row[at[ok]] * n + self.lang[k[ok]], minlength=s.n * n).reshape(s.n, n)
        return np.where(votes.max(1) > 0, votes.argmax(1), -1)


def clamp(texts: list[str], langs: np.ndarray, levels: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """(mean level, words) of each language's profiles that occur in graded samples."""
    n = PROFILES * (int(langs.max()) + 1 if len(langs) else 1)
    s = scan(pa.array(texts, pa.string()))
    row, profile, words = _profiles(s)
    cell = langs[row] * PROFILES + profile
    mass = np.bincount(cell, weights=words, minlength=n)
    value = np.bincount(cell, weights=words * np.asarray(levels, float)[row], minlength=n)
    return np.divide(value, mass, out=np.zeros(n), where=mass > 0), mass


def reading_levels(documents: DataFrame, samples: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, level, difficulty): level 1 to 5 of each document with enough running text, and its continuous mean.

    Texts that are null, blank, bare lists or in none of the samples' languages give no row; repeated texts each do. A
    sentence may end without a mark where its text, paragraph or line does; alone it needs LEAST_OPEN words to be told
    from a heading.
    """
    spark = documents.sparkSession
    graded = samples.select("text", "lang", "level").where("text is not null and lang is not null and level is not null").limit(MAX_SAMPLES + 1).collect()
    if len(graded) > MAX_SAMPLES:
        raise ValueError(f"more than {MAX_SAMPLES} graded samples")
    graded = sorted(graded, key=lambda r: (r["lang"], r["level"], r["text"]))
    if not graded:
        return spark.createDataFrame([], "doc_id long, level int, difficulty double")
    texts, langs = [r["text"] for r in graded], [r["lang"] for r in graded]
    tongue = Languages(texts, langs)
    fixed, mass = clamp(texts, np.array([tongue.names.index(x) for x in langs]), [r["level"] for r in graded])
    size = len(tongue.names) * PROFILES
    fixed, mass = np.resize(fixed, size) if len(fixed) < size else fixed, np.resize(mass, size) if len(mass) < size else mass

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, col in chunks(b.column(1)):
                s = scan(col)
                sent, lang = _numbered(s), tongue.of(s)
                enough = (_blank_words(s, sent) >= LEAST_WORDS) & (lang >= 0)
                row, profile, words = _profiles(s, sent)
                ok = enough[row]
                cell = lang[row[ok]] * PROFILES + profile[ok]
                key, inv = np.unique(row[ok].astype(np.int64) * size + cell, return_inverse=True)
                w = np.bincount(inv.ravel(), weights=words[ok], minlength=len(key)).astype(np.int32)
                have, n = np.unique(key // size, return_counts=True)
                if not len(have):
                    continue
                off = pa.array(np.r_[0, np.cumsum(n)].astype(np.int32))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(have + lo)), pa.ListArray.from_arrays(off, pa.array((key % size).astype(np.int32))), pa.ListArray.from_arrays(off, pa.array(w))], names=["doc_id", "cells", "words"])

    graph = cut(documents.select("doc_id", "text").where("doc_id is not null and text is not null").mapInArrow(read, "doc_id long, cells array<int>, words array<int>"))

    def arrays(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        off = b.column(k).offsets.to_numpy().astype(np.int64)
        return off - off[0], b.column(k).flatten().to_numpy(zero_copy_only=False), b.column(k + 1).flatten().to_numpy(zero_copy_only=False).astype(float)

    held = mass > 0
    value = np.where(held, fixed, np.nan)
    for _ in range(rounds):
        def step(batches: Iterator[pa.RecordBatch], value: np.ndarray = value) -> Iterator[pa.RecordBatch]:
            got, weight = np.zeros(size), np.zeros(size)
            for b in batches:
                off, cell, w = arrays(b, 0)
                known = ~np.isnan(value[cell])
                top = np.add.reduceat(np.where(known, w * np.nan_to_num(value[cell]), 0.0), off[:-1])
                low = np.add.reduceat(np.where(known, w, 0.0), off[:-1])
                doc = np.repeat(np.divide(top, low, out=np.full(len(top), np.nan), where=low > 0), np.diff(off))
                use = ~np.isnan(doc) & ~held[cell]
                got += np.bincount(cell[use], weights=(w * doc)[use], minlength=size)
                weight += np.bincount(cell[use], weights=w[use], minlength=size)
            at = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(got[at]), pa.array(weight[at])], names=["cell", "v", "w"])

        # one row per open profile; their number is bounded by the steps of a profile
        rows = graph.select("cells", "words").mapInArrow(step, "cell int, v double, w double").groupBy("cell").agg(F.sum("v").alias("v"), F.sum("w").alias("w")).collect()
        nxt = value.copy()
        for r in rows:
            nxt[r[0]] = r[1] / r[2]
        moved = np.nanmax(np.abs(np.nan_to_num(nxt, nan=-1.0) - np.nan_to_num(value, nan=-1.0)))
        value = nxt
        if moved < SETTLED:
            break
    else:
        raise RuntimeError("levels did not settle")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            off, cell, w = arrays(b, 1)
            v = value[cell]
            ok = ~np.isnan(v)
            row = np.repeat(np.arange(b.num_rows), np.diff(off))
            level = np.clip(np.rint(np.nan_to_num(v)), 1, LEVELS).astype(np.int64)
            share = np.bincount(row[ok] * LEVELS + level[ok] - 1, weights=w[ok], minlength=b.num_rows * LEVELS).reshape(-1, LEVELS)
            top = np.bincount(row[ok], weights=(w * np.nan_to_num(v))[ok], minlength=b.num_rows)
            keep = np.flatnonzero(share.sum(1) > 0)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep)), pa.array((share.argmax(1) + 1)[keep].astype(np.int32)), pa.array(top[keep] / share.sum(1)[keep])], names=["doc_id", "level", "difficulty"])

    return graph.mapInArrow(decide, "doc_id long, level int, difficulty double")
