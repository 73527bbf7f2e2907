"""Words and sentences of many texts at once, read off the bytes of an Arrow string column with numpy."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are scanned together; one text is never cut.
AT_ONCE = 1 << 21
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Lower case of letters of two bytes (Latin with marks, Greek, Cyrillic, Armenian), where it has two bytes too.
_PAIR = np.arange(0x800, dtype=np.int64)
for _c in range(0x80, 0x800):
    _l = chr(_c).lower()
    if len(_l) == 1 and 0x80 <= ord(_l) < 0x800:
        _PAIR[_c] = ord(_l)
_LETTER = np.zeros(256, bool)
_LETTER[97:123] = _LETTER[65:91] = True
_LETTER[0x80:] = True
_WORD = _LETTER.copy()
_WORD[48:58] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: A form feed stands for the end of a paragraph that a tag marks.
BREAK = 0x0C
_BLOCK_TAGS = (b"p", b"/p", b"br", b"br/", b"li", b"/li", b"div", b"/div", b"ul", b"/ul", b"td", b"/td", b"tr", b"/tr", b"h1", b"/h1", b"h2", b"/h2", b"h3", b"/h3")
_rng = np.random.default_rng(20240229)
_T = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_P = np.ones(256, np.uint64)
with np.errstate(over="ignore"):
    for _i in range(1, 256):
        _P[_i] = _P[_i - 1] * np.uint64(0x9E3779B97F4A7C15)


def chunks(col: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string column, cut between rows at about AT_ONCE bytes."""
    size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(size)
    lo = 0
    while lo < len(col):
        base = total[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(total, base + AT_ONCE, "right")))
        yield lo, col.slice(lo, hi - lo)
        lo = hi


@dataclass
class Scan:
    """buf: the texts, each with a line end of its own; row: text of each byte; words as [start, end) in buf."""

    buf: np.ndarray
    row: np.ndarray
    first: np.ndarray
    start: np.ndarray
    end: np.ndarray
    n: int

    @property
    def word_row(self) -> np.ndarray:
        return self.row[self.start]

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word in lower case."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        size = self.end - self.start
        at = np.repeat(self.start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        pos = np.minimum(at - np.repeat(self.start, size), 255)
        with np.errstate(over="ignore"):
            return np.add.reduceat(_T[self.lower()[at]] * _P[pos], np.cumsum(size) - size)

    def lower(self) -> np.ndarray:
        """The texts in lower case."""
        low = _LOWER[self.buf]
        lead = np.flatnonzero((self.buf[:-1] >= 0xC3) & (self.buf[:-1] < 0xE0) & ((self.buf[1:] & 0xC0) == 0x80)) if len(low) > 1 else np.zeros(0, np.int64)
        code = _PAIR[(self.buf[lead].astype(np.int64) & 31) << 6 | self.buf[lead + 1] & 63]
        low[lead], low[lead + 1] = 0xC0 | code >> 6, 0x80 | code & 63
        return low

    def letters(self) -> np.ndarray:
        """Characters of each word."""
        lead = np.r_[0, np.cumsum((self.buf & 0xC0) != 0x80)]
        return lead[self.end] - lead[self.start]

    def ordinals(self) -> np.ndarray:
        """Number of each word within its text, from 0."""
        r = self.word_row
        if not len(r):
            return np.zeros(0, np.int64)
        new = np.flatnonzero(np.r_[True, r[1:] != r[:-1]])
        return np.arange(len(r)) - np.repeat(new, np.diff(np.r_[new, len(r)]))


def scan(col: pa.Array) -> Scan:
    """Words of a string column. Tags and character entities are no text, a word parted by a hyphen at a line's end is
    one word, and null is an empty text."""
    col = pc.fill_null(col.cast(pa.large_string()), "")
    n = len(col)
    off = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + n + 1]
    lens = np.diff(off)
    total = int(off[-1] - off[0])
    buf = np.full(total + n, 0x0A, np.uint8)
    row = np.repeat(np.arange(n, dtype=np.int32), lens + 1)
    if total:
        src = np.frombuffer(col.buffers()[2], np.uint8)[off[0] : off[-1]]
        buf[np.arange(total) + np.repeat(np.arange(n), lens)] = src
    _tags(buf, row)
    _entities(buf)
    drop = _hyphens(buf, row)
    if drop is not None:
        buf, row = buf[~drop], row[~drop]
    word = _WORD[buf]
    two = np.flatnonzero((buf[:-1] == 0xC2) & (buf[1:] >= 0x80) & (buf[1:] < 0xC0)) if len(buf) > 1 else np.zeros(0, np.int64)
    three = np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80)) if len(buf) > 2 else np.zeros(0, np.int64)
    for k in range(2):
        word[two + k] = False
    for k in range(3):
        word[three + k] = False
    edge = np.diff(np.r_[False, word, False].astype(np.int8))
    first = np.searchsorted(row, np.arange(n))
    return Scan(buf, row, first, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), n)


def _tags(buf: np.ndarray, row: np.ndarray) -> None:
    lt, gt = np.flatnonzero(buf == 0x3C), np.flatnonzero(buf == 0x3E)
    if not len(lt) or not len(gt):
        return
    nxt = buf[np.minimum(lt + 1, len(buf) - 1)]
    lt = lt[_LETTER[nxt] & (nxt < 0x80) | (nxt == 0x2F) | (nxt == 0x21)]
    close = np.searchsorted(gt, lt)
    ok = close < len(gt)
    lt, close = lt[ok], gt[close[ok]]
    ok = (close - lt < 300) & (row[lt] == row[close])
    for a, b in zip(lt[ok].tolist(), close[ok].tolist()):
        name = bytes(buf[a + 1 : b]).lower().split(b" ")[0]
        buf[a : b + 1] = 0x20
        if name in _BLOCK_TAGS:
            buf[a] = BREAK


def _entities(buf: np.ndarray) -> None:
    at = np.flatnonzero(buf == 0x26)
    for k in range(2, 9):
        if not len(at):
            return
        inside = buf[np.minimum(at + k - 1, len(buf) - 1)]
        at = at[(_WORD[inside] & (inside < 0x80)) | (inside == 0x23)]
        hit = at[buf[np.minimum(at + k, len(buf) - 1)] == 0x3B]
        for j in range(k + 1):
            buf[hit + j] = 0x20


def _hyphens(buf: np.ndarray, row: np.ndarray) -> np.ndarray | None:
    at = np.flatnonzero(buf[:-1] == 0x2D) if len(buf) > 1 else np.zeros(0, np.int64)
    at = at[(at > 0)]
    at = at[_LETTER[buf[at - 1]] & ((buf[at + 1] == 0x0A) | (buf[at + 1] == 0x0D))]
    if not len(at):
        return None
    end = at + 1
    for _ in range(6):
        b = buf[np.minimum(end, len(buf) - 1)]
        end = np.where((end < len(buf)) & ((b == 0x0A) | (b == 0x0D) | (b == 0x20) | (b == 0x3E)), end + 1, end)
    ok = (end < len(buf)) & _LETTER[buf[np.minimum(end, len(buf) - 1)]] & (row[at] == row[np.minimum(end, len(buf) - 1)])
    drop = np.zeros(len(buf), bool)
    for a, e in zip(at[ok].tolist(), end[ok].tolist()):
        drop[a:e] = True
    return drop


def words_of(text: str) -> np.ndarray:
    """Hashes of the words of one text."""
    return scan(pa.array([text], pa.string())).hashes()
