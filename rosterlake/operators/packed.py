"""Several values packed in one field: split into one value per row with its position.

The split runs over whole Arrow string buffers with numpy: quote parity and delimiter masks are computed for all
bytes of a batch at once, child offsets are derived from the mask, and the children are flattened next to the
ordinal of their parent. No Python loop touches a row unless its values hold JSON escapes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUOTE, BACKSLASH, COMMA, SLASH = 0x22, 0x5C, 0x2C, 0x2F
SINGLE = np.zeros(256, bool)
SINGLE[[ord(x) for x in ";|\n\t\r"]] = True
BLANK = np.zeros(256, bool)
BLANK[[ord(x) for x in " \n\t\r\x0b\x0c"]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True

#: How a field is written: does a bare comma (outside quotes) part values, and does one slash between blanks?
STYLES = {"list": (True, True), "entries": (False, False)}


def _escaped(buf: np.ndarray) -> np.ndarray:
    """Bytes that follow an odd run of backslashes."""
    out = np.zeros(len(buf), bool)
    at = np.flatnonzero(buf == BACKSLASH)
    if not len(at):
        return out
    first = np.r_[True, np.diff(at) != 1]
    start = at[first][np.cumsum(first) - 1]
    last = np.r_[~(np.diff(at) == 1), True]
    ends = at[last & ((at - start) % 2 == 0)] + 1
    out[ends[ends < len(buf)]] = True
    return out


def _prev_nonblank(blank: np.ndarray) -> np.ndarray:
    """For each byte the index of the last non-blank byte before it, -1 if none."""
    idx = np.where(~blank, np.arange(len(blank)), -1)
    return np.r_[-1, np.maximum.accumulate(idx)[:-1]] if len(blank) else idx


def _next_nonblank(blank: np.ndarray) -> np.ndarray:
    """For each byte the index of the first non-blank byte after it, len if none."""
    n = len(blank)
    idx = np.where(~blank, np.arange(n), n)
    return np.r_[np.minimum.accumulate(idx[::-1])[::-1][1:], n] if n else idx


def split_array(values: pa.Array, style: str = "list") -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(parent ordinal, position from 1, item) of every non-empty value packed in `values` (nulls give none)."""
    bare_comma, one_slash = STYLES[style]
    values = pc.fill_null(values.cast(pa.large_string()), "")
    n = len(values)
    off = np.frombuffer(values.buffers()[1], np.int64)[values.offset : values.offset + n + 1]
    if n == 0 or off[-1] == off[0]:
        return np.zeros(0, np.int64), np.zeros(0, np.int32), pa.array([], pa.string())
    # every row gets a line end of its own, so that no mask reaches over a row's edge
    lens = np.diff(off)
    total = int(off[-1] - off[0])
    src = np.frombuffer(values.buffers()[2], np.uint8)[off[0] : off[-1]]
    row_of = np.repeat(np.arange(n), lens)
    buf = np.full(total + n, 0x0A, np.uint8)
    buf[np.arange(total) + row_of] = src
    start = off[:-1] - off[0] + np.arange(n)
    end = start + lens  # index of the row's own line end
    row = np.repeat(np.arange(n), lens + 1)

    is_q = (buf == QUOTE) & ~_escaped(buf)
    before = np.cumsum(is_q) - is_q
    parity = (before - before[start][row]) & 1
    odd = ((before[end] - before[start]) & 1).astype(bool)[row]  # unbalanced quotes are plain letters
    inside = (parity == 1) & ~odd
    inside |= is_q & (parity == 0) & ~odd
    blank = BLANK[buf]

    delim = SINGLE[buf] & ~inside
    last, nxt = _prev_nonblank(blank), _next_nonblank(blank)
    closes = is_q & (parity == 1) & ~odd
    # JSON-like brackets around the whole row
    has = lens > 0
    a = np.where(has, np.where(blank[start], nxt[start], start), 0)
    z = np.where(has, last[end], 0)
    boxed = has & (buf[np.minimum(a, len(buf) - 1)] == 0x5B) & (buf[z] == 0x5D) & (z > a)
    delim[a[boxed]] = True
    delim[z[boxed]] = True

    # dots and bullets of two and three bytes, outside quotes
    mid = (buf[:-1] == 0xC2) & (buf[1:] == 0xB7)
    for k, hit in ((2, np.flatnonzero(mid)), (3, np.flatnonzero((buf[:-2] == 0xE2) & (buf[1:-1] == 0x80) & ((buf[2:] == 0xA2) | (buf[2:] == 0xA3))))):
        hit = hit[~inside[hit]]
        for j in range(k):
            delim[hit + j] = True

    # slashes: a run with a blank or an edge on both sides; one slash parts only lists
    is_s = (buf == SLASH) & ~inside
    if is_s.any():
        at = np.flatnonzero(is_s)
        first = np.r_[True, np.diff(at) != 1]
        lo, size = at[first], np.diff(np.r_[np.flatnonzero(first), len(at)])
        left = (lo == 0) | BLANK[buf[np.maximum(lo - 1, 0)]] | delim[np.maximum(lo - 1, 0)]
        right = BLANK[buf[lo + size]] | delim[lo + size]
        ok = left & right & ((size == 2) | (one_slash & (size == 1)))
        delim[at[np.repeat(ok, size)]] = True

    is_c = (buf == COMMA) & ~inside
    if not bare_comma:
        # a comma parts entries only right after a closing quote and before an opening quote or the end
        p, q = np.maximum(last, 0), np.minimum(nxt, len(buf) - 1)
        opens_next = (nxt >= len(buf)) | (row[q] != row) | (is_q[q] & (parity[q] == 0)) | delim[q] | (buf[q] == COMMA)
        is_c &= closes[p] & (last >= 0) & (row[p] == row) & opens_next
    delim |= is_c
    delim[end] = True

    # segments between delimiters, trimmed
    stop = np.flatnonzero(delim)
    begin = np.r_[0, stop[:-1] + 1]

    def trim(b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b = np.where(b < e, np.where(blank[np.minimum(b, len(buf) - 1)], nxt[np.minimum(b, len(buf) - 1)], b), b)
        b = np.minimum(b, e)
        return b, np.where(b < e, last[np.minimum(e, len(buf) - 1)] + 1, b)

    begin, stop = trim(begin, stop)
    # list notation: "12. " or "12) ", "- ", "* "
    safe = lambda i: np.minimum(i, len(buf) - 1)
    digits = np.zeros(len(begin), np.int64)
    run = np.ones(len(begin), bool)
    for j in range(3):
        run &= (begin + j < stop) & DIGIT[buf[safe(begin + j)]]
        digits += run
    after = begin + digits
    numbered = (digits > 0) & (after < stop) & np.isin(buf[safe(after)], [0x2E, 0x29]) & BLANK[buf[safe(after + 1)]]
    dashed = (begin < stop) & np.isin(buf[safe(begin)], [0x2D, 0x2A]) & BLANK[buf[safe(begin + 1)]]
    begin = np.where(numbered, after + 1, np.where(dashed, begin + 1, begin))
    begin, stop = trim(np.minimum(begin, stop), stop)

    quoted = (stop - begin >= 2) & is_q[safe(begin)] & closes[safe(stop - 1)] & ~odd[safe(begin)]
    # the opening quote must be closed by the last byte and not earlier, or by a doubled quote in between
    begin, stop = np.where(quoted, begin + 1, begin), np.where(quoted, stop - 1, stop)
    begin, stop = trim(begin, stop)
    keep = stop > begin
    begin, stop, quoted = begin[keep], stop[keep], quoted[keep]
    parent = row[begin] if len(begin) else np.zeros(0, np.int64)

    size = stop - begin
    child = np.r_[0, np.cumsum(size)].astype(np.int64)
    take = np.repeat(begin - child[:-1], size) + np.arange(child[-1])
    items = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(child), pa.py_buffer(np.ascontiguousarray(buf[take])))
    q = pa.array(quoted)
    if quoted.any():
        bs = pc.match_substring(items, "\\")
        if pc.any(pc.and_(bs, q)).as_py():
            idx = np.flatnonzero(pc.and_(bs, q).to_numpy(zero_copy_only=False))
            fixed = [_unescape(x) for x in items.take(pa.array(idx)).to_pylist()]
            mask = np.zeros(len(items), bool)
            mask[idx] = True
            items = pc.replace_with_mask(items, pa.array(mask), pa.array(fixed, pa.large_string()))
        items = pc.if_else(q, pc.replace_substring(items, '""', '"'), items)
    fresh = np.r_[True, parent[1:] != parent[:-1]] if len(parent) else np.zeros(0, bool)
    ordinal = np.arange(len(parent)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1] + 1 if len(parent) else np.zeros(0, np.int64)
    return parent, ordinal.astype(np.int32), items.cast(pa.string())


def _unescape(s: str) -> str:
    try:
        return json.loads(f'"{s}"')
    except ValueError:
        return s.replace('\\"', '"').replace("\\\\", "\\")


#: Bytes of text that are scanned together; one text is never cut.
AT_ONCE = 1 << 24


def _pieces(b: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """A batch cut between rows at about AT_ONCE bytes of its text column."""
    total = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < b.num_rows:
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + AT_ONCE, "right")))
        yield b.slice(lo, hi - lo)
        lo = hi


def explode_packed(df: DataFrame, keys: list[str], value: str, styles: dict[str, str] | None = None, field: str | None = None) -> DataFrame:
    """One row per value packed in column `value`: the keys, item_no (from 1, in the order written) and item.

    Delimiters (any mix in one field): ; | line end, tab, middle dot, bullet, slashes between blanks; in a list also
    the comma; in entries a comma only between quoted entries. Values in double quotes are one value, with `""` and
    backslash escapes undone; JSON arrays, bullets and numbering are notation. Null, blank and empty values give no
    row; unbalanced quotes count as letters; other columns of `df` are dropped, whatever their names. `styles` maps
    the value of column `field` to "list" or "entries"; without it all rows are lists.
    """
    cols = keys + ([field] if field and field not in keys else [])
    src = df.select(*cols, F.col(value).alias("__packed"))
    schema = T.StructType([*(src.schema[c] for c in cols), T.StructField("item_no", T.IntegerType()), T.StructField("item", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            kinds = b.column(names.index(field)) if field else None
            for style in STYLES if field else ["list"]:
                part = b
                if field:
                    wanted = [k for k, v in (styles or {}).items() if v == style]
                    part = b.filter(pc.is_in(kinds, value_set=pa.array(wanted, kinds.type)))
                for piece in _pieces(part, names.index("__packed")):
                    parent, no, items = split_array(piece.column(names.index("__packed")), style)
                    at = pa.array(parent)
                    yield pa.RecordBatch.from_arrays([*(piece.column(names.index(c)).take(at) for c in cols), pa.array(no), items], names=[*cols, "item_no", "item"])

    return src.mapInArrow(run, schema)


def profile_lists(enhanced: DataFrame) -> DataFrame:
    """(person_id, field, item_no, item) for the three packed fields of the enhanced search results.

    Repeated rows of a person count once: of several texts the longest (then the greatest) stands for the field.
    """
    fields = {"skills": "list", "experience_history": "entries", "education_history": "entries"}
    long = enhanced.select("person_id", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "text"))
    one = (
        long.where(F.col("text").isNotNull() & (F.trim("text") != "") & F.col("person_id").isNotNull())
        .groupBy("person_id", "field")
        .agg(F.max(F.struct(F.length("text").alias("n"), F.col("text").alias("text"))).alias("best"))
        .select("person_id", "field", F.col("best.text").alias("text"))
    )
    return explode_packed(one, ["person_id"], "text", fields, "field").select("person_id", "field", "item_no", "item")
