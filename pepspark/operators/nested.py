"""Deeply nested semi-structured records -> linked flat tables, by vectorised structural indexing.

A batch of JSON texts is treated as one byte buffer. Bitmaps of quotes, brackets and delimiters
are built with numpy; the parity of the running quote count says what lies inside a string; the
prefix sum of +1/-1 at brackets is the nesting depth; containers, ordinals and value spans follow
from sorting the delimiters by depth. No record is visited in a Python loop.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_QUOTE, _BACK, _OPEN_A, _OPEN_O, _CLOSE, _COLON, _COMMA = 1, 2, 3, 4, 5, 6, 7
_CLASS = np.zeros(256, np.uint8)
for _ch, _k in (('"', _QUOTE), ("\\", _BACK), ("[", _OPEN_A), ("{", _OPEN_O), ("]", _CLOSE), ("}", _CLOSE), (":", _COLON), (",", _COMMA)):
    _CLASS[ord(_ch)] = _k
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 13, 32]] = True

# what a character after a backslash stands for; 0: nothing
_ESCAPE = np.zeros(256, np.uint8)
for _ch, _to in zip('"\\/bfnrt', '"\\/\b\f\n\r\t'):
    _ESCAPE[ord(_ch)] = ord(_to)
_HEX = np.full(256, -1, np.int64)
for _ch in "0123456789abcdefABCDEF":
    _HEX[ord(_ch)] = int(_ch, 16)
_LITERAL = r"^(-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?|true|false|null)$"
#: Why a record is malformed.
REASONS = ("", "quotes", "brackets", "escape", "syntax", "no container")

#: Bytes of JSON text indexed at a time; bounds the worker's memory whatever the batch size is.
SLICE_BYTES = 4_000_000


def _gather(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The byte spans of ``buf`` as one Arrow string column."""
    lens = np.maximum(ends - starts, 0)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lens, out=offsets[1:])
    data = buf[np.repeat(starts - offsets[:-1], lens) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data))


def _escapes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Places of the backslashes that begin an escape; runs of backslashes begin anew at each of ``starts``."""
    back = np.flatnonzero(data == 92)
    if not len(back):
        return back
    begin = np.r_[True, np.diff(back) != 1] | np.isin(back, starts)
    run = back[np.maximum.accumulate(np.where(begin, np.arange(len(back)), 0))]
    return back[(back - run) % 2 == 0]


def _code_units(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """UTF-16 unit of each \\uXXXX that begins at ``at``; -1 if it isn't one."""
    last = len(data) - 1
    digits = [_HEX[data[np.minimum(at + k, last)]] for k in (2, 3, 4, 5)]
    unit = ((digits[0] * 16 + digits[1]) * 16 + digits[2]) * 16 + digits[3]
    return np.where((at + 5 <= last) & np.all([d >= 0 for d in digits], axis=0), unit, -1)


def _unescape(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Texts (spans of ``data``) with their escapes replaced; all escapes must be valid. Half of a surrogate pair becomes U+FFFD."""
    data = data.copy()
    at = _escapes(data, offsets)
    keep = np.ones(len(data), bool)
    nxt = data[at + 1]
    simple = at[nxt != 117]
    data[simple] = _ESCAPE[data[simple + 1]]
    keep[simple + 1] = False
    u = at[nxt == 117]
    if len(u):
        unit = _code_units(data, u)
        follows = np.r_[u[1:] == u[:-1] + 6, False]
        high = (unit >= 0xD800) & (unit < 0xDC00) & follows & (np.r_[unit[1:], 0] >= 0xDC00) & (np.r_[unit[1:], 0] < 0xE000)
        low = np.r_[False, high[:-1]]
        point = np.where(high, 0x10000 + ((unit - 0xD800) << 10) + (np.r_[unit[1:], 0] - 0xDC00), np.where((unit >= 0xD800) & (unit < 0xE000), 0xFFFD, unit))
        size = np.where(low, 0, np.where(point < 0x80, 1, np.where(point < 0x800, 2, np.where(point < 0x10000, 3, 4))))
        lead = np.select([size == 1, size == 2, size == 3], [point, 0xC0 | (point >> 6), 0xE0 | (point >> 12)], 0xF0 | (point >> 18))
        for k in range(6):
            keep[u + k] = k < size
        for k in range(4):
            w = size > k
            byte = lead if k == 0 else 0x80 | ((point >> np.maximum(6 * (size - 1 - k), 0)) & 0x3F)
            data[u[w] + k] = byte[w]
    ends = np.r_[0, np.cumsum(keep)]
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends[offsets].astype(np.int64)), pa.py_buffer(data[keep]))


class StructuralIndex:
    """The slots (array elements and object members) of all records of one buffer.

    ``parent`` is the token number of the slot's container, ``child`` the token that opens the
    slot's own container (-1 for scalars), ``ordinal`` its place from 1.
    Malformed records get no slots; ``reason`` holds for every record why (0: well formed).
    """

    def __init__(self, buf: np.ndarray, bounds: np.ndarray):
        self.reason = np.zeros(len(bounds) - 1, np.int8)
        buf = self._without_malformed(buf, bounds)
        self.buf = buf
        cls = _CLASS[buf]
        pos = np.flatnonzero(cls)
        quotes = self._quotes(buf, pos, cls)
        tok = pos[cls[pos] > _BACK]
        tok = tok[np.searchsorted(quotes, tok) % 2 == 0]
        kind = cls[tok]
        self.tok, self.kind = tok, kind
        is_open = (kind == _OPEN_A) | (kind == _OPEN_O)
        depth = np.cumsum(np.where(is_open, 1, np.where(kind == _CLOSE, -1, 0)))
        level = depth + (kind == _CLOSE)
        order = np.lexsort((np.arange(len(tok)), level))
        opens = np.maximum.accumulate(np.where(is_open[order], np.arange(len(tok)), 0)) if len(tok) else order
        container = np.empty(len(tok), np.int64)
        container[order] = order[opens] if len(tok) else order
        holder = kind[container] if len(tok) else kind
        slot = ((kind == _COLON) & (holder == _OPEN_O)) | ((kind == _COMMA) & (holder == _OPEN_A)) | (kind == _OPEN_A)
        at = np.flatnonzero(slot)
        nxt = np.minimum(at + 1, max(len(tok) - 1, 0))
        child = np.where(is_open[nxt], nxt, -1) if len(tok) else at
        start, end = (tok[at] + 1, tok[nxt]) if len(tok) else (at, at)
        start, end = self._trim(buf, start, end)
        keep = (child >= 0) | (end > start)
        at, child, start, end = at[keep], child[keep], start[keep], end[keep]
        self.parent, self.child, self.start, self.end = container[at] if len(tok) else at, child, start, end
        by = np.lexsort((at, self.parent))
        p = self.parent[by]
        first = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else p
        rank = np.arange(len(p)) - np.repeat(first, np.diff(np.r_[first, len(p)])) + 1 if len(p) else p
        self.ordinal = np.empty(len(p), np.int64)
        self.ordinal[by] = rank
        member = kind[at] == _COLON
        ks, ke = self._trim(buf, np.where(member, tok[at - 1] + 1, 0), np.where(member, tok[at], 0), quote=True) if len(at) else (at, at)
        self.key = self._text(ks, ke)
        self.member = member
        codes = self.key.dictionary_encode()
        self._codes = np.asarray(codes.indices)
        self._names = {k: i for i, k in enumerate(codes.dictionary.to_pylist())}
        roots = np.flatnonzero(is_open & (level == 1))
        self.roots, self.root_row = roots, np.searchsorted(bounds, tok[roots], side="right") - 1

    @staticmethod
    def _quotes(buf: np.ndarray, pos: np.ndarray, cls: np.ndarray) -> np.ndarray:
        kinds = cls[pos]
        quotes, back = pos[kinds == _QUOTE], pos[kinds == _BACK]
        if not len(back) or not len(quotes):
            return quotes
        begin = np.r_[True, np.diff(back) != 1]
        run_start = back[np.maximum.accumulate(np.where(begin, np.arange(len(back)), 0))]
        i = np.searchsorted(back, quotes) - 1
        touching = (i >= 0) & (back[np.maximum(i, 0)] == quotes - 1)
        odd = (quotes - run_start[np.maximum(i, 0)]) % 2 == 1
        return quotes[~(touching & odd)]

    def _without_malformed(self, buf: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Blanks out malformed records and notes why they are: odd quotes, unbalanced brackets, unknown escapes, wrong order of signs and values, no container."""
        n = len(bounds) - 1
        filled = np.add.reduceat(np.r_[~_SPACE[buf], False], np.minimum(bounds[:-1], len(buf)), dtype=np.int64) > 0 if n else np.zeros(0, bool)
        filled &= np.diff(bounds) > 0
        for check in (self._bad_quotes, self._bad_brackets, self._bad_escapes, self._bad_order):
            reason, places = check(buf, bounds)
            if len(places):
                bad = np.zeros(n, bool)
                bad[np.searchsorted(bounds, places, side="right") - 1] = True
                self.reason[bad] = REASONS.index(reason)
                buf = self._blank(buf, bounds, bad)
        opened = np.zeros(n, bool)
        opens = np.flatnonzero((_CLASS[buf] == _OPEN_A) | (_CLASS[buf] == _OPEN_O))
        opened[np.searchsorted(bounds, opens, side="right") - 1] = True
        bare = filled & ~opened & (self.reason == 0)
        for i in np.flatnonzero(bare):  # a null record is none
            bare[i] = buf[bounds[i] : bounds[i + 1]].tobytes().strip() != b"null"
        self.reason[bare] = REASONS.index("no container")
        return self._blank(buf, bounds, bare) if bare.any() else buf

    def _bad_quotes(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        cls = _CLASS[buf]
        row = np.searchsorted(bounds, self._quotes(buf, np.flatnonzero(cls), cls), side="right") - 1
        return "quotes", bounds[:-1][np.bincount(row, minlength=len(bounds) - 1) % 2 == 1]

    def _tokens(self, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places and kinds of the structural characters outside of strings, and the quotes."""
        cls = _CLASS[buf]
        pos = np.flatnonzero(cls)
        quotes = self._quotes(buf, pos, cls)
        tok = pos[cls[pos] > _BACK]
        tok = tok[np.searchsorted(quotes, tok) % 2 == 0]
        return tok, cls[tok], quotes

    def _bad_brackets(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        n = len(bounds) - 1
        tok, kind, _ = self._tokens(buf)
        tok, kind = tok[kind <= _CLOSE], kind[kind <= _CLOSE]
        row = np.searchsorted(bounds, tok, side="right") - 1
        step = np.where(kind == _CLOSE, -1, 1)
        total = np.bincount(row, weights=step, minlength=n)[:n]
        run = np.cumsum(step)
        base = np.r_[0, np.cumsum(total)][row] if n else run
        low = np.zeros(n)
        np.minimum.at(low, row, run - base)
        return "brackets", bounds[:-1][(total != 0) | (low < 0)]

    @staticmethod
    def _bad_escapes(buf: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        at = _escapes(buf, bounds[:-1])
        nxt = buf[np.minimum(at + 1, len(buf) - 1)] if len(at) else at
        return "escape", at[np.where(nxt == 117, _code_units(buf, at) < 0, _ESCAPE[nxt] == 0)] if len(at) else at

    def _bad_order(self, buf: np.ndarray, bounds: np.ndarray) -> tuple[str, np.ndarray]:
        """Tokens that are followed by what may not follow them, and values that are none."""
        tok, kind, quotes = self._tokens(buf)
        if not len(tok):
            return "syntax", tok
        is_open = (kind == _OPEN_A) | (kind == _OPEN_O)
        depth = np.cumsum(np.where(is_open, 1, np.where(kind == _CLOSE, -1, 0)))
        order = np.lexsort((np.arange(len(tok)), depth))
        holder = np.empty(len(tok), np.int64)
        holder[order] = order[np.maximum.accumulate(np.where(is_open[order], np.arange(len(tok)), 0))]
        opener = np.empty(len(tok), np.int64)
        order = np.lexsort((np.arange(len(tok)), depth + (kind == _CLOSE)))
        opener[order] = order[np.maximum.accumulate(np.where(is_open[order], np.arange(len(tok)), 0))]
        wrong_close = (kind == _CLOSE) & ((buf[tok] == 125) != (kind[opener] == _OPEN_O))
        t = np.flatnonzero(depth > 0)
        start, end = self._trim(buf, tok[t] + 1, tok[t + 1])
        blank, here, after, in_object = start >= end, kind[t], kind[t + 1], kind[holder[t]] == _OPEN_O
        opens = (after == _OPEN_A) | (after == _OPEN_O)
        stops = (after == _COMMA) | (after == _CLOSE)
        value = (stops & ~blank) | (opens & blank)
        names = (after == _COLON) & ~blank
        ok = np.select(
            [here == _CLOSE, here == _COLON, in_object & (here == _COMMA), in_object, here == _COMMA],
            [stops & blank, in_object & value, names, names | ((after == _CLOSE) & blank), value],
            value | ((after == _CLOSE) & blank),
        )
        # what stands between two signs is one quoted text, or (but for names) a number, true, false or null
        inside = np.searchsorted(quotes, end) - np.searchsorted(quotes, start)
        first, last = buf[np.minimum(start, len(buf) - 1)], buf[np.maximum(end - 1, 0)]
        quoted = (inside == 2) & (first == 34) & (last == 34)
        plain = ok & ~blank & ~quoted
        ok &= ~(plain & ((inside > 0) | (after == _COLON)))
        check = np.flatnonzero(plain & ok)
        if len(check):
            ok[check] = np.asarray(pc.match_substring_regex(_gather(buf, start[check], end[check]), _LITERAL), dtype=bool)
        return "syntax", np.concatenate([tok[t][~ok], tok[wrong_close]])

    @staticmethod
    def _blank(buf: np.ndarray, bounds: np.ndarray, bad: np.ndarray) -> np.ndarray:
        return np.where(np.repeat(bad, np.diff(bounds)), 32, buf).astype(np.uint8)

    @staticmethod
    def _trim(buf: np.ndarray, start: np.ndarray, end: np.ndarray, quote: bool = False) -> tuple[np.ndarray, np.ndarray]:
        start, end = start.copy(), end.copy()
        while len(start) and (m := (start < end) & _SPACE[buf[np.minimum(start, len(buf) - 1)]]).any():
            start += m
        while len(start) and (m := (start < end) & _SPACE[buf[np.maximum(end - 1, 0)]]).any():
            end -= m
        if quote and len(start):
            start += (start < end) & (buf[np.minimum(start, len(buf) - 1)] == 34)
            end -= (start < end) & (buf[np.maximum(end - 1, 0)] == 34)
        return start, end

    def _text(self, start: np.ndarray, end: np.ndarray) -> pa.Array:
        out = _gather(self.buf, start, end)
        hit = np.flatnonzero(np.asarray(pc.match_substring(out, "\\"), dtype=bool))
        if len(hit):
            lens = (end - start)[hit]
            offsets = np.r_[0, np.cumsum(lens)]
            data = self.buf[np.repeat(start[hit] - offsets[:-1], lens) + np.arange(offsets[-1])]
            mask = np.zeros(len(out), bool)
            mask[hit] = True
            out = pc.replace_with_mask(out, pa.array(mask), _unescape(data, offsets))
        return out

    def step(self, cur: np.ndarray, name: str) -> np.ndarray:
        """Slots below the containers marked in ``cur``: '[]' elements, '*' members, else the named member."""
        inside = cur[self.parent] >= 0
        if name == "[]":
            return np.flatnonzero(inside & ~self.member)
        if name == "*":
            return np.flatnonzero(inside & self.member)
        return np.flatnonzero(inside & self.member & (self._codes == self._names.get(name, -1)))

    def mark(self, opens: np.ndarray) -> np.ndarray:
        """A map from container token to its place in ``opens``; -1 entries of ``opens`` (scalars) get none."""
        cur = np.full(len(self.tok) + 1, -1, np.int64)
        ok = opens >= 0
        cur[opens[ok]] = np.flatnonzero(ok)
        return cur

    def scalars(self, slots: np.ndarray) -> pa.Array:
        """Text of scalar slots; JSON null, missing (-1) and containers give null."""
        ok = (slots >= 0) & (self.child[np.maximum(slots, 0)] < 0) if len(self.child) else np.zeros(len(slots), bool)
        s = np.where(ok, slots, 0)
        start, end = (self.start[s], self.end[s]) if len(self.start) else (s, s)
        start, end = np.where(ok, start, 0), np.where(ok, end, 0)
        quoted = ok & (self.buf[np.minimum(start, len(self.buf) - 1)] == 34)
        text = self._text(start + quoted, end - quoted)
        null = ~ok | (~quoted & np.asarray(pc.equal(text, "null"), dtype=bool))
        return pc.if_else(pa.array(~null), text, pa.scalar(None, pa.large_string()))


@dataclass(frozen=True)
class FlatTable:
    """One output table of :func:`shred`.

    ``path``: steps from the root ('[]', '*' or a member name); each '[]' adds an ordinal.
    ``columns``: paths below an element, tuples of member names; ('$key',) is the member's own name.
    ``containers``: keep only elements that are objects or arrays (null elements keep their place but give no row).
    """

    name: str
    path: tuple[str, ...]
    columns: tuple[tuple[str, ...], ...]
    containers: bool = True


def _emit(ix: StructuralIndex, t: FlatTable) -> tuple[np.ndarray, np.ndarray, list[pa.Array]]:
    """Row numbers, ordinals (elements x number of '[]') and value columns of one table."""
    opens, row = ix.roots, ix.root_row
    ords = np.zeros((len(opens), 0), np.int64)
    slots = np.zeros(0, np.int64)
    for name in t.path:
        cur = ix.mark(opens)
        slots = ix.step(cur, name)
        src = cur[ix.parent[slots]]
        row, ords = row[src], ords[src]
        if name == "[]":
            ords = np.c_[ords, ix.ordinal[slots]]
        opens = ix.child[slots]
    if t.containers:
        keep = opens >= 0
        slots, opens, row, ords = slots[keep], opens[keep], row[keep], ords[keep]
    columns = []
    for path in t.columns:
        if path == ("$key",):
            columns.append(ix.key.take(pa.array(slots)))
            continue
        found, below = np.arange(len(slots)), opens
        value = slots
        for name in path:
            cur = ix.mark(below)
            got = ix.step(cur, name)
            value = np.full(len(slots), -1, np.int64)
            value[found[cur[ix.parent[got]]]] = got
            below = np.where(value >= 0, ix.child[np.maximum(value, 0)], -1) if len(ix.child) else value
        columns.append(ix.scalars(value))
    return row, ords, columns


def _shred_batches(batches: Iterator[pa.RecordBatch], tables: tuple[FlatTable, ...], n_ids: int, depth: int, width: int, malformed: str | None = None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        text = batch.column(n_ids).cast(pa.large_string())
        text = pc.fill_null(text, "")
        lens = np.asarray(pc.binary_length(text))
        ends = np.cumsum(lens)
        lo = 0
        while lo < len(text):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE_BYTES)))
            part = text.slice(lo, hi - lo)
            offsets = np.frombuffer(part.buffers()[1], np.int64, len(part) + 1, part.offset * 8)
            raw = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
            buf = raw[offsets[0] : offsets[-1]]
            if len(buf):
                ix = StructuralIndex(buf, offsets - offsets[0])
                for t in tables:
                    row, ords, columns = _emit(ix, t)
                    if not len(row):
                        continue
                    ids = [batch.column(k).take(pa.array(row + lo)) for k in range(n_ids)]
                    place = [pa.array(ords[:, d].astype(np.int32)) if d < ords.shape[1] else pa.nulls(len(row), pa.int32()) for d in range(depth)]
                    cells = [columns[k].cast(pa.string()) if k < len(columns) else pa.nulls(len(row), pa.string()) for k in range(width)]
                    names = [batch.schema.names[k] for k in range(n_ids)] + ["table"] + [f"ord{d + 1}" for d in range(depth)] + [f"v{k + 1}" for k in range(width)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([t.name] * len(row)), *place, *cells], names)
                bad = np.flatnonzero(ix.reason)
                if malformed and len(bad):
                    ids = [batch.column(k).take(pa.array(bad + lo)) for k in range(n_ids)]
                    why = pa.array([REASONS[r] for r in ix.reason[bad]])
                    names = [batch.schema.names[k] for k in range(n_ids)] + ["table"] + [f"ord{d + 1}" for d in range(depth)] + [f"v{k + 1}" for k in range(width)]
                    yield pa.RecordBatch.from_arrays([*ids, pa.array([malformed] * len(bad)), *[pa.nulls(len(bad), pa.int32())] * depth, why, *[pa.nulls(len(bad), pa.string())] * (width - 1)], names)
            lo = hi


def shred(df: DataFrame, ids: list[str], record: Column | str, tables: list[FlatTable], malformed: str | None = "malformed") -> DataFrame:
    """Turn one nested column into linked flat rows in a single pass over ``df``.

    ``record`` is a JSON text, or a struct, array or map column (then serialised by the JVM).
    Result: the ``ids`` columns, ``table``, ``ord1..`` (places from 1 of each array level on the
    way, the link to the parent row) and ``v1..`` (the table's columns as text).
    A record that isn't a well-formed JSON array or object gives one row of the table ``malformed`` with the
    reason (one of REASONS) in ``v1`` and no others; with ``malformed`` None it gives none.
    Null and empty records give no rows; null elements keep their place but give none;
    repeated records give repeated rows; other columns of ``df`` are ignored, whatever their names.
    """
    col = F.col(record) if isinstance(record, str) else record
    kind = df.select(col.alias("x")).schema[0].dataType
    if not isinstance(kind, T.StringType):
        col = F.to_json(col, {"ignoreNullFields": "false"})
    src = df.select(*ids, col.alias("__record"))
    depth = max(t.path.count("[]") for t in tables)
    width = max(1, *(len(t.columns) for t in tables))
    schema = T.StructType(
        [src.schema[k] for k in range(len(ids))]
        + [T.StructField("table", T.StringType())]
        + [T.StructField(f"ord{d + 1}", T.IntegerType()) for d in range(depth)]
        + [T.StructField(f"v{k + 1}", T.StringType()) for k in range(width)]
    )
    spec, n_ids = tuple(tables), len(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _shred_batches(batches, spec, n_ids, depth, width, malformed)

    return src.mapInArrow(run, schema)


#: The flat tables of a pepXML ``search_hit`` array and their value columns.
HIT_COLUMNS = ("hit_rank", "peptide", "modified_peptide", "calc_neutral_pep_mass", "massdiff", "num_tot_proteins", "num_missed_cleavages", "is_rejected")
PROTEIN_COLUMNS = ("protein", "protein_descr", "num_tol_term", "peptide_prev_aa", "peptide_next_aa")
SEARCH_HIT_TABLES = [
    FlatTable("hit", ("[]",), tuple((c,) for c in HIT_COLUMNS) + (("modification_info", "mod_nterm_mass"), ("modification_info", "mod_cterm_mass"))),
    FlatTable("protein", ("[]", "proteins", "[]"), tuple((c,) for c in PROTEIN_COLUMNS)),
    FlatTable("score", ("[]", "search_score", "*"), (("$key",), ()), containers=False),
    FlatTable("modification", ("[]", "modification_info", "mod_aminoacid_mass", "[]"), (("mod_position",), ("mass",))),
    FlatTable("analysis", ("[]", "analysis_result", "[]"), (("analysis",), ("probability",))),
    FlatTable("ntt", ("[]", "analysis_result", "[]", "all_ntt_prob", "[]"), ((),), containers=False),
]


def search_hit_rows(psms: DataFrame, names: tuple[str, ...] | None = None) -> DataFrame:
    """The flat rows of ``psms.search_hit`` keyed by ``query_id``, tagged by table; of the tables ``names`` only, if given."""
    return shred(psms, ["query_id"], "search_hit", [t for t in SEARCH_HIT_TABLES if names is None or t.name in names])


def search_hit_children(psms: DataFrame) -> DataFrame:
    """One row per non-null child of a query: query_id, child, hit_no, child_no, child_label.

    A child delivered repeatedly counts once. Terminal modifications sit at place 0 and at
    peptide length + 1 (null if the peptide is null); the label of a modification is the integer
    part of its mass, null if the mass is null or not finite.
    """
    rows = shred(
        psms,
        ["query_id"],
        "search_hit",
        [
            FlatTable("hit", ("[]",), (("peptide",), ("modification_info", "mod_nterm_mass"), ("modification_info", "mod_cterm_mass"))),
            FlatTable("protein", ("[]", "proteins", "[]"), (("protein",),)),
            FlatTable("score", ("[]", "search_score", "*"), (("$key",),), containers=False),
            FlatTable("modification", ("[]", "modification_info", "mod_aminoacid_mass", "[]"), (("mod_position",), ("mass",))),
        ],
        malformed=None,
    )
    t = F.col("table")

    def child(kind: str, no: Column, label: Column) -> Column:
        return F.struct(F.lit(kind).alias("child"), no.try_cast("int").alias("child_no"), label.alias("child_label"))

    def whole(mass: Column) -> Column:
        return mass.try_cast("double").try_cast("bigint").cast("string")

    one = (
        F.when(t == "hit", child("hit", F.lit(0), F.col("v1")))
        .when(t == "protein", child("protein", F.col("ord2"), F.col("v1")))
        .when(t == "score", child("score", F.lit(0), F.col("v1")))
        .otherwise(child("modification", F.col("v1"), whole(F.col("v2"))))
    )
    n_term = F.when((t == "hit") & F.col("v2").isNotNull(), child("modification", F.lit(0), whole(F.col("v2"))))
    c_term = F.when((t == "hit") & F.col("v3").isNotNull(), child("modification", F.length("v1") + 1, whole(F.col("v3"))))
    return (
        rows.select("query_id", F.col("ord1").alias("hit_no"), F.explode(F.array_compact(F.array(one, n_term, c_term))).alias("c"))
        .select("query_id", "c.child", "hit_no", "c.child_no", "c.child_label")
        .distinct()
    )


def search_hit_tables(psms: DataFrame, names: tuple[str, ...] | None = None) -> dict[str, DataFrame]:
    """The typed flat tables hit, protein, score, modification, analysis and ntt (or those of ``names``), and malformed.

    (query_id, hit_no) leads back to the hit, (query_id, hit_no, analysis_no) from ntt to its analysis. Only the tables that are
    asked for are emitted.
    """
    rows = search_hit_rows(psms, names)

    def cells(names: tuple[str, ...], types: dict[str, str]) -> list[Column]:
        return [F.col(f"v{i + 1}").try_cast(types.get(c, "string")).alias(c) for i, c in enumerate(names)]

    hit_types = {"hit_rank": "int", "calc_neutral_pep_mass": "double", "massdiff": "double", "num_tot_proteins": "int", "num_missed_cleavages": "int", "is_rejected": "boolean", "mod_nterm_mass": "double", "mod_cterm_mass": "double"}
    second = {"protein": "protein_no", "modification": "modification_no", "analysis": "analysis_no", "ntt": "analysis_no"}
    columns = {
        "hit": ((*HIT_COLUMNS, "mod_nterm_mass", "mod_cterm_mass"), hit_types),
        "protein": (PROTEIN_COLUMNS, {"num_tol_term": "int"}),
        "score": (("score_name", "score"), {"score": "double"}),
        "modification": (("mod_position", "mass"), {"mod_position": "int", "mass": "double"}),
        "analysis": (("analysis", "probability"), {"probability": "double"}),
        "ntt": (("probability",), {"probability": "double"}),
    }
    out = {}
    for name, (fields, types) in columns.items():
        if names is None or name in names:
            link = ["query_id", F.col("ord1").alias("hit_no")] + ([F.col("ord2").alias(second[name])] if name in second else []) + ([F.col("ord3").alias("ntt_no")] if name == "ntt" else [])
            out[name] = rows.filter(F.col("table") == name).select(*link, *cells(fields, types))
    out["malformed"] = rows.filter("table = 'malformed'").select("query_id", F.col("v1").alias("reason"))
    return out
