"""Template residue, filler and error-page text, by character n-gram likelihood ratios.

Models of hashed character 3- and 4-grams are fitted for filler, error notices, script notices,
unfilled form fields and for text that only talks about such things (``contrast``), from the written
examples of :mod:`examples`; the model of natural text is counted over the whole corpus. Every place
of a text gets the mean log-likelihood ratio of the window around it. A sentence is residue if
windows in favour of residue cover enough of it and their evidence adds up to enough.

Unfilled slots have a shape instead of words: delimiter, name, delimiter. Their n-grams are made of
these three units, raw and by character class, with the same likelihood ratio against natural text
and against code. A slot stands in place of content unless windows of the contrast model hold in the
rest of its sentence.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark.llm import examples as X

#: Orders of the character n-grams and bits of their bucket numbers; bits of those of slots.
ORDERS = ((3, 16), (4, 17))
SLOT_BITS = 14
SIZES = (*(1 << bits for _, bits in ORDERS), 1 << SLOT_BITS, 1 << SLOT_BITS)
#: Count vectors are added up in ranges of so many buckets, in so many lanes first.
RANGE = 1 << 14
LANES = 64
#: Bytes of text scored at a time.
SLICE_BYTES = 1_000_000
#: Longest name of a slot in bytes; longest delimiter that is told apart.
NAME_BYTES, DELIMITER_BYTES = 40, 4
TEXT_KINDS = ("filler", "error", "script", "form", "contrast")
#: Weight, in n-grams, of all examples together in the natural model: matters for small corpora only, which show little natural text. Slots are taken to be absent from ten times as many bytes.
POOL = 20_000
#: Windows stand around every so many bytes of a sentence (a power of two).
STRIDE = 4
#: Natural text stands in an example model with this share of the examples' counts.
PRIOR = 0.5
#: What is reported; unfilled form fields count as slots.
KINDS = ("slot", "filler", "error", "script")

# soft hyphens, zero-width and direction signs in UTF-8
_DROPPED = re.compile(rb"\xc2\xad|\xe2\x80[\x8b-\x8f\xaa-\xae]|\xe2\x81[\xa0-\xa4]|\xef\xbb\xbf")
# guillemets and escaped angle brackets become single bytes, so that delimiters are bytes
def _delimited(raw: bytes) -> bytes:
    if not raw.isascii():
        raw = _DROPPED.sub(b"", raw).replace("«".encode(), b"\1").replace("»".encode(), b"\2")
    if b"&" in raw:
        raw = raw.replace(b"&lt;", b"\3").replace(b"&gt;", b"\4")
    return raw.replace(b"\0", b" ")


_PAD = b"\0" * 24


def _bytes(chars: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(chars)] = True
    return table


_CODES = np.arange(256)
_DIGIT = (_CODES >= 48) & (_CODES <= 57)
_UPPER = (_CODES >= 65) & (_CODES <= 90)
_LOWER = ((_CODES >= 97) & (_CODES <= 122)) | (_CODES >= 128)
_WORD = _DIGIT | _UPPER | _LOWER
_NAME = _WORD | _bytes(b" _-.")
_OPEN, _SHUT, _SIGN = _bytes(b"{[<\1\3"), _bytes(b"}]>\2\4"), _bytes(b"%$#@|*~^")
# character classes of delimiters, and the byte that mirrors each
_CLASS = np.where(_OPEN, 1, np.where(_SHUT, 2, np.where(_SIGN | (_CODES == 95), 3, _CODES))).astype(np.uint64)
_MIRROR = _CODES.copy()
for _a, _b in ("{}", "[]", "<>", "\1\2", "\3\4", "()"):
    _MIRROR[ord(_a)] = ord(_b)
# letters in lower case, digits as 0, delimiters as blanks
_FOLD = np.where(_UPPER, _CODES + 32, np.where(_DIGIT, 48, np.where(_OPEN | _SHUT | _bytes(b"%$#@_|*~"), 32, _CODES))).astype(np.uint32)
_QUOTE = _bytes(b"\"'`")
_STOP = _bytes(b".!?")
_STOP_OR_COLON = _STOP | _bytes(b":")
_MIX, _STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0x100000001B3)


def _bucket(code: np.ndarray, bits: int) -> np.ndarray:
    return ((code * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def gram_buckets(buf: np.ndarray) -> list[np.ndarray]:
    """Buckets of the folded n-grams of each order that begin at each byte."""
    f = np.concatenate([_FOLD[buf], np.full(3, 10, np.uint32)])
    n = len(buf)
    three = (f[:n] << np.uint32(16)) | (f[1 : n + 1] << np.uint32(8)) | f[2 : n + 2]
    four = (three << np.uint32(8)) | f[3 : n + 3]
    return [(code * np.uint32(0x9E3779B1)) >> np.uint32(32 - bits) for code, (_, bits) in zip((three, four), ORDERS)]


def slot_spans(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(begin, end, raw bucket, class bucket) of every name between two runs of delimiters.

    The class bucket knows of each delimiter only what kind of sign it is, whether the two mirror each
    other, how the name is written and whether letters or quotes touch the whole from outside.
    """
    word = _WORD[buf]
    before, after = np.r_[False, word[:-1]], np.r_[word[1:], False]
    sign = _OPEN[buf] | _SHUT[buf] | _SIGN[buf] | ((buf == 95) & ~(before & after)) | (buf == 41)
    left, right = np.r_[np.uint8(0), buf[:-1]], np.r_[buf[1:], np.uint8(0)]
    sign |= (buf == 40) & ((left == 37) | (left == 36))  # %(name)s, $(name)
    sign |= ((buf == 33) | (buf == 63)) & (_OPEN[left] | _SHUT[right])  # {!name!}, <?name?>
    sign |= (buf == 61) & ((left == 37) | (left == 63))  # <%=name%>
    begin, end = np.flatnonzero(sign & ~np.r_[False, sign[:-1]]), np.flatnonzero(sign & ~np.r_[sign[1:], False]) + 1
    none = np.zeros(0, np.int64)
    if len(begin) < 2:
        return none, none, none, none
    a, b = end[:-1], begin[1:]
    i = np.flatnonzero((b - a <= NAME_BYTES) & ~_SHUT[buf[a - 1]] & (buf[a - 1] != 41) & ~_OPEN[buf[b]])
    if len(i):
        strange, letters = (np.cumsum(np.r_[False, x[buf]], dtype=np.int32) for x in (~_NAME, _UPPER | _LOWER))
        a, b = a[i], b[i]
        i = i[(strange[b] == strange[a]) & (letters[b] > letters[a])]
        a, b = end[:-1], begin[1:]
    if not len(i):
        return none, none, none, none
    a, b, first, last = a[i], b[i], begin[i], end[i + 1]
    left, right = np.minimum(a - first, DELIMITER_BYTES), np.minimum(last - b, DELIMITER_BYTES)
    lead, trail = buf[a] == 32, buf[b - 1] == 32
    lower, blanks = (np.cumsum(np.r_[False, x], dtype=np.int32) for x in (_LOWER[buf], buf == 32))
    style = np.where(lower[b] == lower[a], 3, np.where(_UPPER[buf[np.minimum(a + lead, len(buf) - 1)]], 2, 1))
    words = blanks[b] - blanks[a] - lead - trail > 0
    side = np.where(word, 1, np.where(_QUOTE[buf], 2, 0)).astype(np.uint64)
    outside = np.where(first > 0, side[np.maximum(first - 1, 0)], 0).astype(np.uint64) * np.uint64(4) + np.where(last < len(buf), side[np.minimum(last, len(buf) - 1)], 0).astype(np.uint64)
    short = b - a - lead - trail <= 2  # as of markup
    shape = style.astype(np.uint64) * np.uint64(64) + short * np.uint64(32) + words.astype(np.uint64) * np.uint64(16) + outside
    raw, kind, mirrored = shape * _STEP + lead * np.uint64(2) + trail, shape, np.ones(len(i), bool)
    for k in range(DELIMITER_BYTES):  # both read outwards from the name
        x = np.where(k < left, buf[np.maximum(a - 1 - k, 0)], 0)
        y = np.where(k < right, buf[np.minimum(b + k, len(buf) - 1)], 0)
        raw = (raw * _STEP + x.astype(np.uint64)) * _STEP + y.astype(np.uint64)
        mirrored &= _MIRROR[x] == y
        if k < 2:
            kind = (kind * _STEP + _CLASS[x]) * _STEP + _CLASS[y]
    return first, last, _bucket(raw, SLOT_BITS), _bucket(kind * _STEP + mirrored, SLOT_BITS)


def sentence_starts(buf: np.ndarray, fields: bool = False) -> np.ndarray:
    """Begins of lines and of sentences within lines; with ``fields`` also behind each ': '."""
    at = np.zeros(len(buf) + 2, bool)
    at[0] = True
    stop = _STOP_OR_COLON[buf] if fields else _STOP[buf]
    at[2 : len(buf) + 1] |= stop[:-1] & (buf[1:] == 32)
    at[1 : len(buf) + 1] |= buf == 10
    at[1 : len(buf)] |= (buf[:-1] == 0) & (buf[1:] != 0)
    return np.flatnonzero(at[: len(buf)])


def _bounds(buf: np.ndarray, fields: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of every sentence, and for every byte those of its own."""
    begin = sentence_starts(buf, fields)
    end = np.append(begin[1:], len(buf))
    n = end - begin
    return begin, end, np.repeat(begin.astype(np.int32), n), np.repeat(end.astype(np.int32), n)


def _parts(raw: bytes) -> Iterator[bytes]:
    """A text's bytes in parts of at most SLICE_BYTES, cut after a line feed or a blank where there is one."""
    at = 0
    while len(raw) - at > SLICE_BYTES:
        end = max(raw.rfind(b"\n", at, at + SLICE_BYTES), raw.rfind(b". ", at, at + SLICE_BYTES) + 1)
        end = end if end > at else at + SLICE_BYTES - 1
        yield raw[at : end + 1]
        at = end + 1
    yield raw[at:]


def _slices(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A text column as byte buffers of bounded size: (buffer, begin of each part and end, number of each part's text).

    Each text ends with a line feed and is parted from the next by padding; windows end with their
    sentence, so that no result depends on which texts lie beside it. Very long texts are several parts.
    """
    parts, starts, owners, n = [_PAD], [0], [], len(_PAD)
    for i, value in enumerate(pc.fill_null(texts.cast(pa.large_binary()), b"").to_pylist()):
        raw = _delimited(value) + b"\n"
        for part in _parts(raw):
            parts += [part, _PAD]
            n += len(part) + len(_PAD)
            starts.append(n)
            owners.append(i)
            if n >= SLICE_BYTES:
                yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(owners)
                parts, starts, owners, n = [_PAD], [0], [], len(_PAD)
    if owners:
        yield np.frombuffer(b"".join(parts), np.uint8), np.array(starts), np.array(owners)


def _inside(first: np.ndarray, last: np.ndarray, buf: np.ndarray) -> np.ndarray:
    """Which bytes lie in slots or touch them."""
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, np.maximum(first - 2, 0), 1)
    np.add.at(edge, last, -1)
    return np.cumsum(edge[:-1]) > 0


def count_vectors(buf: np.ndarray, once: bool = False) -> list[np.ndarray]:
    """Counts of the buckets of each order and of slots, in sentences; with ``once`` a sentence that the buffer repeats counts once.

    So nothing becomes natural by being repeated, be it a third of all rows.
    """
    begin, end, _, ends = _bounds(buf)
    keep = np.ones(len(begin), bool)
    grams = gram_buckets(buf)
    if once:
        code = np.add.reduceat((grams[-1].astype(np.uint64) + np.uint64(1)) * _MIX, begin)
        keep[:] = False
        keep[np.unique(code, return_index=True)[1]] = True
    kept, at, out = np.repeat(keep, end - begin) & (buf != 0), np.arange(len(buf), dtype=np.int32), []
    for (n, bits), g in zip(ORDERS, grams):
        out.append(np.bincount(g[kept & (at + n <= ends)], minlength=1 << bits))
    first, last, raw, kind = slot_spans(buf)
    whole = kept[first] & (last <= ends[first])
    out += [np.bincount(x[whole], minlength=1 << SLOT_BITS) for x in (raw, kind)]
    return [x.astype(np.int64) for x in out]


def corpus_counts(docs: DataFrame, text_col: str = "text") -> list[np.ndarray]:
    """Counts over all texts: one vector per task, added up by range of buckets in LANES lanes and then over the lanes.

    A sentence counts once in each slice of SLICE_BYTES. Only the sums, which are of fixed size, reach the driver.
    """
    total = sum(SIZES)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(total, np.int64)
        for batch in batches:
            for buf, _, _ in _slices(batch.column(0)):
                sums += np.concatenate(count_vectors(buf, once=True))
        cuts = range(0, total, RANGE)
        lane = TaskContext.get().partitionId() % LANES
        packed = [zlib.compress(sums[k : k + RANGE].tobytes(), 1) for k in cuts]
        yield pa.RecordBatch.from_arrays([pa.array([k // RANGE for k in cuts], pa.int32()), pa.array([lane] * len(packed), pa.int32()), pa.array(packed, pa.binary())], ["part", "lane", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for part, lane, v in zip(*(c.to_pylist() for c in batch.columns)):
                x = np.frombuffer(zlib.decompress(v), np.int64)
                sums[part, lane] = sums[part, lane] + x if (part, lane) in sums else x
        rows = list(sums.items())
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k, _ in rows], pa.int32()), pa.array([k[1] for k, _ in rows], pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for _, v in rows], pa.binary())], ["part", "lane", "v"])

    schema = "part int, lane int, v binary"
    vectors = docs.select(text_col).filter(F.length(text_col) > 0).mapInArrow(count, schema)
    lanes = vectors.repartition("part", "lane").mapInArrow(add, schema).withColumn("lane", F.lit(0))
    sums = np.zeros(total, np.int64)
    for part, _, v in lanes.repartition("part").mapInArrow(add, schema).collect():
        sums[part * RANGE : (part + 1) * RANGE] += np.frombuffer(zlib.decompress(v), np.int64)
    return np.split(sums, np.cumsum(SIZES)[:-1])


def _text(lines: list[str]) -> np.ndarray:
    return np.frombuffer(_delimited(("\n".join(lines) + "\n").encode()), np.uint8)


def _flat(groups: dict[str, list[str]]) -> list[str]:
    return [line for lines in groups.values() for line in lines]


@dataclass
class ResidueModel:
    """Log-likelihood ratios against natural text, and how they are read.

    ``tables``: thousandths, one table per order, TEXT_KINDS x buckets. ``slots``: log-probability per byte of a slot's
    raw and class bucket in natural text, slots and code. ``half_window``: bytes on both sides of a place.
    ``threshold``: mean ratio of a window that speaks for residue. ``coverage`` and ``evidence``: share of the
    sentence under such windows, and the sum of their ratios. ``slot_ratio``: ratio of a slot; ``talk``: window
    of the contrast model in the rest of its sentence beyond which the slot is only talked about.
    """

    tables: list[np.ndarray]
    slots: np.ndarray
    half_window: int = 14
    threshold: float = 0.2
    coverage: float = 0.65
    evidence: float = 12.0
    field_evidence: float = 10.0
    slot_ratio: float = 2.5
    code_ratio: float = -1.5
    talk: float = 0.9

    @classmethod
    def fit(cls, natural: list[np.ndarray], examples: dict[str, dict[str, list[str]]] | None = None) -> ResidueModel:
        """The models of ``examples`` (kind -> group -> lines) against the counts of natural text."""
        seeds = X.examples() if examples is None else examples
        form = {"form": seeds["slot"].get("form", [])}
        lines = {k: _flat(form if k == "form" else seeds[k]) for k in TEXT_KINDS}
        tables = []
        for j, (n, bits) in enumerate(ORDERS):
            counts = []
            for kind in TEXT_KINDS:
                buf = _text(lines[kind])
                _, _, _, ends = _bounds(buf, kind == "form")
                inside = np.arange(len(buf)) + n <= ends
                if kind == "contrast":
                    inside &= ~_inside(*slot_spans(buf)[:2], buf)
                counts.append(np.minimum(np.bincount(gram_buckets(buf)[j][inside], minlength=1 << bits), 40))
            pool = sum(c / max(c.sum(), 1) for c in counts) / len(counts)
            p = natural[j] + 0.5 + POOL * pool
            p /= p.sum()
            table = np.zeros((len(TEXT_KINDS), (1 << bits) + 1), np.int16)  # the last entry is that of no n-gram
            for k, c in enumerate(counts):
                prior = PRIOR * c.sum()
                table[k, :-1] = np.round(1000 * np.clip(np.log((c / p + prior + 1e-9) / (c.sum() + prior + 1e-9)), -4, 4))
            tables.append(table)
        slot_lines = _flat({d: x for d, x in seeds["slot"].items() if d != "form"})
        code = seeds["contrast"].get("code", [])
        of = [(natural[-2], natural[-1], natural[0].sum() + 10 * POOL), *((*count_vectors(_text(x))[-2:], len(_text(x))) for x in (slot_lines, code))]
        # a raw form that was never seen gets a small part of its class
        return cls(tables, np.array([[0.8 * raw / size, 0.02 * (kind + 0.05) / size] for raw, kind, size in of]))

    def windows(self, buf: np.ndarray, grams: list[np.ndarray], kinds: tuple[int, ...], places: np.ndarray, begins: np.ndarray, ends: np.ndarray, masked: np.ndarray | None = None, least: int = 1) -> list[np.ndarray]:
        """For each kind the mean ratio of the window around each of ``places``, within its sentence; -4 where fewer than ``least`` n-grams lie in it.

        Sums are whole numbers, so a window's mean does not depend on what stands before it.
        """
        n, at = len(buf), np.arange(len(buf), dtype=np.int32)
        whole = [(at + m <= ends) & (buf != 0) for m, _ in ORDERS]
        if masked is not None:
            whole = [w & ~masked for w in whole]
        grams = [np.where(w, g, np.uint32(table.shape[1] - 1)) for w, g, table in zip(whole, grams, self.tables)]
        lo, hi = np.maximum(begins[places], places - self.half_window), np.minimum(ends[places], places + self.half_window + 1)
        run = np.zeros(n + 1, np.int32)
        np.cumsum(whole[0].view(np.int8) + whole[1].view(np.int8), out=run[1:])
        count = run[hi] - run[lo]
        few = count < least
        count = 1000.0 * np.maximum(count, 1).astype(np.float32)
        out = []
        for k in kinds:
            total = self.tables[0][k][grams[0]] + self.tables[1][k][grams[1]]
            np.cumsum(total, out=run[1:])
            mean = (run[hi] - run[lo]) / count
            mean[few] = -4.0
            out.append(mean)
        return out

    def slot_ratios(self, raw: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log-likelihood ratios of slots against natural text and against code."""
        natural, slot, code = (np.log(x[0][raw] + x[1][kind]) for x in self.slots)
        return slot - natural, slot - code


def _places(buf: np.ndarray, begins: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every STRIDE-th byte of each sentence, the number of its sentence, and how many bytes (without line feeds and padding) it stands for."""
    places = np.flatnonzero(((np.arange(len(buf), dtype=np.int32) - begins) & (STRIDE - 1)) == 0).astype(np.int32)
    weight = np.add.reduceat(((buf != 10) & (buf != 0)).view(np.int8), places, dtype=np.int32)
    return places, np.searchsorted(begin, places, side="right") - 1, weight


def residue_sentences(model: ResidueModel, texts: pa.Array) -> Iterator[tuple[int, str, str, float]]:
    """(number of the text, kind, sentence, share of it covered) of every sentence that is residue."""
    reported = {0: "filler", 1: "error", 2: "script"}
    contrast = len(TEXT_KINDS) - 1
    for buf, starts, owners in _slices(texts):
        found: dict[int, tuple[str, float]] = {}
        begin, end, begins, ends = _bounds(buf)
        grams = gram_buckets(buf)

        # sentences of filler, error and script notices
        places, of, weight = _places(buf, begins, begin)
        *scores, talk = model.windows(buf, grams, (0, 1, 2, contrast), places, begins, ends)
        best = np.maximum(np.maximum(scores[0], scores[1]), scores[2])
        hit = (best > model.threshold) & (best > talk)
        share = np.bincount(of, weight * hit, len(begin)) / np.maximum(np.bincount(of, weight, len(begin)), 1)
        ratio = np.bincount(of, np.where(hit, best * weight, 0.0), len(begin))
        taken = np.flatnonzero((share >= model.coverage) & (ratio >= model.evidence))
        if len(taken):
            sums = np.array([np.bincount(of, np.where(hit, x * weight, 0.0), len(begin))[taken] for x in scores])
            for i, k in zip(taken, sums.argmax(axis=0)):
                found[begin[i]] = (reported[int(k)], float(share[i]))

        # unfilled form fields: what stands behind a colon, or alone on its line
        f_begin, f_end, f_begins, f_ends = _bounds(buf, fields=True)
        f_places, f_of, f_weight = _places(buf, f_begins, f_begin)
        (form,) = model.windows(buf, grams, (3,), f_places, f_begins, f_ends)
        marked = form > model.threshold
        covered = np.bincount(f_of, f_weight * marked, len(f_begin)) >= 0.9 * np.maximum(np.bincount(f_of, f_weight, len(f_begin)), 1)
        ratio = np.bincount(f_of, np.where(marked, form * f_weight, 0.0), len(f_begin))
        line_end = (buf[f_end - 1] == 10) | (f_end >= len(buf))
        for i in np.flatnonzero(covered & line_end & (ratio >= model.field_evidence)):
            at = f_begin[i]
            if at == 0 or buf[at - 1] in (0, 10) or buf[at - 2] == 58:
                found.setdefault(begin[np.searchsorted(begin, at, side="right") - 1], ("slot", 1.0))

        # slots in sentences that do not talk about them
        first, last, raw, kind = slot_spans(buf)
        if len(first):
            against_text, against_code = model.slot_ratios(raw, kind)
            keep = (against_text > model.slot_ratio) & (against_code > model.code_ratio) & (last <= ends[first])
            if keep.any():
                (talk,) = model.windows(buf, grams, (contrast,), places, begins, ends, _inside(first, last, buf), least=13)
                worst = np.full(len(begin), -4.0)
                np.maximum.at(worst, of, talk)
                for at in np.unique(begins[first[keep]]):
                    if worst[np.searchsorted(begin, at)] < model.talk:
                        found[at] = ("slot", found.get(at, ("", 0.0))[1])
        for at, (name, part) in sorted(found.items()):
            stop = end[np.searchsorted(begin, at)]
            sentence = buf[at:stop].tobytes().decode(errors="replace").strip().strip("\0")
            if sentence:
                yield int(owners[np.searchsorted(starts, at, side="right") - 1]), name, sentence, part


def held_out(natural: list[np.ndarray], folds: int = 10, examples: dict[str, dict[str, list[str]]] | None = None, by_delimiter: bool = False) -> dict[tuple[str, str], tuple[int, int]]:
    """Cross-validation over the written examples: (kind, group) -> (lines found as residue, lines).

    Each fold of lines (or of delimiters of slots) is judged by a model fitted on the other folds. Lines of
    the kind 'contrast' ought not to be found.
    """
    seeds = X.examples() if examples is None else examples
    out: dict[tuple[str, str], tuple[int, int]] = {}
    for f in range(folds):
        rest: dict[str, dict[str, list[str]]] = {}
        tested: list[tuple[str, str, str]] = []
        for kind, groups in seeds.items():
            rest[kind] = {}
            for g, (group, lines) in enumerate(groups.items()):
                leave = by_delimiter and kind == "slot" and group != "form"
                rest[kind][group] = [x for i, x in enumerate(lines) if (g if leave else i) % folds != f]
                tested += [(kind, group, x) for i, x in enumerate(lines) if (g if leave else i) % folds == f]
        model = ResidueModel.fit(natural, rest)
        hits = {i for i, _, _, _ in residue_sentences(model, pa.array([x for _, _, x in tested], pa.large_string()))}
        for i, (kind, group, _) in enumerate(tested):
            n, m = out.get((kind, group), (0, 0))
            out[kind, group] = (n + (i in hits), m + 1)
    return out


def residue_documents(docs: DataFrame, doc_id: str = "doc_id", text_col: str = "text", examples: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Documents in which residue stands in place of content: doc_id and kinds (sorted).

    The natural model is counted over all texts (see ``corpus_counts``), and every text is scored whole. Null, empty and
    blank texts are no cases; a repeated document counts once; other columns are ignored. ``examples`` replaces the
    written examples (kind -> group -> lines), for other languages or kinds of sites.
    """
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(ResidueModel.fit(corpus_counts(docs, text_col), examples))
    out_type = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField("kind", T.StringType())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sorted({(i, kind) for i, kind, _, _ in residue_sentences(held.value, batch.column(1))})
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in found], pa.int64())), pa.array([k for _, k in found], pa.string())], out_type.names)

    rows = docs.select(doc_id, text_col).filter(F.length(F.trim(text_col)) > 0).mapInArrow(score, out_type)
    return rows.groupBy(doc_id).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
