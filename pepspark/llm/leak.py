"""Evaluation texts leaking into training text, by pigeonhole edit matching.

Words are compared in a normal form (no markup, case, accents, punctuation or look-alike letters).
A passage of ``passage_words`` words is there if at most ``budget`` of its words were changed, added or
dropped, or if two parts of it that stand apart have no more edits between them. The gap is one more
error: split into budget + 2 pieces, a passage keeps one of them whole. The pieces of all passages of
all test items form the index. Documents are scanned for exact piece hits, and around each hit Myers'
bit-parallel edit distance verifies the passages that hold the piece.
"""

from __future__ import annotations

import html
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from pepspark.session import materialize

PASSAGE_WORDS = 18
BUDGET = 2
#: Shortest part of a passage that counts when its parts stand apart.
PART_WORDS = 6
#: Words of test items that are searched for in one pass; more items are searched in several passes.
BLOCK_WORDS = 2_000_000
#: Characters of a text whose words are made at a time; longer texts are cut at white space.
SEGMENT_CHARS = 1_000_000
#: Words of texts that are searched at a time.
BATCH_WORDS = 500_000

_BLOCK_TAG = re.compile(r"</?(?:p|br|hr|div|li|ul|ol|tr|td|th|table|h[1-6]|blockquote|pre|section|article)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[A-Za-z][^<>]*>")
_HYPHEN_BREAK = re.compile(r"(?<=\w)[-‐]\s*\n\s*(?=\w)")
_DROPPED = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_ESCAPED_SPACE = re.compile(r"\\[nrt]")
_ESCAPED_CODE = re.compile(r"\\u([0-9a-fA-F]{4})")
_NOT_WORD = re.compile(r"[\W_]+")
# Cyrillic and Greek letters that look like Latin ones.
_LOOKALIKE = str.maketrans("авеёкмнорстухіјѕһԁԛԝοαικνρτυχ", "abeekmhopctyxijshdqwoaiknptux")


def normal_words(text: str) -> list[str]:
    """The words of a text (split at white space) in their normal form; words of nothing but signs are left out."""
    if "\\" in text:  # texts written into JSON or code
        text = _ESCAPED_CODE.sub(lambda m: chr(int(m[1], 16)), _ESCAPED_SPACE.sub(" ", text))
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = _TAG.sub("", _BLOCK_TAG.sub(" ", text))
    if not text.isascii():
        text = unicodedata.normalize("NFKD", _DROPPED.sub("", text)).casefold()
        text = "".join(c for c in text if not unicodedata.combining(c)).translate(_LOOKALIKE)
    else:
        text = text.lower()
    if "-\n" in text or "‐" in text or "- \n" in text:
        text = _HYPHEN_BREAK.sub("", text)
    return [w for w in (w if w.isalnum() else _NOT_WORD.sub("", w) for w in text.split()) if w]


def _words(text: str) -> list[str]:
    """The words of a text of any length; those of very long texts are made part by part and kept once each."""
    if len(text) <= SEGMENT_CHARS:
        return normal_words(text)
    out: list[str] = []
    known: dict[str, str] = {}
    at = 0
    while at < len(text):
        end = at + SEGMENT_CHARS
        gap = re.compile(r"\s").search(text, end)
        end = gap.start() if gap else len(text)
        out += [known.setdefault(w, w) for w in normal_words(text[at:end])]
        at = end
    return out


def myers_distance(pattern: list[str], text: list[str]) -> int:
    """Least edit distance (in words) of ``pattern`` and any part of ``text``, bit-parallel."""
    m = len(pattern)
    if not m:
        return 0
    peq: dict[str, int] = defaultdict(int)
    for i, w in enumerate(pattern):
        peq[w] |= 1 << i
    mask, high = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score, best = mask, 0, m, m
    for w in text:
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (~(xh | pv) & mask)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & mask
        mh = (mh << 1) & mask
        pv = mh | (~(xv | ph) & mask)
        mv = ph & xv
        best = min(best, score)
    return best


@dataclass
class ItemIndex:
    """The pieces of a block of test items."""

    passage_words: int = PASSAGE_WORDS
    budget: int = BUDGET
    part_words: int = PART_WORDS
    words: dict[int, list[str]] = field(default_factory=dict)
    vocabulary: dict[str, int] = field(default_factory=dict)
    #: length -> hash of a piece -> [(item, word of the item)]; items shorter than a piece are one piece of their own length.
    pieces: dict[int, dict[int, list[tuple[int, int]]]] = field(default_factory=lambda: defaultdict(lambda: defaultdict(list)))
    _sorted: dict[int, np.ndarray] = field(default_factory=dict)

    @property
    def piece_words(self) -> int:
        return max(1, self.passage_words // (self.budget + 2))

    def add(self, item_id: int, text: str | None) -> None:
        w = _words(text or "")
        if not w:
            return
        self.words[item_id] = w
        ids = np.array([self.vocabulary.setdefault(x, len(self.vocabulary)) for x in w], np.int64)
        q = min(self.piece_words, len(w))
        for k, code in enumerate(self._codes(ids, q).tolist()):
            self.pieces[q][code].append((item_id, k))
        self._sorted.clear()

    def edits(self, n: int) -> int:
        """Edits allowed in a passage, or in the whole of an item of n words, if that is shorter."""
        return n * self.budget // self.passage_words

    @staticmethod
    def _codes(ids: np.ndarray, q: int) -> np.ndarray:
        """Hash of the q words that begin at each place."""
        n = len(ids) - q + 1
        code = np.zeros(max(n, 0), np.int64)
        for k in range(q if n > 0 else 0):
            code = code * np.int64(0x5851F42D4C957F2D) + ids[k : k + n] + 1
        return code

    def hits(self, ids: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(place, item, word of the item) of the exact piece hits; words that no item has are -1."""
        known = np.cumsum(np.r_[0, ids < 0])
        for q, table in self.pieces.items():
            if len(ids) < q:
                continue
            if q not in self._sorted:
                self._sorted[q] = np.sort(np.fromiter(table, np.int64, len(table)))
            keys = self._sorted[q]
            at = np.flatnonzero(known[q:] == known[:-q])
            codes = self._codes(ids, q)[at]
            there = keys[np.minimum(np.searchsorted(keys, codes), len(keys) - 1)] == codes
            for j, code in zip(at[there].tolist(), codes[there].tolist()):
                for item, i in table[code]:
                    yield j, item, i

    def search(self, texts: list[str | None]) -> list[tuple[int, int]]:
        """(number of the text, item) of all texts that hold an item or a passage of it."""
        out: list[tuple[int, int]] = []
        lists: list[list[str]] = []
        first, total = 0, 0
        for k, text in enumerate(texts):
            lists.append(_words(text or ""))
            total += len(lists[-1])
            if total >= BATCH_WORDS or k == len(texts) - 1:
                out += [(first + t, item) for t, item in self._search(lists)]
                first, total, lists = k + 1, 0, []
        return out

    def found(self, text: str | None) -> list[int]:
        return [item for _, item in self.search([text])]

    def _search(self, lists: list[list[str]]) -> Iterator[tuple[int, int]]:
        # all texts in one array, parted by words that no item has
        get = self.vocabulary.get
        ids = np.fromiter((i for w in lists for i in (*(get(x, -1) for x in w), -1)), np.int64, sum(len(w) + 1 for w in lists))
        starts = np.cumsum([0] + [len(w) + 1 for w in lists])
        by_pair: dict[tuple[int, int], list[tuple[int, int]]] = defaultdict(list)
        for j, item, i in self.hits(ids):
            t = int(np.searchsorted(starts, j, side="right")) - 1
            by_pair[t, item].append((j - int(starts[t]), i))
        known: dict[int, set[str]] = {}
        for (t, item), places in by_pair.items():
            if t not in known:
                known = {t: set(lists[t])}
            if self._holds(self.words[item], lists[t], known[t], sorted(places)):
                yield t, item

    def _holds(self, words: list[str], w: list[str], known: set[str], hits: list[tuple[int, int]]) -> bool:
        """Whether the text holds a passage of the item (or all of a shorter item), in one piece or in two parts."""
        m = min(self.passage_words, len(words))
        e = self.edits(m)
        # a passage is possible only where all but e of its words occur in the text at all
        missing = [0]
        for x in words:
            missing.append(missing[-1] + (x not in known))
        possible = {a for a in range(len(words) - m + 1) if missing[a + m] - missing[a] <= e}
        if not possible:
            return False
        at, done, q = set(hits), set(), min(self.piece_words, len(words))
        for j, i in hits:
            if (j - 1, i - 1) in at:
                continue
            n = q
            while (j + n - q + 1, i + n - q + 1) in at:
                n += 1
            for a in range(max(0, i + n - m), min(i, len(words) - m) + 1) if n < m else range(i, i + 1):
                b = j + a - i
                if a in possible and (a, b) not in done:
                    done.add((a, b))
                    if n >= m or myers_distance(words[a : a + m], w[max(0, b - e) : max(0, b + m + e)]) <= e:
                        return True
        return m == self.passage_words >= 2 * self.part_words and self._apart(words, w, hits, possible)

    def _apart(self, words: list[str], w: list[str], hits: list[tuple[int, int]], possible: set[int]) -> bool:
        """Whether two parts side by side in the item make up a passage with the edits of both within the budget.

        One of the two holds a hit and is verified around it, the other is looked for in the whole text.
        """
        m, e, q = self.passage_words, self.budget, self.piece_words
        near: dict[tuple[int, int], int] = {}
        far: dict[tuple[int, int], int] = {}
        for j, i in hits:
            for n in range(self.part_words, m - self.part_words + 1):
                for a in range(max(0, i + q - n), min(i, len(words) - n) + 1):
                    if a not in possible and a - (m - n) not in possible:
                        continue
                    b = j + a - i
                    d = myers_distance(words[a : a + n], w[max(0, b - e) : max(0, b + n + e)])
                    if d >= near.get((a, n), e + 1):
                        continue
                    near[a, n] = d
                    for start, other in ((a, a + n), (a - (m - n), a - (m - n))):
                        if start not in possible:
                            continue
                        key = (other, m - n)
                        if key not in far:
                            far[key] = myers_distance(words[other : other + m - n], w)
                        if d + far[key] <= e:
                            return True
        return False


def leaked_items(
    docs: DataFrame,
    items: DataFrame,
    passage_words: int = PASSAGE_WORDS,
    budget: int = BUDGET,
    part_words: int = PART_WORDS,
    block_words: int = BLOCK_WORDS,
    doc_id: str = "doc_id",
    item_id: str = "item_id",
    text_col: str = "text",
) -> DataFrame:
    """Pairs of a document and a test item of which it holds the whole or a passage.

    Documents are read once for each block of about ``block_words`` words of items (the stated query set;
    its index is what is sent to the tasks, so its size is bounded). With several blocks the pairs of each
    are written before the next is read, so the driver holds one block at a time. Null and empty texts of either
    side give no pairs; items of fewer words than a passage match as a whole, with edits in proportion; a repeated document or item
    counts once; other columns are ignored. The whole text of every document is searched.
    """
    sizes = items.agg(F.sum(F.length(text_col))).first()[0] or 0
    blocks = max(1, -(-int(sizes) // (block_words * 4)))
    item_type = items.schema[item_id].dataType
    out_type = T.StructType([T.StructField(doc_id, docs.schema[doc_id].dataType), T.StructField(item_id, item_type)])
    out_arrow = to_arrow_type(item_type)
    result = None
    for b in range(blocks):
        part = items.filter(F.col(text_col).isNotNull()).select(item_id, text_col)
        if blocks > 1:
            part = part.filter(F.pmod(F.xxhash64(item_id), F.lit(blocks)) == b)
        rows = [(r[0], r[1]) for r in part.distinct().toLocalIterator()]
        held = docs.sparkSession.sparkContext.broadcast((rows, passage_words, budget, part_words))
        built: list[ItemIndex] = []

        def search(batches: Iterator[pa.RecordBatch], held=held, built=built) -> Iterator[pa.RecordBatch]:
            if not built:
                texts, *params = held.value
                index = ItemIndex(*params)
                for item, text in texts:
                    index.add(item, text)
                built.append(index)
            for batch in batches:
                pairs = built[0].search(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([k for k, _ in pairs], pa.int64())), pa.array([i for _, i in pairs], out_arrow)], out_type.names)

        pairs = docs.select(doc_id, text_col).filter(F.length(text_col) > 0).mapInArrow(search, out_type)
        if blocks > 1:
            pairs = materialize(pairs.distinct(), "leak")
            held.destroy()
        result = pairs if result is None else result.unionByName(pairs)
    return result.distinct()
