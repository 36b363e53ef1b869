"""Join-shaped operators: tolerance and nearest joins, references, coverage."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pepspark.session import BROADCAST_LIMIT, materialize

#: Rows of the timeline in a stretch of the nearest join, and most stretches of one timeline.
STRETCH_ROWS = 4096
MAX_STRETCHES = 1_000_000


def tolerance_join(left: DataFrame, right: DataFrame, left_value: str, right_value: str, rtol: float | None = None, atol: float | None = None, on: list[str] | None = None) -> DataFrame:
    """Pairs of rows whose values differ by less than the tolerance (strictly), as an equi-join on buckets.

    ``atol`` is absolute, ``rtol`` relative to the right (observed) value; values must be positive for
    ``rtol``. Each left row goes to its own bucket and each right row to the buckets its tolerance
    reaches (two at most), so no pair is missed or doubled. ``on`` names columns that both sides share
    and that must be equal. Null and NaN values match nothing. Column names other than ``on`` must differ.
    """
    if (rtol is None) == (atol is None):
        raise ValueError("give rtol or atol")
    on = on or []
    lv, rv = F.col(left_value), F.col(right_value)
    if atol is not None:
        width = max(atol, 1e-12)
        bucket = lambda v: F.floor(v / F.lit(width)).cast("bigint")
        low, high = rv - atol, rv + atol
        near = F.abs(lv - rv) < atol
    else:
        import math

        width = math.log1p(2 * rtol)
        bucket = lambda v: F.floor(F.log(v) / F.lit(width)).cast("bigint")
        low, high = rv * (1 - rtol), rv * (1 + rtol)
        near = (lv > 0) & (rv > 0) & (F.abs(lv - rv) / rv < rtol)
    fine = lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & ((v > 0) if rtol is not None else F.lit(True))
    a = left.filter(fine(lv)).withColumn("__bucket", bucket(lv))
    b = right.filter(fine(rv)).withColumn("__bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return a.join(b, [*on, "__bucket"]).filter(near).drop("__bucket")


def nearest_join(probes: DataFrame, timeline: DataFrame, probe_value: str, line_value: str, on: list[str] | None = None, width: float | None = None) -> DataFrame:
    """For each probe the row of the timeline with the nearest value; ties go to the smaller value.

    As-of in both directions by one sort: probes and timeline are put in one order per stretch of
    ``width`` (default: so that a stretch holds about STRETCH_ROWS rows of the timeline), the last and next timeline rows are carried along, and those of
    the stretches before and after are added as each stretch's edge rows. Columns other than ``on``
    must differ; probes with a null value, or without any timeline row, are left out.
    """
    on = on or []
    if width is None:
        lo, hi, n = timeline.agg(F.min(line_value), F.max(line_value), F.count(line_value)).first()
        if not n:
            fields = [*(probes.schema[c] for c in on), *(f for f in probes.schema if f.name not in on), *(f for f in timeline.schema if f.name not in on)]
            return probes.sparkSession.createDataFrame([], StructType(fields))
        stretches = min(max(int(n) // STRETCH_ROWS, 1), MAX_STRETCHES)
        width = max((float(hi) - float(lo)) / stretches, 1e-9)
    keys = [*on, "__s"]
    cell = lambda v: F.floor(F.col(v) / F.lit(width)).cast("bigint")
    payload = F.struct(F.col(line_value).cast("double").alias("__v"), *[F.col(c) for c in timeline.columns if c not in on])
    line = timeline.filter(F.col(line_value).isNotNull()).select(*on, payload.alias("__row")).withColumn("__s", F.floor(F.col("__row.__v") / F.lit(width)).cast("bigint"))
    edges = line.groupBy(*keys).agg(F.min("__row").alias("__first"), F.max("__row").alias("__last"))
    stretches = probes.filter(F.col(probe_value).isNotNull()).select(*on, cell(probe_value).alias("__s")).distinct()
    both = stretches.join(edges, keys, "full")
    group = Window.partitionBy(*on) if on else Window.partitionBy(F.lit(0))  # one row per stretch
    before = F.last("__last", True).over(group.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last("__first", True).over(group.orderBy(F.col("__s").desc()).rowsBetween(Window.unboundedPreceding, -1))
    both = both.withColumn("__before", before).withColumn("__after", after)
    t = probes.filter(F.col(probe_value).isNotNull()).withColumn("__s", cell(probe_value)).withColumn("__probe", F.struct(*[F.col(c) for c in probes.columns if c not in on]))
    row_type = line.schema["__row"].dataType
    events = t.select(*keys, F.col(probe_value).cast("double").alias("__at"), F.lit(1).alias("__kind"), "__probe", F.lit(None).cast(row_type).alias("__row")).unionByName(
        line.select(*keys, F.col("__row.__v").alias("__at"), F.lit(0).alias("__kind"), F.lit(None).cast(t.schema["__probe"].dataType).alias("__probe"), "__row")
    )
    w = Window.partitionBy(*keys).orderBy("__at", "__kind")
    down = F.last("__row", True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    back = Window.partitionBy(*keys).orderBy(F.col("__at").desc(), F.col("__kind").desc())  # a running frame from the other end, not one that shrinks
    up = F.last("__row", True).over(back.rowsBetween(Window.unboundedPreceding, 0))
    placed = events.withColumn("__down", down).withColumn("__up", up).filter("__kind = 1").join(both.select(*keys, "__before", "__after"), keys, "left")
    candidates = F.array_compact(F.array("__down", "__before", "__up", "__after"))
    best = F.array_sort(F.transform(candidates, lambda r: F.struct(F.abs(r["__v"] - F.col("__at")).alias("e"), r["__v"].alias("v"), r.alias("r"))))
    out = placed.withColumn("__best", F.get(best, F.lit(0))["r"]).filter("__best is not null")
    return out.select(*on, *[F.col("__probe")[c].alias(c) for c in probes.columns if c not in on], *[F.col("__best")[c].alias(c) for c in timeline.columns if c not in on])


def time_slice(timeline: DataFrame, value: str, start: float, end: float) -> DataFrame:
    """Rows between the rows nearest to ``start`` and ``end``, both included."""
    near = lambda t: F.min_by(value, F.struct(F.abs(F.col(value) - t), F.col(value)))
    ends = timeline.filter(F.col(value).isNotNull()).agg(near(start).alias("__lo"), near(end).alias("__hi"))
    return timeline.join(F.broadcast(ends), (F.col(value) >= F.col("__lo")) & (F.col(value) <= F.col("__hi"))).drop("__lo", "__hi")


def resolve_references(df: DataFrame, targets: dict[str, tuple[DataFrame, str]], prefix: bool = True) -> DataFrame:
    """Left join of each reference column with its target table: column -> (table, key).

    Unresolved references stay with nulls. Columns come out as '<column>_<name>' (or as they are).
    Targets must be unique by key. Small ones are broadcast by the optimizer's own size check.
    """
    for column, (table, key) in targets.items():
        names = [c for c in table.columns if c != key]
        side = table.select(F.col(key).alias(f"__{column}"), *[F.col(c).alias(f"{column}_{c}" if prefix else c) for c in names])
        df = df.join(side, F.col(column) == F.col(f"__{column}"), "left").drop(f"__{column}")
    return df


def resolve_reference_lists(df: DataFrame, id_col: str, refs_col: str, table: DataFrame, key: str, sep: str = " ") -> DataFrame:
    """Space-separated references of each row -> array of the referred structs, in order; unresolved ones are left out."""
    refs = df.select(id_col, F.posexplode(F.split(F.trim(F.col(refs_col)), sep)).alias("__pos", "__ref"))
    hit = refs.join(table.withColumnRenamed(key, "__ref"), "__ref")
    cols = [c for c in table.columns if c != key]
    rows = hit.groupBy(id_col).agg(F.transform(F.array_sort(F.collect_list(F.struct("__pos", F.struct(F.col("__ref").alias(key), *cols).alias("r")))), lambda x: x["r"]).alias(f"{refs_col}_rows"))
    return df.join(rows, id_col, "left")


@dataclass
class PeptideIndex:
    """Peptides by the length of their seed: the longest power of two of residues that they begin with.

    A hash is a difference of prefix sums of values times powers of an odd base modulo 2^64, so the hashes of all
    pieces of a text, of whatever length, are a few array operations. There is one pass over a text for each seed length.
    ``by_seed``: seed length -> (sorted seed hashes, hashes of the whole peptides, their bytes' lengths, their texts).
    """

    by_seed: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]

    #: Bytes of one pass over texts.
    SLICE: ClassVar[int] = 1_000_000
    _BASE: ClassVar[int] = 0x9E3779B97F4A7C15
    _VALUES: ClassVar[np.ndarray] = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64)

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n + 1, np.uint64(base), np.uint64)
        out[0] = 1
        return np.multiply.accumulate(out)

    @classmethod
    def _sums(cls, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Prefix sums, and what takes the place out of a hash."""
        sums = np.r_[np.uint64(0), np.cumsum(cls._VALUES[buf] * cls._powers(cls._BASE, len(buf))[:-1], dtype=np.uint64)]
        return sums, cls._powers(pow(cls._BASE, -1, 1 << 64), len(buf))

    @classmethod
    def build(cls, peptides: list[str]) -> PeptideIndex:
        raws = [p.encode() for p in peptides]
        out = {}
        if raws:
            lens = np.array([len(r) for r in raws])
            begins = np.cumsum(np.r_[0, lens[:-1]])
            sums, unit = cls._sums(np.frombuffer(b"".join(raws), np.uint8))
            seeds = 1 << np.floor(np.log2(lens)).astype(np.int64)
            texts = pa.array(raws, pa.large_binary())
            for k in np.unique(seeds):
                i = np.flatnonzero(seeds == k)
                code = (sums[begins[i] + k] - sums[begins[i]]) * unit[begins[i]]
                i = i[np.argsort(code, kind="stable")]
                out[int(k)] = (np.sort(code), (sums[begins[i] + lens[i]] - sums[begins[i]]) * unit[begins[i]], lens[i], texts.take(pa.array(i)))
        return cls(out)

    def search(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        """(row, start, length, peptide) of the hits, slice by slice; ``start`` and ``length`` count characters."""
        rows, parts, size = [], [], 0
        for i, text in enumerate(texts.to_pylist()):
            rows.append(i)
            parts.append((text or "").encode())
            size += len(parts[-1]) + 1
            if size >= self.SLICE or i == len(texts) - 1:
                yield from self._search(np.array(rows), parts)
                rows, parts, size = [], [], 0

    def _search(self, rows: np.ndarray, parts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]]:
        raw = b"\n".join(parts)
        buf = np.frombuffer(raw, np.uint8)
        lens = np.array([len(p) for p in parts])
        begins = np.cumsum(np.r_[0, lens[:-1] + 1])
        sums, unit = self._sums(buf)
        owner = np.repeat(np.arange(len(parts)), lens + 1)[: len(buf)]
        last = (begins + lens)[owner]
        chars = None if raw.isascii() else np.cumsum(np.r_[0, (buf & 0xC0) != 0x80])
        for k, (codes, wholes, sizes, texts) in self.by_seed.items():
            if k > len(buf):
                continue
            here = (sums[k:] - sums[:-k]) * unit[: len(buf) - k + 1]
            first = np.minimum(np.searchsorted(codes, here), len(codes) - 1)
            hit = np.flatnonzero((codes[first] == here) & (np.arange(len(here)) + k <= last[: len(here)]))
            n = np.searchsorted(codes, here[hit], side="right") - first[hit]
            which = np.repeat(first[hit] - np.cumsum(n) + n, n) + np.arange(n.sum())
            hit = np.repeat(hit, n)
            inside = hit + sizes[which] <= last[hit]
            hit, which = hit[inside], which[inside]
            same = (sums[hit + sizes[which]] - sums[hit]) * unit[hit] == wholes[which]
            hit, which = hit[same], which[same]
            if not len(hit):
                continue
            text, size = texts.take(pa.array(which)), sizes[which]
            offsets = np.r_[0, np.cumsum(size)]
            span = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(hit), [None, pa.py_buffer(offsets), pa.py_buffer(buf[np.repeat(hit - offsets[:-1], size) + np.arange(offsets[-1])])])
            true = pc.equal(text, span)
            hit, size, text = hit[np.asarray(true)], size[np.asarray(true)], text.filter(true)
            row = owner[hit]
            start = hit - begins[row] if chars is None else chars[hit] - chars[begins[row]]
            yield rows[row], start, size if chars is None else chars[hit + size] - chars[hit], text.cast(pa.large_string()).cast(pa.string())


def coverage_counts(proteins: DataFrame, peptides: DataFrame, protein_id: str, sequence: str, peptide: str, block_bytes: int = BROADCAST_LIMIT) -> DataFrame:
    """Occurrences (overlapping ones too) of peptides in proteins: protein_id, start (from 0), length, peptide.

    Rolling hashes of the texts are compared with those of the peptides (see PeptideIndex) in Arrow batches; hits are compared in full. The peptides' hashes are sent to the tasks in blocks of at most ``block_bytes`` of text
    (by hash of the peptide), and the proteins are read once for each block; no row is made for a position that
    holds no peptide. Peptides of any length count; repeated ones count once; null and empty ones match nothing.
    """
    pep = peptides.select(F.col(peptide).alias("peptide")).filter(F.length("peptide") > 0).distinct()
    size = pep.agg(F.sum(F.octet_length("peptide") + 16)).first()[0] or 0
    blocks = max(1, -(-int(size) // block_bytes))
    if blocks > 1:
        pep = materialize(pep, "peptides")
    schema = StructType([proteins.schema[protein_id], StructField("start", IntegerType()), StructField("length", IntegerType()), StructField("peptide", StringType())])
    out = None
    for b in range(blocks):
        part = pep if blocks == 1 else pep.filter(F.pmod(F.xxhash64("peptide"), F.lit(blocks)) == b)
        held = proteins.sparkSession.sparkContext.broadcast(PeptideIndex.build(part.toArrow().column(0).to_pylist()))

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row, start, length, text in held.value.search(batch.column(1)):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(start, pa.int32()), pa.array(length, pa.int32()), text], schema.names)

        hits = proteins.select(protein_id, sequence).filter(F.length(sequence) > 0).mapInArrow(find, schema)
        if blocks > 1:
            hits = materialize(hits, "coverage")
            held.destroy()
        out = hits if out is None else out.unionByName(hits)
    return out


def coverage(proteins: DataFrame, peptides: DataFrame, protein_id: str, sequence: str, peptide: str) -> DataFrame:
    """protein_id, n_covered, coverage (share of residues under at least one peptide). Empty sequences have null coverage."""
    hits = coverage_counts(proteins, peptides, protein_id, sequence, peptide)
    # of the peptides that begin at one place only the longest matters
    spans = hits.groupBy(protein_id, "start").agg(F.max(F.col("start") + F.col("length")).alias("__end"))
    w = Window.partitionBy(protein_id).orderBy("start")
    seen = F.coalesce(F.max("__end").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = F.greatest(F.lit(0), F.col("__end") - F.greatest(F.col("start"), seen))
    total = spans.withColumn("__new", new).groupBy(protein_id).agg(F.sum("__new").alias("n_covered"))
    return proteins.select(protein_id, F.length(sequence).alias("__n")).join(total, protein_id, "left").select(protein_id, F.coalesce("n_covered", F.lit(0)).alias("n_covered"), F.when(F.col("__n") > 0, F.coalesce("n_covered", F.lit(0)) / F.col("__n")).alias("coverage"))


def coverage_mask(proteins: DataFrame, peptides: DataFrame, protein_id: str, sequence: str, peptide: str) -> DataFrame:
    """protein_id, position (from 0), n_peptides of each covered residue."""
    hits = coverage_counts(proteins, peptides, protein_id, sequence, peptide)
    return hits.select(protein_id, F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("position")).groupBy(protein_id, "position").agg(F.count("*").alias("n_peptides"))
