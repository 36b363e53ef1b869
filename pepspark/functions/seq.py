"""Peptide strings (modX notation) and in-silico digestion, as Column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pepspark.constants import EXPASY_RULES, PSIMS_RULES

AMINO_ACIDS = "ACDEFGHIKLMNPQRSTVWY"
LABELS = "ACDEFGHIJKLMNOPQRSTUVWY"
GROUP = "[^A-Z-]*[A-Z]"
# a body is any text without dash that ends in a capital; written without a repeated group, as those overflow the stack on long texts
MODX = "^([^-]+-)?([^-]*[A-Z])(-[^-]+)?$"
N_TERM, C_TERM = "H-", "-OH"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once per row, however often the body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _part(s: Column, k: int) -> Column:
    x = F.regexp_extract(s, MODX, k)
    return F.when(x == "", None).otherwise(x)


def modx_parts(seq: Column | str, labels: Iterable[str] = ()) -> Column:
    """struct(n_term, body, c_term) of a modX string; null if it isn't one.

    A single dash is ambiguous: 'A-B' is a body with a C-terminal group, unless the first part is
    'H-', is among ``labels``, or isn't made of plain residues.
    """
    s = _col(seq)
    n, body, c = _part(s, 1), _part(s, 2), _part(s, 3)
    plain = F.regexp_replace(n, "-$", "").rlike(f"^(?:[{LABELS}])+$")
    known = n.isin(N_TERM, *labels)
    swap = n.isNotNull() & c.isNull() & ~known & plain
    parts = F.struct(
        F.when(swap, None).otherwise(n).alias("n_term"),
        F.when(swap, F.regexp_replace(n, "-$", "")).otherwise(body).alias("body"),
        F.when(swap, F.concat(F.lit("-"), body)).otherwise(c).alias("c_term"),
    )
    return F.when(s.rlike(MODX), parts)


def parse_modx(seq: Column | str, show_unmodified_termini: bool = False, labels: Iterable[str] = ()) -> Column:
    """Array of groups of a modX string: residues with their modifications, and terminal groups."""
    p = modx_parts(seq, labels)
    groups = F.regexp_extract_all(p["body"], F.lit(f"({GROUP})"))
    n, c = F.coalesce(p["n_term"], F.lit(N_TERM)), F.coalesce(p["c_term"], F.lit(C_TERM))
    empty = F.array().cast("array<string>")
    left = F.array(n) if show_unmodified_termini else F.when(n != N_TERM, F.array(n)).otherwise(empty)
    right = F.array(c) if show_unmodified_termini else F.when(c != C_TERM, F.array(c)).otherwise(empty)
    return F.when(p.isNotNull(), F.concat(left, groups, right))


def split_groups(seq: Column | str) -> Column:
    """Array of struct(mod, aa): the residues of the body, modification and letter apart."""
    groups = F.regexp_extract_all(modx_parts(seq)["body"], F.lit(f"({GROUP})"))
    return F.transform(groups, lambda g: F.struct(F.regexp_extract(g, "^(.*?)[A-Z]$", 1).alias("mod"), F.regexp_extract(g, "([A-Z])$", 1).alias("aa")))


def to_string(groups: Column | str, show_unmodified_termini: bool = True) -> Column:
    """The modX string of an array of groups."""
    g = _col(groups)
    return F.array_join(g if show_unmodified_termini else F.filter(g, lambda x: ~x.isin(N_TERM, C_TERM)), "")


def length(seq: Column | str) -> Column:
    """Number of residues, terminal groups not counted."""
    return F.size(F.regexp_extract_all(modx_parts(seq)["body"], F.lit(f"({GROUP})")))


def strip(seq: Column | str) -> Column:
    """Bare letters: modifications and terminal groups dropped."""
    return F.regexp_replace(modx_parts(seq)["body"], "[^A-Z]", "")


def valid(seq: Column | str, labels: Iterable[str] | None = None) -> Column:
    """Is it modX? With ``labels``, every residue, modification and terminal group must also be among them."""
    if labels is None:
        return F.coalesce(_col(seq).rlike(MODX), F.lit(False))
    labels = list(labels)
    one = "".join(x for x in labels if len(x) == 1 and x.isupper())
    more = [x for x in labels if x not in one]
    p = modx_parts(seq, more)
    known = F.forall(split_groups(seq), lambda g: g["aa"].isin(*one) & ((g["mod"] == "") | g["mod"].isin(*more, "-")))
    return F.coalesce(known, F.lit(False)) & (p["n_term"].isNull() | p["n_term"].isin(N_TERM, *more)) & (p["c_term"].isNull() | p["c_term"].isin(C_TERM, *more))


def fast_valid(seq: Column | str, alphabet: str = LABELS) -> Column:
    """Does the string consist of the letters of ``alphabet`` only?"""
    return _col(seq).rlike(rf"^[{alphabet}]*\z")


def is_term_group(label: Column | str) -> Column:
    return _col(label).rlike("^(?:[^-]+-|-[^-]+)$")


def is_modx_label(label: Column | str) -> Column:
    return _col(label).rlike(f"^{GROUP}$")


def count_of(seq: Column | str, letter: str) -> Column:
    s = _col(seq)
    return F.length(s) - F.length(F.replace(s, F.lit(letter), F.lit("")))


def aa_composition(seq: Column | str, term_aa: bool = False, show_unmodified_termini: bool = False) -> Column:
    """map(group -> count) of a modX string; with ``term_aa`` the outer residues count as 'ntermX' and 'ctermX'."""

    def marked(g: Column) -> Column:
        inner = F.filter(g, lambda x: ~F.contains(x, F.lit("-")))
        ends = F.filter(g, lambda x: F.contains(x, F.lit("-")))
        return let(inner, lambda r: F.concat(F.transform(r, lambda x, i: F.when(i == 0, F.concat(F.lit("nterm"), x)).when(i == F.size(r) - 1, F.concat(F.lit("cterm"), x)).otherwise(x)), ends))

    def counted(g: Column) -> Column:
        keys = F.array_sort(F.array_distinct(g))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.size(F.filter(g, lambda x: x == k))))

    groups = parse_modx(seq, show_unmodified_termini)
    return let(let(groups, marked) if term_aa else groups, counted)


def rule_pattern(rule: str) -> str:
    """The pattern of a named rule (either set, PSI-MS accessions too), else the rule itself."""
    if rule.lower() in EXPASY_RULES:
        return EXPASY_RULES[rule.lower()]
    for name, (accession, pattern) in PSIMS_RULES.items():
        if rule in (name, accession):
            return pattern
    return rule


def fragments_of(seq: Column | str, rule: str, exception: str | None = None) -> Column:
    """Array of the pieces between cuts, in order (no missed cleavages)."""
    pattern = rule_pattern(rule)
    marked = F.regexp_replace(_col(seq), f"(?:{pattern})", "$0|")
    if exception:
        # a cut whose end is also the end of a match of the exception is taken back
        stops = F.regexp_replace(_col(seq), f"(?:{rule_pattern(exception)})", "$0~")
        cut, keep = _stops(marked, "|"), _stops(stops, "~")
        at = F.concat(F.array(F.lit(0)), F.array_except(cut, keep), F.array(F.length(_col(seq))))
        return F.filter(F.transform(F.slice(at, 1, F.size(at) - 1), lambda a, i: F.substring(_col(seq), a + 1, F.element_at(at, i + 2) - a)), lambda x: x != "")
    return F.filter(F.split(marked, r"\|"), lambda x: x != "")


def _stops(marked: Column, mark: str) -> Column:
    parts = F.split(marked, "\\" + mark)
    ends = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.length(p))
    return F.aggregate(ends, F.array().cast("array<int>"), lambda acc, n: F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + n)))


def digest(
    seq: Column | str,
    rule: str = "trypsin",
    missed_cleavages: int = 0,
    min_length: int | None = None,
    max_length: int | None = None,
    semi: bool = False,
    exception: str | None = None,
) -> Column:
    """Array of struct(start from 0, peptide) of an in-silico digest.

    Each peptide joins up to ``missed_cleavages`` + 1 neighbouring pieces. ``semi`` adds every prefix
    and suffix within the length limits (once each). Null gives null, the empty string an empty array.
    """
    parts = fragments_of(seq, rule, exception)
    if missed_cleavages == 0:
        out = _with_starts(parts)
    else:
        def joined(p: Column, k: int) -> Column:
            n = F.size(p)
            first = F.when(n > k, F.sequence(F.lit(1), n - k)).otherwise(F.array().cast("array<int>"))
            return F.transform(first, lambda i: F.struct(F.element_at(p, i)["start"].alias("start"), F.array_join(F.transform(F.slice(p, i, k + 1), lambda x: x["peptide"]), "").alias("peptide")))

        out = let(_with_starts(parts), lambda p: F.concat(*[joined(p, k) for k in range(missed_cleavages + 1)]))
    lo, hi = min_length or 1, max_length
    if semi:
        def ends(p: Column) -> Column:
            m = F.length(p["peptide"])
            top = F.least(m - 1, F.lit(hi)) if hi else m - 1
            cuts = F.when(top >= lo, F.sequence(F.lit(lo), top)).otherwise(F.array().cast("array<int>"))
            return F.concat(
                F.array(p),
                F.transform(cuts, lambda k: F.struct(p["start"].alias("start"), F.substring(p["peptide"], F.lit(1), k).alias("peptide"))),
                F.transform(cuts, lambda k: F.struct((p["start"] + m - k).alias("start"), F.substring(p["peptide"], m - k + 1, k).alias("peptide"))),
            )

        out = F.array_distinct(F.flatten(F.transform(out, ends)))
    keep = lambda p: (F.length(p["peptide"]) >= lo) & (F.length(p["peptide"]) <= hi if hi else F.lit(True))
    return F.filter(out, keep) if (lo > 1 or hi) else out


def _with_starts(parts: Column) -> Column:
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,peptide:string>>").alias("all")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["all"], F.array(F.struct(acc["at"].alias("start"), p.alias("peptide")))).alias("all")),
        lambda acc: acc["all"],
    )


def xcleave(seq: Column | str, rule: str = "trypsin", missed_cleavages: int = 0, min_length: int | None = None, max_length: int | None = None, exception: str | None = None) -> Column:
    """Array of the peptides of a digest, repeated ones kept; without places, which makes it cheaper than :func:`digest`."""
    lo, hi = min_length or 1, max_length

    def joined(parts: Column) -> Column:
        n = F.size(parts)
        runs = [parts]
        for k in range(1, missed_cleavages + 1):
            first = F.when(n > k, F.sequence(F.lit(1), n - k)).otherwise(F.array().cast("array<int>"))
            runs.append(F.transform(first, _join_of(parts, k + 1)))
        return F.concat(*runs) if missed_cleavages else parts

    parts = fragments_of(seq, rule, exception)
    out = let(parts, joined) if missed_cleavages else parts
    return F.filter(out, lambda p: (F.length(p) >= lo) & (F.length(p) <= hi if hi else F.lit(True))) if (lo > 1 or hi) else out


def _join_of(parts: Column, n: int) -> Callable[[Column], Column]:
    if n == 2:
        return lambda i: F.concat(F.element_at(parts, i), F.element_at(parts, i + 1))
    return lambda i: F.array_join(F.slice(parts, i, n), "")


def cleave(seq: Column | str, rule: str = "trypsin", missed_cleavages: int = 0, min_length: int | None = None, max_length: int | None = None, semi: bool = False, exception: str | None = None) -> Column:
    """Array of the distinct peptides of a digest."""
    if not semi:
        return F.array_distinct(xcleave(seq, rule, missed_cleavages, min_length, max_length, exception))
    return F.array_distinct(F.transform(digest(seq, rule, missed_cleavages, min_length, max_length, semi, exception), lambda p: p["peptide"]))


def num_sites(seq: Column | str, rule: str = "trypsin", exception: str | None = None) -> Column:
    """Number of cuts inside the sequence: pieces - 1 (0 for a sequence without any)."""
    return F.greatest(F.size(fragments_of(seq, rule, exception)) - 1, F.lit(0))
