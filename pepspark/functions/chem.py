"""Charge, isoelectric point, hydropathicity and retention time, as Column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from pepspark import constants as K
from pepspark.functions import seq as S

PkSet = dict[str, tuple[float, int]]


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _group_charge(ph: Column, pk: Column | float, sign: int) -> Column:
    pk = F.lit(pk) if isinstance(pk, float) else pk
    return sign / (1 + F.pow(F.lit(10.0), sign * (ph - pk)))


def charge(seq: Column | str, ph: Column | float, pk: PkSet | None = None, pk_nterm: dict[str, float] | None = None, pk_cterm: dict[str, float] | None = None) -> Column:
    """Net charge of a plain one-letter sequence at a pH (Henderson and Hasselbalch).

    ``pk_nterm`` and ``pk_cterm`` override the terminus by the residue that bears it.
    """
    pk = pk or K.PK_LEHNINGER
    s = _col(seq)
    p = F.lit(float(ph)) if isinstance(ph, (int, float)) else ph
    total = F.lit(0.0)
    for g in sorted(pk):
        value, sign = pk[g]
        if g == "H-" and pk_nterm:
            own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in pk_nterm.items() for x in kv]), F.substring(s, 1, 1)), F.lit(value))
            total = total + _group_charge(p, own, sign)
        elif g == "-OH" and pk_cterm:
            own = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in pk_cterm.items() for x in kv]), F.substring(s, -1, 1)), F.lit(value))
            total = total + _group_charge(p, own, sign)
        elif g in ("H-", "-OH"):
            total = total + _group_charge(p, value, sign)
        else:
            total = total + S.count_of(s, g) * _group_charge(p, value, sign)
    return total


def charges(seq: Column | str, phs: list[float], pk: PkSet | None = None) -> Column:
    """Array of the charges at several pH."""
    return F.array(*[charge(seq, x, pk) for x in phs])


def isoelectric_point(seq: Column | str, pk: PkSet | None = None, low: float = 0.0, high: float = 14.0, precision: float = 0.01) -> Column:
    """pH of zero net charge, by bisection to ``precision``; without a change of sign the end of the smaller absolute charge."""
    pk = pk or K.PK_LEHNINGER
    s = _col(seq)
    steps = max(1, math.ceil(math.log2((high - low) / precision)))
    counts = F.struct(*[S.count_of(s, g).alias(f"n{i}") for i, g in enumerate(sorted(pk)) if g not in ("H-", "-OH")])

    def at(n: Column, ph: Column) -> Column:
        total = F.lit(0.0)
        for i, g in enumerate(sorted(pk)):
            value, sign = pk[g]
            c = _group_charge(ph, value, sign)
            total = total + (c if g in ("H-", "-OH") else n[f"n{i}"] * c)
        return total

    def solve(n: Column) -> Column:
        lo, hi = at(n, F.lit(low)), at(n, F.lit(high))
        found = F.aggregate(
            F.sequence(F.lit(1), F.lit(steps)),
            F.struct(F.lit(low).alias("lo"), F.lit(high).alias("hi")),
            lambda acc, _: S.let((acc["lo"] + acc["hi"]) / 2, lambda m: S.let(at(n, m), lambda c: F.struct(F.when(c > 0, m).otherwise(acc["lo"]).alias("lo"), F.when(c > 0, acc["hi"]).otherwise(m).alias("hi")))),
            lambda acc: (acc["lo"] + acc["hi"]) / 2,
        )
        return F.when(lo * hi < 0, found).when(F.abs(lo) <= F.abs(hi), low).otherwise(high)

    return S.let(counts, solve)


def gravy(seq: Column | str, scale: dict[str, float] | None = None) -> Column:
    """Mean hydropathicity; null if a residue isn't in the scale or the sequence is empty."""
    scale = scale or K.HYDROPATHICITY_KD
    s = _col(seq)
    total = F.lit(0.0)
    for aa in sorted(scale):
        total = total + S.count_of(s, aa) * F.lit(scale[aa])
    return F.when(s.rlike(f"^[{''.join(scale)}]+$"), total / F.length(s))


def retention_time(seq: Column | str, rc: dict, raise_no_mod: bool = True) -> Column:
    """(sum of count * coefficient) * (1 + lcp * ln(length)) + const, of a modX string.

    Coefficients named 'ntermX' and 'ctermX' apply to the outer residues. A residue without
    coefficient makes the result null; with ``raise_no_mod`` False a modified one counts as bare.
    """
    aa = rc["aa"]
    term = any(k.startswith(("nterm", "cterm")) for k in aa)
    table = F.create_map(*[x for k, v in aa.items() for x in (F.lit(k), F.lit(float(v)))])
    groups = S.parse_modx(seq, show_unmodified_termini="H-" in aa)

    def value(key: Column) -> Column:
        own = F.element_at(table, key)
        return own if raise_no_mod else F.coalesce(own, F.element_at(table, F.regexp_extract(key, "([A-Z])$", 1)))

    def marked(g: Column) -> Column:
        if not term:
            return g
        inner = F.filter(g, lambda x: ~F.contains(x, F.lit("-")))
        n = F.size(inner)
        return F.concat(F.transform(inner, lambda x, i: F.when(i == 0, F.concat(F.lit("nterm"), x)).when(i == n - 1, F.concat(F.lit("cterm"), x)).otherwise(x)), F.filter(g, lambda x: F.contains(x, F.lit("-"))))

    total = F.aggregate(S.let(groups, marked), F.lit(0.0), lambda acc, g: acc + value(g))
    return total * (1 + F.lit(float(rc.get("lcp", 0))) * F.log(S.length(seq).cast("double"))) + F.lit(float(rc.get("const", 0)))


def plain_retention_time(seq: Column | str, rc: dict) -> Column:
    """Retention time of a plain one-letter sequence: counts times coefficients in alphabetical order."""
    total = F.lit(0.0)
    for aa in sorted(x for x in rc["aa"] if len(x) == 1):
        total = total + S.count_of(seq, aa) * F.lit(float(rc["aa"][aa]))
    return total * (1 + F.lit(float(rc.get("lcp", 0))) * F.log(F.length(_col(seq)).cast("double"))) + F.lit(float(rc.get("const", 0)))
