"""Compositions, masses, m/z, fragment ions and isotopes, as Column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pepspark import constants as K
from pepspark.functions import seq as S

# One element of a formula with its isotope and count.
ELEMENT = r"([A-Z][a-z+]*)(\[\d+\])?([+-]?\d+)?"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def literal_map(d: dict[str, float | int], kind: str) -> Column:
    if not d:
        return F.create_map().cast(f"map<string,{kind}>")
    return F.map_from_arrays(F.array(*[F.lit(k) for k in d]), F.array(*[F.lit(v).cast(kind) for v in d.values()]))


def add_compositions(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b (or a - b) of two compositions; elements of count 0 are not kept; null counts as empty."""
    empty = F.create_map().cast("map<string,int>")
    total = F.map_zip_with(F.coalesce(a, empty), F.coalesce(b, empty), lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)) * sign)
    return F.map_filter(total, lambda k, v: v != 0)


def scale_composition(a: Column, n: Column | int) -> Column:
    return F.map_filter(F.transform_values(a, lambda k, v: (v * n).cast("int")), lambda k, v: v != 0)


def formula_composition(formula: Column | str) -> Column:
    """map(element -> count) of a formula like 'H2OC[13]2N-1'; null if it isn't one. Repeated elements add up."""
    f = _col(formula)
    pattern = ELEMENT
    parts = F.regexp_extract_all(f, F.lit(f"({pattern})"), 1)
    pairs = F.transform(
        parts,
        lambda x: F.struct(
            F.concat(F.regexp_extract(x, pattern, 1), F.regexp_extract(x, pattern, 2)).alias("k"),
            F.when(F.regexp_extract(x, pattern, 3) == "", 1).otherwise(F.regexp_extract(x, pattern, 3).cast("int")).alias("n"),
        ),
    )

    def summed(p: Column) -> Column:
        keys = F.array_distinct(F.transform(p, lambda x: x["k"]))
        return F.map_from_arrays(keys, F.transform(keys, lambda k: F.aggregate(F.filter(p, lambda x: x["k"] == k), F.lit(0), lambda acc, x: acc + x["n"])))

    # nothing but elements (and a line end); a repeated group would overflow the stack on long texts
    return F.when(F.regexp_replace(f, rf"{ELEMENT}|\R\z", "") == "", F.map_filter(S.let(pairs, summed), lambda k, v: v != 0))


def composition_of(text: Column | str, modifications: dict[str, str] | None = None, ion_type: str | None = None) -> Column:
    """Composition of a string read as a modX sequence if all its labels are known, else as a formula; null if neither."""
    return F.coalesce(modx_composition(text, modifications, ion_type), formula_composition(text))


def composition_mass(comp: Column | str, average: bool = False) -> Column:
    """Mass of a composition; an unknown element makes it null."""
    table = {el: K.element_mass(el, average) for el in K.NIST_MASS}
    table |= {f"{el}[{i}]": m for el, iso in K.NIST_MASS.items() for i, (m, _) in iso.items() if i and el in ("H", "C", "N", "O", "S")}
    masses = literal_map(table, "double")
    return F.aggregate(F.map_entries(_col(comp)), F.lit(0.0), lambda acc, e: acc + e["value"] * F.element_at(masses, e["key"]))


def element_counts(seq: Column | str, ion_type: str | None = None) -> dict[str, Column]:
    """Counts of each element in a plain one-letter sequence with H- and -OH ends, one Column per element."""
    base = {"H": 2, "O": 1}
    for el, n in K.formula_composition(K.ION_FORMULA[ion_type] if ion_type else "").items():
        base[el] = base.get(el, 0) + n
    out = {}
    for el in ("C", "H", "N", "O", "S", "Se"):
        total = F.lit(base.get(el, 0))
        for aa in sorted(K.AA_COMPOSITION):
            if n := K.AA_COMPOSITION[aa].get(el):
                total = total + S.count_of(seq, aa) * n
        out[el] = total.cast("int")
    return out


def sequence_composition(seq: Column | str, ion_type: str | None = None) -> Column:
    """Elemental composition of a plain one-letter sequence."""
    counts = element_counts(seq, ion_type)
    return F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in counts]), F.array(*counts.values())), lambda k, v: v != 0)


def modx_composition(seq: Column | str, modifications: dict[str, str] | None = None, ion_type: str | None = None) -> Column:
    """Elemental composition of a modX string.

    ``modifications`` gives formulas of labels; a terminal group that isn't listed is read as a
    formula. A label without formula makes the result null.
    """
    mods = {k: K.formula_composition(v) for k, v in (modifications or {}).items()}
    table = {**{k: dict(v) for k, v in K.AA_COMPOSITION.items()}, **mods}
    names = F.array(*[F.lit(k) for k in table])
    comps = F.array(*[literal_map(v, "int") for v in table.values()])
    known = F.map_from_arrays(names, comps)
    p = S.modx_parts(seq)
    pieces = F.flatten(F.transform(S.split_groups(seq), lambda g: F.when(g["mod"] == "", F.array(g["aa"])).otherwise(F.array(g["mod"], g["aa"]))))
    empty = F.create_map().cast("map<string,int>")
    body = F.aggregate(pieces, empty, lambda acc, x: F.when(F.element_at(known, x).isNotNull() & acc.isNotNull(), add_compositions(acc, F.element_at(known, x))))

    def end(group: Column, std: str) -> Column:
        bare = F.regexp_replace(group, "^-|-$", "")
        return F.when(group.isNull(), literal_map(K.TERMINI[std], "int")).otherwise(F.coalesce(F.element_at(known, group), formula_composition(bare)))

    total = add_compositions(add_compositions(body, end(p["n_term"], "H-")), end(p["c_term"], "-OH"))
    if ion_type:
        total = add_compositions(total, literal_map(K.formula_composition(K.ION_FORMULA[ion_type]), "int"))
    return F.when(body.isNotNull(), total)


def fast_mass(seq: Column | str, ion_type: str | None = None, charge: Column | int | None = None, aa_mass: dict[str, float] | None = None) -> Column:
    """Monoisotopic mass (m/z with ``charge``) of a plain one-letter sequence.

    Counts times constants in alphabetical order, so the floating-point sum is the same everywhere.
    """
    masses = aa_mass or K.AA_MASS
    total = F.lit(0.0)
    for aa in sorted(masses):
        total = total + S.count_of(seq, aa) * F.lit(masses[aa])
    total = total + F.lit(K.WATER)
    if ion_type:
        total = total + F.lit(K.ION_DELTA[ion_type])
    return mz(total, charge) if charge is not None else total


def average_mass(seq: Column | str) -> Column:
    """Abundance-weighted mass of a plain one-letter sequence."""
    total = F.lit(0.0)
    for el, n in element_counts(seq).items():
        total = total + n * F.lit(K.element_mass(el, average=True))
    return total


def modx_mass(seq: Column | str, modification_mass: dict[str, float] | None = None, ion_type: str | None = None, charge: Column | int | None = None) -> Column:
    """Mass of a modX string; modification labels by mass, terminal groups as formulas. Null if a label is unknown."""
    table = {**K.AA_MASS, **(modification_mass or {})}
    known = literal_map(table, "double")
    p = S.modx_parts(seq)
    body = F.aggregate(S.split_groups(seq), F.lit(0.0), lambda acc, g: acc + F.element_at(known, g["aa"]) + F.when(g["mod"] == "", 0.0).otherwise(F.element_at(known, g["mod"])))

    def end(group: Column, std: str) -> Column:
        bare = F.regexp_replace(group, "^-|-$", "")
        return F.when(group.isNull(), K.composition_mass(K.TERMINI[std])).otherwise(F.coalesce(F.element_at(known, group), composition_mass(formula_composition(bare))))

    total = body + end(p["n_term"], "H-") + end(p["c_term"], "-OH")
    if ion_type:
        total = total + F.lit(K.ION_DELTA[ion_type])
    return mz(total, charge) if charge is not None else total


def mz(neutral: Column | str, charge: Column | int, carrier_mass: float = K.PROTON) -> Column:
    """m/z of a neutral mass; charge 0 gives null."""
    z = F.lit(charge) if isinstance(charge, int) else charge
    return F.when(z != 0, (_col(neutral) + z * F.lit(carrier_mass)) / F.abs(z))


def neutral_mass(mz_: Column | str, charge: Column | int, carrier_mass: float = K.PROTON) -> Column:
    z = F.lit(charge) if isinstance(charge, int) else charge
    return _col(mz_) * F.abs(z) - z * F.lit(carrier_mass)


def carrier(text: str, charge: int | None = None) -> tuple[float, int]:
    """(mass of one charge carrier ion, its charge) of 'Na+', 'Ca+2', 'H+'; a formula without sign needs ``charge``."""
    import re

    m = re.fullmatch(r"(.*?)([+-])(\d*)", text)
    if m and m[1]:
        z = int(m[3] or 1) * (1 if m[2] == "+" else -1)
        body = m[1]
    else:
        if charge is None:
            raise ValueError("charge of the carrier not specified")
        body, z = text, charge
    mass = K.composition_mass(K.formula_composition(body)) - z * K.element_mass("e*")
    return (K.PROTON, 1) if body == "H" and z == 1 else (mass, z)


def ion_name(ion: Column, index: Column, charge: Column) -> Column:
    """'b3-H2O++' of ('b-H2O', 3, 2)."""
    return F.concat(F.substring(ion, 1, 1), index.cast("string"), F.substring(ion, 2, 100), F.when(charge > 0, F.repeat(F.lit("+"), charge)).otherwise(F.repeat(F.lit("-"), -charge)))


def fragment_series(seq: Column | str, ion_types: tuple[str, ...] = ("b", "y"), max_charge: int = 1, aa_mass: dict[str, float] | None = None) -> Column:
    """Array of struct(ion, index, charge, name, mz) of a plain one-letter sequence.

    Prefix ions (a, b, c) and suffix ions (x, y, z) of 1 .. n-1 residues for each charge up to
    ``max_charge``; a residue without mass makes the m/z null.
    """
    known = literal_map(aa_mass or K.AA_MASS, "double")
    residues = F.filter(F.split(_col(seq), ""), lambda x: x != "")

    def sums(r: Column) -> Column:
        return F.aggregate(
            r,
            F.struct(F.lit(0.0).alias("m"), F.array().cast("array<double>").alias("all")),
            lambda acc, x: S.let(acc["m"] + F.element_at(known, x), lambda m: F.struct(m.alias("m"), F.concat(acc["all"], F.array(m)).alias("all"))),
            lambda acc: acc["all"],
        )

    def one(ion: str, z: int) -> Callable[[Column, Column], Column]:
        shift = F.lit(K.WATER + K.ION_DELTA[ion])

        def named(m: Column, i: Column) -> Column:
            index = (i + 1).cast("int")
            label = F.concat(F.lit(ion[0]), index.cast("string"), F.lit(ion[1:] + "+" * z))
            return F.struct(F.lit(ion).alias("ion"), index.alias("index"), F.lit(z).alias("charge"), label.alias("name"), ((m + shift + F.lit(z * K.PROTON)) / z).alias("mz"))

        return named

    def ions(t: Column) -> Column:
        run = {ion: t["prefix"] if ion[0] in "abc" else t["suffix"] for ion in ion_types}
        cut = {ion: F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))) for ion, r in run.items()}
        return F.concat(*[F.transform(cut[ion], one(ion, z)) for ion in ion_types for z in range(1, max_charge + 1)])

    both = F.struct(sums(residues).alias("prefix"), sums(F.reverse(residues)).alias("suffix"))
    return S.let(both, ions)


def most_probable_isotopes(comp: Column | str) -> Column:
    """map(element[isotope] -> count) of the most probable isotopic composition, over the two main isotopes of each element.

    Atoms are split as ceil(n) * p1 rounded, the rest going to the second isotope; labelled atoms stay.
    """
    rows = F.map_entries(_col(comp))
    top = {}
    for el, iso in K.NIST_MASS.items():
        main = sorted(((a, i) for i, (_, a) in iso.items() if i), reverse=True)
        if main:
            top[el] = (main[0][1], main[0][0], main[1][1] if len(main) > 1 else None)
    first = literal_map({k: v[0] for k, v in top.items()}, "int")
    share = literal_map({k: v[1] for k, v in top.items()}, "double")
    second = literal_map({k: v[2] for k, v in top.items() if v[2]}, "int")

    def split(e: Column) -> Column:
        el, n = e["key"], e["value"]
        n1 = F.when(F.element_at(second, el).isNull(), n).otherwise(F.least(n, F.bround(F.ceil(n) * F.element_at(share, el)).cast("int")))
        return F.when(
            F.contains(el, F.lit("[")), F.array(F.struct(el.alias("k"), n.alias("n")))
        ).otherwise(F.array(F.struct(F.concat(el, F.lit("["), F.element_at(first, el), F.lit("]")).alias("k"), n1.alias("n")), F.struct(F.concat(el, F.lit("["), F.coalesce(F.element_at(second, el), F.lit(0)), F.lit("]")).alias("k"), (n - n1).alias("n"))))

    pairs = F.filter(F.flatten(F.transform(rows, split)), lambda p: p["n"] > 0)
    return F.map_from_entries(pairs)


def isotopic_abundance(comp: Column | str) -> Column:
    """Probability of an isotopic state: per element the multinomial of its isotopes' counts. Unlabelled elements count as 1."""
    share = literal_map({f"{el}[{i}]": a for el, iso in K.NIST_MASS.items() for i, (_, a) in iso.items() if i and a > 0}, "double")
    log_fact = F.array(*[F.lit(math.lgamma(n + 1)) for n in range(171)])

    def lf(n: Column) -> Column:
        big = n.cast("double")
        return F.when(n <= 170, F.element_at(log_fact, n.cast("int") + 1)).otherwise(big * F.log(big) - big + 0.5 * F.log(2 * math.pi * big) + 1 / (12 * big))

    labelled = F.filter(F.map_entries(_col(comp)), lambda e: F.contains(e["key"], F.lit("[")))

    def total(es: Column) -> Column:
        elements = F.array_distinct(F.transform(es, lambda e: F.regexp_extract(e["key"], r"^([^\[]+)", 1)))
        per = F.transform(elements, lambda el: lf(F.aggregate(F.filter(es, lambda e: F.startswith(e["key"], F.concat(el, F.lit("[")))), F.lit(0), lambda acc, e: acc + e["value"])))
        own = F.transform(es, lambda e: e["value"] * F.log(F.element_at(share, e["key"])) - lf(e["value"]))
        plus = lambda a: F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x)
        return F.exp(plus(per) + plus(own))

    return S.let(labelled, total)
