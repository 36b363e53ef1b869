"""Generators: modified forms of modX peptides, ProForma placements, isotopologues."""

from __future__ import annotations

import functools
import itertools
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from pepspark import constants as K
from pepspark.functions import proforma as P
from pepspark.functions import seq as S

_GROUP = re.compile(r"([^A-Z-]*)([A-Z])")
_MODX = re.compile(S.MODX)


def _applies(rule, aa: str, first: bool, last: bool) -> bool:
    return rule is True or aa in rule or (first and "nterm" + aa in rule) or (last and "cterm" + aa in rule)


def modx_forms(seq: str, variable: dict | None = None, fixed: dict | None = None, max_mods: int | None = None, override: bool = False, show_termini: bool = False) -> list[str]:
    """All forms of a modX peptide under variable and fixed modifications (label -> residues, or True for all).

    Labels with a dash are terminal groups. A residue bears one modification; an own one of the
    sequence stays unless ``override``. ``max_mods`` bounds the number of changed sites; a changed
    terminus and a changed residue beside it are one site.
    """
    m = _MODX.match(seq)
    if not m:
        raise ValueError(f"not a modX sequence: {seq!r}")
    n_term, c_term = m[1] or S.N_TERM, m[3] or S.C_TERM
    groups = [(mod, aa) for mod, aa in _GROUP.findall(m[2])]
    last = len(groups) - 1
    for label, where in (fixed or {}).items():
        if label.endswith("-"):
            n_term = label if (n_term == S.N_TERM or override) and _applies(where, groups[0][1], True, last == 0) else n_term
        elif label.startswith("-"):
            c_term = label if (c_term == S.C_TERM or override) and _applies(where, groups[-1][1], last == 0, True) else c_term
        else:
            groups = [(label, aa) if (not mod or override) and (where is True or aa in where) else (mod, aa) for mod, aa in groups]
    plain = {k: v for k, v in sorted((variable or {}).items()) if "-" not in k}
    sites: list[list[tuple[str, str, str, str]]] = []
    for i, (mod, aa) in enumerate(groups):
        own = [mod] + [k for k, where in plain.items() if (not mod or override) and k != mod and _applies(where, aa, i == 0, i == last)]
        left = [n_term if i == 0 else ""]
        right = [c_term if i == last else ""]
        for k, where in sorted((variable or {}).items()):
            if i == 0 and k.endswith("-") and (n_term == S.N_TERM or override) and (where is True or aa in where):
                left.append(k)
            if i == last and k.startswith("-") and (c_term == S.C_TERM or override) and (where is True or aa in where):
                right.append(k)
        sites.append([(a, b, aa, c) for a in left for b in own for c in right])
    open_ = [i for i, s in enumerate(sites) if len(s) > 1]
    top = len(open_) if max_mods is None else min(max_mods, len(open_))

    def text(form: list[tuple[str, str, str, str]]) -> str:
        return "".join((a if show_termini or a != S.N_TERM else "") + b + aa + (c if show_termini or c != S.C_TERM else "") for a, b, aa, c in form)

    out = []
    for n in range(top + 1):
        for chosen in itertools.combinations(open_, n):
            for states in itertools.product(*[sites[i][1:] for i in chosen]):
                form = [s[0] for s in sites]
                for i, state in zip(chosen, states):
                    form[i] = state
                out.append(text(form))
    return out


def peptidoforms_modx(df: DataFrame, seq: str, variable: dict | None = None, fixed: dict | None = None, max_mods: int | None = 2, **kwargs) -> DataFrame:
    """``df`` with one row per form, in the column 'form'. Malformed and null sequences give no rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("form", T.StringType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            forms = [modx_forms(x, variable, fixed, max_mods, **kwargs) if isinstance(x, str) and _MODX.match(x) else [] for x in f[seq]]
            g = f.assign(form=forms).explode("form").dropna(subset=["form"])
            if len(g):
                yield g

    return df.mapInPandas(run, schema)


def peptidoforms_proforma(df: DataFrame, text: str, variable: dict[str, list[str]] | None = None, max_mods: int | None = 2) -> DataFrame:
    """``df`` with one row per placement of ambiguous and variable modifications, in 'form' and 'form_mass'."""
    schema = T.StructType([*df.schema.fields, T.StructField("form", T.StringType()), T.StructField("form_mass", T.DoubleType())])

    def forms(x: str | None) -> list[tuple[str, float]]:
        try:
            return [(str(p), p.mass) for p in P.peptidoforms(P.parse(x), variable, max_mods)] if x else []
        except P.ProFormaError:
            return []

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            g = f.assign(__f=[forms(x) for x in f[text]]).explode("__f").dropna(subset=["__f"])
            if len(g):
                yield g.assign(form=[a for a, _ in g["__f"]], form_mass=[float(b) for _, b in g["__f"]]).drop(columns="__f")

    return df.mapInPandas(run, schema)


@functools.lru_cache(maxsize=20_000)
def _element_states(el: str, n: int, isotope_threshold: float, overall_threshold: float) -> list[tuple[dict[str, int], float]]:
    """States of n atoms of one element, most abundant first; the same for every composition, so they are kept."""
    iso = [(i, a) for i, (_, a) in K.NIST_MASS[el].items() if i and a >= isotope_threshold]
    states = []
    for split in _splits(n, len(iso)):
        p = math.exp(math.lgamma(n + 1) + sum(k * math.log(a) - math.lgamma(k + 1) for k, (_, a) in zip(split, iso)))
        if p >= overall_threshold:
            states.append(({f"{el}[{i}]": k for k, (i, _) in zip(split, iso) if k}, p))
    return sorted(states, key=lambda s: -s[1])


def isotopologues_of(comp: dict[str, int], isotope_threshold: float = 5e-4, overall_threshold: float = 0.0) -> list[tuple[dict[str, int], float]]:
    """Isotopic states of a composition with their abundances; isotopes and states below the thresholds are left out.

    States are built element by element and dropped as soon as the most abundant completion would
    stay below ``overall_threshold``.
    """
    per = [[({el: n}, 1.0)] if "[" in el else _element_states(el, n, isotope_threshold, overall_threshold) for el, n in comp.items()]
    best_rest = [1.0] * (len(per) + 1)
    for i in range(len(per) - 1, -1, -1):
        best_rest[i] = best_rest[i + 1] * (per[i][0][1] if per[i] else 0.0)
    found: list[tuple[dict[str, int], float]] = [({}, 1.0)]
    for i, states in enumerate(per):
        found = [({**c, **s}, p * q) for c, p in found for s, q in states if p * q * best_rest[i + 1] >= overall_threshold]
    return found


def _splits(n: int, parts: int) -> Iterator[tuple[int, ...]]:
    if parts == 1:
        yield (n,)
        return
    for k in range(n, -1, -1):
        for rest in _splits(n - k, parts - 1):
            yield (k, *rest)


def isotopologues(df: DataFrame, composition: str, isotope_threshold: float = 5e-4, overall_threshold: float = 1e-3) -> DataFrame:
    """``df`` with one row per isotopologue: isotopes (map), abundance and isotope_mass. Null compositions give no rows."""
    schema = T.StructType([*df.schema.fields, T.StructField("isotopes", T.MapType(T.StringType(), T.IntegerType())), T.StructField("abundance", T.DoubleType()), T.StructField("isotope_mass", T.DoubleType())])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            known: dict = {}

            def states(c):
                if c is None:
                    return []
                key = tuple(sorted(dict(c).items()))
                if key not in known:
                    known[key] = isotopologues_of(dict(key), isotope_threshold, overall_threshold)
                return known[key]

            g = f.assign(__s=[states(c) for c in f[composition]]).explode("__s").dropna(subset=["__s"])
            if len(g):
                yield g.assign(isotopes=[s[0] for s in g["__s"]], abundance=[float(s[1]) for s in g["__s"]], isotope_mass=[K.composition_mass(s[0]) for s in g["__s"]]).drop(columns="__s")

    return df.mapInPandas(run, schema)


def map_entries(df: DataFrame, function, schema: str) -> DataFrame:
    """A user function over every row in parallel: ``function`` takes and returns a pandas frame of a batch."""
    return df.mapInPandas(lambda frames: (function(f) for f in frames), schema)
