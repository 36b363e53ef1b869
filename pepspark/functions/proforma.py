"""ProForma 2 peptidoform notation: parsing, writing, masses, fragments and generation of forms.

The grammar is read by one recursive pass over the string (brackets first, then what stands
between them). On Spark the parser runs in Arrow-batched UDFs; plain upper-case sequences take the
built-in expressions instead (:func:`proforma_mass`).
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark import constants as K
from pepspark.functions import mass as M


class ProFormaError(ValueError):
    pass


#: Prefixes of tags and the type they stand for.
PREFIXES = {"u": "unimod", "unimod": "unimod", "m": "psimod", "mod": "psimod", "psi-mod": "psimod", "x": "xlmod", "xlmod": "xlmod", "r": "resid", "g": "gno", "gno": "gno", "gnome": "gno", "formula": "formula", "glycan": "glycan", "info": "info", "obs": "observed", "c": "custom", "custom": "custom", "position": "position", "limit": "limit"}
_NUMBER = re.compile(r"[+-]\d+(?:\.\d+)?(?:[eE][+-]?\d+)?")
_MONO = re.compile("(" + "|".join(sorted(K.MONOSACCHARIDES, key=len, reverse=True)) + r")(?:\((\d+)\)|(\d+))?")


class Vocabulary:
    """Names and ids of modifications with their compositions or masses; further ones are registered."""

    def __init__(self, entries: Iterable[tuple[str, int | None, str | None, float | None]] = ()):
        self.names: dict[str, tuple[dict[str, int] | None, float]] = {}
        self.ids: dict[str, tuple[dict[str, int] | None, float]] = {}
        for name, (number, formula) in K.MODIFICATIONS.items():
            self.register(name, number, formula)
        for e in entries:
            self.register(*e)

    def register(self, name: str, number: int | None = None, formula: str | None = None, mass: float | None = None) -> None:
        if formula is None and mass is None:
            raise ValueError("a modification needs a formula or a mass")
        comp = K.formula_composition(formula) if formula is not None else None
        value = (comp, mass if mass is not None else K.composition_mass(comp))
        self.names[name.lower()] = value
        if number is not None:
            self.ids[str(number)] = value

    def find(self, key: str) -> tuple[dict[str, int] | None, float] | None:
        return self.ids.get(key) or self.names.get(key.lower())


    @classmethod
    def of_table(cls, modifications, name: str = "code_name", number: str | None = "id", mass: str = "monoisotopic_mass", limit: int = 1_000_000) -> Vocabulary:
        """A vocabulary with the rows of a table of modifications (Unimod's, or another ontology's with the same columns).

        A vocabulary goes to every task, so a table of more than ``limit`` distinct rows is an error. Of rows with the same
        name or number the one with the least mass counts; rows without mass are left out.
        """
        from pyspark.sql import functions as F

        rows = modifications.filter(F.col(mass).isNotNull()).groupBy(name, *([number] if number else [])).agg(F.min(mass).alias("__mass"))
        n = rows.count()
        if n > limit:
            raise ValueError(f"{n} modifications are too many for a vocabulary")
        out = cls()
        for r in rows.orderBy(F.col("__mass").desc(), name, *([number] if number else [])).toLocalIterator():
            value = (None, float(r["__mass"]))
            if r[name] is not None:
                out.names[str(r[name]).lower()] = value
            if number and r[number] is not None:
                out.ids[str(r[number])] = value
        return out


STANDARD = Vocabulary()


@dataclass
class Tag:
    type: str
    value: str
    mass: float | None = None
    composition: dict[str, int] | None = None
    group_id: str | None = None
    score: float | None = None
    extra: list[str] = field(default_factory=list)
    text: str = ""


@dataclass
class Peptidoform:
    sequence: list[tuple[str, list[Tag]]] = field(default_factory=list)
    n_term: list[Tag] = field(default_factory=list)
    c_term: list[Tag] = field(default_factory=list)
    unlocalized: list[Tag] = field(default_factory=list)
    labile: list[Tag] = field(default_factory=list)
    fixed: list[tuple[Tag, list[str]]] = field(default_factory=list)
    intervals: list[tuple[int, int, bool, list[Tag]]] = field(default_factory=list)
    isotopes: list[str] = field(default_factory=list)
    charge: int | None = None
    adducts: list[tuple[str, int, int]] = field(default_factory=list)
    names: dict[int, str] = field(default_factory=dict)

    def _fixed_mass(self, i: int) -> float:
        aa, n = self.sequence[i][0], len(self.sequence)
        hit = lambda t: t == aa or (t.lower().startswith("n-term") and i == 0 and t.partition(":")[2] in ("", aa)) or (t.lower().startswith("c-term") and i == n - 1 and t.partition(":")[2] in ("", aa))
        return sum(tag.mass or 0.0 for tag, targets in self.fixed if any(map(hit, targets)))

    def residue_mass(self, i: int) -> float:
        aa, tags = self.sequence[i]
        base = 0.0 if aa == "X" else K.AA_MASS.get(aa, 0.0)
        return base + self._fixed_mass(i) + sum(t.mass or 0.0 for t in tags)

    @property
    def mass(self) -> float:
        """Neutral mass with fixed, labile, unlocalised, terminal and interval modifications."""
        tags = [*self.n_term, *self.c_term, *self.unlocalized, *self.labile, *(t for iv in self.intervals for t in iv[3])]
        return sum(self.residue_mass(i) for i in range(len(self.sequence))) + sum(t.mass or 0.0 for t in tags) + K.WATER

    def mz(self, charge: int | None = None) -> float:
        z = charge if charge is not None else self.charge
        if not z:
            raise ProFormaError("no charge state")
        if charge is None and self.adducts:
            carrier = sum(n * (K.composition_mass(K.formula_composition(name)) - q * K.element_mass("e*")) for name, q, n in self.adducts)
            return (self.mass + carrier) / abs(z)
        return (self.mass + z * K.PROTON) / abs(z)

    def composition(self) -> dict[str, int]:
        """Elemental composition of the neutral form; a modification known only by mass raises ProFormaError."""
        total: dict[str, int] = {"H": 2, "O": 1}

        def add(c: dict[str, int] | None, what: str) -> None:
            if c is None:
                raise ProFormaError(f"no composition of {what}")
            for k, v in c.items():
                total[k] = total.get(k, 0) + v

        for i, (aa, tags) in enumerate(self.sequence):
            if aa not in K.AA_COMPOSITION:
                raise ProFormaError(f"no composition of residue {aa}")
            add(K.AA_COMPOSITION[aa], aa)
            for tag, targets in self.fixed:
                if Peptidoform([self.sequence[i]], fixed=[(tag, targets)])._fixed_mass(0) and self._fixed_mass(i):
                    add(tag.composition, tag.text)
            for t in tags:
                if t.mass is not None:
                    add(t.composition, t.text)
        for t in [*self.n_term, *self.c_term, *self.unlocalized, *self.labile, *(t for iv in self.intervals for t in iv[3])]:
            if t.mass is not None:
                add(t.composition, t.text)
        return {k: v for k, v in total.items() if v}

    def fragments(self, ion: str, charge: int = 1, include_labile: bool = False, include_unlocalized: bool = True) -> list[float]:
        """m/z of the n-1 prefix (a, b, c) or suffix (x, y, z) fragments; charge 0 gives masses.

        A modification of an interval counts from the first fragment that reaches into it; labile
        ones are lost in fragments unless ``include_labile``.
        """
        back = ion[0] in "xyz"
        n = len(self.sequence)
        total = K.ION_DELTA[ion] + K.WATER + sum(t.mass or 0.0 for t in (self.c_term if back else self.n_term))
        if include_labile:
            total += sum(t.mass or 0.0 for t in self.labile)
        if include_unlocalized:
            total += sum(t.mass or 0.0 for t in self.unlocalized)
        waiting = sorted(self.intervals, key=lambda iv: iv[0], reverse=back)
        out = []
        for i in (range(n - 1, 0, -1) if back else range(n - 1)):
            total += self.residue_mass(i)
            while waiting and waiting[0][0] <= i < waiting[0][1]:
                total += sum(t.mass or 0.0 for t in waiting.pop(0)[3])
            out.append((total + charge * K.PROTON) / abs(charge) if charge else total)
        return out

    def slice(self, start: int, stop: int) -> Peptidoform:
        """Residues start .. stop - 1: terminal tags stay at an end that is kept, ranges are clipped and left out if empty; unlocalised and labile tags, as their places are unknown, are dropped unless all residues stay."""
        n = len(self.sequence)
        a, b = max(0, start), min(n, stop)
        whole = a == 0 and b == n
        spans = [(max(x, a) - a, min(y, b) - a, amb, tags) for x, y, amb, tags in self.intervals if max(x, a) < min(y, b)]
        return Peptidoform(self.sequence[a:b], self.n_term if a == 0 else [], self.c_term if b == n else [], self.unlocalized if whole else [], self.labile if whole else [], self.fixed, spans, self.isotopes, self.charge if whole else None, self.adducts if whole else [], self.names)

    def tags(self) -> list[tuple[str, int, Tag]]:
        """All tags with where they stand: (place kind, position from 0 or -1, tag)."""
        out = [("residue", i, t) for i, (_, tags) in enumerate(self.sequence) for t in tags]
        out += [("interval", a, t) for a, _, _, tags in self.intervals for t in tags]
        return out + [(kind, -1, t) for kind in ("n_term", "c_term", "unlocalized", "labile") for t in getattr(self, kind)] + [("fixed", -1, t) for t, _ in self.fixed]

    def find_tags(self, group_id: str) -> list[tuple[str, int, Tag]]:
        """Tags of one group."""
        return [x for x in self.tags() if x[2].group_id == group_id]

    def __str__(self) -> str:
        return to_proforma(self)


def _close(s: str, i: int, pair: str = "[]") -> int:
    depth = 0
    for j in range(i, len(s)):
        if s[j] == pair[0]:
            depth += 1
        elif s[j] == pair[1]:
            depth -= 1
            if not depth:
                return j
    raise ProFormaError(f"unclosed {pair[0]!r} at {i} in {s!r}")


def glycan_composition(text: str) -> dict[str, int]:
    total: dict[str, int] = {}
    at = 0
    for m in _MONO.finditer(text):
        if m.start() != at:
            break
        at = m.end()
        n = int(m[2] or m[3] or 1)
        for k, v in K.formula_composition(K.MONOSACCHARIDES[m[1]]).items():
            total[k] = total.get(k, 0) + v * n
    if at != len(text):
        raise ProFormaError(f"unknown monosaccharide in {text!r}")
    return total


def proforma_formula(text: str) -> dict[str, int]:
    """'[13C2]C-2H6' of a Formula tag as a composition with keys like 'C[13]'."""
    text = re.sub(r"\[(\d+)([A-Z][a-z]?)(-?\d*)\]", r"\2[\1]\3", text.replace(" ", ""))
    return K.formula_composition(text.partition(":z")[0])


def parse_tag(text: str, vocabulary: Vocabulary = STANDARD) -> Tag:
    """One tag: alternatives parted by '|', a group by '#', a mass by its sign, else a prefix or a name."""
    parts = [p for p in re.split(r"\||(?=(?<!^)#)", text) if p]
    if not parts:
        raise ProFormaError("empty tag")

    def one(p: str) -> Tag:
        if p[0] == "#":
            m = re.fullmatch(r"(#[^()]+)(?:\(([^)]*)\))?", p)
            if not m:
                raise ProFormaError(f"bad group {p!r}")
            return Tag("group", "", group_id=m[1], score=float(m[2]) if m[2] else None, text=p)
        if _NUMBER.fullmatch(p):
            return Tag("mass", p, float(p), text=p)
        prefix, colon, value = p.partition(":")
        kind = PREFIXES.get(prefix.strip().lower()) if colon else None
        if kind in ("formula", "glycan"):
            comp = proforma_formula(value) if kind == "formula" else glycan_composition(value)
            return Tag(kind, value, K.composition_mass(comp), comp, text=p)
        if kind in ("info", "position", "limit"):
            return Tag(kind, value, text=p)
        if not colon and p.lower() in ("comup", "comkp"):
            return Tag(p.lower(), "", text=p)
        name = value if kind else p
        if kind and _NUMBER.fullmatch(name):
            return Tag(kind, name, float(name), text=p)
        found = vocabulary.find(name)
        return Tag(kind or "name", name, found[1] if found else None, found[0] if found else None, text=p)

    first, *rest = [one(p) for p in parts]
    for t in rest:
        if t.type == "group":
            first.group_id, first.score = t.group_id, t.score
        elif first.mass is None and t.mass is not None:
            first.mass, first.composition = t.mass, t.composition
        first.extra.append(t.text)
    first.text = text
    return first


def _tags(s: str, i: int, vocabulary: Vocabulary) -> tuple[list[Tag], int]:
    out = []
    while i < len(s) and s[i] == "[":
        j = _close(s, i)
        out.append(parse_tag(s[i + 1 : j], vocabulary))
        i = j + 1
    return out, i


def _charge(text: str) -> tuple[int, list[tuple[str, int, int]]]:
    """'2', '-1', '2[+2Na+,+H+]' or '[Na:z+1^2,H:z+1]'."""
    m = re.fullmatch(r"(-?\d+)?(?:\[(.*)\])?", text)
    if not m or not text:
        raise ProFormaError(f"bad charge {text!r}")
    adducts = []
    for a in filter(None, (m[2] or "").split(",")):
        new = re.fullmatch(r"([0-9A-Za-z\[\]]+):[zZ]([+-]\d+)(?:\^(\d+))?", a)
        old = re.fullmatch(r"([+-]?\d*)([A-Za-z]+)(\d*[+-])", a)
        if new:
            adducts.append((new[1], int(new[2]), int(new[3] or 1)))
        elif old:
            sign = -1 if old[3][-1] == "-" else 1
            count = old[1] + "1" if old[1] in ("+", "-", "") else old[1]
            adducts.append((old[2], sign * int(old[3][:-1] or 1), int(count)))
        else:
            raise ProFormaError(f"bad adduct {a!r}")
    total = sum(q * n for _, q, n in adducts)
    return int(m[1]) if m[1] else total, adducts


def parse(text: str, vocabulary: Vocabulary = STANDARD) -> Peptidoform:
    """One peptidoform. Malformed strings, empty ones and cross-linked chains ('//') raise ProFormaError."""
    forms = parse_chimeric(text, vocabulary)
    if len(forms) > 1:
        raise ProFormaError("several peptidoforms; use parse_chimeric")
    return forms[0]


def parse_chimeric(text: str, vocabulary: Vocabulary = STANDARD) -> list[Peptidoform]:
    """The peptidoforms of a string, parted by '+' outside brackets; global rules hold for all of them."""
    s, i = text.strip(), 0
    out: list[Peptidoform] = []
    fixed: list[tuple[Tag, list[str]]] = []
    isotopes: list[str] = []
    while True:
        p = Peptidoform(fixed=fixed, isotopes=isotopes)
        while i < len(s) and s.startswith("(>", i):
            j = _close(s, i, "()")
            level = len(s[i + 1 : j]) - len(s[i + 1 : j].lstrip(">"))
            p.names[level] = s[i + 1 + level : j]
            i = j + 1
        while i < len(s) and s[i] == "<":
            j = s.find("[", i) if s.startswith("<[", i) else -1
            j = s.find(">", _close(s, j) if j >= 0 else i)
            if j < 0:
                raise ProFormaError("unclosed '<'")
            body = s[i + 1 : j]
            if body.startswith("["):
                e = _close(body, 0)
                if not body.startswith("@", e + 1):
                    raise ProFormaError("a fixed modification needs '@' and its targets")
                fixed.append((parse_tag(body[1:e], vocabulary), [x.strip() for x in body[e + 2 :].split(",")]))
            else:
                isotopes.append(body)
            i = j + 1
        while i < len(s) and s[i] == "{":
            j = _close(s, i, "{}")
            p.labile.append(parse_tag(s[i + 1 : j], vocabulary))
            i = j + 1
        lead: list[Tag] = []
        while i < len(s) and s[i] == "[":
            j = _close(s, i)
            tag = parse_tag(s[i + 1 : j], vocabulary)
            i = j + 1
            times = re.match(r"\^(\d+)", s[i:])
            if times:
                i += times.end()
            lead += [tag] * (int(times[1]) if times else 1)
            if i < len(s) and s[i] == "?":
                p.unlocalized += lead
                lead = []
                i += 1
        if lead:
            if i >= len(s) or s[i] != "-":
                raise ProFormaError(f"terminal modification without '-' in {text!r}")
            p.n_term = lead
            i += 1
        opened: tuple[int, bool] | None = None
        ended = False
        while i < len(s):
            c = s[i]
            if c.isalpha():
                tags, i = _tags(s, i + 1, vocabulary)
                p.sequence.append((c.upper(), tags))
            elif c == "(":
                if opened:
                    raise ProFormaError("nested range")
                ambiguous = s.startswith("(?", i)
                opened = (len(p.sequence), ambiguous)
                i += 2 if ambiguous else 1
            elif c == ")" and opened:
                tags, i = _tags(s, i + 1, vocabulary)
                p.intervals.append((opened[0], len(p.sequence), opened[1], tags))
                opened = None
            elif c == "-":
                p.c_term, j = _tags(s, i + 1, vocabulary)
                if not p.c_term:
                    raise ProFormaError("empty C-terminal modification")
                i = j
            elif c == "/":
                if s.startswith("//", i):
                    raise ProFormaError("cross-linked chains aren't supported")
                m = re.match(r"/(-?\d*(?:\[[^\]]*\])?)", s[i:])
                p.charge, p.adducts = _charge(m[1])
                i += m.end()
            elif c == "+":
                ended = True
                i += 1
                break
            else:
                raise ProFormaError(f"unexpected {c!r} at {i} in {text!r}")
        if opened or not p.sequence:
            raise ProFormaError(f"incomplete sequence {text!r}")
        out.append(p)
        if not ended:
            return out


def to_proforma(p: Peptidoform) -> str:
    """The string of a peptidoform."""
    b = lambda tags: "".join(f"[{t.text}]" for t in tags)
    s = "".join(f"(>{'>' * (k - 1)}{v})" for k, v in sorted(p.names.items(), reverse=True))
    s += "".join(f"<{x}>" for x in p.isotopes) + "".join(f"<[{t.text}]@{','.join(g)}>" for t, g in p.fixed)
    s += "".join(f"{{{t.text}}}" for t in p.labile)
    if p.unlocalized:
        s += "".join(f"[{k}]" + (f"^{n}" if n > 1 else "") for k, n in ((k, len(list(g))) for k, g in itertools.groupby(t.text for t in p.unlocalized))) + "?"
    if p.n_term:
        s += b(p.n_term) + "-"
    opens, closes = {}, {}
    for a, e, amb, tags in p.intervals:
        opens[a] = "(?" if amb else "("
        closes[e] = ")" + b(tags)
    for i, (aa, tags) in enumerate(p.sequence):
        s += closes.pop(i, "") + opens.pop(i, "") + aa + b(tags)
    s += closes.pop(len(p.sequence), "")
    if p.c_term:
        s += "-" + b(p.c_term)
    if p.charge is not None:
        s += f"/{p.charge}" + (f"[{','.join(f'{n}:z{q:+d}' + (f'^{k}' if k != 1 else '') for n, q, k in p.adducts)}]" if p.adducts else "")
    return s


@dataclass(frozen=True)
class Placement:
    """Where a tag of unknown place may go, by its 'Position', 'Limit', 'CoMKP' and 'CoMUP' parts."""

    residues: frozenset[str] | None
    limit: int
    beside_known: bool
    beside_unknown: bool

    @classmethod
    def of(cls, tag: Tag) -> Placement:
        residues, limit, known, unknown = None, 1, False, False
        for part in tag.extra:
            key, _, value = part.partition(":")
            if key.lower() == "position":
                residues = frozenset(x.strip() for x in value.split(",")) | (residues or frozenset())
            elif key.lower() == "limit":
                limit = int(value)
            elif key.lower() == "comkp":
                known = True
            elif key.lower() == "comup":
                unknown = True
        return cls(residues, limit, known, unknown)

    def places(self, base: list[tuple[str, list[Tag]]]) -> list[int]:
        n = len(base)
        fits = lambda i, aa: self.residues is None or aa in self.residues or (i == 0 and "N-term" in self.residues) or (i == n - 1 and "C-term" in self.residues)
        return [i for i, (aa, tags) in enumerate(base) if (not tags or self.beside_known) and fits(i, aa)]


def peptidoforms(p: Peptidoform, variable: dict[str, list[str]] | None = None, max_mods: int | None = None, vocabulary: Vocabulary = STANDARD) -> Iterator[Peptidoform]:
    """Forms with every placement of unlocalised and grouped tags and of variable modifications (tag -> residues).

    Each unlocalised tag sits on one residue without a tag, each group on one of its places; at most
    ``max_mods`` variable ones are set. A tag may carry its own rules: 'Position:S,T' its residues,
    'Limit:n' how many of it one residue bears, 'CoMKP' and 'CoMUP' that it may share a residue with
    tags of known or of unknown place. Every distinct form comes once. The number of forms grows
    exponentially with the sites: bound it by ``max_mods``.
    """
    base = [(aa, [t for t in tags if not t.group_id]) for aa, tags in p.sequence]
    groups: dict[str, tuple[Tag, list[int]]] = {}
    for i, (_, tags) in enumerate(p.sequence):
        for t in tags:
            if t.group_id:
                tag, places = groups.get(t.group_id, (t, []))
                groups[t.group_id] = (t if tag.type == "group" else tag, [*places, i])
    choices: list[list[tuple[int, Tag]]] = [[(i, tag) for i in places] for tag, places in groups.values() if tag.type != "group"]
    choices += [[(i, t) for i in Placement.of(t).places(base)] for t in p.unlocalized]
    optional = [(i, t) for tag, residues in (variable or {}).items() for t in (parse_tag(tag, vocabulary),) for i in Placement.of(t).places(base) if base[i][0] in residues]
    seen: set[str] = set()
    top = len(optional) if max_mods is None else min(max_mods, len(optional))

    def allowed(placed: list[tuple[int, Tag]]) -> bool:
        at: dict[int, list[Tag]] = {}
        for i, t in placed:
            at.setdefault(i, []).append(t)
        for tags in at.values():
            if len(tags) == 1:
                continue
            names = [t.text for t in tags]
            if any(names.count(t.text) > Placement.of(t).limit for t in tags):
                return False
            if len(set(names)) > 1 and not all(Placement.of(t).beside_unknown for t in tags):
                return False
        return True

    for fixed in itertools.product(*choices):
        for n in range(top + 1):
            for extra in itertools.combinations(optional, n):
                placed = [*fixed, *extra]
                if not allowed(placed):
                    continue
                seq = [(aa, list(tags)) for aa, tags in base]
                for i, t in sorted(placed, key=lambda x: (x[0], x[1].text)):
                    seq[i][1].append(Tag(t.type, t.value, t.mass, t.composition, text=re.split(r"[#|]", t.text)[0] or t.text))
                form = Peptidoform(seq, p.n_term, p.c_term, [], p.labile, p.fixed, p.intervals, p.isotopes, p.charge, p.adducts, p.names)
                key = str(form)
                if key not in seen:
                    seen.add(key)
                    yield form


TAG_TYPE = T.StructType([T.StructField("type", T.StringType()), T.StructField("value", T.StringType()), T.StructField("mass", T.DoubleType()), T.StructField("group_id", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("extra", T.ArrayType(T.StringType()))])
_TAGS = T.ArrayType(TAG_TYPE)
PEPTIDOFORM_TYPE = T.StructType(
    [
        T.StructField("sequence", T.ArrayType(T.StructType([T.StructField("aa", T.StringType()), T.StructField("tags", _TAGS)]))),
        *[T.StructField(c, _TAGS) for c in ("n_term", "c_term", "unlocalized", "labile")],
        T.StructField("fixed", T.ArrayType(T.StructType([T.StructField("tag", TAG_TYPE), T.StructField("targets", T.ArrayType(T.StringType()))]))),
        T.StructField("intervals", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("ambiguous", T.BooleanType()), T.StructField("tags", _TAGS)]))),
        T.StructField("isotopes", T.ArrayType(T.StringType())),
        T.StructField("charge", T.IntegerType()),
        T.StructField("adducts", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("charge", T.IntegerType()), T.StructField("count", T.IntegerType())]))),
        T.StructField("mass", T.DoubleType()),
    ]
)


def _row(p: Peptidoform) -> dict:
    t = lambda tags: [{"type": x.type, "value": x.value, "mass": x.mass, "group_id": x.group_id, "score": x.score, "extra": x.extra} for x in tags]
    return {
        "sequence": [{"aa": aa, "tags": t(tags)} for aa, tags in p.sequence],
        **{c: t(getattr(p, c)) for c in ("n_term", "c_term", "unlocalized", "labile")},
        "fixed": [{"tag": t([x])[0], "targets": g} for x, g in p.fixed],
        "intervals": [{"start": a, "end": e, "ambiguous": m, "tags": t(tags)} for a, e, m, tags in p.intervals],
        "isotopes": p.isotopes,
        "charge": p.charge,
        "adducts": [{"name": n, "charge": q, "count": k} for n, q, k in p.adducts],
        "mass": p.mass,
    }


def _each(texts: pd.Series, f, vocabulary: Vocabulary = STANDARD) -> list:
    known: dict = {}
    out = []
    for x in texts:
        if x not in known:
            try:
                known[x] = None if x is None else f(parse(x, vocabulary))
            except ProFormaError:
                known[x] = None
        out.append(known[x])
    return out


def parse_proforma(text: Column | str, vocabulary: Vocabulary = STANDARD) -> Column:
    """Struct (PEPTIDOFORM_TYPE) of a ProForma string; null if it is malformed or null."""

    @F.pandas_udf(PEPTIDOFORM_TYPE)
    def run(s: pd.Series) -> pd.DataFrame:
        rows = _each(s, _row, vocabulary)
        names = PEPTIDOFORM_TYPE.fieldNames()
        return pd.DataFrame({c: pd.Series([None if r is None else r[c] for r in rows], dtype="object") for c in names})

    out = run(text)
    return F.when(F.size(out["sequence"]) > 0, out)


def proforma_mass(text: Column | str, vocabulary: Vocabulary = STANDARD) -> Column:
    """Neutral mass; plain upper-case sequences stay in the JVM, others go through the parser; null if malformed."""
    c = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, lambda p: p.mass, vocabulary), dtype="float64")

    plain = c.rlike("^[ACDEFGHIKLMNPQRSTVWY]+$")
    return F.when(plain, M.fast_mass(c)).otherwise(run(F.when(~plain, c)))


def proforma_mz(text: Column | str, charge: int | None = None, vocabulary: Vocabulary = STANDARD) -> Column:
    """m/z at ``charge``, or at the string's own charge state; null without either."""

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, lambda p: p.mz(charge), vocabulary), dtype="float64")

    return run(text)


def proforma_fragments(text: Column | str, ion: str, charge: int = 1, vocabulary: Vocabulary = STANDARD) -> Column:
    """Array of fragment m/z."""

    @F.pandas_udf("array<double>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, lambda p: p.fragments(ion, charge), vocabulary), dtype="object")

    return run(text)


def proforma_composition(text: Column | str, vocabulary: Vocabulary = STANDARD) -> Column:
    """map(element -> count); null if a modification is known only by its mass."""

    @F.pandas_udf("map<string,int>")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_each(s, lambda p: p.composition(), vocabulary), dtype="object")

    return run(text)


def modx_to_proforma(seq: Column | str, names: dict[str, str] | None = None) -> Column:
    """ProForma string of a modX string; labels become tags by ``names``, or stay as they are. Terminal groups become terminal tags."""
    from pepspark.functions import seq as S

    table = F.create_map(*[F.lit(x) for kv in (names or {"": ""}).items() for x in kv])
    tag = lambda m: F.concat(F.lit("["), F.coalesce(F.element_at(table, m), m), F.lit("]"))
    p = S.modx_parts(seq)
    body = F.array_join(F.transform(S.split_groups(seq), lambda g: F.concat(g["aa"], F.when(g["mod"] == "", "").otherwise(tag(g["mod"])))), "")
    n, c = F.regexp_replace(p["n_term"], "-$", ""), F.regexp_replace(p["c_term"], "^-", "")
    return F.when(p.isNotNull(), F.concat(F.when(n.isNull() | (n == "H"), "").otherwise(F.concat(tag(n), F.lit("-"))), body, F.when(c.isNull() | (c == "OH"), "").otherwise(F.concat(F.lit("-"), tag(c)))))


FRAGMENT_TYPE = T.ArrayType(T.StructType([T.StructField("ion", T.StringType()), T.StructField("index", T.IntegerType()), T.StructField("charge", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("mz", T.DoubleType())]))
_PLAIN = "^[ACDEFGHIJKLMNOPQRSTUVWY]+$"
_MODX_GROUP = re.compile(r"([^A-Z-]*)([A-Z])")


def from_modx(text: str, modification_mass: dict[str, float] | None = None) -> Peptidoform:
    """A modX string as a peptidoform: labels by their masses, terminal groups by mass or as formulas that replace H and OH."""
    m = re.match(r"^([^-]+-)?([^-]*[A-Z])(-[^-]+)?$", text)
    if not m:
        raise ProFormaError(f"not a modX sequence: {text!r}")
    known = modification_mass or {}
    p = Peptidoform()
    for mod, aa in _MODX_GROUP.findall(m[2]):
        if mod and mod not in known:
            raise ProFormaError(f"unknown label {mod!r}")
        p.sequence.append((aa, [Tag("mass", mod, known[mod], text=mod)] if mod else []))
    for group, std, end in ((m[1], "H", p.n_term), (m[3], "OH", p.c_term)):
        if group and group.strip("-") != std:
            formula = group.strip("-")
            mass = known[group] if group in known else K.composition_mass(K.formula_composition(formula))
            end.append(Tag("mass", group, mass - K.composition_mass(K.formula_composition(std)), text=group))
    return p


def read_peptide(text: str, modification_mass: dict[str, float] | None = None) -> Peptidoform:
    """ProForma if the letters outside brackets are all capitals, else modX."""
    bare = re.sub(r"\[[^\[\]]*\]|\{[^{}]*\}|<[^<>]*>|\(>[^()]*\)", "", text)
    if re.search("[a-z]", bare) or ("[" not in text and re.search("^[^-]+-|-[^-]+$", bare)):
        return from_modx(text, modification_mass)
    return parse(text)


def _any(texts: pd.Series, f, modification_mass: dict[str, float] | None) -> list:
    known: dict = {}
    for x in texts:
        if x not in known:
            try:
                known[x] = None if x is None else f(read_peptide(x, modification_mass))
            except (ProFormaError, KeyError):
                known[x] = None
    return [known[x] for x in texts]


def fragment_series(text: Column | str, ions: tuple[str, ...] = ("b", "y"), max_charge: int = 1, modification_mass: dict[str, float] | None = None) -> Column:
    """Array of struct(ion, index, charge, name, mz) of plain, ProForma or modX peptides; null if unreadable.

    Plain sequences stay in the JVM; the others are read once per distinct string of a batch.
    """
    c = F.col(text) if isinstance(text, str) else text

    def series(p: Peptidoform) -> list[dict]:
        out = []
        for ion in ions:
            for z in range(1, max_charge + 1):
                out += [{"ion": ion, "index": i, "charge": z, "name": f"{ion[0]}{i}{ion[1:]}{'+' * z}", "mz": m} for i, m in enumerate(p.fragments(ion, z), 1)]
        return out

    @F.pandas_udf(FRAGMENT_TYPE)
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_any(s, series, modification_mass), dtype="object")

    plain = c.rlike(_PLAIN)
    return F.when(plain, M.fragment_series(c, ions, max_charge).cast(FRAGMENT_TYPE)).otherwise(run(F.when(~plain, c)))


def peptide_mass(text: Column | str, modification_mass: dict[str, float] | None = None) -> Column:
    """Neutral mass of plain, ProForma or modX peptides; null if unreadable."""
    c = F.col(text) if isinstance(text, str) else text

    @F.pandas_udf("double")
    def run(s: pd.Series) -> pd.Series:
        return pd.Series(_any(s, lambda p: p.mass, modification_mass), dtype="float64")

    plain = c.rlike(_PLAIN)
    return F.when(plain, M.fast_mass(c)).otherwise(run(F.when(~plain, c)))
