"""Several values packed in one field: one row per value, with its place kept.

Ordinary characters are masked (a run of digits becomes '9', or '0' if it is all zeros; a run of
letters 'a') and the signs, separators, blanks and quotes of one class become one sign, which
leaves the field's delimiter skeleton. There are far fewer distinct skeletons than fields; for each
of them once, a rule says which runs of digits are values and what their sign is. The rules go back
to the rows by a join on the skeleton, broadcast if the counted number of skeletons allows, and the
values are taken out by place, all in the JVM. :func:`unpack_texts` does the same for texts, where
quotes may protect delimiters.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Up to this many bytes of skeleton text the rules are broadcast; beyond that they are joined by shuffle.
RULE_BYTES = 32 * 1024 * 1024
_MINUS = "-−⁻‐‑‒–﹣－"
_PLUS = "+⁺﹢＋"
_QUOTES = "\"'`´“”„‟‘’‚‛«»‹›"
_SEPARATORS = ";|/&:，；、"
_VALUE = re.compile(r"(?<![\w.])(?:a\s*=\s*)?([+-]?)([09])(?:\.([09]))?([+-]?)")


def skeleton(text: Column) -> Column:
    """The field with its ordinary characters masked and its signs reduced to their classes.

    Quotes are left out, as they protect nothing in a list of numbers; blanks beside a separator too.
    """
    one = F.regexp_replace(F.regexp_replace(text, "[0-9]*[1-9][0-9]*", "9"), "0+", "0")
    one = F.regexp_replace(one, r"\p{L}+\s*[=:]\s*", "a=")
    one = F.regexp_replace(one, r"(?<!\p{L})\p{L}+(?![\p{L}=])", "a")
    same = _MINUS + _PLUS + _SEPARATORS + _QUOTES
    one = F.translate(one, same, "-" * len(_MINUS) + "+" * len(_PLUS) + "," * len(_SEPARATORS))
    return F.trim(F.regexp_replace(F.regexp_replace(one, r"\s+", " "), r" ?(?:,|\ba\b(?! ?=)) ?", ","))


def signed_number_rule(skel: str) -> list[tuple[int, int]]:
    """Which digit runs of a skeleton are values, as (number of the run from 1, sign).

    A sign may stand before or after its number ('+2', '2+', 'z=-2'; superscripts too); without
    one the number is positive. A part after a decimal point belongs to the number before it. Zero
    isn't a value.
    """
    runs = {m.start(): i for i, m in enumerate(re.finditer(r"[09]", skel), 1)}
    out = []
    for m in _VALUE.finditer(skel):
        if m[2] == "9":
            out.append((runs[m.start(2)], -1 if (m[1] or m[4]) == "-" else 1))
    return out


def _rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield pd.DataFrame({"skel": f["skel"], "rule": [[{"run": r, "sign": s} for r, s in signed_number_rule(x)] for x in f["skel"]]})


def unpack_numbers(df: DataFrame, ids: list[str], field: str, at_least: int = 1, broadcast: bool | None = None) -> DataFrame:
    """Signed whole numbers packed in a text field: ids, pos (from 1), value.

    Fields with fewer than ``at_least`` values give no rows, as do null, empty and blank ones;
    empty pieces take no place; equal values each count; quotes and brackets around values or the
    whole field are part of the skeleton. A field repeated under the same ids counts once. A
    number beyond 18 digits has a null value. ``broadcast`` None: decided by the counted size of
    the distinct skeletons.
    """
    src = df.select(*ids, F.col(field).alias("__text")).filter(F.col("__text").rlike("[1-9]")).withColumn("skel", skeleton(F.col("__text")))
    skels = src.select("skel").distinct()
    if broadcast is None:
        size = skels.agg(F.sum(F.length("skel") * 4 + 64)).first()[0] or 0
        broadcast = size <= RULE_BYTES
    rules = skels.mapInPandas(_rules, "skel string, rule array<struct<run:int,sign:int>>").filter(F.size("rule") >= max(1, at_least))
    rows = src.join(F.broadcast(rules) if broadcast else rules, "skel")
    rows = rows.select(*ids, F.regexp_extract_all("__text", F.lit("([0-9]+)")).alias("__runs"), "rule").distinct()
    return rows.select(*ids, "__runs", F.posexplode("rule").alias("__pos", "__r")).select(
        *ids,
        (F.col("__pos") + 1).alias("pos"),
        (F.expr("try_cast(element_at(__runs, __r.run) as bigint)") * F.col("__r.sign")).alias("value"),
    )


#: Mask of a run of blanks only.
_BLANK = "\1"


def text_rule(skel: str, delimiters: str, quotes: str) -> list[tuple[int, int]]:
    """The values of a skeleton of texts, as (first token from 1, number of tokens).

    A quote that begins a value protects everything up to the same quote before a delimiter or the
    end; without such a quote it is an ordinary character. Values without any ordinary run are empty and left out.
    """
    out, i, n = [], 0, len(skel)
    while i < n:
        if skel[i] == _BLANK:
            i += 1
            continue
        j = i + 1
        if skel[i] in quotes:
            ends = [k for k in range(i + 1, n) if skel[k] == skel[i] and skel[k + 1 :].lstrip(_BLANK)[:1] in ("", *delimiters)]
            if ends:
                if "a" in skel[i + 1 : ends[0]]:
                    out.append((i + 2, ends[0] - i - 1))
                j = ends[0] + 1
                while j < n and skel[j] not in delimiters:
                    j += 1
                i = j + 1
                continue
        j = i
        while j < n and skel[j] not in delimiters:
            j += 1
        if "a" in skel[i:j]:
            out.append((i + 1, j - i))
        i = j + 1
    return out


def unpack_texts(df: DataFrame, ids: list[str], field: str, delimiters: str = ",;|\t\n", quotes: str = "\"'", at_least: int = 1, broadcast: bool | None = None) -> DataFrame:
    """Texts packed in a field: ids, pos (from 1), value (without blanks around it and without its quotes).

    Delimiters may be mixed within a field and stand inside quoted values; blanks around delimiters and quotes don't count.
    Null, empty and blank fields give no rows, empty pieces take no place, equal values each count, a field repeated
    under the same ids counts once.
    """
    special = "".join(re.escape(c) for c in delimiters + quotes)
    src = df.select(*ids, F.regexp_replace(F.col(field), _BLANK, " ").alias("__text")).filter(F.trim("__text") != "")
    blanks = F.regexp_replace("__text", rf"(?<![^{special}])(?:(?![{special}])\s)+(?![^{special}])", _BLANK)
    src = src.withColumn("skel", F.regexp_replace(blanks, f"[^{special}{_BLANK}]+", "a"))
    skels = src.select("skel").distinct()
    if broadcast is None:
        broadcast = (skels.agg(F.sum(F.length("skel") * 4 + 64)).first()[0] or 0) <= RULE_BYTES

    def rules(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"skel": f["skel"], "rule": [[{"first": a, "n": n} for a, n in text_rule(x, delimiters, quotes)] for x in f["skel"]]})

    known = skels.mapInPandas(rules, "skel string, rule array<struct<first:int,n:int>>").filter(F.size("rule") >= max(1, at_least))
    rows = src.join(F.broadcast(known) if broadcast else known, "skel")
    rows = rows.select(*ids, F.regexp_extract_all("__text", F.lit(f"([^{special}]+|[{special}])")).alias("__tokens"), "rule").distinct()
    value = F.array_join(F.slice("__tokens", F.col("__r.first"), F.col("__r.n")), "")
    return rows.select(*ids, "__tokens", F.posexplode("rule").alias("__pos", "__r")).select(*ids, (F.col("__pos") + 1).alias("pos"), F.regexp_replace(value, r"^\s+|\s+$", "").alias("value"))
