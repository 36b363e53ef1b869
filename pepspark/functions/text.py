"""FASTA and PEFF headers, decoys, and the small grammars: charge, ion, USI, duration, scalar casts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DECOY_PREFIX = "DECOY_"

#: Keys that may follow a header's head, by flavour; None: any.
HEADER_KEYS = {"uniprot": ("OS", "OX", "GN", "PE", "SV"), "uniref": ("n", "Tax", "TaxID", "RepID"), "uniparc": ("status",), "unimes": None}
FLAVORS = ("uniprot", "uniref", "uniparc", "unimes", "spd", "ncbi", "refseq")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _g(text: Column, pattern: str, k: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, k)
    return F.when(x == "", None).otherwise(x)


def _map(fields: dict[str, Column]) -> Column:
    m = F.map_from_arrays(F.array(*[F.lit(k) for k in fields]), F.array(*fields.values()))
    return F.map_filter(m, lambda k, v: v.isNotNull())


def _present(c: Column) -> Column:
    """A text, or null if it is empty."""
    return F.when(F.length(c) > 0, c)


def _head_and_fields(h: Column, flavor: str) -> tuple[Column, Column]:
    """A header cut before each of its flavour's keys: the head, and the array of 'KEY=value' pieces."""
    keys = HEADER_KEYS[flavor]
    pieces = F.split(h, r"\s+(?=%s=)" % (r"\w+" if keys is None else "(?:" + "|".join(keys) + ")"))
    return F.get(pieces, F.lit(0)), F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0)))


def _field(fields: Column, key: str) -> Column:
    """Value of the last piece with the key."""
    return _present(F.trim(F.substr(F.try_element_at(F.filter(fields, lambda x: F.startswith(x, F.lit(f"{key}="))), F.lit(-1)), F.lit(len(key) + 2))))


def _first_word(text: Column) -> tuple[Column, Column]:
    """The first word of a text and what follows it."""
    word = F.get(F.split(text, r"\s+", 2), F.lit(0))
    return word, F.trim(F.substr(text, F.length(word) + 1))


def _before_brackets(text: Column) -> tuple[Column, Column]:
    """What stands before the last ' [', and the text in those brackets; null without closing bracket."""
    tail = F.element_at(F.split(text, r"\s\["), -1)
    closed = (F.length(tail) < F.length(text)) & F.contains(tail, F.lit("]"))
    inside = F.array_join(F.slice(F.split(tail, "\\]"), 1, F.greatest(F.size(F.split(tail, "\\]")) - 1, F.lit(1))), "]")
    return F.when(closed, F.trim(F.substr(text, F.lit(1), F.length(text) - F.length(tail) - 2))), F.when(closed, inside)


def parse_header(header: Column | str, flavor: str = "auto") -> Column:
    """map(field -> text) of a FASTA header (a leading '>' is allowed), with the field 'flavor'.

    Heads are cut at bars, blanks and brackets, the tail before each known key. 'auto' takes the first
    flavour whose required parts are there, in the order of FLAVORS; null if none does.
    """
    h = F.trim(F.ltrim(_col(header), F.lit(">")))
    bars = F.transform(F.split(h, "\\|"), lambda x: F.trim(x))
    word, rest = _first_word(h)

    def uniprot() -> Column:
        head, fields = _head_and_fields(h, "uniprot")
        first, name = _first_word(head)
        parts = F.split(first, "\\|")
        entry = F.split(F.get(parts, F.lit(2)), "_")
        ok = (F.size(parts) == 3) & (F.size(entry) == 2) & ~F.exists(F.concat(parts, entry), lambda x: x == "")
        named = {"db": F.get(parts, F.lit(0)), "id": F.get(parts, F.lit(1)), "entry": F.get(parts, F.lit(2)), "name": _present(name)}
        return F.when(ok, _map({"flavor": F.lit("uniprot"), **named, **{k: _field(fields, k) for k in HEADER_KEYS["uniprot"]}, "gene_id": F.get(entry, F.lit(0)), "taxon": F.get(entry, F.lit(1))}))

    def uniref() -> Column:
        head, fields = _head_and_fields(h, "uniref")
        first, cluster = _first_word(head)
        values = {k: _field(fields, k) for k in HEADER_KEYS["uniref"]}
        return F.when(values["Tax"].isNotNull() | values["TaxID"].isNotNull(), _map({"flavor": F.lit("uniref"), "id": first, "cluster": _present(cluster), **values}))

    def uniparc() -> Column:
        head, fields = _head_and_fields(h, "uniparc")
        status = _field(fields, "status")
        return F.when((F.size(fields) == 1) & (F.size(F.split(head, r"\s+")) == 1) & (F.size(F.split(status, r"\s+")) == 1), _map({"flavor": F.lit("uniparc"), "id": head, "status": status}))

    def unimes() -> Column:
        head, fields = _head_and_fields(h, "unimes")
        first, name = _first_word(head)
        keys = F.array_distinct(F.transform(fields, lambda x: F.substring_index(x, "=", 1)))
        values = F.map_from_arrays(keys, F.transform(keys, lambda k: F.trim(F.substr(F.try_element_at(F.filter(fields, lambda x: F.startswith(x, F.concat(k, F.lit("=")))), F.lit(-1)), F.length(k) + 2))))
        ok = F.array_contains(keys, "OS") & F.array_contains(keys, "SV") & ~F.array_contains(keys, "PE") & (name != "") & ~F.array_contains(keys, "id") & ~F.array_contains(keys, "name") & ~F.array_contains(keys, "flavor")
        return F.when(ok, F.map_concat(_map({"flavor": F.lit("unimes"), "id": first, "name": name}), values))

    def spd() -> Column:
        gene = F.get(bars, F.lit(1))
        gene_id, taxon = F.substring_index(gene, "_", 1), F.substr(gene, F.locate("_", gene) + 1)
        ok = (F.size(bars) == 3) & ~F.exists(bars, lambda x: x == "") & F.contains(gene, F.lit("_")) & (gene_id != "") & (taxon != "") & ~F.contains(h, F.lit("="))
        return F.when(ok, _map({"flavor": F.lit("spd"), "id": F.get(bars, F.lit(0)), "gene": gene, "gene_id": gene_id, "taxon": taxon, "description": F.get(bars, F.lit(2))}))

    def ncbi() -> Column:
        text, taxon = _before_brackets(rest)
        return F.when(_present(text).isNotNull(), _map({"flavor": F.lit("ncbi"), "id": word, "description": text, "taxon": taxon}))

    def refseq() -> Column:
        head, taxon = F.get(F.split(h, "\\[", 2), F.lit(0)), _before_brackets(h)[1]
        parts = F.split(head, "\\|", 3)
        text = F.trim(F.get(parts, F.lit(2)))
        ok = (F.get(parts, F.lit(0)) == "ref") & (F.get(parts, F.lit(1)) != "") & (text != "") & taxon.isNotNull()
        return F.when(ok, _map({"flavor": F.lit("refseq"), "id": F.get(parts, F.lit(1)), "description": text, "taxon": taxon}))

    by = {"uniprot": uniprot, "uniref": uniref, "uniparc": uniparc, "unimes": unimes, "spd": spd, "ncbi": ncbi, "refseq": refseq}
    if flavor != "auto":
        if flavor not in by:
            raise ValueError(f"unknown flavor {flavor!r}")
        return by[flavor]()
    return F.coalesce(*[by[f]() for f in FLAVORS])


def reverse_decoy(seq: Column | str, keep_nterm: bool = False, keep_cterm: bool = False) -> Column:
    s = _col(seq)
    a, b = int(keep_nterm), int(keep_cterm)
    return F.concat(F.substring(s, 1, a), F.reverse(F.substring(s, F.lit(a + 1), F.greatest(F.length(s) - a - b, F.lit(0)))), F.substring(s, F.greatest(F.length(s) - b + 1, F.lit(a + 1)), F.lit(b)) if b else F.lit(""))


def shuffle_decoy(seq: Column | str, keep_nterm: bool = False, keep_cterm: bool = False, keep_nterm_m: bool = False, fix_aa: str = "", seed: int = 0) -> Column:
    """A permutation of the residues that depends on sequence and ``seed`` only; fixed residues keep their places."""
    s = _col(seq)
    n = F.length(s)
    chars = F.filter(F.split(s, ""), lambda c: c != "")
    free = lambda c, i: ~(
        (F.lit(keep_nterm) & (i == 0)) | (F.lit(keep_cterm) & (i == n - 1)) | (F.lit(keep_nterm_m) & (i == 0) & (c == "M")) | (F.instr(F.lit(fix_aa), c) > 0 if fix_aa else F.lit(False))
    )
    marked = F.transform(chars, lambda c, i: F.struct(c.alias("c"), i.alias("i"), free(c, i).alias("free")))
    moving = F.filter(marked, lambda x: x["free"])
    order = F.array_sort(F.transform(moving, lambda x: F.struct(F.xxhash64(s, x["i"], F.lit(seed)).alias("h"), x["i"].alias("i"), x["c"].alias("c"))))
    ranks = F.struct(marked.alias("m"), order.alias("o"), F.transform(moving, lambda x: x["i"]).alias("at"))
    put = F.transform(F.array(ranks), lambda r: F.array_join(F.transform(r["m"], lambda x: F.when(x["free"], F.element_at(r["o"], F.array_position(r["at"], x["i"]).cast("int"))["c"]).otherwise(x["c"])), ""))
    return F.element_at(put, 1)


def fused_decoy(seq: Column | str, sep: str = "R", **kwargs) -> Column:
    """Reversed decoy, separator and target in one chain."""
    return F.concat(reverse_decoy(seq, **kwargs), F.lit(sep), _col(seq))


def parse_charge(text: Column | str) -> Column:
    """Signed charge of '2+', '3-', '2', '-2' or '2.0'; null otherwise."""
    t = F.trim(_col(text))
    n = F.regexp_extract(t, r"^([0-9]+)[+-]$", 1)
    return (
        F.when(n != "", n.cast("int") * F.when(F.endswith(t, F.lit("-")), -1).otherwise(1))
        .when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("int"))
        .when(t.rlike(r"^[+-]?[0-9]*\.[0-9]*$"), F.when(t.try_cast("double") == F.floor(t.try_cast("double")), t.try_cast("double").cast("int")))
    )


def parse_charge_list(text: Column | str) -> Column:
    """Array of charges of '2+, 3+ and 4+'; order kept."""
    return F.transform(F.split(_col(text), r"(?:,\s*)|(?:\s*and\s*)"), parse_charge)


def format_charge(charge: Column | str) -> Column:
    c = _col(charge)
    return F.concat(F.abs(c).cast("string"), F.when(c < 0, "-").otherwise("+"))


def format_charge_list(charges: Column | str) -> Column:
    """'2+, 3+ and 4+'."""
    c = F.transform(_col(charges), format_charge)
    n = F.size(c)
    return F.when(n == 0, "").when(n == 1, F.get(c, F.lit(0))).otherwise(F.concat(F.array_join(F.slice(c, 1, F.greatest(n - 1, F.lit(0))), ", "), F.lit(" and "), F.get(c, n - 1)))


def parse_ion(text: Column | str) -> Column:
    """struct(ion_type, neutral_loss, charge) of 'y2-H2O+1'; null if malformed."""
    t = _col(text)
    p = r"^([abcxyz]\d+(-H2O|-NH3)?)([+|-]\d+)"
    return F.when(t.rlike(p), F.struct(F.regexp_extract(t, p, 1).alias("ion_type"), _g(t, p, 2).alias("neutral_loss"), F.regexp_replace(F.regexp_extract(t, p, 3), r"[|]", "").cast("int").alias("charge")))


def parse_usi(usi: Column | str) -> Column:
    """struct(protocol, dataset, datafile, scan_identifier_type, scan_identifier, interpretation)."""
    parts = F.split(_col(usi), ":", 6)
    names = ("protocol", "dataset", "datafile", "scan_identifier_type", "scan_identifier", "interpretation")
    return F.struct(*[F.get(parts, F.lit(i)).alias(n) for i, n in enumerate(names)])


def duration_minutes(text: Column | str) -> Column:
    """Minutes of an xsd:duration ('PT353.43S'); years, months and days don't count; plain numbers stay as they are."""
    t = _col(text)
    part = lambda unit: F.coalesce(F.regexp_extract(t, rf"T.*?([0-9.]+){unit}", 1).try_cast("double"), F.lit(0.0))
    return F.when(F.startswith(t, F.lit("P")), part("H") * 60 + part("M") + part("S") / 60).otherwise(t.try_cast("double"))


def parse_bool(text: Column | str) -> Column:
    t = F.lower(_col(text))
    return F.when(t.isin("true", "1", "y"), True).when(t.isin("false", "0", "n"), False)


def cast_numeric(text: Column | str) -> Column:
    """struct(whole, number, text): a text as whole number, else as number, else as it is; the fields that don't apply are null."""
    t = F.trim(_col(text))
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint"))
    number = F.when(whole.isNull(), t.try_cast("double"))
    return F.when(t.isNotNull(), F.struct(whole.alias("whole"), number.alias("number"), F.when(whole.isNull() & number.isNull(), _col(text)).alias("text")))


def parse_pepmass(text: Column | str) -> Column:
    """struct(mz, intensity, charge) of a PEPMASS value of one to three fields."""
    p = F.split(F.trim(_col(text)), r"\s+")
    return F.struct(F.get(p, F.lit(0)).try_cast("double").alias("mz"), F.get(p, F.lit(1)).try_cast("double").alias("intensity"), parse_charge(F.get(p, F.lit(2))).alias("charge"))


def cv_value(params: Column | str, accession: str) -> Column:
    """Value of the first CV parameter of an accession; its name if the value is empty."""
    hit = F.get(F.filter(_col(params), lambda p: p["accession"] == accession), F.lit(0))
    return F.when(F.coalesce(hit["value"], F.lit("")) == "", hit["name"]).otherwise(hit["value"])


def cv_index(params: Column | str) -> Column:
    """map(accession -> value); of repeated accessions the last one counts."""
    p = F.reverse(F.filter(_col(params), lambda x: x["accession"].isNotNull()))
    keys = F.array_distinct(F.transform(p, lambda x: x["accession"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: _param_value(F.filter(p, lambda x: x["accession"] == k))))


def _param_value(entries: Column) -> Column:
    e = F.get(entries, F.lit(0))
    return F.when(F.coalesce(e["value"], F.lit("")) == "", e["name"]).otherwise(e["value"])
