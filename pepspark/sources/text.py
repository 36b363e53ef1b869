"""Text formats: FASTA, PEFF, MGF, MS1, MS2, mzTab, USI spectra; and the FASTA and MGF writers.

Files are split at record separators by Spark's text source, so one large file is read by many
tasks; parsing is done by built-in expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pepspark.functions import text as X

_EMPTY_MAP = "map<string,string>"


def _records(spark: SparkSession, path: str | list[str], separator: str) -> DataFrame:
    return spark.read.text(path, lineSep=separator).select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("source"))


def last_wins(keys: Column, values: Column) -> Column:
    """A map of parallel arrays in which the last of repeated keys counts."""
    pairs = F.reverse(F.arrays_zip(keys.alias("k"), values.alias("v")))
    names = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.get(F.filter(pairs, lambda p: p["k"] == n), F.lit(0))["v"]))


def read_fasta(spark: SparkSession, path: str | list[str], flavor: str | None = None, comments: bool = False, ignore_comments: bool = False) -> DataFrame:
    """description, sequence, source (and header, a map, if a flavor or 'auto' is given).

    Files are split at headers. Blank lines and a trailing '*' are dropped; an entry without sequence has an empty one.
    Lines with ';' after a header belong to the description: they are joined to it with a blank, or left out with
    ``ignore_comments``. ``comments`` is for files in which ';' lines or several headers in a row begin entries: they are
    cut there too, and adjacent heads make one description (the first one with ``ignore_comments``).
    """
    if comments:
        return _commented_fasta(spark, path, flavor, ignore_comments)
    r = _records(spark, path, "\n>").filter(F.trim("value") != "")
    lines = F.filter(F.transform(F.split(F.regexp_replace("value", "^>", ""), "\n"), lambda x: F.trim(x)), lambda x, i: (i == 0) | (x != ""))
    r = r.select("source", lines.alias("lines"))
    rest = F.slice("lines", 2, F.greatest(F.size("lines") - 1, F.lit(0)))
    notes = F.transform(F.filter(rest, lambda x: F.startswith(x, F.lit(";"))), lambda x: F.trim(F.substr(x, F.lit(2))))
    body = F.array_join(F.filter(rest, lambda x: ~F.startswith(x, F.lit(";"))), "")
    head = F.slice("lines", 1, 1)
    description = F.array_join(head if ignore_comments else F.concat(head, notes), " ")
    out = r.select(description.alias("description"), F.regexp_replace(body, r"\*$", "").alias("sequence"), "source")
    return out.withColumn("header", X.parse_header("description", flavor)) if flavor else out


def _commented_fasta(spark: SparkSession, path: str | list[str], flavor: str | None, ignore_comments: bool) -> DataFrame:
    """Files are split before each head line ('>' or ';'); heads without sequence lead the next entry. One file is read by one task."""
    whole = spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("source"))
    entries = whole.select("source", F.explode(F.split("value", r"(?<=\n)(?<!^)(?=[>;])")).alias("line"))
    # a piece is one head line with the sequence lines behind it; pieces without sequence lead the next one
    pieces = entries.select("source", F.monotonically_increasing_id().alias("__at"), F.trim(F.substr(F.split_part("line", F.lit("\n"), F.lit(1)), F.lit(2))).alias("head"), F.regexp_replace(F.regexp_replace("line", r"^[>;][^\n]*\n?", ""), r"\s*\n\s*|^\s+|\s+$", "").alias("body"), F.col("line").rlike("^[>;]").alias("is_head"))
    order = Window.partitionBy("source").orderBy("__at")
    done = F.sum((F.col("body") != "").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    entry = pieces.withColumn("__entry", F.coalesce(done, F.lit(0))).groupBy("source", "__entry").agg(F.array_sort(F.collect_list(F.struct("__at", "is_head", "head", "body"))).alias("p"))
    heads = F.transform(F.filter("p", lambda x: x["is_head"]), lambda x: x["head"])
    body = F.array_join(F.transform("p", lambda x: x["body"]), "")
    out = entry.select((F.coalesce(F.get(heads, F.lit(0)), F.lit("")) if ignore_comments else F.array_join(heads, " ")).alias("description"), F.regexp_replace(body, r"\*$", "").alias("sequence"), "source").filter("sequence <> ''")
    return out.withColumn("header", X.parse_header("description", flavor)) if flavor else out


def with_accession(fasta: DataFrame, pattern: str = r"^(?:\w+\|)?([^|\s]+)", group: int = 1) -> DataFrame:
    """A second key taken out of the description, for look-ups by either."""
    return fasta.withColumn("accession", F.regexp_extract("description", pattern, group))


def read_peff(spark: SparkSession, path: str | list[str]) -> DataFrame:
    r"""PEFF entries: prefix, db_id, sequence, fields (map of the \Key=value pairs), features.

    ``features`` has (key, position in the list, array of the pipe-parted fields) of the values in
    parentheses. File header blocks ('#') are read by :func:`read_peff_header`.
    """
    fasta = read_fasta(spark, path).filter(~F.startswith("description", F.lit("#")))
    pattern = r"\\(\S+?)=(.*?)(?=\s+\\\S+?=|\s*$)"
    d = F.col("description")
    keys, values = F.regexp_extract_all(d, F.lit(pattern), 1), F.regexp_extract_all(d, F.lit(pattern), 2)
    out = fasta.select(
        F.regexp_extract("description", r"^(\w+):", 1).alias("prefix"),
        F.regexp_extract("description", r"^(?:\w+:)?(\S+)", 1).alias("db_id"),
        F.regexp_replace("sequence", "#.*$", "").alias("sequence"),
        last_wins(keys, values).alias("fields"),
        "source",
    )
    listed = F.filter(F.map_entries("fields"), lambda e: F.startswith(e["value"], F.lit("(")))
    split = lambda e: F.transform(F.split(F.regexp_replace(e["value"], r"^\(|\)\s*$", ""), r"\)\s*\("), lambda x, i: F.struct(e["key"].alias("key"), (i + 1).alias("position"), F.split(x, r"\|").alias("values")))
    return out.withColumn("features", F.flatten(F.transform(listed, split)))


def read_peff_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """key, value, block (from 0) of the '#' lines, blocks parted by '# //'."""
    from pyspark.sql import Window

    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line")).filter(F.startswith("line", F.lit("#")))
    w = Window.partitionBy("source").orderBy("n")
    rows = lines.withColumn("block", F.sum(F.col("line").rlike(r"^#\s*//").cast("int")).over(w))
    return rows.filter(F.contains("line", F.lit("="))).select("source", "block", F.regexp_extract("line", r"^#\s*([^=]+?)\s*=", 1).alias("key"), F.regexp_extract("line", r"=\s*(.*?)\s*$", 1).alias("value"))


def _peak_columns(lines: Column) -> Column:
    return F.transform(lines, lambda x: F.split(F.trim(x), r"\s+"))


def _number(parts: Column, k: int, kind: str) -> Column:
    return F.transform(parts, lambda p: F.get(p, F.lit(k)).try_cast(kind))


def read_mgf(spark: SparkSession, path: str | list[str], use_header: bool = True) -> DataFrame:
    """MGF spectra: source, title, params (lower-case keys), pepmass, charge, rtinseconds, scans, mz, intensity, charge_array, ion_array.

    Comment lines (# ; ! /) and lines without meaning are skipped. With ``use_header`` keys of the
    file's header hold for spectra that lack them. A third peak column that is a number is a charge
    (0 and missing ones are null), else an ion label. An explicit charge in PEPMASS wins.
    """
    r = _records(spark, path, "BEGIN IONS")
    lines = F.filter(F.transform(F.split(F.split(F.col("value"), "END IONS")[0], "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~x.rlike("^[#;!/]"))
    r = r.withColumn("lines", lines).withColumn("is_spectrum", F.contains("value", F.lit("END IONS")))
    keyed = F.filter("lines", lambda x: x.rlike(r"^[A-Za-z][\w ]*="))
    pairs = last_wins(F.transform(keyed, lambda x: F.lower(F.trim(F.regexp_extract(x, r"^([^=]*)=", 1)))), F.transform(keyed, lambda x: F.trim(F.regexp_extract(x, r"^[^=]*=(.*)$", 1))))
    r = r.withColumn("params", pairs)
    spectra = r.filter("is_spectrum")
    if use_header:
        heads = r.filter("not is_spectrum").filter(F.size("params") > 0).groupBy("source").agg(F.first("params").alias("head"))
        spectra = spectra.join(heads, "source", "left")
        own = F.col("params")
        spectra = spectra.withColumn("params", F.when(F.col("head").isNull(), own).otherwise(F.map_concat(F.map_filter("head", lambda k, v: ~F.map_contains_key(own, k)), own)))
    peaks = _peak_columns(F.filter("lines", lambda x: x.rlike(r"^[-+]?[0-9.]")))
    s = spectra.withColumn("peaks", peaks)
    p = lambda k: F.element_at("params", k)
    mass = X.parse_pepmass(p("pepmass"))
    charges = F.when(mass["charge"].isNotNull(), F.array(mass["charge"])).otherwise(X.parse_charge_list(p("charge")))
    third = _number(F.col("peaks"), 2, "string")
    return s.select(
        "source",
        p("title").alias("title"),
        "params",
        F.when(p("pepmass").isNotNull(), F.struct(mass["mz"].alias("mz"), mass["intensity"].alias("intensity"))).alias("pepmass"),
        charges.alias("charge"),
        p("rtinseconds").try_cast("double").alias("rtinseconds"),
        p("scans").alias("scans"),
        _number(F.col("peaks"), 0, "double").alias("mz"),
        _number(F.col("peaks"), 1, "double").alias("intensity"),
        F.transform(third, lambda x: F.nullif(X.parse_charge(x), F.lit(0))).alias("charge_array"),
        F.transform(third, lambda x: F.when(X.parse_charge(x).isNull(), x)).alias("ion_array"),
    )


def read_mgf_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source, key, value of the file headers."""
    r = _records(spark, path, "BEGIN IONS").filter(~F.contains("value", F.lit("END IONS")))
    line = r.select("source", F.explode(F.split("value", "\n")).alias("line")).filter(F.col("line").rlike(r"^[A-Za-z][\w ]*="))
    return line.select("source", F.lower(F.trim(F.regexp_extract("line", "^([^=]*)=", 1))).alias("key"), F.trim(F.regexp_extract("line", "^[^=]*=(.*)$", 1)).alias("value"))


def _read_ms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    r = _records(spark, path, "\nS").filter(F.col("value").rlike(r"^S?\s+\d"))
    lines = F.filter(F.transform(F.split(F.regexp_replace("value", r"^S?\s+", ""), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    r = r.withColumn("lines", lines).withColumn("first", F.split(F.get("lines", F.lit(0)), r"\s+"))
    info = F.filter("lines", lambda x: x.rlike(r"^[ID]\s"))
    r = r.withColumn("params", last_wins(F.transform(info, lambda x: F.regexp_extract(x, r"^[ID]\s+(\S+)", 1)), F.transform(info, lambda x: F.regexp_extract(x, r"^[ID]\s+\S+\s*(.*)$", 1))))
    return r.withColumn("peaks", _peak_columns(F.filter("lines", lambda x, i: (i > 0) & x.rlike(r"^[0-9.]"))))


def read_ms1(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """MS1 scans: source, scan_from, scan_to, params, mz, intensity. Header lines are read by :func:`read_ms_header`."""
    r = _read_ms(spark, path)
    return r.select("source", F.get("first", F.lit(0)).alias("scan_from"), F.get("first", F.lit(1)).alias("scan_to"), "params", F.element_at("params", "RTime").try_cast("double").alias("rtime"), _number(F.col("peaks"), 0, "double").alias("mz"), _number(F.col("peaks"), 1, "double").alias("intensity"))


def read_ms2(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """MS2 scans: as MS1, with precursor_mz, charge and neutral_mass (of the Z lines), charge_array and resolution of the peaks."""
    r = _read_ms(spark, path)
    z = F.transform(F.filter("lines", lambda x: x.rlike(r"^Z\s")), lambda x: F.split(x, r"\s+"))
    four = F.exists("peaks", lambda p: F.size(p) > 3)
    return r.select(
        "source",
        F.get("first", F.lit(0)).alias("scan_from"),
        F.get("first", F.lit(1)).alias("scan_to"),
        F.get("first", F.lit(2)).try_cast("double").alias("precursor_mz"),
        "params",
        F.element_at("params", "RTime").try_cast("double").alias("rtime"),
        F.transform(z, lambda p: F.get(p, F.lit(1)).try_cast("double")).alias("charge"),
        F.transform(z, lambda p: F.get(p, F.lit(2)).try_cast("double")).alias("neutral_mass"),
        _number(F.col("peaks"), 0, "double").alias("mz"),
        _number(F.col("peaks"), 1, "double").alias("intensity"),
        F.transform(_number(F.col("peaks"), 2, "int"), lambda x: F.nullif(x, F.lit(0))).alias("charge_array"),
        F.when(four, _number(F.col("peaks"), 3, "int")).alias("resolution"),
    )


def read_ms_header(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """source, key, value of the H lines of MS1 and MS2 files."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("source"), F.col("value")).filter(F.col("value").rlike(r"^H\s"))
    return lines.select("source", F.regexp_extract("value", r"^H\s+(\S+)", 1).alias("key"), F.trim(F.regexp_extract("value", r"^H\s+\S+\s*(.*)$", 1)).alias("value"))


_SECTIONS = {"PRT": "PRH", "PEP": "PEH", "PSM": "PSH", "SML": "SMH", "SMF": "SFH", "SME": "SEH"}


def mztab_cell(cell: Column) -> Column:
    """A cell with 'null' as null."""
    return F.when(F.lower(cell) != "null", cell)


def read_mztab(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """metadata (key, value), comments, and one table of strings for each section of the file (PRT, PEP, PSM, SML, SMF, SME).

    Column names come from each file's own header rows (a column that a file lacks is null there); 'null' is null. Cast with :func:`cast_mztab`.
    """
    cells = spark.read.text(path).select(F.split("value", "\t").alias("c"), F.col("_metadata.file_path").alias("source")).filter(F.size("c") > 1)
    kind = F.get("c", F.lit(0))
    out = {
        "metadata": cells.filter(kind == "MTD").select(F.get("c", F.lit(1)).alias("key"), mztab_cell(F.get("c", F.lit(2))).alias("value")),
        "comments": cells.filter(kind == "COM").select(F.get("c", F.lit(1)).alias("comment")),
    }
    head_rows = cells.filter(kind.isin(*_SECTIONS.values()))
    heads: dict[str, list[list[str]]] = {}
    for k, c in head_rows.select(kind.alias("k"), "c").distinct().collect():  # one row for each different header, not for each file
        heads.setdefault(k, []).append(c[1:])
    for section, head in _SECTIONS.items():
        if head not in heads:
            continue
        rows = cells.filter(kind == section)
        if len(heads[head]) == 1:
            out[section] = rows.select(*[mztab_cell(F.get("c", F.lit(i + 1))).alias(n) for i, n in enumerate(heads[head][0])])
            continue
        # files with differing columns: each row is read by its own file's header
        own = head_rows.filter(kind == head).groupBy("source").agg(F.first(F.slice("c", 2, F.size("c"))).alias("names"))
        named = rows.join(own, "source").select(last_wins(F.col("names"), F.transform("names", lambda _, i: F.get("c", i + 1))).alias("m"))
        out[section] = named.select(*[mztab_cell(F.try_element_at("m", F.lit(n))).alias(n) for n in dict.fromkeys(n for names in sorted(heads[head]) for n in names)])
    return out


def cast_mztab(df: DataFrame) -> DataFrame:
    """Columns whose every value is a whole number or a number get that type."""
    probe = df.agg(*[F.struct(F.every(F.col(f"`{c}`").try_cast("bigint").isNotNull() | F.col(f"`{c}`").isNull()).alias("i"), F.every(F.col(f"`{c}`").try_cast("double").isNotNull() | F.col(f"`{c}`").isNull()).alias("d"), F.count(f"`{c}`").alias("n")).alias(f"c{k}") for k, c in enumerate(df.columns)]).first()
    kinds = ["bigint" if p["n"] and p["i"] else "double" if p["n"] and p["d"] else "string" for p in probe]
    return df.select(*[F.col(f"`{c}`").cast(k).alias(c) for c, k in zip(df.columns, kinds)])


def mztab_variant(metadata: DataFrame) -> tuple[str | None, str | None]:
    """(version, variant): variant 'M' or 'P'."""
    row = metadata.filter(F.col("key") == "mzTab-version").select("value").first()
    version = row[0] if row else None
    return version, ("M" if version and version.upper().endswith("M") else "P" if version else None)


def mztab_groups(metadata: DataFrame) -> DataFrame:
    """Keys like 'ms_run[1]-location' as entity, index, property, value."""
    p = r"^([A-Za-z_]+)(?:\[(\d+)\])?(?:-(.*))?$"
    return metadata.select(F.regexp_extract("key", p, 1).alias("entity"), F.regexp_extract("key", p, 2).try_cast("int").alias("index"), F.nullif(F.regexp_extract("key", p, 3), F.lit("")).alias("property"), "value")


def mztab_param(cell: Column | str) -> Column:
    """struct(cv, accession, name, value) of '[cv, accession, name, value]'; null if it isn't one."""
    c = F.col(cell) if isinstance(cell, str) else cell
    p = r"^\s*\[\s*([^,]*),\s*([^,]*),\s*(\"[^\"]*\"|[^,]*),\s*(.*?)\s*\]\s*$"
    part = lambda k: F.nullif(F.trim(F.regexp_replace(F.regexp_extract(c, p, k), '^"|"$', "")), F.lit(""))
    return F.when(c.rlike(p), F.struct(part(1).alias("cv"), part(2).alias("accession"), part(3).alias("name"), part(4).alias("value")))


PROXI_SCHEMA = "array<struct<usi:string,status:string,mzs:array<string>,intensities:array<string>,attributes:array<struct<accession:string,name:string,value:string>>>>"


def proxi_spectra(json_text: Column | str) -> Column:
    """Spectra of a PROXI response (JSON text): arrays as doubles, attributes as they are."""
    rows = F.from_json(json_text, PROXI_SCHEMA)
    return F.transform(rows, lambda r: F.struct(r["usi"].alias("usi"), F.transform(r["mzs"], lambda x: x.cast("double")).alias("mz"), F.transform(r["intensities"], lambda x: x.cast("double")).alias("intensity"), r["attributes"].alias("attributes")))


def merge_proxi(responses: DataFrame, usi: str = "usi", spectrum: str = "spectrum") -> DataFrame:
    """One spectrum per USI from the responses of several servers: the longest arrays, attributes distinct by accession and value."""
    s = F.col(spectrum)
    best = responses.groupBy(usi).agg(F.max_by(F.struct(s["mz"].alias("mz"), s["intensity"].alias("intensity")), F.size(s["mz"])).alias("a"), F.array_distinct(F.flatten(F.collect_list(s["attributes"]))).alias("attributes"))
    return best.select(usi, "a.mz", "a.intensity", "attributes")


def fasta_lines(description: Column | str, sequence: Column | str, width: int = 70) -> Column:
    """One entry as text: header (line feeds become comment lines), wrapped sequence, blank line."""
    d = F.col(description) if isinstance(description, str) else description
    s = F.col(sequence) if isinstance(sequence, str) else sequence
    return F.concat(F.lit(">"), F.regexp_replace(d, "\n", "\n;"), F.lit("\n"), F.regexp_replace(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), "\n$", ""), F.lit("\n"))


def write_fasta(df: DataFrame, path: str, description: str = "description", sequence: str = "sequence", mode: str = "errorifexists") -> None:
    df.select(fasta_lines(description, sequence).alias("value")).write.mode(mode).text(path)


def decoy_db(df: DataFrame, mode: str = "reverse", prefix: str = X.DECOY_PREFIX, decoy_only: bool = False, description: str = "description", sequence: str = "sequence", **kwargs) -> DataFrame:
    """Targets and decoys (or decoys only) with the prefix in the description."""
    make = {"reverse": X.reverse_decoy, "shuffle": X.shuffle_decoy, "fused": X.fused_decoy}[mode]
    decoys = df.withColumn(description, F.concat(F.lit(prefix), F.col(description))).withColumn(sequence, make(F.col(sequence), **kwargs))
    return decoys if decoy_only else df.unionByName(decoys)


def mgf_text(params: Column, mz: Column, intensity: Column, charges: Column | None = None, ions: Column | None = None, header: dict[str, str] | None = None, fragment_format: str = "%.5f %.1f") -> Column:
    """One spectrum as MGF text: title, pepmass, rtinseconds and charge first, then the other keys in order; keys equal to the header's are left out."""
    order = ["title", "pepmass", "rtinseconds", "charge"]
    same = F.create_map(*[F.lit(x) for kv in (header or {"": ""}).items() for x in kv])
    keys = F.concat(F.filter(F.array(*[F.lit(k) for k in order]), lambda k: F.map_contains_key(params, k)), F.array_sort(F.filter(F.map_keys(params), lambda k: ~k.isin(*order))))
    kept = F.filter(keys, lambda k: F.coalesce(F.element_at(same, k) != F.element_at(params, k), F.lit(True)))
    lines = F.transform(kept, lambda k: F.concat(F.upper(k), F.lit("="), F.element_at(params, k)))
    extra = lambda i: (F.concat(F.lit(" "), X.format_charge(F.coalesce(F.get(charges, i), F.lit(0)))) if charges is not None else F.lit("") if ions is None else F.concat(F.lit(" "), F.coalesce(F.get(ions, i), F.lit(""))))
    peaks = F.transform(F.arrays_zip(mz.alias("m"), intensity.alias("i")), lambda p, i: F.concat(F.format_string(fragment_format, p["m"], p["i"]), extra(i)))
    return F.concat(F.lit("BEGIN IONS\n"), F.array_join(F.concat(lines, peaks), "\n"), F.lit("\nEND IONS\n"))


def write_mgf(df: DataFrame, path: str, params: str = "params", mz: str = "mz", intensity: str = "intensity", charges: str | None = None, ions: str | None = None, header: dict[str, str] | None = None, mode: str = "errorifexists") -> None:
    """Spectra as MGF part files. A header goes into keys of the spectra, as parts have no common head."""
    text = mgf_text(F.col(params), F.col(mz), F.col(intensity), F.col(charges) if charges else None, F.col(ions) if ions else None, header)
    df.select(text.alias("value")).write.mode(mode).text(path)
