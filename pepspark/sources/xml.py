"""XML formats by Spark's own XML source: one row per ``rowTag`` element, explicit schemas, values cast late."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.functions import arrays as A
from pepspark.functions import text as X
from pepspark.functions.seq import let
from pepspark.sources.text import last_wins

CV = "array<struct<_accession:string,_name:string,_value:string,_unitName:string,_unitAccession:string>>"
_CV_LIST = f"cvParam:{CV},userParam:{CV}"


def read_xml(spark: SparkSession, path: str | list[str], tag: str, schema: str) -> DataFrame:
    """Elements ``tag`` (local name, at any depth) with an explicit schema; attributes have the prefix '_', text is _VALUE.

    The column 'source' is the file; ids are unique within a file only, so every join has it in its key.
    """
    raw = spark.read.format("xml").option("rowTag", tag).option("ignoreNamespace", "true").option("attributePrefix", "_").option("valueTag", "_VALUE").schema(schema).load(path)
    return raw.withColumn("source", F.col("_metadata.file_path"))


def cv_params(params: Column) -> Column:
    """array<struct<accession, name, value, unit>> of cvParam elements; null becomes empty."""
    empty = F.array().cast("array<struct<accession:string,name:string,value:string,unit:string>>")
    return F.coalesce(F.transform(params, lambda p: F.struct(p["_accession"].alias("accession"), p["_name"].alias("name"), p["_value"].alias("value"), p["_unitName"].alias("unit"))), empty)


def _value(params: Column, accession: str) -> Column:
    return F.get(F.filter(params, lambda p: p["accession"] == accession), F.lit(0))["value"]


def _has(params: Column, *accessions: str) -> Column:
    return F.exists(params, lambda p: p["accession"].isin(*accessions))


_ARRAY = f"struct<binaryDataArray:array<struct<_arrayLength:string,{_CV_LIST},referenceableParamGroupRef:array<struct<_ref:string>>,binary:string>>>"
_PRECURSOR = f"struct<precursor:array<struct<_spectrumRef:string,selectedIonList:struct<selectedIon:array<struct<{_CV_LIST}>>>,isolationWindow:struct<{_CV_LIST}>,activation:struct<{_CV_LIST}>>>>"
MZML_SPECTRUM = f"_id string, _index bigint, _defaultArrayLength bigint, referenceableParamGroupRef array<struct<_ref:string>>, cvParam {CV}, userParam {CV}, scanList struct<{_CV_LIST},scan:array<struct<{_CV_LIST},scanWindowList:struct<scanWindow:array<struct<{_CV_LIST}>>>>>>, precursorList {_PRECURSOR}, binaryDataArrayList {_ARRAY}"
# PSI-MS accessions of array kinds, types and compressions.
_KINDS = {"MS:1000514": "mz", "MS:1000515": "intensity", "MS:1000516": "charge", "MS:1000595": "time"}
_TYPES = {"MS:1000521": "f32", "MS:1000523": "f64", "MS:1000519": "i32", "MS:1000522": "i64"}
_COMPRESSIONS = {"MS:1000574": "zlib", "MS:1000576": "none", "MS:1002312": "linear", "MS:1002313": "pic", "MS:1002314": "slof", "MS:1002746": "zlib-linear", "MS:1002747": "zlib-pic", "MS:1002748": "zlib-slof"}


def _named(params: Column, table: dict[str, str], default: str | None) -> Column:
    out = F.lit(default)
    for accession, name in table.items():
        out = F.when(_has(params, accession), name).otherwise(out)
    return out


# Further array kinds of the PSI-MS vocabulary; others go by the name of their term.
_MORE_KINDS = {"MS:1000517": "signal to noise array", "MS:1000617": "wavelength array", "MS:1000820": "flow rate array", "MS:1000821": "pressure array", "MS:1000822": "temperature array", "MS:1002477": "mean ion mobility drift time array", "MS:1003006": "mean inverse reduced ion mobility array", "MS:1002742": "noise array", "MS:1002743": "mass resolution array", "MS:1002744": "baseline array"}


def _arrays(binary: Column) -> Column:
    """The binary arrays of one element, where they stand: map(name -> array<double>), and their units as map(name -> unit).

    Known kinds have short names (mz, intensity, charge, time); others the name of the parameter that ends in 'array'; a
    non-standard array the name in its value. Of arrays with the same name the last counts. The texts of a row go through
    one Arrow call, so nothing is exploded or joined.
    """
    known = {**_KINDS, **_MORE_KINDS}
    empty = F.array().cast("array<struct<name:string,unit:string,compression:string,dtype:string,text:string>>")

    def one(b: Column) -> Column:
        p = cv_params(b["cvParam"])
        named = F.get(F.filter(p, lambda x: x["accession"].isin(*known)), F.lit(0))
        other = F.get(F.filter(p, lambda x: F.endswith(x["name"], F.lit("array"))), F.lit(0))
        free = F.get(F.filter(p, lambda x: x["accession"] == "MS:1000786"), F.lit(0))
        short = named["accession"]
        for accession, name in known.items():
            short = F.when(named["accession"] == accession, F.lit(name)).otherwise(short)
        name = F.coalesce(short, F.when(free.isNotNull(), F.coalesce(F.nullif(free["value"], F.lit("")), free["name"])), other["name"], F.lit("array"))
        return F.struct(name.alias("name"), F.coalesce(named["unit"], free["unit"], other["unit"]).alias("unit"), _named(p, _COMPRESSIONS, "none").alias("compression"), _named(p, _TYPES, "f64").alias("dtype"), F.trim(b["binary"]).alias("text"))

    return F.coalesce(F.transform(binary, one), empty)


def _decoded(df: DataFrame, arrays: str) -> DataFrame:
    """``df`` with the columns arrays (name -> values) and array_units (name -> unit) in place of the encoded ``arrays``."""
    values = A.decode_arrays(F.transform(arrays, lambda a: a["text"]), F.transform(arrays, lambda a: a["compression"]), F.transform(arrays, lambda a: a["dtype"]))
    names = F.transform(F.col(arrays), lambda a: a["name"])
    rows = df.withColumn("__values", values)
    rows = rows.withColumn("arrays", last_wins(names, F.col("__values"))).withColumn("array_units", last_wins(names, F.transform(F.col(arrays), lambda a: a["unit"])))
    return rows.drop("__values", arrays)


def read_mzml(spark: SparkSession, path: str | list[str], decode: bool = True) -> DataFrame:
    """mzML spectra: spectrum_id, idx, ms_level, rt (minutes), cv_params, scan_params, precursors, mz, intensity, charge_array, arrays (all arrays by name), array_units.

    Referenced parameter groups are joined in; arrays may be plain, zlib or MS-Numpress. With
    ``decode`` False the arrays stay encoded in binaryDataArrayList.
    """
    raw = read_xml(spark, path, "spectrum", MZML_SPECTRUM)
    groups = read_xml(spark, path, "referenceableParamGroup", f"_id string, cvParam {CV}").select("source", F.col("_id").alias("__g"), cv_params(F.col("cvParam")).alias("__p"))
    refs = raw.select("source", "_id", F.explode("referenceableParamGroupRef._ref").alias("__g")).join(groups, ["source", "__g"]).groupBy("source", "_id").agg(F.flatten(F.collect_list("__p")).alias("__group"))
    s = raw.join(refs, ["source", "_id"], "left").withColumn("cv_params", F.concat(cv_params(F.col("cvParam")), F.coalesce("__group", F.array().cast("array<struct<accession:string,name:string,value:string,unit:string>>"))))
    scan = F.get("scanList.scan", F.lit(0))
    s = s.withColumn("scan_params", cv_params(scan["cvParam"]))
    start = F.get(F.filter("scan_params", lambda p: p["accession"] == "MS:1000016"), F.lit(0))
    precursors = F.transform(
        F.coalesce(F.col("precursorList.precursor"), F.array().cast(f"array<struct<_spectrumRef:string,selectedIonList:struct<selectedIon:array<struct<{_CV_LIST}>>>,isolationWindow:struct<{_CV_LIST}>,activation:struct<{_CV_LIST}>>>")),
        lambda p: F.struct(
            _value(cv_params(F.get(p["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]), "MS:1000744").cast("double").alias("mz"),
            _value(cv_params(F.get(p["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]), "MS:1000042").cast("double").alias("intensity"),
            _value(cv_params(F.get(p["selectedIonList"]["selectedIon"], F.lit(0))["cvParam"]), "MS:1000041").cast("int").alias("charge"),
            p["_spectrumRef"].alias("ref"),
        ),
    )
    out = s.select(
        "source",
        F.col("_id").alias("spectrum_id"),
        F.col("_index").alias("idx"),
        F.col("_defaultArrayLength").alias("array_length"),
        _value(F.col("cv_params"), "MS:1000511").cast("int").alias("ms_level"),
        (start["value"].cast("double") / F.when(start["unit"] == "second", 60.0).otherwise(1.0)).alias("rt"),
        "cv_params",
        "scan_params",
        precursors.alias("precursors"),
        "binaryDataArrayList",
    )
    if not decode:
        return out
    rows = _decoded(out.withColumn("__arrays", _arrays(F.col("binaryDataArrayList.binaryDataArray"))).drop("binaryDataArrayList"), "__arrays")
    value = lambda k: F.element_at("arrays", k)
    return rows.withColumn("mz", value("mz")).withColumn("intensity", value("intensity")).withColumn("charge_array", A.mask_zero(value("charge")))


def read_chromatograms(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """mzML chromatograms: chromatogram_id, time, intensity, arrays (by name), array_units."""
    raw = read_xml(spark, path, "chromatogram", f"_id string, cvParam {CV}, binaryDataArrayList {_ARRAY}").select("source", F.col("_id").alias("chromatogram_id"), _arrays(F.col("binaryDataArrayList.binaryDataArray")).alias("__arrays"))
    return _decoded(raw, "__arrays").withColumn("time", F.element_at("arrays", "time")).withColumn("intensity", F.element_at("arrays", "intensity"))


_SCAN = "_num:string,_msLevel:string,_peaksCount:string,_polarity:string,_retentionTime:string,_lowMz:string,_highMz:string,_basePeakMz:string,_basePeakIntensity:string,_totIonCurrent:string,precursorMz:array<struct<_VALUE:string,_precursorIntensity:string,_precursorCharge:string>>,peaks:array<struct<_VALUE:string,_precision:string,_compressionType:string,_byteOrder:string>>"


def read_mzxml(spark: SparkSession, path: str | list[str], depth: int = 8) -> DataFrame:
    """mzXML scans, nested ones too (a file nested deeper than ``depth`` levels raises an error when it is read), ordered by nothing: num, ms_level, rt (minutes), peaks_count, precursors, mz, intensity."""
    inner = f"array<struct<{_SCAN},scan:array<struct<_num:string>>>>"
    for _ in range(depth - 1):
        inner = f"array<struct<{_SCAN},scan:{inner}>>"
    schema = ", ".join(f"{x.split(':', 1)[0]} {x.split(':', 1)[1]}" for x in _split_fields(_SCAN)) + f", scan {inner}"
    level = read_xml(spark, path, "scan", schema)
    names = [x.split(":", 1)[0] for x in _split_fields(_SCAN)]
    scans = level.select("source", *names)
    for k in range(depth):
        level = level.select("source", F.explode("scan").alias("s"))
        here = level
        if k == depth - 1:
            deeper = F.coalesce(F.size("s.scan"), F.lit(0)) > 0
            here = level.withColumn("s", F.when(deeper, F.raise_error(F.lit(f"scans are nested deeper than {depth} levels: pass a larger depth")).cast(level.schema["s"].dataType)).otherwise(F.col("s")))
        scans = scans.unionByName(here.select("source", *[F.col(f"s.{n}").alias(n) for n in names]))
        if k < depth - 1:
            level = level.select("source", F.col("s.scan").alias("scan"))
    peaks = F.get("peaks", F.lit(0))
    s = scans.withColumn("__text", F.trim(peaks["_VALUE"])).withColumn("__z", F.when(peaks["_compressionType"] == "zlib", "zlib").otherwise("none")).withColumn("__t", F.when(peaks["_precision"] == "64", "f64be").otherwise("f32be"))
    s = s.withColumn("__flat", A.decode_binary("__text", "__z", "__t"))
    return s.select(
        "source",
        F.col("_num").alias("num"),
        F.col("_msLevel").cast("int").alias("ms_level"),
        F.col("_polarity").alias("polarity"),
        F.col("_peaksCount").cast("int").alias("peaks_count"),
        X.duration_minutes("_retentionTime").alias("rt"),
        F.col("_totIonCurrent").cast("double").alias("total_ion_current"),
        F.transform("precursorMz", lambda p: F.struct(p["_VALUE"].cast("double").alias("mz"), p["_precursorIntensity"].cast("double").alias("intensity"), p["_precursorCharge"].cast("int").alias("charge"))).alias("precursors"),
        F.filter("__flat", lambda _, i: i % 2 == 0).alias("mz"),
        F.filter("__flat", lambda _, i: i % 2 == 1).alias("intensity"),
    )


def _split_fields(spec: str) -> list[str]:
    out, depth, at = [], 0, 0
    for i, c in enumerate(spec):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(spec[at:i])
            at = i + 1
    return [*out, spec[at:]]


_NV = "array<struct<_name:string,_value:string>>"
_PROT = "_protein:string,_protein_descr:string,_num_tol_term:string,_peptide_prev_aa:string,_peptide_next_aa:string"
PEPXML_QUERY = (
    "_spectrum string, _spectrumNativeID string, _start_scan int, _end_scan int, _index int, _assumed_charge int, _precursor_neutral_mass double, _retention_time_sec double, "
    f"search_result array<struct<search_hit:array<struct<_hit_rank:int,_peptide:string,_calc_neutral_pep_mass:double,_massdiff:string,_num_tot_proteins:int,_num_missed_cleavages:int,_is_rejected:string,{_PROT},"
    f"alternative_protein:array<struct<{_PROT}>>,search_score:{_NV},modification_info:array<struct<_modified_peptide:string,_mod_nterm_mass:double,_mod_cterm_mass:double,mod_aminoacid_mass:array<struct<_position:int,_mass:double>>>>,"
    f"analysis_result:array<struct<_analysis:string,peptideprophet_result:struct<_probability:double,_all_ntt_prob:string>,interprophet_result:struct<_probability:double,_all_ntt_prob:string>>>>>>>"
)


def _protein(p: Column) -> Column:
    return F.struct(p["_protein"].alias("protein"), p["_protein_descr"].alias("protein_descr"), p["_num_tol_term"].cast("int").alias("num_tol_term"), p["_peptide_prev_aa"].alias("peptide_prev_aa"), p["_peptide_next_aa"].alias("peptide_next_aa"))


def read_pepxml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """pepXML spectrum queries with search_hit (sorted by rank): proteins, search_score (map), modifications, prophet results."""
    raw = read_xml(spark, path, "spectrum_query", PEPXML_QUERY)

    def hit(h: Column) -> Column:
        info = F.get(h["modification_info"], F.lit(0))
        n = F.length(h["_peptide"])
        place = lambda mass, at: F.when(mass.isNotNull(), F.struct(at.cast("int").alias("position"), mass.alias("mass")))
        mods = F.array_compact(F.concat(F.array(place(info["_mod_nterm_mass"], F.lit(0))), F.coalesce(F.transform(info["mod_aminoacid_mass"], lambda m: F.struct(m["_position"].alias("position"), m["_mass"].alias("mass"))), F.array().cast("array<struct<position:int,mass:double>>")), F.array(place(info["_mod_cterm_mass"], n + 1))))
        empty = F.array().cast("array<struct<protein:string,protein_descr:string,num_tol_term:int,peptide_prev_aa:string,peptide_next_aa:string>>")
        scores = F.coalesce(h["search_score"], F.array().cast(_NV))
        return F.struct(
            h["_hit_rank"].alias("hit_rank"),
            h["_peptide"].alias("peptide"),
            F.coalesce(info["_modified_peptide"], h["_peptide"]).alias("modified_peptide"),
            h["_calc_neutral_pep_mass"].alias("calc_neutral_pep_mass"),
            F.regexp_replace(h["_massdiff"], "^\\+-", "-").try_cast("double").alias("massdiff"),
            h["_num_tot_proteins"].alias("num_tot_proteins"),
            h["_num_missed_cleavages"].alias("num_missed_cleavages"),
            X.parse_bool(h["_is_rejected"]).alias("is_rejected"),
            F.concat(F.array(_protein(h)), F.coalesce(F.transform(h["alternative_protein"], _protein), empty)).alias("proteins"),
            F.map_from_arrays(F.transform(scores, lambda s: s["_name"]), F.transform(scores, lambda s: s["_value"].try_cast("double"))).alias("search_score"),
            mods.alias("modifications"),
            F.transform(h["analysis_result"], lambda a: F.struct(a["_analysis"].alias("analysis"), F.coalesce(a["peptideprophet_result"]["_probability"], a["interprophet_result"]["_probability"]).alias("probability"))).alias("analysis_result"),
        )

    hits = F.transform(F.flatten(F.col("search_result.search_hit")), hit)
    # the comparison needs only rank and place, as hits hold maps, which have no order
    ranked = let(hits, lambda a: F.transform(F.array_sort(F.transform(a, lambda h, i: F.struct(h["hit_rank"].alias("r"), i.alias("i")))), lambda x: F.get(a, x["i"])))
    return raw.select(
        "source",
        F.col("_spectrum").alias("spectrum"),
        F.col("_start_scan").alias("start_scan"),
        F.col("_end_scan").alias("end_scan"),
        F.col("_index").alias("index"),
        F.col("_assumed_charge").alias("assumed_charge"),
        F.col("_precursor_neutral_mass").alias("precursor_neutral_mass"),
        F.col("_retention_time_sec").alias("retention_time_sec"),
        ranked.alias("search_hit"),
    )


def flatten_pepxml(queries: DataFrame, by: str = "query", sep: str | None = None) -> DataFrame:
    """Flat table of pepXML queries: the top hit of each (``by='query'``) or all hits (``by='search_hit'``).

    Protein attributes are parallel lists, or texts joined by ``sep``; modifications 'mass@position'.
    Queries without hits are left out. Scores come as the map 'search_score'.
    """
    h = F.explode("search_hit") if by == "search_hit" else F.get("search_hit", F.lit(0))
    keep = [c for c in queries.columns if c != "search_hit"]
    rows = queries.select(*keep, h.alias("h")).filter("h is not null")
    joined = lambda c: F.concat_ws(sep, c) if sep is not None else c
    proteins = F.col("h.proteins")
    return rows.select(
        *keep,
        *[F.col(f"h.{c}").alias(c) for c in ("hit_rank", "peptide", "modified_peptide", "calc_neutral_pep_mass", "massdiff", "num_tot_proteins", "num_missed_cleavages", "is_rejected", "search_score")],
        *[joined(proteins[c].cast("array<string>")).alias(c) for c in ("protein", "protein_descr", "num_tol_term", "peptide_prev_aa", "peptide_next_aa")],
        F.transform("h.modifications", lambda m: F.format_string("%.3f@%d", m["mass"], m["position"])).alias("modifications"),
        F.get(F.filter("h.analysis_result", lambda a: a["analysis"] == "peptideprophet"), F.lit(0))["probability"].alias("peptideprophet_probability"),
        F.get(F.filter("h.analysis_result", lambda a: a["analysis"] == "interprophet"), F.lit(0))["probability"].alias("interprophet_probability"),
    )


def roc_curve(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Points of the prophet error tables: charge, tag ('roc_data_point' or 'error_point'), min_prob, sensitivity or error, counts."""
    point = "array<struct<_min_prob:double,_sensitivity:double,_error:double,_num_corr:double,_num_incorr:double>>"
    raw = read_xml(spark, path, "roc_error_data", f"_charge string, roc_data_point {point}, error_point {point}")
    parts = [raw.select("source", F.col("_charge").alias("charge"), F.lit(t).alias("tag"), F.explode(t).alias("p")) for t in ("roc_data_point", "error_point")]
    return parts[0].unionByName(parts[1]).select("source", "charge", "tag", F.col("p._min_prob").alias("min_prob"), F.col("p._sensitivity").alias("sensitivity"), F.col("p._error").alias("error"), F.col("p._num_corr").alias("num_corr"), F.col("p._num_incorr").alias("num_incorr"))


PROTXML_GROUP = "_group_number bigint, _probability double, protein array<struct<_protein_name:string,_n_indistinguishable_proteins:int,_probability:double,_percent_coverage:double,_unique_stripped_peptides:string,_group_sibling_id:string,_total_number_peptides:int,_pct_spectrum_ids:double,indistinguishable_protein:array<struct<_protein_name:string>>,annotation:array<struct<_protein_description:string>>,peptide:array<struct<_peptide_sequence:string,_charge:int,_initial_probability:double,_nsp_adjusted_probability:double,_weight:double,_n_instances:int,_calc_neutral_pep_mass:double>>>>"


def read_protxml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """protXML groups: group_number, probability, protein (array of structs)."""
    raw = read_xml(spark, path, "protein_group", PROTXML_GROUP)
    one = lambda p: F.struct(
        p["_protein_name"].alias("protein_name"),
        p["_probability"].alias("probability"),
        p["_percent_coverage"].alias("percent_coverage"),
        F.split(p["_unique_stripped_peptides"], r"\+").alias("unique_stripped_peptides"),
        p["_total_number_peptides"].alias("total_number_peptides"),
        F.transform(p["indistinguishable_protein"], lambda x: x["_protein_name"]).alias("indistinguishable_protein"),
        F.get(p["annotation"], F.lit(0))["_protein_description"].alias("protein_description"),
        F.transform(p["peptide"], lambda x: F.struct(x["_peptide_sequence"].alias("peptide_sequence"), x["_charge"].alias("charge"), x["_initial_probability"].alias("initial_probability"), x["_nsp_adjusted_probability"].alias("nsp_adjusted_probability"), x["_n_instances"].alias("n_instances"))).alias("peptide"),
    )
    return raw.select("source", F.col("_group_number").alias("group_number"), F.col("_probability").alias("probability"), F.transform("protein", one).alias("protein"))


def flatten_protxml(groups: DataFrame) -> DataFrame:
    """One row per protein, with its group."""
    return groups.select("source", "group_number", F.col("probability").alias("group_probability"), F.explode("protein").alias("p")).select("source", "group_number", "group_probability", "p.*")


_DOMAIN = "struct<_id:string,_start:int,_end:int,_expect:double,_mh:double,_delta:double,_hyperscore:double,_nextscore:double,_y_score:double,_b_score:double,_pre:string,_post:string,_seq:string,_missed_cleavages:int,aa:array<struct<_type:string,_at:int,_modified:double>>>"
TANDEM_GROUP = f"_id string, _mh double, _z int, _rt string, _expect double, _label string, _type string, _sumI double, _maxI double, _fI double, protein array<struct<_expect:double,_uid:string,_label:string,_sumI:double,note:array<struct<_VALUE:string,_label:string>>,file:struct<_URL:string>,peptide:struct<_start:int,_end:int,domain:array<{_DOMAIN}>>>>, group array<struct<_label:string,_type:string,note:array<struct<_VALUE:string,_label:string>>>>"


def read_tandem(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """X!Tandem models: id, mh, z, rt, expect, protein (array), support notes. Other groups are left out."""
    raw = read_xml(spark, path, "group", TANDEM_GROUP).filter(F.col("_type") == "model")
    mods = lambda d: F.transform(d["aa"], lambda a: F.struct(a["_type"].alias("type"), a["_at"].alias("at"), a["_modified"].alias("modified")))
    protein = lambda p: F.struct(
        p["_label"].alias("label"),
        p["_expect"].alias("expect"),
        p["_uid"].alias("uid"),
        F.get(p["note"], F.lit(0))["_VALUE"].alias("note"),
        F.transform(p["peptide"]["domain"], lambda d: F.struct(d["_seq"].alias("seq"), d["_start"].alias("start"), d["_end"].alias("end"), d["_expect"].alias("expect"), d["_mh"].alias("mh"), d["_hyperscore"].alias("hyperscore"), d["_nextscore"].alias("nextscore"), d["_missed_cleavages"].alias("missed_cleavages"), d["_pre"].alias("pre"), d["_post"].alias("post"), mods(d).alias("modifications"))).alias("domains"),
    )
    notes = F.flatten(F.transform(F.coalesce(F.col("group"), F.array().cast("array<struct<_label:string,_type:string,note:array<struct<_VALUE:string,_label:string>>>>")), lambda g: F.coalesce(g["note"], F.array().cast("array<struct<_VALUE:string,_label:string>>"))))
    rt = F.coalesce(X.duration_minutes("_rt") * F.when(F.startswith("_rt", F.lit("P")), 60.0).otherwise(1.0), F.lit(None).cast("double"))
    return raw.select("source", F.col("_id").alias("id"), F.col("_mh").alias("mh"), F.col("_z").alias("z"), rt.alias("rt"), F.col("_expect").alias("expect"), F.col("_label").alias("label"), F.transform("protein", protein).alias("protein"), F.get(F.filter(notes, lambda n: n["_label"] == "Description"), F.lit(0))["_VALUE"].alias("scan_description"))


def flatten_tandem(models: DataFrame) -> DataFrame:
    """One row per model: first protein's peptide, proteins as lists, modifications 'mass@type'."""
    d = F.get(F.get("protein", F.lit(0))["domains"], F.lit(0))
    return models.select("source", "id", "mh", "z", "rt", "expect", "scan_description", d["seq"].alias("seq"), d["start"].alias("start"), d["end"].alias("end"), d["hyperscore"].alias("hyperscore"), d["nextscore"].alias("nextscore"), d["missed_cleavages"].alias("missed_cleavages"), F.transform("protein", lambda p: p["label"]).alias("protein_label"), F.transform("protein", lambda p: p["expect"]).alias("protein_expect"), F.transform(d["modifications"], lambda m: F.concat(F.format_string("%.3f", m["modified"]), F.lit("@"), m["type"])).alias("modifications"))


_SII = f"_id:string,_rank:int,_chargeState:int,_peptide_ref:string,_experimentalMassToCharge:double,_calculatedMassToCharge:double,_passThreshold:string,PeptideEvidenceRef:array<struct<_peptideEvidence_ref:string>>,{_CV_LIST}"


def read_mzid(spark: SparkSession, path: str | list[str], retrieve_refs: bool = True) -> DataFrame:
    """mzIdentML results, one row per spectrum and identification item.

    With ``retrieve_refs`` the peptide (sequence, modifications), its evidences and their proteins
    are joined in; unresolved references stay null.
    """
    raw = read_xml(spark, path, "SpectrumIdentificationResult", f"_id string, _spectrumID string, _spectraData_ref string, SpectrumIdentificationItem array<struct<{_SII}>>, cvParam {CV}")
    items = raw.select("source", F.col("_id").alias("result_id"), F.col("_spectrumID").alias("spectrum_id"), F.explode("SpectrumIdentificationItem").alias("i"))
    scores = cv_params(F.col("i.cvParam"))
    rows = items.select(
        "source",
        "result_id",
        "spectrum_id",
        F.col("i._id").alias("item_id"),
        F.col("i._rank").alias("rank"),
        F.col("i._chargeState").alias("charge"),
        F.col("i._experimentalMassToCharge").alias("experimental_mz"),
        F.col("i._calculatedMassToCharge").alias("calculated_mz"),
        X.parse_bool("i._passThreshold").alias("pass_threshold"),
        F.col("i._peptide_ref").alias("peptide_ref"),
        F.transform("i.PeptideEvidenceRef", lambda e: e["_peptideEvidence_ref"]).alias("evidence_refs"),
        F.map_from_arrays(F.array_distinct(F.transform(scores, lambda s: s["name"])), F.transform(F.array_distinct(F.transform(scores, lambda s: s["name"])), lambda n: F.get(F.filter(scores, lambda s: s["name"] == n), F.lit(0))["value"])).alias("scores"),
    )
    if not retrieve_refs:
        return rows
    peptides = read_xml(spark, path, "Peptide", f"_id string, PeptideSequence string, Modification array<struct<_location:int,_monoisotopicMassDelta:double,cvParam:{CV}>>").select(
        "source", F.col("_id").alias("peptide_ref"), F.col("PeptideSequence").alias("peptide"), F.transform("Modification", lambda m: F.struct(m["_location"].alias("position"), m["_monoisotopicMassDelta"].alias("mass"), F.get(m["cvParam"], F.lit(0))["_name"].alias("name"))).alias("modifications")
    )
    evidence = read_xml(spark, path, "PeptideEvidence", "_id string, _peptide_ref string, _dBSequence_ref string, _start int, _end int, _pre string, _post string, _isDecoy string").filter("_dBSequence_ref is not null")
    db = read_xml(spark, path, "DBSequence", f"_id string, _accession string, _length int, cvParam {CV}").select("source", F.col("_id").alias("_dBSequence_ref"), F.col("_accession").alias("accession"), _value(cv_params(F.col("cvParam")), "MS:1001088").alias("protein_descr"))
    evidence = evidence.join(db, ["source", "_dBSequence_ref"], "left").select("source", F.col("_id").alias("ref"), F.struct(F.col("accession"), F.col("protein_descr"), F.col("_start").alias("start"), F.col("_end").alias("end"), F.col("_pre").alias("pre"), F.col("_post").alias("post"), X.parse_bool("_isDecoy").alias("is_decoy")).alias("e"))
    key = ["source", "result_id", "item_id"]
    found = rows.select(*key, F.posexplode("evidence_refs").alias("n", "ref")).join(evidence, ["source", "ref"]).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "e"))), lambda x: x["e"]).alias("evidence"))
    return rows.join(peptides, ["source", "peptide_ref"], "left").join(found, key, "left")


def flatten_mzid(rows: DataFrame) -> DataFrame:
    """One row per result: its first item, evidences as lists, is_decoy if all evidences are decoys."""
    keys = ("source", "result_id")
    best = rows.groupBy(*keys).agg(F.min_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(F.coalesce("rank", F.lit(1 << 30)), "item_id")).alias("r")).select(*keys, "r.*")
    e = F.col("evidence")
    return best.select(*[c for c in best.columns if c != "evidence"], *[e[c].alias(c) for c in ("accession", "start", "end", "pre", "post")], F.forall(e, lambda x: F.coalesce(x["is_decoy"], F.lit(False))).alias("is_decoy"))


_USER = "UserParam:array<struct<_type:string,_name:string,_value:string>>"


def read_idxml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OpenMS idXML: score_type, higher_score_better, mz, rt, hits (sequence, charge, score, target_decoy, proteins). An identification repeated in a file comes once."""
    raw = read_xml(spark, path, "PeptideIdentification", f"_score_type string, _higher_score_better string, _significance_threshold double, _MZ double, _RT double, _spectrum_reference string, PeptideHit array<struct<_score:double,_sequence:string,_charge:int,_aa_before:string,_aa_after:string,_start:string,_end:string,_protein_refs:string,{_USER}>>")
    proteins = read_xml(spark, path, "ProteinHit", f"_id string, _accession string, _score double, _sequence string, {_USER.replace(':', ' ', 1)}").select("source", F.col("_id").alias("ref"), F.col("_accession").alias("accession"))
    keyed = raw.withColumn("row", F.xxhash64("source", "_MZ", "_RT", "_spectrum_reference", F.to_json("PeptideHit")))
    keyed = keyed.dropDuplicates(["source", "row"])
    hits = keyed.select("source", "row", F.posexplode_outer("PeptideHit").alias("n", "h"))
    refs = hits.select("source", "row", "n", F.posexplode(F.split("h._protein_refs", r"\s+")).alias("k", "ref")).join(proteins, ["source", "ref"]).groupBy("source", "row", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "accession"))), lambda x: x["accession"]).alias("proteins"))
    done = hits.join(refs, ["source", "row", "n"], "left").filter("h is not null").groupBy("source", "row").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("n", "h", "proteins"))),
            lambda x: F.struct(x["h"]["_score"].alias("score"), x["h"]["_sequence"].alias("sequence"), x["h"]["_charge"].alias("charge"), x["h"]["_aa_before"].alias("aa_before"), x["h"]["_aa_after"].alias("aa_after"), F.get(F.filter(x["h"]["UserParam"], lambda u: u["_name"] == "target_decoy"), F.lit(0))["_value"].alias("target_decoy"), x["proteins"].alias("proteins")),
        ).alias("hits")
    )
    return keyed.join(done, ["source", "row"], "left").select("source", F.col("_score_type").alias("score_type"), X.parse_bool("_higher_score_better").alias("higher_score_better"), F.col("_MZ").alias("mz"), F.col("_RT").alias("rt"), F.col("_spectrum_reference").alias("spectrum_reference"), "hits")


def flatten_idxml(rows: DataFrame) -> DataFrame:
    """First hit of each identification; is_decoy by its target_decoy mark."""
    h = F.get("hits", F.lit(0))
    return rows.select("source", "score_type", "higher_score_better", "mz", "rt", *[h[c].alias(c) for c in ("score", "sequence", "charge", "aa_before", "aa_after", "proteins")], (F.lower(h["target_decoy"]) == "decoy").alias("is_decoy"))


def read_traml(spark: SparkSession, path: str | list[str], retrieve_refs: bool = True) -> DataFrame:
    """TraML transitions: id, precursor_mz, product_mz, peptide_ref, cv_params; with references the peptide's sequence and proteins."""
    raw = read_xml(spark, path, "Transition", f"_id string, _peptideRef string, _compoundRef string, Precursor struct<{_CV_LIST}>, Product struct<{_CV_LIST}>, RetentionTime struct<{_CV_LIST}>, cvParam {CV}")
    rows = raw.select("source", F.col("_id").alias("id"), F.col("_peptideRef").alias("peptide_ref"), F.col("_compoundRef").alias("compound_ref"), _value(cv_params(F.col("Precursor.cvParam")), "MS:1000827").cast("double").alias("precursor_mz"), _value(cv_params(F.col("Product.cvParam")), "MS:1000827").cast("double").alias("product_mz"), _value(cv_params(F.col("Product.cvParam")), "MS:1000041").cast("int").alias("product_charge"), cv_params(F.col("cvParam")).alias("cv_params"))
    if not retrieve_refs:
        return rows
    peptides = read_xml(spark, path, "Peptide", f"_id string, _sequence string, ProteinRef array<struct<_ref:string>>, cvParam {CV}").filter("_sequence is not null").select("source", F.col("_id").alias("peptide_ref"), F.col("_sequence").alias("sequence"), F.transform("ProteinRef", lambda p: p["_ref"]).alias("protein_refs"))
    return rows.join(peptides, ["source", "peptide_ref"], "left")


def read_featurexml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """OpenMS features: id, position, intensity, quality, charge, convexhull (array of point lists)."""
    dim = "array<struct<_VALUE:double,_dim:int>>"
    raw = read_xml(spark, path, "feature", f"_id string, position {dim}, intensity double, quality {dim}, overallquality double, charge int, convexhull array<struct<_nr:int,pt:array<struct<_x:double,_y:double>>>>")
    ordered = lambda c: F.transform(F.array_sort(F.transform(c, lambda p: F.struct(p["_dim"].alias("d"), p["_VALUE"].alias("v")))), lambda p: p["v"])
    return raw.select("source", F.col("_id").alias("id"), ordered(F.col("position")).alias("position"), "intensity", ordered(F.col("quality")).alias("quality"), "overallquality", "charge", F.transform("convexhull", lambda h: F.transform(h["pt"], lambda p: F.struct(p["_x"].alias("x"), p["_y"].alias("y")))).alias("convexhull"))


def read_trafoxml(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pairs of a retention-time transformation: from, to."""
    return read_xml(spark, path, "Pair", "_from double, _to double").select("source", F.col("_from").alias("from"), F.col("_to").alias("to"))
