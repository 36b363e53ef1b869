"""Queries that write the domain tables in the formats of the readers, into the shared folder, and read them back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.functions import arrays as A
from pepspark.plans.domain import _PEP, _PROT, peptides, proteins
from pepspark.session import scratch, table
from pepspark.sources import text as TXT
from pepspark.sources import xml as XML

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        _SQL[f.__name__] = sql
        return f

    return keep


def _write(df: DataFrame, value: Column, name: str) -> str:
    path = scratch(df.sparkSession, name)
    df.select(value.alias("value")).write.text(path)
    return path


def _write_xml(rows: DataFrame, name: str) -> str:
    """Elements (column value) as part files, each a document of its own."""
    path = scratch(rows.sparkSession, name)

    def wrap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        line = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.string())], ["value"])
        yield line("<?xml version='1.0' encoding='UTF-8'?>\n<root>")
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], ["value"])
        yield line("</root>")

    rows.mapInArrow(wrap, "value string").write.text(path)
    return path


def _attr(name: str, value: Column | str) -> Column:
    """An XML attribute, left out if its value is null."""
    v = F.col(value) if isinstance(value, str) else value
    return F.coalesce(F.concat(F.lit(f' {name}="'), F.replace(F.replace(F.replace(v.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;")), F.lit('"')), F.lit(""))


def _spectra(spark: SparkSession, d: str) -> DataFrame:
    """Spectra with peaks whose intensities are all there and finite."""
    s = table(spark, d, "spectra").filter("title is not null and pepmass.mz is not null and size(mz) > 0 and size(intensity) = size(mz)")
    return s.filter(~F.exists("intensity", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).filter(~F.exists("mz", lambda x: x.isNull())).select("spectrum_id", "title", "ms_level", "pepmass", "mz", "intensity").distinct()


_SPECTRA = """s as (select distinct spectrum_id, title, ms_level, pepmass, mz, intensity from spectra where title is not null and pepmass.mz is not null and len(mz) > 0 and len(intensity) = len(mz)
 and len(list_filter(intensity, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(mz, lambda x: x is null)) = 0)"""


def _sum(array: Column | str, scale: int) -> Column:
    """Exact check sum of an array of decimals."""
    return F.aggregate(F.transform(array, lambda x: F.round(x * scale).cast("bigint")), F.lit(0).cast("bigint"), lambda a, x: a + x)


_SUMS = "list_sum(list_transform(mz, lambda x: round(x * 10000)::bigint))::bigint as mz_sum, list_sum(list_transform(intensity, lambda x: round(x * 10)::bigint))::bigint as intensity_sum"


@query(f"with {_PROT} select 'sp|D' || doc_id || '|G' || doc_id || '_TEST Protein ' || doc_id || ' OS=Test species OX=1 GN=g' || doc_id || ' PE=1 SV=1 read twice' as description, seq as sequence, 'D' || doc_id as id, 'G' || doc_id as gene_id, 'Test species' as organism from prot")
def q82_fasta_file(spark: SparkSession, d: str) -> DataFrame:
    """FASTA with a note line in every head, written, read and its UniProt heads parsed."""
    i = F.col("doc_id").cast("string")
    head = F.concat(F.lit("sp|D"), i, F.lit("|G"), i, F.lit("_TEST Protein "), i, F.lit(" OS=Test species OX=1 GN=g"), i, F.lit(" PE=1 SV=1"))
    path = scratch(spark, "fasta")
    TXT.write_fasta(proteins(spark, d).select(F.concat(head, F.lit("\nread twice")).alias("description"), F.col("seq").alias("sequence")), path)
    r = TXT.read_fasta(spark, path)
    from pepspark.functions.text import parse_header

    m = r.withColumn("m", parse_header(F.replace("description", F.lit(" read twice"), F.lit("")), "uniprot"))
    return m.select("description", "sequence", *[F.element_at("m", k).alias(a) for k, a in (("id", "id"), ("gene_id", "gene_id"), ("OS", "organism"))])


@query(f"with {_SPECTRA} select spectrum_id, title, round(pepmass.mz, 4) as precursor_mz, 2::int as charge, len(mz)::int as n_peaks, {_SUMS} from s")
def q83_mgf_file(spark: SparkSession, d: str) -> DataFrame:
    """MGF written and read: titles, precursors, charges and all peaks."""
    s = _spectra(spark, d)
    params = F.map_from_arrays(F.array(*[F.lit(k) for k in ("title", "pepmass", "charge", "scans")]), F.array(F.col("title"), F.format_string("%.4f", "pepmass.mz"), F.lit("2+"), F.col("spectrum_id").cast("string")))
    path = scratch(spark, "mgf")
    TXT.write_mgf(s.withColumn("params", params), path)
    r = TXT.read_mgf(spark, path)
    return r.select(F.col("scans").cast("bigint").alias("spectrum_id"), "title", F.round("pepmass.mz", 4).alias("precursor_mz"), F.get("charge", F.lit(0)).alias("charge"), F.size("mz").alias("n_peaks"), _sum("mz", 10000).alias("mz_sum"), _sum("intensity", 10).alias("intensity_sum"))


def _ms_text(s: DataFrame, head: Column) -> Column:
    peaks = F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.format_string("%.4f %.1f", p["mz"], p["intensity"]))
    scan = F.col("spectrum_id").cast("string")
    return F.concat(F.lit("S\t"), scan, F.lit("\t"), scan, head, F.array_join(peaks, "\n"))


@query(f"with {_SPECTRA} select spectrum_id, round(pepmass.mz, 4) as precursor_mz, 3::int as charge, len(mz)::int as n_peaks, {_SUMS} from s")
def q84_ms2_file(spark: SparkSession, d: str) -> DataFrame:
    s = _spectra(spark, d)
    path = _write(s, _ms_text(s, F.concat(F.lit("\t"), F.format_string("%.4f", "pepmass.mz"), F.lit("\nI\tRTime\t1.5\nZ\t3\t1000.5\n"))), "ms2")
    r = TXT.read_ms2(spark, path)
    return r.select(F.col("scan_from").cast("bigint").alias("spectrum_id"), F.round(r["precursor_mz"].cast("double"), 4).alias("precursor_mz"), F.get("charge", F.lit(0)).cast("int").alias("charge"), F.size("mz").alias("n_peaks"), _sum("mz", 10000).alias("mz_sum"), _sum("intensity", 10).alias("intensity_sum"))


@query(f"with {_SPECTRA} select spectrum_id, len(mz)::int as n_peaks, {_SUMS} from s")
def q85_ms1_file(spark: SparkSession, d: str) -> DataFrame:
    s = _spectra(spark, d)
    r = TXT.read_ms1(spark, _write(s, _ms_text(s, F.lit("\nI\tRTime\t1.5\n")), "ms1"))
    return r.select(F.col("scan_from").cast("bigint").alias("spectrum_id"), F.size("mz").alias("n_peaks"), _sum("mz", 10000).alias("mz_sum"), _sum("intensity", 10).alias("intensity_sum"))


def _cv(accession: str, name: str, value: Column | str = "") -> Column:
    v = F.lit(value) if isinstance(value, str) else value
    return F.concat(F.lit(f'<cvParam cvRef="MS" accession="{accession}" name="{name}"'), _attr("value", v), F.lit("/>"))


def _binary(kind: Column, encoded: Column) -> Column:
    return F.concat(F.lit("<binaryDataArray>"), _cv("MS:1000523", "64-bit float"), _cv("MS:1000574", "zlib compression"), kind, F.lit("<binary>"), encoded, F.lit("</binary></binaryDataArray>"))


@query(f"with {_SPECTRA} select spectrum_id, ms_level, round(pepmass.mz, 4) as precursor_mz, len(mz)::int as n_peaks, {_SUMS}, len(mz)::int as n_mobility, 'volt-second' as mobility_unit from s")
def q86_mzml_file(spark: SparkSession, d: str) -> DataFrame:
    """mzML with a referenced parameter group and four arrays: m/z, intensity, ion mobility and a named one."""
    s = _spectra(spark, d)
    level = F.when(F.col("ms_level").isNotNull(), _cv("MS:1000511", "ms level", F.col("ms_level").cast("string"))).otherwise(F.lit(""))
    ion = F.concat(F.lit("<precursorList><precursor><selectedIonList><selectedIon>"), _cv("MS:1000744", "selected ion m/z", F.col("pepmass.mz").cast("string")), F.lit("</selectedIon></selectedIonList></precursor></precursorList>"))
    mobility = F.lit('<cvParam cvRef="MS" accession="MS:1003006" name="mean inverse reduced ion mobility array" unitName="volt-second"/>')
    named = F.lit('<cvParam cvRef="MS" accession="MS:1000786" name="non-standard data array" value="my numbers"/>')
    arrays = F.concat(_binary(_cv("MS:1000514", "m/z array"), A.encode_binary("mz", True)), _binary(_cv("MS:1000515", "intensity array"), A.encode_binary("intensity", True)), _binary(mobility, A.encode_binary("mz", True)), _binary(named, A.encode_binary("intensity", True)))
    value = F.concat(F.lit("<spectrum"), _attr("id", F.concat(F.lit("scan="), F.col("spectrum_id").cast("string"))), F.lit(' index="0"'), _attr("defaultArrayLength", F.size("mz")), F.lit('><referenceableParamGroupRef ref="common"/>'), level, ion, F.lit("<binaryDataArrayList>"), arrays, F.lit("</binaryDataArrayList></spectrum>"))
    path = _write_xml(s.select((value).alias("value")), "mzml")
    r = XML.read_mzml(spark, path)
    array = lambda k: F.element_at("arrays", k)
    mobility_name = "mean inverse reduced ion mobility array"
    return r.filter(F.size("arrays") == 4).select(
        F.regexp_extract("spectrum_id", "([0-9]+)", 1).cast("bigint").alias("spectrum_id"), "ms_level", F.round(F.get("precursors", F.lit(0))["mz"], 4).alias("precursor_mz"), F.size("mz").alias("n_peaks"),
        _sum("mz", 10000).alias("mz_sum"), _sum(array("my numbers"), 10).alias("intensity_sum"), F.size(array(mobility_name)).alias("n_mobility"), F.element_at("array_units", mobility_name).alias("mobility_unit"),
    )


@query(f"with {_SPECTRA} select spectrum_id * 10 + k as num, (k + 1)::int as ms_level, 1.5::double as rt, len(mz)::int as n_peaks, {_SUMS} from s, (select unnest([0, 1, 2]) as k)")
def q87_mzxml_file(spark: SparkSession, d: str) -> DataFrame:
    """mzXML with scans nested three deep, each with the spectrum's peaks as big-endian pairs."""
    s = _spectra(spark, d).withColumn("peaks", A.encode_binary(F.flatten(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.array(p["mz"], p["intensity"]))), dtype="f64be"))
    value = F.lit("")
    for k in (2, 1, 0):
        open_ = F.concat(F.lit("<scan"), _attr("num", F.col("spectrum_id") * 10 + k), F.lit(f' msLevel="{k + 1}" retentionTime="PT90S"'), _attr("peaksCount", F.size("mz")), F.lit('><peaks precision="64" byteOrder="network" compressionType="none">'))
        value = F.concat(open_, F.col("peaks"), F.lit("</peaks>"), value, F.lit("</scan>"))
    r = XML.read_mzxml(spark, _write_xml(s.select((value).alias("value")), "mzxml"))
    return r.select(F.col("num").cast("bigint").alias("num"), "ms_level", "rt", F.size("mz").alias("n_peaks"), _sum("mz", 10000).alias("mz_sum"), _sum("intensity", 10).alias("intensity_sum"))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    """Hits with a named protein: query_id, hit_no, rank, peptide, score, proteins."""
    h = table(spark, d, "psms").select("query_id", F.posexplode("search_hit").alias("n", "h"))
    names = F.transform(F.filter("h.proteins", lambda p: p.isNotNull() & p["protein"].isNotNull()), lambda p: p["protein"])
    return h.select("query_id", (F.col("n") + 1).alias("hit_no"), F.col("h.hit_rank").alias("rank"), F.col("h.peptide").alias("peptide"), F.element_at("h.search_score", "expect").alias("score"), names.alias("proteins")).filter("size(proteins) > 0 and peptide is not null and rank is not null and score is not null").filter(~F.isnan("score")).distinct()


_HITS = """r as (select query_id, generate_subscripts(search_hit, 1) as hit_no, unnest(search_hit) as h from psms),
h as (select distinct query_id, hit_no::int as hit_no, h.hit_rank as rank, h.peptide as peptide, map_extract_value(h.search_score, 'expect') as score, list_transform(list_filter(h.proteins, lambda p: p is not null and p.protein is not null), lambda p: p.protein) as proteins from r
 where h.peptide is not null and h.hit_rank is not null),
hits as (select * from h where len(proteins) > 0 and score is not null and not isnan(score))"""
_HIT_ROWS = "query_id, hit_no, rank, peptide, score, array_to_string(proteins, ';') as proteins"


@query(f"with {_HITS} select {_HIT_ROWS} from hits")
def q88_pepxml_file(spark: SparkSession, d: str) -> DataFrame:
    """pepXML: one spectrum query for each hit, alternative proteins after the first."""
    h = _hits(spark, d)
    others = F.array_join(F.transform(F.slice("proteins", 2, F.size("proteins")), lambda p: F.concat(F.lit("<alternative_protein"), _attr("protein", p), F.lit("/>"))), "")
    hit = F.concat(F.lit("<search_hit"), _attr("hit_rank", "rank"), _attr("peptide", "peptide"), _attr("protein", F.get("proteins", F.lit(0))), F.lit(' is_rejected="0">'), others, F.lit('<search_score name="expect"'), _attr("value", "score"), F.lit("/></search_hit>"))
    value = F.concat(F.lit("<spectrum_query"), _attr("spectrum", F.concat_ws(".", "query_id", "hit_no")), F.lit("><search_result>"), hit, F.lit("</search_result></spectrum_query>"))
    flat = XML.flatten_pepxml(XML.read_pepxml(spark, _write_xml(h.select((value).alias("value")), "pepxml")), by="search_hit", sep=";")
    part = lambda k, kind: F.split_part("spectrum", F.lit("."), F.lit(k)).cast(kind)
    return flat.select(part(1, "bigint").alias("query_id"), part(2, "int").alias("hit_no"), F.col("hit_rank").alias("rank"), "peptide", F.element_at("search_score", "expect").alias("score"), F.col("protein").alias("proteins"))


@query(f"with {_HITS} select {_HIT_ROWS} from hits")
def q89_tandem_file(spark: SparkSession, d: str) -> DataFrame:
    """X!Tandem models: one group for each hit."""
    h = _hits(spark, d)
    domain = F.concat(F.lit('<peptide start="1" end="9"><domain id="1.1.1" start="1" end="9"'), _attr("seq", "peptide"), F.lit("/></peptide>"))
    each = F.array_join(F.transform("proteins", lambda p: F.concat(F.lit("<protein"), _attr("label", p), F.lit(">"), domain, F.lit("</protein>"))), "")
    value = F.concat(F.lit('<group type="model"'), _attr("id", F.concat_ws(".", "query_id", "hit_no")), _attr("z", "rank"), _attr("expect", "score"), F.lit(">"), each, F.lit("</group>"))
    flat = XML.flatten_tandem(XML.read_tandem(spark, _write_xml(h.select((value).alias("value")), "tandem")))
    part = lambda k, kind: F.split_part("id", F.lit("."), F.lit(k)).cast(kind)
    return flat.select(part(1, "bigint").alias("query_id"), part(2, "int").alias("hit_no"), F.col("z").alias("rank"), F.col("seq").alias("peptide"), F.col("expect").alias("score"), F.array_join("protein_label", ";").alias("proteins"))


@query(f"with {_HITS}, p as (select query_id, hit_no, score, generate_subscripts(proteins, 1)::int as protein_no, unnest(proteins) as protein from hits) select query_id, hit_no, score, protein_no, protein from p")
def q90_protxml_file(spark: SparkSession, d: str) -> DataFrame:
    """protXML: the proteins of each hit as a group, flattened to one row per protein; the group has the query's number, its peptides have the hit's."""
    h = _hits(spark, d)
    peptide = F.concat(F.lit("<peptide"), _attr("n_instances", "hit_no"), F.lit("/>"))
    each = F.array_join(F.transform("proteins", lambda p, i: F.concat(F.lit("<protein"), _attr("protein_name", p), _attr("total_number_peptides", i + 1), F.lit(">"), peptide, F.lit("</protein>"))), "")
    value = F.concat(F.lit("<protein_group"), _attr("group_number", "query_id"), _attr("probability", "score"), F.lit(">"), each, F.lit("</protein_group>"))
    flat = XML.flatten_protxml(XML.read_protxml(spark, _write_xml(h.select((value).alias("value")), "protxml")))
    return flat.select(F.col("group_number").alias("query_id"), F.get("peptide", F.lit(0))["n_instances"].alias("hit_no"), F.col("group_probability").cast("double").alias("score"), F.col("total_number_peptides").cast("int").alias("protein_no"), F.col("protein_name").alias("protein"))


@query(f"with {_HITS} select {_HIT_ROWS} from hits")
def q91_mzid_file(spark: SparkSession, d: str) -> DataFrame:
    """mzIdentML: results, peptides, evidences and database sequences, joined again by their references."""
    h = _hits(spark, d)
    key = F.concat_ws(".", "query_id", "hit_no")
    refs = F.array_join(F.transform("proteins", lambda p, i: F.concat(F.lit("<PeptideEvidenceRef"), _attr("peptideEvidence_ref", F.concat(F.lit("E"), key, F.lit("."), i.cast("string"))), F.lit("/>"))), "")
    item = F.concat(F.lit("<SpectrumIdentificationItem"), _attr("id", F.concat(F.lit("I"), key)), _attr("rank", "rank"), _attr("peptide_ref", F.concat(F.lit("P"), key)), F.lit(">"), refs, _cv("MS:1001330", "expect", F.col("score").cast("string")), F.lit("</SpectrumIdentificationItem>"))
    result = F.concat(F.lit("<SpectrumIdentificationResult"), _attr("id", key), F.lit(' spectrumID="s">'), item, F.lit("</SpectrumIdentificationResult>"))
    peptide = F.concat(F.lit("<Peptide"), _attr("id", F.concat(F.lit("P"), key)), F.lit("><PeptideSequence>"), F.col("peptide"), F.lit("</PeptideSequence></Peptide>"))
    evidence = F.array_join(F.transform("proteins", lambda p, i: F.concat(F.lit("<PeptideEvidence"), _attr("id", F.concat(F.lit("E"), key, F.lit("."), i.cast("string"))), _attr("dBSequence_ref", F.concat(F.lit("D"), p)), F.lit(' isDecoy="false"/>'))), "")
    rows = h.select(F.concat(peptide, evidence, result).alias("value")).unionByName(h.select(F.explode("proteins").alias("p")).distinct().select(F.concat(F.lit("<DBSequence"), _attr("id", F.concat(F.lit("D"), F.col("p"))), _attr("accession", "p"), F.lit("/>")).alias("value")))
    r = XML.read_mzid(spark, _write_xml(rows.coalesce(1), "mzid"))  # references hold within a file
    part = lambda k, kind: F.split_part("result_id", F.lit("."), F.lit(k)).cast(kind)
    return r.select(part(1, "bigint").alias("query_id"), part(2, "int").alias("hit_no"), "rank", "peptide", F.element_at("scores", "expect").cast("double").alias("score"), F.array_join(F.transform("evidence", lambda e: e["accession"]), ";").alias("proteins"))


@query(f"with {_HITS} select {_HIT_ROWS} from hits")
def q92_idxml_file(spark: SparkSession, d: str) -> DataFrame:
    """idXML: identifications with protein references."""
    h = _hits(spark, d)
    refs = F.array_join(F.transform("proteins", lambda p: F.concat(F.lit("PH_"), p)), " ")
    hit = F.concat(F.lit("<PeptideHit"), _attr("score", "score"), _attr("sequence", "peptide"), _attr("charge", "rank"), _attr("protein_refs", refs), F.lit("/>"))
    one = F.concat(F.lit('<PeptideIdentification score_type="expect" higher_score_better="false"'), _attr("spectrum_reference", F.concat_ws(".", "query_id", "hit_no")), F.lit(">"), hit, F.lit("</PeptideIdentification>"))
    names = h.select(F.explode("proteins").alias("p")).distinct().select(F.concat(F.lit("<ProteinHit"), _attr("id", F.concat(F.lit("PH_"), F.col("p"))), _attr("accession", "p"), F.lit("/>")).alias("value"))
    path = _write_xml(h.select(one.alias("value")).unionByName(names).coalesce(1), "idxml")
    flat = XML.flatten_idxml(XML.read_idxml(spark, path))
    part = lambda k, kind: F.split_part("spectrum_reference", F.lit("."), F.lit(k)).cast(kind)
    r = XML.read_idxml(spark, path).withColumn("h", F.get("hits", F.lit(0)))
    assert "is_decoy" in flat.columns
    return r.select(part(1, "bigint").alias("query_id"), part(2, "int").alias("hit_no"), F.col("h.charge").alias("rank"), F.col("h.sequence").alias("peptide"), F.col("h.score").alias("score"), F.array_join("h.proteins", ";").alias("proteins"))


@query(f"with {_HITS} select {_HIT_ROWS} from hits")
def q93_mztab_file(spark: SparkSession, d: str) -> DataFrame:
    """mzTab: the PSM section, cast to numbers."""
    h = _hits(spark, d)
    row = F.concat_ws("\t", F.lit("PSM"), F.col("query_id").cast("string"), F.col("hit_no").cast("string"), F.col("rank").cast("string"), "peptide", F.col("score").cast("string"), F.array_join("proteins", ";"), F.lit("null"))
    head = "MTD\tmzTab-version\t1.0.0\nPSH\tquery_id\thit_no\trank\tsequence\tscore\taccession\tnothing"
    path = scratch(spark, "mztab")
    spark.range(1).select(F.lit(head).alias("value")).unionByName(h.select(row.alias("value"))).coalesce(1).write.text(path)
    psm = TXT.cast_mztab(TXT.read_mztab(spark, path)["PSM"])
    return psm.filter("nothing is null").select(F.col("query_id").cast("bigint").alias("query_id"), F.col("hit_no").cast("int").alias("hit_no"), F.col("rank").cast("int").alias("rank"), F.col("sequence").alias("peptide"), F.col("score").cast("double").alias("score"), F.col("accession").alias("proteins"))


@query(f"with {_PEP} select peptide, round(length(peptide) * 100.25::double, 4) as precursor_mz, round(length(peptide) + 0.5::double, 4) as product_mz, 'DB|' || peptide as protein from pep")
def q94_traml_file(spark: SparkSession, d: str) -> DataFrame:
    """TraML: transitions and their peptides."""
    p = peptides(spark, d)
    n = F.length("peptide")
    peptide = F.concat(F.lit("<Peptide"), _attr("id", F.concat(F.lit("P"), F.col("peptide"))), _attr("sequence", "peptide"), F.lit("><ProteinRef"), _attr("ref", F.concat(F.lit("DB|"), F.col("peptide"))), F.lit("/></Peptide>"))
    ion = lambda tag, v: F.concat(F.lit(f"<{tag}>"), _cv("MS:1000827", "isolation window target m/z", v.cast("string")), F.lit(f"</{tag}>"))
    transition = F.concat(F.lit("<Transition"), _attr("id", F.concat(F.lit("T"), F.col("peptide"))), _attr("peptideRef", F.concat(F.lit("P"), F.col("peptide"))), F.lit(">"), ion("Precursor", n * 100.25), ion("Product", n + 0.5), F.lit("</Transition>"))
    r = XML.read_traml(spark, _write_xml(p.select((F.concat(peptide, transition)).alias("value")), "traml"))
    return r.select(F.col("sequence").alias("peptide"), F.round("precursor_mz", 4).alias("precursor_mz"), F.round("product_mz", 4).alias("product_mz"), F.get("protein_refs", F.lit(0)).alias("protein"))


@query(f"with {_SPECTRA} select spectrum_id, round(pepmass.mz, 4) as mz, len(mz)::int as n_points, mz[1] as first_x, intensity[len(mz)] as last_y, 2::int as charge from s")
def q95_featurexml_file(spark: SparkSession, d: str) -> DataFrame:
    """featureXML: a hull through all peaks of each spectrum; and trafoXML pairs of the same file."""
    s = _spectra(spark, d)
    points = F.array_join(F.transform(F.arrays_zip("mz", "intensity"), lambda p: F.concat(F.lit("<pt"), _attr("x", p["mz"]), _attr("y", p["intensity"]), F.lit("/>"))), "")
    value = F.concat(F.lit("<feature"), _attr("id", F.col("spectrum_id")), F.lit('><position dim="1">'), F.col("pepmass.mz").cast("string"), F.lit('</position><position dim="0">7.5</position><charge>2</charge><convexhull nr="0">'), points, F.lit("</convexhull></feature>"))
    r = XML.read_featurexml(spark, _write_xml(s.select((value).alias("value")), "featurexml")).withColumn("hull", F.get("convexhull", F.lit(0)))
    return r.select(F.col("id").cast("bigint").alias("spectrum_id"), F.round(F.get("position", F.lit(1)), 4).alias("mz"), F.size("hull").alias("n_points"), F.get("hull", F.lit(0))["x"].alias("first_x"), F.element_at("hull", -1)["y"].alias("last_y"), "charge")


@query(f"with {_SPECTRA} select distinct round(pepmass.mz, 4) as \"from\", round(pepmass.mz + 0.5, 4) as \"to\" from s")
def q96_trafoxml_file(spark: SparkSession, d: str) -> DataFrame:
    s = _spectra(spark, d).select(F.col("pepmass.mz").alias("x")).distinct()
    r = XML.read_trafoxml(spark, _write_xml(s.select((F.concat(F.lit("<Pair"), _attr("from", "x"), _attr("to", F.col("x") + 0.5), F.lit("/>"))).alias("value")), "trafoxml"))
    return r.select(F.round("from", 4).alias("from"), F.round("to", 4).alias("to")).distinct()


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
