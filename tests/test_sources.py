import base64
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from pepspark.sources import text as T
from pepspark.sources import unimod as U
from pepspark.sources import xml as X


@pytest.fixture
def put(tmp_path):
    def write(name, content):
        p = tmp_path / name
        p.write_text(content)
        return str(p)

    return write


def test_fasta(spark, put):
    path = put("a.fasta", ">sp|P1|A_HUMAN First OS=Homo sapiens OX=9606 PE=1 SV=2\nPEPT\n\nIDE*\n>second\nAC\nDC\n>empty\n")
    rows = {r.description: r.sequence for r in T.read_fasta(spark, path).collect()}
    assert rows == {"sp|P1|A_HUMAN First OS=Homo sapiens OX=9606 PE=1 SV=2": "PEPTIDE", "second": "ACDC", "empty": ""}
    h = T.read_fasta(spark, path, "auto").filter("header is not null").first().header
    assert h["id"] == "P1" and h["OX"] == "9606"
    assert {r.accession for r in T.with_accession(T.read_fasta(spark, path)).collect()} == {"P1", "second", "empty"}
    c = put("c.fasta", ";one\n>two\nPEP\n;more\n;lines\nTIDE*\n")
    assert [(r.description, r.sequence) for r in T.read_fasta(spark, c, comments=True).collect()] == [("one two", "PEP"), ("more lines", "TIDE")]
    assert [r.description for r in T.read_fasta(spark, c, comments=True, ignore_comments=True).collect()] == ["one", "more"]


def test_fasta_round_trip_and_decoys(spark, tmp_path):
    df = spark.createDataFrame([("a b", "PEPTIDEK" * 30), ("c", "A" * 70), ("d", "M")], "description string, sequence string")
    T.write_fasta(T.decoy_db(df), str(tmp_path / "out"))
    got = {(r.description, r.sequence) for r in T.read_fasta(spark, str(tmp_path / "out")).collect()}
    want = {(r.description, r.sequence) for r in df.collect()}
    assert got == want | {("DECOY_" + d, s[::-1]) for d, s in want}
    assert T.decoy_db(df, "shuffle", decoy_only=True).count() == 3 and T.decoy_db(df, "fused").count() == 6


def test_peff(spark, put):
    path = put("a.peff", "# PEFF 1.0\n# //\n# DbName=x\n# //\n>nxp:NX_1-1 \\PName=Some protein \\NcbiTaxId=9606 \\ModResPsi=(1|MOD:1|n)(5|MOD:2|m) \\Length=3\nPEP\n>nxp:NX_2 \\PName=Other\nAC\n")
    rows = {r.db_id: r for r in T.read_peff(spark, path).collect()}
    assert rows["NX_1-1"].fields["PName"] == "Some protein" and rows["NX_1-1"].fields["Length"] == "3" and rows["NX_1-1"].sequence == "PEP"
    assert [(f.key, f.position, f["values"]) for f in rows["NX_1-1"].features] == [("ModResPsi", 1, ["1", "MOD:1", "n"]), ("ModResPsi", 2, ["5", "MOD:2", "m"])]
    assert [(r.key, r.value) for r in T.read_peff_header(spark, path).collect()] == [("DbName", "x")]


MGF = """COM=test
CHARGE=2+ and 3+
# comment
BEGIN IONS
TITLE=Spectrum 1
PEPMASS=983.6
CHARGE=2+
846.6 73
846.8 44.5

END IONS

BEGIN IONS
TITLE=Spectrum = 2
SCANS=3
RTINSECONDS=25.5
PEPMASS=1084.9 1234.0
345.1 237 2+
370.2 128 0
460.2 108 y3+1
END IONS
"""


def test_mgf(spark, put, tmp_path):
    path = put("a.mgf", MGF)
    a, b = T.read_mgf(spark, path).orderBy("title").collect()
    a, b = (a, b) if a.title == "Spectrum 1" else (b, a)
    assert a.charge == [2] and a.pepmass.mz == 983.6 and a.pepmass.intensity is None and a.mz == [846.6, 846.8] and a.intensity == [73, 44.5]
    assert b.title == "Spectrum = 2" and b.charge == [2, 3] and b.pepmass.intensity == 1234.0 and b.rtinseconds == 25.5 and b.scans == "3"
    assert b.charge_array == [2, None, None] and b.ion_array[2] == "y3+1" and b.params["com"] == "test"
    assert T.read_mgf(spark, path, use_header=False).filter("title like '%2'").first().charge is None
    assert {r.key: r.value for r in T.read_mgf_header(spark, path).collect()} == {"com": "test", "charge": "2+ and 3+"}
    T.write_mgf(T.read_mgf(spark, path), str(tmp_path / "o"))
    back = T.read_mgf(spark, str(tmp_path / "o")).orderBy("title").collect()
    assert {x.title: (x.mz, x.intensity, x.charge) for x in back} == {x.title: (x.mz, x.intensity, x.charge) for x in (a, b)}


def test_ms1_ms2(spark, put):
    ms1 = put("a.ms1", "H\tCreationDate\tx y\nH\tExtractor\tz\nS\t1\t1\nI\tRTime\t0.1\nI\tBPI\t2\n100.1 5\n200.2 6.5\nS\t2\t3\nI\tRTime\t0.2\n300.3 1\n")
    rows = T.read_ms1(spark, ms1).orderBy("scan_from").collect()
    assert [(r.scan_from, r.scan_to, r.rtime, r.mz) for r in rows] == [("1", "1", 0.1, [100.1, 200.2]), ("2", "3", 0.2, [300.3])]
    assert {r.key: r.value for r in T.read_ms_header(spark, ms1).collect()} == {"CreationDate": "x y", "Extractor": "z"}
    ms2 = put("a.ms2", "H\tCreationDate\tx\nS\t5\t5\t700.5\nI\tRTime\t1.5\nZ\t2\t1399.9\nZ\t3\t2099.3\n100.1 5 1 60000\n200.2 6 0 50000\n")
    r = T.read_ms2(spark, ms2).first()
    assert r.precursor_mz == 700.5 and r.charge == [2, 3] and r.neutral_mass == [1399.9, 2099.3] and r.charge_array == [1, None] and r.resolution == [60000, 50000]


def test_mztab(spark, put):
    path = put("a.mztab", "COM\thello\nMTD\tmzTab-version\t2.0.0-M\nMTD\tms_run[1]-location\tfile:///x\nMTD\tquantification\t[MS, MS:1, \"name, odd\", null]\n\nSMH\tSML_ID\tmass\tname\nSML\t1\t12.5\tnull\nSML\t2\t3\tx\n")
    t = T.read_mztab(spark, path)
    assert T.mztab_variant(t["metadata"]) == ("2.0.0-M", "M") and set(t) == {"metadata", "comments", "SML"}
    rows = T.cast_mztab(t["SML"]).orderBy("SML_ID").collect()
    assert [tuple(r) for r in rows] == [(1, 12.5, None), (2, 3.0, "x")]
    g = {(r.entity, r["index"], r.property): r.value for r in T.mztab_groups(t["metadata"]).collect()}
    assert g[("ms_run", 1, "location")] == "file:///x"
    p = t["metadata"].filter("key = 'quantification'").select(T.mztab_param("value").alias("p")).first().p
    assert (p.cv, p.accession, p.name) == ("MS", "MS:1", "name, odd")


def test_proxi(spark):
    one = '[{"usi":"u","mzs":["1.5",2],"intensities":[3,"4"],"attributes":[{"accession":"MS:1","name":"n","value":"5"}]}]'
    two = '[{"usi":"u","mzs":[1,2,3],"intensities":[3,4,5],"attributes":[{"accession":"MS:2","name":"m","value":"6"}]}]'
    df = spark.createDataFrame([("u", one), ("u", two)], "usi string, j string").select("usi", F.explode(T.proxi_spectra("j")).alias("spectrum"))
    r = T.merge_proxi(df).first()
    assert r.mz == [1, 2, 3] and {a.accession for a in r.attributes} == {"MS:1", "MS:2"}


def b64(values, code="d", z=False, order="<"):
    raw = struct.pack(f"{order}{len(values)}{code}", *values)
    return base64.b64encode(zlib.compress(raw) if z else raw).decode()


def cv(acc, name="n", value="", unit=None):
    return f'<cvParam cvRef="MS" accession="{acc}" name="{name}" value="{value}"' + (f' unitName="{unit}"' if unit else "") + "/>"


def test_mzml(spark, put):
    def arrays(mz, it, z):
        c = cv("MS:1000574") if z else cv("MS:1000576")
        return f"<binaryDataArrayList count='2'><binaryDataArray>{cv('MS:1000523')}{c}{cv('MS:1000514', 'm/z array')}<binary>{b64(mz, 'd', z)}</binary></binaryDataArray><binaryDataArray>{cv('MS:1000521')}{c}{cv('MS:1000515', 'intensity array')}<binary>{b64(it, 'f', z)}</binary></binaryDataArray></binaryDataArrayList>"

    spectra = "".join(
        f"<spectrum index='{i}' id='scan={i}' defaultArrayLength='2'><referenceableParamGroupRef ref='g1'/>{cv('MS:1000511', 'ms level', 2)}<scanList>{cv('MS:1000795')}<scan>{cv('MS:1000016', 'scan start time', 90 if i else 1.5, 'second' if i else 'minute')}</scan></scanList><precursorList><precursor spectrumRef='scan=9'><selectedIonList><selectedIon>{cv('MS:1000744', 'mz', 445.3)}{cv('MS:1000041', 'charge', 2)}</selectedIon></selectedIonList></precursor></precursorList>{arrays([100.5, 200.25], [1.0, 2.0], i == 1)}</spectrum>"
        for i in range(2)
    )
    path = put("a.mzML", f'<?xml version="1.0"?><indexedmzML xmlns="http://psi.hupo.org/ms/mzml"><mzML><referenceableParamGroupList><referenceableParamGroup id="g1">{cv("MS:1000127", "centroid")}</referenceableParamGroup></referenceableParamGroupList><run><spectrumList>{spectra}</spectrumList><chromatogramList><chromatogram id="TIC"><binaryDataArrayList><binaryDataArray>{cv("MS:1000523")}{cv("MS:1000576")}{cv("MS:1000595")}<binary>{b64([1.0, 2.0])}</binary></binaryDataArray></binaryDataArrayList></chromatogram></chromatogramList></run></mzML></indexedmzML>')
    rows = X.read_mzml(spark, path).orderBy("idx").collect()
    assert [(r.spectrum_id, r.ms_level, r.rt, r.mz, r.intensity) for r in rows] == [("scan=0", 2, 1.5, [100.5, 200.25], [1, 2]), ("scan=1", 2, 1.5, [100.5, 200.25], [1, 2])]
    p = rows[0].precursors[0]
    assert (p.mz, p.charge, p.ref) == (445.3, 2, "scan=9") and "MS:1000127" in {c.accession for c in rows[0].cv_params}
    assert X.read_mzml(spark, path, decode=False).first().binaryDataArrayList is not None
    assert X.read_chromatograms(spark, path).first().time == [1.0, 2.0]
    # the same ids in a second file stay apart
    two = put("b.mzML", open(path).read().replace(b64([100.5, 200.25]), b64([7.5, 8.25])))
    both = X.read_mzml(spark, [path, two])
    assert both.count() == 4 and both.filter("spectrum_id = 'scan=0'").select("source", "mz").distinct().count() == 2


def test_mzxml(spark, put):
    peaks = lambda code, z: f"<peaks precision='{32 if code == 'f' else 64}' compressionType='{'zlib' if z else 'none'}'>{b64([100.5, 1.0, 200.25, 2.0], code, z, '>')}</peaks>"
    path = put("a.mzXML", f"<mzXML><msRun><scan num='1' msLevel='1' peaksCount='2' retentionTime='PT353.43S'>{peaks('f', False)}<scan num='2' msLevel='2' peaksCount='2' retentionTime='PT360S'><precursorMz precursorIntensity='5' precursorCharge='2'>500.5</precursorMz>{peaks('d', True)}</scan></scan><scan num='3' msLevel='1' peaksCount='2' retentionTime='PT400S'>{peaks('f', False)}</scan></msRun></mzXML>")
    rows = X.read_mzxml(spark, path).orderBy("num").collect()
    assert [(r.num, r.ms_level, r.mz, r.intensity) for r in rows] == [(str(i), 2 if i == 2 else 1, [100.5, 200.25], [1, 2]) for i in (1, 2, 3)]
    assert abs(rows[0].rt - 5.8905) < 1e-9 and rows[1].precursors[0].mz == 500.5 and rows[1].precursors[0].charge == 2


PEPXML = """<msms_pipeline_analysis xmlns="http://regis-web.systemsbiology.net/pepXML"><analysis_summary><peptideprophet_summary><roc_error_data charge="all"><roc_data_point min_prob="0.9" sensitivity="0.5" error="0.01" num_corr="10" num_incorr="1"/><error_point error="0.02" min_prob="0.8" num_corr="12" num_incorr="2"/></roc_error_data></peptideprophet_summary></analysis_summary>
<msms_run_summary><spectrum_query spectrum="s.1.1.2" start_scan="1" end_scan="1" precursor_neutral_mass="860.39" assumed_charge="2" index="1"><search_result>
<search_hit hit_rank="2" peptide="AAA" protein="q" num_tot_proteins="1" calc_neutral_pep_mass="1" massdiff="0.1" is_rejected="0"/>
<search_hit hit_rank="1" peptide="SLNGEWR" protein="DECOY_a" num_tot_proteins="2" num_tol_term="2" peptide_prev_aa="R" peptide_next_aa="L" calc_neutral_pep_mass="860.41" massdiff="+-0.5" is_rejected="0"><alternative_protein protein="b" protein_descr="second"/><modification_info modified_peptide="S[167]LNGEWR" mod_nterm_mass="43.0"><mod_aminoacid_mass position="1" mass="167.0"/></modification_info><search_score name="xcorr" value="1.553"/><search_score name="deltacn" value="0.081"/><analysis_result analysis="peptideprophet"><peptideprophet_result probability="0.96" all_ntt_prob="(0,0.1,0.9)"/></analysis_result></search_hit></search_result></spectrum_query>
<spectrum_query spectrum="s.2.2.2" start_scan="2" end_scan="2" assumed_charge="2" index="2"><search_result/></spectrum_query></msms_run_summary></msms_pipeline_analysis>"""


def test_pepxml(spark, put):
    path = put("a.pep.xml", PEPXML)
    q = X.read_pepxml(spark, path)
    h = q.filter("start_scan = 1").first().search_hit
    assert [x.hit_rank for x in h] == [1, 2] and h[0].search_score == {"xcorr": 1.553, "deltacn": 0.081} and h[0].massdiff == -0.5
    assert [p.protein for p in h[0].proteins] == ["DECOY_a", "b"] and [(m.position, m.mass) for m in h[0].modifications] == [(0, 43.0), (1, 167.0)]
    flat = X.flatten_pepxml(q).collect()
    assert len(flat) == 1 and flat[0].protein == ["DECOY_a", "b"] and flat[0].modifications == ["43.000@0", "167.000@1"] and flat[0].peptideprophet_probability == 0.96
    assert X.flatten_pepxml(q, "search_hit", ";").filter("hit_rank = 1").first().protein == "DECOY_a;b" and X.flatten_pepxml(q, "search_hit").count() == 2
    assert {(r.tag, r.error) for r in X.roc_curve(spark, path).collect()} == {("roc_data_point", 0.01), ("error_point", 0.02)}


def test_protxml(spark, put):
    path = put("a.prot.xml", "<protein_summary><protein_group group_number='1' probability='1.0'><protein protein_name='A' probability='0.99' unique_stripped_peptides='PEP+TIDE' total_number_peptides='2'><indistinguishable_protein protein_name='B'/><annotation protein_description='d'/><peptide peptide_sequence='PEP' charge='2' initial_probability='0.9'/></protein></protein_group><protein_group group_number='2' probability='0.5'><protein protein_name='C' probability='0.4' unique_stripped_peptides='X'/></protein_group></protein_summary>")
    g = X.read_protxml(spark, path)
    p = g.filter("group_number = 1").first().protein[0]
    assert p.unique_stripped_peptides == ["PEP", "TIDE"] and p.indistinguishable_protein == ["B"] and p.peptide[0].charge == 2
    assert {(r.group_number, r.protein_name) for r in X.flatten_protxml(g).collect()} == {(1, "A"), (2, "C")}


def test_protxml_large_group_numbers(spark, put):
    path = put("b.prot.xml", "<protein_summary><protein_group group_number='2147483648' probability='1.0'><protein protein_name='A'/></protein_group><protein_group group_number='9223372036854775807' probability='0.5'><protein protein_name='B'/></protein_group></protein_summary>")
    assert {(r.group_number, r.protein_name) for r in X.flatten_protxml(X.read_protxml(spark, path)).collect()} == {(2147483648, "A"), (9223372036854775807, "B")}


def test_protxml_query_of_any_key(spark, tmp_path):
    from pepspark.plans import files

    ids = [1, 2147484, 30004165, 9007199254740993, 9223372036854775807, -5, None]
    one = lambda peptide, names: (1, peptide, {"expect": 0.5}, [(n,) for n in names])
    hits = [one("PEPTIDE", ["A&B", "C"])] + [one("PEPK", ["D"])] * 1000
    schema = "query_id bigint, search_hit array<struct<hit_rank:int,peptide:string,search_score:map<string,double>,proteins:array<struct<protein:string>>>>"
    spark.createDataFrame([(i, hits) for i in ids], schema).write.parquet(str(tmp_path / "psms.parquet"))
    got = sorted((tuple(r) for r in files.queries()["q90_protxml_file"](spark, str(tmp_path)).collect()), key=str)
    each = [(1, 0.5, 1, "A&B"), (1, 0.5, 2, "C"), *((n, 0.5, 1, "D") for n in range(2, 1002))]
    assert got == sorted(((i, *x) for i in ids for x in each), key=str)


def test_tandem(spark, put):
    path = put("a.t.xml", "<bioml><group id='7' mh='782.4' z='2' rt='PT60S' expect='1.5e-07' label='P' type='model' sumI='1'><protein expect='-1' uid='1' label='sp|P1' sumI='2'><note label='description'>sp|P1 desc</note><peptide start='1' end='9'><domain id='7.1.1' start='3' end='8' expect='1.5e-07' mh='782.4' hyperscore='20.5' nextscore='10' pre='KR' post='A' seq='YLYVDK' missed_cleavages='0'><aa type='Y' at='3' modified='79.97'/></domain></peptide></protein><group label='fragment ion mass spectrum' type='support'><note label='Description'>scan=5</note></group></group><group label='parameters' type='parameters'><note label='x'>y</note></group></bioml>")
    m = X.read_tandem(spark, path).filter("id is not null")
    f = X.flatten_tandem(m).first()
    assert m.count() == 1 and f.seq == "YLYVDK" and f.hyperscore == 20.5 and f.rt == 60.0 and f.modifications == ["79.970@Y"] and f.protein_label == ["sp|P1"] and f.scan_description == "scan=5"


def test_mzid(spark, put):
    path = put("a.mzid", f"""<MzIdentML xmlns="http://psidev.info/psi/pi/mzIdentML/1.1"><SequenceCollection><DBSequence id="db1" accession="P1" length="5">{cv('MS:1001088', 'protein description', 'desc')}</DBSequence><Peptide id="pep1"><PeptideSequence>PEPK</PeptideSequence><Modification location="2" monoisotopicMassDelta="15.99">{cv('UNIMOD:35', 'Oxidation')}</Modification></Peptide><PeptideEvidence id="ev1" peptide_ref="pep1" dBSequence_ref="db1" start="3" end="6" pre="K" post="-" isDecoy="false"/><PeptideEvidence id="ev2" peptide_ref="pep1" dBSequence_ref="none" start="9" end="12" isDecoy="true"/></SequenceCollection><AnalysisData><SpectrumIdentificationResult id="SIR1" spectrumID="index=1" spectraData_ref="sd"><SpectrumIdentificationItem id="SII1" rank="1" chargeState="2" peptide_ref="pep1" experimentalMassToCharge="230.1" calculatedMassToCharge="230.2" passThreshold="true"><PeptideEvidenceRef peptideEvidence_ref="ev1"/><PeptideEvidenceRef peptideEvidence_ref="ev2"/>{cv('MS:1001171', 'Mascot:score', '15.71')}</SpectrumIdentificationItem><SpectrumIdentificationItem id="SII2" rank="2" chargeState="2" peptide_ref="gone" passThreshold="false"/></SpectrumIdentificationResult></AnalysisData></MzIdentML>""")
    rows = {r.item_id: r for r in X.read_mzid(spark, path).collect()}
    a = rows["SII1"]
    assert a.peptide == "PEPK" and a.modifications[0].name == "Oxidation" and a.scores["Mascot:score"] == "15.71" and [(e.accession, e.start, e.is_decoy) for e in a.evidence] == [("P1", 3, False), (None, 9, True)]
    assert rows["SII2"].peptide is None and rows["SII2"].pass_threshold is False
    f = X.flatten_mzid(X.read_mzid(spark, path)).collect()
    assert len(f) == 1 and f[0].accession == ["P1", None] and f[0].is_decoy is False
    assert X.read_mzid(spark, path, retrieve_refs=False).count() == 2


def test_openms(spark, put):
    path = put("a.idXML", "<IdXML><IdentificationRun><ProteinIdentification><ProteinHit id='PH_0' accession='P1' score='0' sequence=''/><ProteinHit id='PH_1' accession='P2' score='0' sequence=''/></ProteinIdentification><PeptideIdentification score_type='XTandem' higher_score_better='true' MZ='368.8' RT='5.5'><PeptideHit score='30.5' sequence='LVGK' charge='2' aa_before='K' aa_after='A' protein_refs='PH_1 PH_0'><UserParam type='string' name='target_decoy' value='decoy'/></PeptideHit><PeptideHit score='1' sequence='AAA' charge='2'/></PeptideIdentification><PeptideIdentification score_type='XTandem' higher_score_better='true' MZ='400' RT='6'/></IdentificationRun></IdXML>")
    rows = {r.mz: r for r in X.read_idxml(spark, path).collect()}
    assert [h.sequence for h in rows[368.8].hits] == ["LVGK", "AAA"] and rows[368.8].hits[0].proteins == ["P2", "P1"] and rows[400.0].hits is None
    f = {r.mz: r for r in X.flatten_idxml(X.read_idxml(spark, path)).collect()}
    assert f[368.8].is_decoy is True and f[368.8].higher_score_better is True
    path = put("a.featureXML", "<featureMap><featureList><feature id='f_1'><position dim='1'>445.3</position><position dim='0'>60.5</position><intensity>100</intensity><quality dim='0'>0.5</quality><overallquality>0.9</overallquality><charge>2</charge><convexhull nr='0'><pt x='1' y='2'/><pt x='3' y='4'/></convexhull></feature></featureList></featureMap>")
    r = X.read_featurexml(spark, path).first()
    assert r.position == [60.5, 445.3] and r.intensity == 100 and [(p.x, p.y) for p in r.convexhull[0]] == [(1, 2), (3, 4)]
    path = put("a.trafoXML", "<TrafoXML><Transformation name='x'><Pairs count='2'><Pair from='3329.2416' to='3333.3515'/><Pair from='1' to='2'/></Pairs></Transformation></TrafoXML>")
    assert X.read_trafoxml(spark, path).filter("`from` > 5").first().to == 3333.3515


def test_traml(spark, put):
    path = put("a.TraML", f"<TraML><CompoundList><Peptide id='p1' sequence='ADV'><ProteinRef ref='P9'/></Peptide></CompoundList><TransitionList><Transition id='t1' peptideRef='p1'><Precursor>{cv('MS:1000827', 'mz', 862.9)}</Precursor><Product>{cv('MS:1000827', 'mz', 1040.5)}{cv('MS:1000041', 'charge', 1)}</Product></Transition><Transition id='t2' peptideRef='zz'><Precursor>{cv('MS:1000827', 'mz', 1.5)}</Precursor></Transition></TransitionList></TraML>")
    rows = {r.id: r for r in X.read_traml(spark, path).collect()}
    assert rows["t1"].sequence == "ADV" and rows["t1"].protein_refs == ["P9"] and rows["t1"].product_mz == 1040.5 and rows["t2"].sequence is None
    assert "sequence" not in X.read_traml(spark, path, retrieve_refs=False).columns


def test_unimod(spark, put):
    path = put("u.xml", "<unimod><modifications><modifications_row record_id='1' full_name='Acetylation' code_name='Acetyl' ex_code_name='' mono_mass='42.010565' avge_mass='42.0367' composition='H(2) C(2) O' approved='1'/><modifications_row record_id='2' full_name='Amidation' code_name='Amidated' mono_mass='-0.98' avge_mass='-0.98' composition='H N O(-1)' approved='0'/></modifications><alt_names><alt_names_row record_id='1' alt_name='Ac group' mod_key='1'/></alt_names><bricks><bricks_row record_id='1' brick='H' full_name='Hydrogen'/><bricks_row record_id='2' brick='Ac' full_name='acetate'/></bricks><brick2element><brick2element_row record_id='1' brick_key='1' element='H' num_element='1'/><brick2element_row record_id='2' brick_key='2' element='C' num_element='2'/><brick2element_row record_id='3' brick_key='2' element='O' num_element='1'/><brick2element_row record_id='4' brick_key='2' element='H' num_element='2'/></brick2element><mod2brick><mod2brick_row record_id='1' brick='Ac' num_brick='1' mod_key='1'/><mod2brick_row record_id='2' brick='H' num_brick='-1' mod_key='1'/></mod2brick></unimod>")
    t = U.read_unimod_tables(spark, path)
    assert len(t) == 17 and t["modification"].count() == 2
    db = U.Unimod(t)
    assert db.by_id(1).first().approved is True and db.get("Acetyl").first().id == 1 and db.get("Ac group").first().id == 1 and db.get(2).first().full_name == "Amidation"
    assert {r.id for r in db.get("mid", strict=False).collect()} == {2} and db.get("nothing").isEmpty()
    assert db.modification_compositions().first().composition == {"C": 2, "O": 1, "H": 1}
    assert db.sql("select max(id) as m from {modification}").first().m == 2


def test_materialize_and_drop(spark, tmp_path, monkeypatch):
    from pepspark import session

    monkeypatch.setattr(session, "shared_dir", lambda s: f"file://{tmp_path}")
    df = session.materialize(spark.range(5), "t")
    assert df.count() == 5 and len(list(tmp_path.iterdir())) == 1
    assert session.drop_materialized(spark) >= 1 and not list(tmp_path.iterdir())


def test_external_arrays(spark):
    from pepspark.sources import external as E

    data = {"mz": [float(i) for i in range(25)], "it": [100.0, 101.0, 101.5, 102.0]}
    chunks = E.chunk_arrays(spark.createDataFrame(list(data.items()), "d string, v array<double>"), "d", "v", size=4)
    assert chunks.count() == 8
    refs = [(1, "mz", 0, 3, None), (2, "mz", 3, 11, None), (3, "mz", 24, 5, None), (4, "mz", 5, 0, None), (5, "no", 0, 2, None), (6, "it", 0, 4, "delta"), (7, "it", 0, 4, "linear")]
    got = {r.k: r["values"] for r in E.attach_arrays(spark.createDataFrame(refs, "k int, dataset string, offset long, length long, t string"), chunks, ["k"], transform="t", size=4).collect()}
    assert got[1] == data["mz"][:3] and got[2] == data["mz"][3:14] and got[3] == [24.0] and got[4] == [] and got[5] is None
    assert got[6] == [100.0, 101.0, 102.5, 104.5] and got[7] == [100.0, 101.0, 102.5, 105.0]
