import pytest

from pepspark import constants as K
from pepspark.functions import proforma as P

PHOSPHO = K.composition_mass(K.formula_composition("HO3P"))


@pytest.mark.parametrize(
    "text,mass",
    [
        ("PEPTIDE", 799.359964027),
        ("EM[Oxidation]EVEES[UNIMOD:21]PEK", None),
        ("PEP[+15.994915]TIDE", 815.354879),
        ("[Acetyl]-PEPTIDE-[Amidated]", None),
        ("<[Carbamidomethyl]@C>ACDCK", None),
        ("[Phospho]^2?PSTSK", None),
        ("PEP(TID)[Phospho]E", None),
        ("{Glycan:Hex}PEPTIDE", 799.359964027 + 162.052823),
        ("PEPT[Formula:[13C2]C-2H2]IDE", None),
        ("PEPT[INFO:note|+10.5]IDE/2", 809.859964),
        ("PRT(?EW)K[Phospho|INFO:x]", None),
        ("EM[Oxidation]EVT[#g1(0.01)]S[#g1(0.09)]ES[Phospho#g1(0.90)]PEK", None),
        ("(>name)PEPTIDE/-2", 799.359964027),
        ("PEPTIDE/2[+2Na+]", 799.359964027),
        ("PEPTIDE/[Na:z+1^2,H:z+1]", 799.359964027),
        ("<13C>ATPEK", None),
    ],
)
def test_round_trip_and_mass(text, mass):
    p = P.parse(text)
    again = P.parse(str(p))
    assert abs(p.mass - again.mass) < 1e-9 and str(again) == str(p)
    if mass is not None:
        assert abs(p.mass - mass) < 1e-5


def test_masses_add_up():
    base = P.parse("PSTSK").mass
    assert abs(P.parse("[Phospho]^2?PSTSK").mass - base - 2 * PHOSPHO) < 1e-9
    assert abs(P.parse("PS[Phospho]TSK").mass - base - PHOSPHO) < 1e-9
    assert abs(P.parse("(PS)[Phospho]TSK").mass - base - PHOSPHO) < 1e-9
    assert abs(P.parse("<[Carbamidomethyl]@C>ACDCK").mass - P.parse("ACDCK").mass - 2 * 57.02146372) < 1e-6
    assert abs(P.parse("<[+10]@N-term>ACK").mass - P.parse("ACK").mass - 10) < 1e-9
    assert P.parse("PS[Phospho]TSK").composition()["P"] == 1
    with pytest.raises(P.ProFormaError):
        P.parse("PS[+79.9]TSK").composition()


def test_mz_and_charge():
    p = P.parse("PEPTIDE/2")
    assert p.charge == 2 and abs(p.mz() - (p.mass + 2 * K.PROTON) / 2) < 1e-9 and abs(p.mz(3) - (p.mass + 3 * K.PROTON) / 3) < 1e-9
    na = P.parse("PEPTIDE/1[+Na+]")
    assert abs(na.mz() - p.mass - 22.98922) < 1e-4 and P.parse("PEPTIDE/[Na:z+1^2,H:z+1]").charge == 3
    with pytest.raises(P.ProFormaError):
        P.parse("PEPTIDE").mz()


def test_fragments():
    p = P.parse("PEPTIDE")
    assert [round(x, 5) for x in p.fragments("b")] == [98.06004, 227.10263, 324.1554, 425.20308, 538.28714, 653.31408]
    assert p.fragments("y") == pytest.approx([148.06043424, 263.08737726, 376.17144124, 477.21911971, 574.27188356, 703.31447664], abs=1e-6)
    q = P.parse("PEPT[Phospho]IDE")
    assert [round(a - b, 4) for a, b in zip(q.fragments("b"), p.fragments("b"))] == [0, 0, 0, *[round(PHOSPHO, 4)] * 3]
    lab = P.parse("{Phospho}PEPTIDE")
    assert lab.fragments("b") == p.fragments("b") and abs(lab.fragments("b", include_labile=True)[0] - p.fragments("b")[0] - PHOSPHO) < 1e-9
    # complementary ions make up the whole
    for f in (p, q, P.parse("[Acetyl]-PEM[Oxidation]K-[Amidated]")):
        b, y = f.fragments("b", 0), f.fragments("y", 0)
        assert all(abs(x + z - f.mass) < 1e-8 for x, z in zip(b, reversed(y)))


@pytest.mark.parametrize("text", ["", "[", "PEP[", "PEP]", "PEPTIDE-", "[Acetyl]PEP", "(PEP", "PEP//TIDE", "<[+1]C>PEP", "PEP/[x]", "P E", "PEP[]"])
def test_malformed(text):
    with pytest.raises(P.ProFormaError):
        P.parse(text)


def test_chimeric_and_names():
    a, b = P.parse_chimeric("<[+57.02]@C>PEPC/2+ACK/1")
    assert a.charge == 2 and b.charge == 1 and b.mass - P.parse("ACK").mass == pytest.approx(57.02)
    with pytest.raises(P.ProFormaError):
        P.parse("PEP+TIDE")


def test_placements():
    assert {str(x) for x in P.peptidoforms(P.parse("[Phospho]?PST"))} == {"P[Phospho]ST", "PS[Phospho]T", "PST[Phospho]"}
    assert {str(x) for x in P.peptidoforms(P.parse("PS[#g1]T[Phospho#g1]"))} == {"PS[Phospho]T", "PST[Phospho]"}
    assert len(list(P.peptidoforms(P.parse("PSTSK"), {"Phospho": ["S", "T"]}, 2))) == 1 + 3 + 3


def test_placement_rules():
    f = lambda t: {str(x) for x in P.peptidoforms(P.parse(t))}
    assert f("[Phospho|Position:S,T]?PSTK") == {"PS[Phospho]TK", "PST[Phospho]K"}
    assert f("[Phospho|Position:S|Limit:2]^2?PSK") == {"PS[Phospho][Phospho]K"} and f("[Phospho|Position:S]^2?PSK") == set()
    assert f("[Methyl|Position:K]?PK[Acetyl]") == set() and f("[Methyl|Position:K|CoMKP]?PK[Acetyl]") == {"PK[Acetyl][Methyl]"}
    assert f("[Methyl|Position:K|CoMUP][Acetyl|Position:K|CoMUP]?PK") == {"PK[Acetyl][Methyl]"} and f("[Methyl|Position:K][Acetyl|Position:K]?PK") == set()
    assert f("[Methyl|Position:N-term]?KPK") == {"K[Methyl]PK"}


def test_slices_and_tags():
    p = P.parse("[Acetyl]-PEM[Oxidation](STK)[Phospho#g1]R[#g1]-[Amidated]/2")
    assert str(p.slice(0, 3)) == "[Acetyl]-PEM[Oxidation]" and str(p.slice(4, 7)) == "(TK)[Phospho#g1]R[#g1]-[Amidated]" and str(p.slice(0, 7)) == str(p)
    assert {(k, i) for k, i, _ in p.find_tags("#g1")} == {("interval", 3), ("residue", 6)} and len(p.tags()) == 5


def test_vocabulary():
    v = P.Vocabulary([("Mine", 9000, "C2H2", None), ("Heavy", None, None, 10.5)])
    assert abs(P.parse("PEP[Mine]K", v).mass - P.parse("PEPK").mass - 26.01565) < 1e-4
    assert abs(P.parse("PEP[U:9000]K", v).mass - P.parse("PEP[Mine]K", v).mass) < 1e-9 and P.parse("PEP[Heavy]K", v).mass - P.parse("PEPK").mass == pytest.approx(10.5)
    with pytest.raises(ValueError):
        v.register("nothing")


def test_columns(spark):
    df = spark.createDataFrame([("PEPTIDE",), ("EM[Oxidation]EK/2",), ("bad[",), (None,), ("PEPTIDE",)], "t string")
    rows = df.select("t", P.proforma_mass("t").alias("m"), P.proforma_mz("t").alias("z"), P.parse_proforma("t").alias("p"), P.proforma_fragments("t", "b").alias("f"), P.proforma_composition("t").alias("c")).collect()
    by = {r.t: r for r in rows}
    assert abs(by["PEPTIDE"].m - 799.359964) < 1e-6 and by["PEPTIDE"].z is None and len(by["PEPTIDE"].f) == 6
    e = by["EM[Oxidation]EK/2"]
    assert e.p.charge == 2 and e.p.sequence[1].tags[0].value == "Oxidation" and e.c["O"] == P.parse("EM[Oxidation]EK").composition()["O"] and abs(e.z - P.parse("EM[Oxidation]EK/2").mz()) < 1e-9
    assert by["bad["].m is None and by["bad["].p is None and by[None].m is None
    x = spark.createDataFrame([("Ac-oxMK-NH2",), ("PEP",)], "s string").select(P.modx_to_proforma("s", {"ox": "Oxidation", "Ac": "Acetyl", "NH2": "Amidated"})).collect()
    assert [r[0] for r in x] == ["[Acetyl]-M[Oxidation]K-[Amidated]", "PEP"]


def test_any_notation(spark):
    mods = {"ox": 15.99491461956, "p": PHOSPHO, "Ac-": K.composition_mass({"C": 2, "H": 3, "O": 1})}
    rows = [("PEPTIDE", "PEPTIDE"), ("oxMEpTK", "M[Oxidation]ET[Phospho]K"), ("Ac-oxMK-NH2", "[Acetyl]-M[Oxidation]K-[Amidated]"), ("zzMK", None), (None, None), ("M[Oxidation]K", "M[Oxidation]K")]
    df = spark.createDataFrame(rows, "a string, b string")
    got = df.select("a", P.peptide_mass("a", mods).alias("m"), P.proforma_mass("b").alias("n"), P.fragment_series("a", ("b", "y"), 2, mods).alias("f"), P.fragment_series("b", ("b", "y"), 2).alias("g")).collect()
    for r in got:
        assert (r.m is None) == (r.n is None) and (r.m is None or abs(r.m - r.n) < 1e-6), r.a
        assert (r.f is None) == (r.g is None)
        if r.f is not None:
            assert [x.name for x in r.f] == [x.name for x in r.g] and all(abs(x.mz - y.mz) < 1e-6 for x, y in zip(r.f, r.g))
    from pepspark.functions import mass as M

    c = spark.createDataFrame([("PEP",), ("H2O",), ("??",)], "s string").select(M.composition_of("s")).collect()
    assert c[0][0]["C"] == 15 and c[1][0] == {"H": 2, "O": 1} and c[2][0] is None


def test_carriers():
    from pepspark.functions import mass as M

    assert M.carrier("H+") == (K.PROTON, 1) and M.carrier("Ca+2")[1] == 2 and abs(M.carrier("Na+")[0] - 22.98922) < 1e-4
    with pytest.raises(ValueError):
        M.carrier("Na")
