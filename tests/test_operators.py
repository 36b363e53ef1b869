import math
import random
import string
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepspark.functions import mass as M
from pepspark.operators import access, forms, joins, regress, tda


@pytest.fixture(scope="module")
def psms(spark):
    rows = [(i, x, 0.01 + 0.001 * i, x.islower()) for i, x in enumerate(string.ascii_uppercase + string.ascii_lowercase)]
    return spark.createDataFrame(rows, "s int, label string, pep double, dec boolean")


@pytest.mark.parametrize("formula,remove,n", [(1, True, 26), (2, True, 26), (1, False, 39), (2, False, 34)])
def test_filter_goldens(psms, formula, remove, n):
    assert tda.filter_psms(psms, 0.5, "s", "dec", formula=formula, remove_decoy=remove, ranges=5).count() == n


def test_pep_and_fdr(psms):
    assert tda.filter_psms(psms, 0.02, "s", pep="pep", ranges=3).count() == 21
    assert tda.fdr(psms, "dec").first().fdr == 1.0 and abs(tda.fdr(psms, pep="pep").first().fdr - 0.0355) < 1e-12
    assert abs(tda.sigma_t(psms, "dec").first()[0] - 7.348469228) < 1e-8 and abs(tda.sigma_fdr(psms, "dec").first()[0] - 0.28263343) < 1e-8
    assert tda.filter_psms(psms.withColumn("f", F.lit("a")).unionByName(psms.withColumn("f", F.lit("b"))), 0.5, "s", "dec", by=["f"], remove_decoy=False, formula=1).count() == 78


def brute_q(rows, formula, correction=0):
    rows = sorted(rows)
    q, d = [], 0
    for i, (_, dec) in enumerate(rows, 1):
        d += dec
        f = d + (correction == 1)
        q.append((f / (i - d) if i > d else float("inf")) if formula == 1 else (d + f) / i)
    for i in range(len(rows) - 1, 0, -1):
        if rows[i][0] == rows[i - 1][0] or q[i - 1] > q[i]:
            q[i - 1] = q[i]
    return sorted((s, d, round(x, 9)) for (s, d), x in zip(rows, q))


@pytest.mark.parametrize("formula,correction,ranges", [(1, 0, 1), (2, 0, 7), (1, 1, 64), (2, 1, 3)])
def test_qvalues_against_brute_force(spark, formula, correction, ranges):
    rng = random.Random(ranges)
    rows = [(float(rng.randint(0, 60)), rng.random() < 0.3) for _ in range(400)]
    df = spark.createDataFrame(rows, "x double, dec boolean")
    got = sorted((r.score, r.is_decoy, round(r.q, 9)) for r in tda.qvalues(df, "x", "dec", formula=formula, correction=correction, ranges=ranges).collect())
    assert got == brute_q(rows, formula, correction)


def test_qvalues_reverse_nulls_empty_and_clashing_names(spark):
    df = spark.createDataFrame([(1.0, False, 9, 9), (None, False, 9, 9), (2.0, None, 9, 9), (0.5, True, 9, 9)], "x double, dec boolean, q int, score int")
    out = tda.qvalues(df, "x", "dec", reverse=True).collect()
    assert len(out) == 3 and {r.score: r.q for r in out} == {2.0: 0.0, 1.0: 0.0, 0.5: 2 / 3}
    assert tda.qvalues(df.limit(0), "x", "dec").count() == 0
    with pytest.raises(ValueError):
        tda.qvalues(df, "x", "dec", ratio=0)
    with pytest.raises(ValueError):
        tda.fdr(df, "dec", formula=3)


def test_corrections():
    assert tda.expected_false(0, 10) < 1 and tda.expected_false(5, 10**4) == pytest.approx(6, abs=1e-3)
    assert tda.confident_false(0.95, 0, 100) >= tda.confident_false(0.5, 0, 100)


def test_all_decoy(spark):
    df = spark.createDataFrame([(["DECOY_a"],), (["DECOY_a", "b"],), ([],), (None,)], "p array<string>")
    assert [r[0] for r in df.select(tda.all_decoy("p")).collect()] == [True, False, True, None]


def test_tolerance_join(spark):
    rng = random.Random(2)
    a = [(i, rng.uniform(100, 110)) for i in range(150)] + [(900, None), (901, float("nan"))]
    b = [(i, rng.uniform(100, 110)) for i in range(150)] + [(902, None)]
    left, right = spark.createDataFrame(a, "i int, x double"), spark.createDataFrame(b, "j int, y double")
    ok = lambda v: v is not None and v == v
    for kw, near in (({"atol": 0.05}, lambda x, y: abs(x - y) < 0.05), ({"rtol": 1e-3}, lambda x, y: abs(x - y) / y < 1e-3)):
        got = {(r.i, r.j) for r in joins.tolerance_join(left, right, "x", "y", **kw).collect()}
        assert got == {(i, j) for i, x in a for j, y in b if ok(x) and ok(y) and near(x, y)}
        assert joins.tolerance_join(left, right, "x", "y", **kw).count() == len(got)
    assert joins.tolerance_join(left.limit(0), right, "x", "y", atol=1).count() == 0


def test_nearest_join(spark):
    rng = random.Random(3)
    line = [(round(rng.uniform(0, 50), 1), k % 2) for k in range(60)]
    probes = [(k, rng.uniform(-20, 90), k % 2) for k in range(80)] + [(999, None, 0)]
    t = spark.createDataFrame(line, "t double, g int")
    p = spark.createDataFrame(probes, "k int, at double, g int")
    for on in (None, ["g"]):
        tt = t if on else t.select("t")
        got = {r.k: r.t for r in joins.nearest_join(p, tt, "at", "t", on=on, width=1.5).collect()}
        assert got == {k: min((x for x, h in line if not on or h == g), key=lambda x: (abs(x - at), x)) for k, at, g in probes if at is not None}
    assert joins.nearest_join(p.select("k", "at"), t.select("t").limit(0), "at", "t").count() == 0
    s = joins.time_slice(t.select("t"), "t", 10.0, 20.0).agg(F.min("t"), F.max("t")).first()
    near = lambda x: min((v for v, _ in line), key=lambda v: (abs(v - x), v))
    assert (s[0], s[1]) == (near(10.0), near(20.0))


def test_coverage(spark):
    prot = spark.createDataFrame([(1, "PEPTIDES"), (2, "AAAA"), (3, ""), (4, None), (5, "MKPEPTIDEKPEPTIDE")], "id int, seq string")
    pep = spark.createDataFrame([("PEP",), ("EPT",), ("AA",), (None,), ("",), ("PEP",), ("PEPTIDEK",)], "p string")
    mask = {}
    for r in joins.coverage_mask(prot, pep, "id", "seq", "p").collect():
        mask.setdefault(r.id, {})[r.position] = r.n_peptides
    assert mask[1] == {0: 1, 1: 2, 2: 2, 3: 1} and mask[2] == {0: 1, 1: 2, 2: 2, 3: 1} and len(mask[5]) == 8 + 3 + 1
    cov = {r.id: r.coverage for r in joins.coverage(prot, pep, "id", "seq", "p").collect()}
    assert cov[1] == 0.5 and cov[2] == 1.0 and cov[3] is None


def test_references(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (3, None)], "i int, ref string")
    t = spark.createDataFrame([("x", 5)], "key string, v int")
    assert {r.i: r.ref_v for r in joins.resolve_references(a, {"ref": (t, "key")}).collect()} == {1: 5, 2: None, 3: None}
    m = spark.createDataFrame([(1, "b a zz"), (2, "")], "i int, refs string")
    s = spark.createDataFrame([("a", 1), ("b", 2)], "id string, v int")
    assert {r.i: [x.v for x in r.refs_rows or []] for r in joins.resolve_reference_lists(m, "i", "refs", s, "id").collect()} == {1: [2, 1], 2: []}


def test_regressions(spark):
    xy = spark.createDataFrame([(1.0, 3.0), (2.0, 5.0), (3.0, 7.0), (None, 1.0)], "x double, y double")
    r = regress.linear_regression(xy, "x", "y").first()
    assert (round(r.a, 9), round(r.b, 9), round(r.r, 9), round(r.stderr, 9)) == (2, 1, 1, 0)
    assert abs(regress.linear_regression(xy, "x", "y", a=1.0).first().b - 3) < 1e-12
    rng = np.random.default_rng(0)
    x, e = rng.normal(size=200), rng.normal(size=200)
    pts = spark.createDataFrame([(float(a), float(1.5 * a + b)) for a, b in zip(x, e)], "x double, y double")
    d = np.c_[x, 1.5 * x + e]
    u = np.linalg.svd((d - d.mean(0)).T, full_matrices=False)[0]
    assert abs(regress.linear_regression_perpendicular(pts, "x", "y").first().a - u[1, 0] / u[0, 0]) < 1e-9
    assert regress.linear_regression(xy.limit(0), "x", "y").count() in (0, 1)


def test_retention_fit_recovers_coefficients(spark):
    rng = random.Random(4)
    true = {a: rng.uniform(-5, 10) for a in "ACDEFGHIKL"}
    seqs = ["".join(rng.choice("ACDEFGHIKL") for _ in range(rng.randint(5, 20))) for _ in range(300)]
    rows = [(s, sum(true[c] for c in s) * (1 - 0.2 * np.log(len(s))) + 3.0) for s in seqs]
    df = spark.createDataFrame([(s, float(t)) for s, t in rows], "s string, rt double")
    fit = regress.fit_retention(df, "s", "rt", lcp=-0.2, labels="ACDEFGHIKL")
    assert all(abs(fit["aa"][a] - v) < 1e-5 for a, v in true.items()) and abs(fit["const"] - 3) < 1e-4
    vary = regress.fit_retention_vary_lcp(df, "s", "rt", accuracy=0.01, labels="ACDEFGHIKL")
    assert abs(vary["lcp"] + 0.2) < 0.011
    with pytest.raises(ValueError):
        regress.fit_retention(df.limit(0), "s", "rt")


def test_access(spark):
    df = spark.createDataFrame([(i, f"id{i}") for i in range(10)], "pos int, id string")
    assert [r.id for r in access.by_ids(df, "id", ["id7", "id2", "no"]).orderBy("request").collect()] == ["id7", "id2"]
    ids = lambda d: sorted(r.pos for r in d.collect())
    assert ids(access.by_position(df, "pos", 2, 8, 3)) == [2, 5] and ids(access.by_position(df, "pos", -3)) == [7, 8, 9]
    assert ids(access.by_key_range(df, "id", "pos", "id6", "id4")) == [4, 5, 6]
    with pytest.raises(KeyError):
        access.by_key_range(df, "id", "pos", "id6", "nope")
    assert access.chain(df, df.select("id")).count() == 20
    assert access.first_per_group(df.withColumn("g", F.col("pos") % 3), ["g"], [-F.col("pos")]).select("pos").orderBy("pos").collect()[-1][0] == 9
    assert [(r.pos, r.rank) for r in access.top_k(df.withColumn("g", F.lit(1)), ["g"], "pos", 2, "id").orderBy("rank").collect()] == [(9, 1), (8, 2)]


def test_modx_forms():
    out = forms.modx_forms("PEPTIDE", {"p": ["T"], "Ac-": True}, max_mods=None)
    assert sorted(out) == sorted(["PEPTIDE", "Ac-PEPTIDE", "PEPpTIDE", "Ac-PEPpTIDE"])
    rng = random.Random(1)
    for _ in range(30):
        s = "".join(rng.choice("AXCDE") for _ in range(rng.randint(2, 8)))
        n = len(forms.modx_forms(s, {"x": ["A"], "y": ["A"], "z": ["X", "C"]}))
        assert n == 3 ** s.count("A") * 2 ** (s.count("X") + s.count("C"))
    assert forms.modx_forms("CAC", {}, {"cam": ["C"]}) == ["camCAcamC"]
    assert forms.modx_forms("oxMA", {"p": ["M"]}) == ["oxMA"] and set(forms.modx_forms("oxMA", {"p": ["M"]}, override=True)) == {"oxMA", "pMA"}
    assert set(forms.modx_forms("MAM", {"ox": ["ntermM"]})) == {"MAM", "oxMAM"}


def test_form_frames(spark):
    df = spark.createDataFrame([("PSTK",), (None,), ("bad-seq-x-",)], "s string")
    assert forms.peptidoforms_modx(df, "s", {"p": ["S", "T"]}, max_mods=1).count() == 3
    pf = spark.createDataFrame([("[Phospho]?PSTK",), ("[",), (None,), ("PEPS",)], "s string")
    out = forms.peptidoforms_proforma(pf, "s", {"Phospho": ["S"]}, max_mods=1)
    assert {r.form for r in out.filter("s = 'PEPS'").collect()} == {"PEPS", "PEPS[Phospho]"}
    iso = spark.createDataFrame([({"C": 6, "O": 2},), (None,)], "c map<string,int>")
    rows = forms.isotopologues(iso, "c", 0, 0).collect()
    assert abs(sum(r.abundance for r in rows) - 1) < 1e-9


def test_isotopologue_toy():
    from pepspark import constants as K

    K.NIST_MASS["F!"] = {0: (6.0, 1.0), 6: (6.0, 0.7), 7: (7.0, 0.3)}
    try:
        states = {c.get("F![7]", 0): p for c, p in forms.isotopologues_of({"F!": 10})}
    finally:
        del K.NIST_MASS["F!"]
    assert states[3] == pytest.approx(120 * 0.3**3 * 0.7**7)


def test_annotate_and_mirror(spark):
    from pepspark.operators import annotate as N

    s = spark.createDataFrame([(1, [98.06, 227.1026, 500.0], [1.0, 4.0, None]), (2, [], [])], "id int, mz array<double>, intensity array<double>")
    p = spark.createDataFrame([(1, "PEPTIDE"), (2, "PEPTIDE")], "id int, peptide string")
    got = {(r.id, r.name): r.intensity for r in N.annotate(s, p, "id", atol=0.01).collect()}
    assert got == {(1, "b1+"): 1.0, (1, "b2+"): 4.0}
    assert N.annotate(s, p, "id").count() == 2
    m = N.mirror(s.filter("id = 1"), s.filter("id = 1"), ["id"]).collect()
    assert len(m) == 6 and {r.intensity for r in m if r.side == "bottom"} == {-0.25, -1.0, None}
    line = regress.linear_regression(spark.createDataFrame([(1.0, 3.0), (2.0, 5.0)], "x double, y double"), "x", "y")
    assert abs(N.trend_line(line, F.lit(10.0)).first().y - 21) < 1e-9


def test_qvalue_curve(psms):
    q = tda.qvalues(psms, "s", "dec", formula=1, remove_decoy=False, ranges=4)
    curve = tda.qvalue_curve(q, 5).collect()
    for r in curve:
        assert r.n_accepted == q.filter(F.col("q") <= r.q).count()


def test_retention_terminal_and_absolute(spark):
    rng = random.Random(7)
    seqs = ["".join(rng.choice("ACDE") for _ in range(rng.randint(3, 12))) for _ in range(200)]
    true = {"A": 1.0, "C": 2.0, "D": 3.0, "E": -1.0}
    rt = [sum(true[c] for c in s[1:-1]) + 2 * true[s[0]] + 0.5 * true[s[-1]] + 4 for s in seqs]
    df = spark.createDataFrame([(s, float(t)) for s, t in zip(seqs, rt)], "s string, rt double")
    fit = regress.fit_retention(df, "s", "rt", lcp=0.0, labels="ACDE", term_aa=True)["aa"]
    # terminal terms are only known up to a constant each
    assert abs(fit["ntermA"] - fit["ntermE"] - 4) < 1e-6 and abs(fit["ctermD"] - fit["ctermE"] - 2) < 1e-6 and abs(fit["D"] - 3) < 1e-6
    plain = [(s, sum(true[c] for c in s) + 4.0) for s in seqs]
    bad = spark.createDataFrame([(s, float(t + (500 if i % 10 == 0 else 0))) for i, (s, t) in enumerate(plain)], "s string, rt double")
    mae = regress.fit_retention(bad, "s", "rt", lcp=0.0, labels="ACDE", metric="mae", steps=30)
    assert all(abs(mae["aa"][a] - v) < 0.05 for a, v in true.items())
    with pytest.raises(ValueError):
        regress.fit_retention(df, "s", "rt", metric="other")


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_isotopologue_query_has_all_states_of_the_operator(spark):
    from pepspark.plans import domain

    d = "/root/testdata/sf0.001"
    got = {r.peptide: r for r in domain.q59_isotopologues(spark, d).collect()}
    for r in domain.peptides(spark, d).select("peptide", M.sequence_composition("peptide").alias("c")).limit(20).collect():
        states = forms.isotopologues_of(dict(r.c), overall_threshold=1e-3)
        assert got[r.peptide].n_states == len(states)
        assert abs(got[r.peptide].uncovered - (1 - sum(p for _, p in states))) < 2e-6


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test data")
def test_slice_query_has_the_whole_table(spark):
    from pepspark.plans import domain

    d = "/root/testdata/sf0.001"
    want = domain.spectra(spark, d).filter("spectrum_id is not null").select("spectrum_id", "title")
    got = domain.q81_whole_slice(spark, d)
    assert got.count() == want.count() > 43 and got.exceptAll(want).count() == 0


@pytest.mark.parametrize("d", [0, 1, 5, 40, 300, 3000])
@pytest.mark.parametrize("t", [0, 1, 7, 100, 2000, 20000])
@pytest.mark.parametrize("p", [0.5, 0.3, 1 / 11])
def test_bounded_sums_against_full_ones(d, t, p):
    m = np.arange(t + 1)
    logs = np.array([k * math.log(p) + math.lgamma(k + d + 1) - math.lgamma(k + 1) - math.lgamma(d + 1) for k in m])
    pi = np.exp(logs - logs.max())
    assert abs(tda.expected_false(d, t, p) - (m * pi).sum() / pi.sum()) <= 1e-9 * max(1, t)
    for level in (0.05, 0.5, 0.95):
        want = int(np.searchsorted(pi.cumsum(), level * pi.sum() * (1 - 1e-9)))
        assert tda.confident_false(level, d, t, p) == want


def test_sums_of_a_million_decoys_are_short():
    assert len(tda._terms(10**6, 10**9, 0.5)[0]) < 300_000 and abs(tda.expected_false(10**6, 10**9, 0.5) - (10**6 + 1)) < 1


@pytest.mark.parametrize("slice_bytes", [10, 1_000_000])
def test_peptide_index_against_brute_force(monkeypatch, slice_bytes):
    import pyarrow as pa

    monkeypatch.setattr(joins.PeptideIndex, "SLICE", slice_bytes)
    rng = random.Random(2)
    seqs = ["".join(rng.choice("ABé") for _ in range(rng.randint(0, 40))) for _ in range(60)]
    peps = sorted({s[i : i + rng.randint(1, 30)] for s in seqs for i in range(0, len(s), 5)} - {""})
    got = sorted((int(r), int(a), int(n), t) for rows, at, size, text in joins.PeptideIndex.build(peps).search(pa.array(seqs)) for r, a, n, t in zip(rows, at, size, text.to_pylist()))
    assert got == sorted((i, k, len(p), p) for i, s in enumerate(seqs) for p in peps for k in range(len(s) - len(p) + 1) if s[k : k + len(p)] == p)
    assert list(joins.PeptideIndex.build([]).search(pa.array(["AB", None]))) == []


def test_coverage_in_several_blocks(spark):
    prot = spark.createDataFrame([(1, "PEPTIDEKPEPTIDER"), (2, "AAAA"), (3, ""), (4, None)], "id int, s string")
    pep = spark.createDataFrame([("PEPTIDE",), ("AA",), ("IDEK",), (None,), ("",), ("AA",)], "p string")
    want = sorted(map(tuple, joins.coverage_counts(prot, pep, "id", "s", "p").collect()))
    assert sorted(map(tuple, joins.coverage_counts(prot, pep, "id", "s", "p", block_bytes=20).collect())) == want and len(want) == 6
