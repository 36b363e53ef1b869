from pepspark.operators import units as U

SCHEMA = "param_id bigint, spectrum_id bigint, source string, parent_element string, cv_ref string, accession string, param_name string, param_value string, unit_accession string, unit_name string, unit string"
T, I, E, V, K, P, M = "MS:1000016", "MS:1000927", "MS:1000045", "MS:1000875", "MS:1002040", "MS:1000869", "MS:1000224"
# (accession, name, value, unit accession, unit name, expected milli or None, origin)
CASES = [
    (T, "scan start time", "2.5", "UO:0000031", "minute", 150000, "field"),
    ("ms:1000016", "scan start time", "1,5", None, "h", 5400000, "field"),
    (T, "scan start time", "90 s", None, None, None, "text"),
    (T, "scan start time (min.)", "2", None, None, 120000, "text"),
    (T, "scan start time", "25 m 45.6 s", None, None, 1545600, "text"),
    (T, "scan start time", "PT1H38M36.4S", None, None, 5916400, "text"),
    (T, "scan start time", "38:54.3", None, None, 2334300, "text"),
    (T, "scan start time", "=  1.1168e2  min.", None, None, 6700800, "text"),
    (I, "ion injection time_µs", "1500", None, None, 1500, "text"),
    (I, "ion injection time", "ca. 0.25sec", None, None, 250000, "text"),
    (I, "ion injection time", "5", "UO:0000028", None, None, "field"),
    (E, "collision energy", "35", "UO:0000187", "percent", None, "field"),
    (E, "collision energy, keV", "0.0345", None, None, 34500, "text"),
    (V, "declustering potential", "1500000 mV", None, None, 1500000, "text"),
    (V, "declustering potential", "value: 1.5 (kV)", None, None, 1500000, "text"),
    (K, "inlet temperature", "100", None, "degF", 310928, "field"),
    (K, "inlet temperature", "~100.5 ℃", None, None, 373650, "text"),
    (K, "inlet temperature", "-10 deg C", None, None, 263150, "text"),
    (P, "collision gas pressure", "1", None, "Torr", 133322, "field"),
    (P, "collision gas pressure / mbar", "0.5", None, None, 50000, "text"),
    (M, "molecular mass", "66.5 KDa", None, None, 66500000, "text"),
    (M, "molecular mass", "unknown", "UO:0000222", "kilodalton", None, "field"),
    (M, "molecular mass", "NaN", None, "kDa", None, "field"),
    (M, "molecular mass", "", None, "kDa", None, "field"),
    (M, "molecular mass", None, None, "kDa", None, "field"),
    (M, "molecular mass", "5", None, "furlong", None, "field"),
    (M, "molecular mass", "5", None, None, None, None),
    ("MS:1000511", "ms level", "2", None, None, "absent", None),
    (None, None, None, None, None, "absent", None),
]


def frame(spark, cases=CASES):
    rows = [(i, 1, None, "scan", None, a, n, v, ua, un, "clash") for i, (a, n, v, ua, un, _, _) in enumerate(cases)]
    return spark.createDataFrame(rows + rows[:3], SCHEMA)


def test_converted_values(spark):
    got = {r.param_id: r.value_milli for r in U.converted_values(frame(spark)).collect()}
    assert got == {i: c[5] for i, c in enumerate(CASES) if isinstance(c[5], int)}


def test_all_rows_and_origin(spark):
    got = {r.param_id: r for r in U.harmonize_units(frame(spark), source_default=False).collect()}
    assert set(got) == {i for i, c in enumerate(CASES) if c[5] != "absent"}
    for i, c in enumerate(CASES):
        if i in got:
            assert got[i].unit_origin == c[6], c
    assert abs(got[2].value_milli - 90000) < 1e-6 and got[11].value_milli is None


def test_source_default(spark):
    rows = [(M, "molecular mass", "5", None, "kDa", 0, "")] * 3 + [(M, "molecular mass", "7", None, "Da", 0, ""), (M, "molecular mass", "6", None, None, 0, "")]
    got = {r.param_id: r for r in U.harmonize_units(frame(spark, rows)).collect()}
    assert got[4].unit_origin == "default" and got[4].unit == "kilodalton" and got[4].value_milli == 6e6


def test_empty(spark):
    assert U.converted_values(frame(spark).limit(0)).count() == 0
