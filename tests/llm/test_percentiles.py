import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from pepspark.llm import percentiles as P


def exact(values, p):
    v = sorted(values)
    return v[max(1, math.ceil(len(v) * p / 100)) - 1]


def test_bounded_error_and_merge(spark):
    rng = np.random.default_rng(1)
    rows = [(f"s{i % 3}", f"d{i % 5}", [float(x) for x in np.exp(rng.normal(i % 3 * 4, 3, 40))]) for i in range(60)]
    df = spark.createDataFrame(rows, "source string, day string, v array<double>")
    c = P.value_counts(df, ["source", "day"], {"v": "v"}, 0.01)
    by_source = P.percentiles_of_counts(P.merge_counts(c, ["source"]), ["source"], error=0.01, stripe=16).collect()
    for r in by_source:
        want = exact([x for s, _, v in rows if s == r.source for x in v], r.percent)
        assert abs(r.value - want) <= 0.0101 * want
        assert r.n_values == 800
    direct = P.percentiles_of_counts(P.value_counts(df, ["source"], {"v": "v"}, 0.01), ["source"], error=0.01).collect()
    assert sorted(map(str, direct)) == sorted(map(str, by_source))


def test_special_values(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([("a", [0.0, None, nan, -5.0, inf, -inf, 5.0]), ("b", None), ("c", []), (None, [1.0]), ("a", [0.0])], "g string, v array<double>")
    out = P.percentiles_of_counts(P.value_counts(df, ["g"], {"v": "v"}), ["g"], (1.0, 50.0, 100.0)).collect()
    a = {r.percent: r.value for r in out if r.g == "a"}
    assert a == {1.0: -inf, 50.0: 0.0, 100.0: inf}
    assert {r.n_values for r in out if r.g == "a"} == {6} and {r.g for r in out} == {"a", None}


def test_bins_keep_order(spark):
    v = [-1e300, -3.0, -1e-300, 0.0, 1e-300, 0.5, 1.0, 2.0, 1e300]
    got = [r[0] for r in spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, x double").orderBy("i").select(P.value_bin(F.col("x"))).collect()]
    assert got == sorted(got)


def test_scalar_column_empty_and_bad_error(spark):
    df = spark.createDataFrame([], "g string, x double")
    assert P.percentiles_of_counts(P.value_counts(df, ["g"], {"x": "x"}), ["g"]).count() == 0
    with pytest.raises(ValueError):
        P.value_counts(df, ["g"], {"x": "x"}, 0.0)


def test_levels_arrays_of_differing_length_and_clashing_names(spark):
    df = spark.createDataFrame([("a", "d1", [1.0, 2.0, 3.0], [5.0], 9), ("a", "d2", [4.0], None, 9), ("a", "d1", None, None, 9)], "field string, day string, x array<double>, y array<double>, n int")
    c = P.value_counts(df.withColumnRenamed("field", "source"), ["source", "day"], {"x": "x", "y": "y"}, 0.01)
    out = P.percentiles_of_counts(P.counts_by_level(c, {"day": ["source", "day"], "all": ["source"]}), ["level", "source", "day"], (50.0, 100.0), 0.01, stripe=2).collect()
    got = {(r.level, r.day, r.field, r.percent): (r.n_values, round(r.value, 1)) for r in out}
    assert got[("all", None, "x", 50.0)] == (4, 2.0) and got[("all", None, "x", 100.0)] == (4, 4.0) and got[("day", "d1", "x", 50.0)] == (3, 2.0)
    assert got[("all", None, "y", 50.0)] == (1, 5.0) and ("day", "d2", "y", 50.0) not in got


def test_per_batch_of_a_stream(spark, tmp_path):
    spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source string, score double").write.parquet(str(tmp_path / "in"))
    seen = []
    s = spark.readStream.schema("source string, score double").parquet(str(tmp_path / "in"))
    q = s.writeStream.foreachBatch(P.value_counts_per_batch(["source"], {"score": "score"}, lambda df, n: seen.append(df.agg(F.sum("n")).first()[0]))).trigger(availableNow=True).start()
    q.awaitTermination()
    assert sum(seen) == 2
