from datetime import datetime as D

from pyspark.sql import functions as F

from pepspark import streaming as S


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.processAllAvailable()
    q.stop()
    return df.sparkSession.table(name)


SCHEMA = "query_id bigint, source string, score double, is_decoy boolean, at timestamp"


def rows():
    return [(i, f"s{i % 2}", float(i % 7), i % 3 == 0, D(2024, 1, 1 + i // 4)) for i in range(40)]


def folder(spark, tmp_path, parts=4):
    spark.createDataFrame(rows() + rows()[:5], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "in"))
    return S.watch_parquet(spark, str(tmp_path / "in"), SCHEMA, 2)


def test_counts_windows_sessions(spark, tmp_path):
    s = folder(spark, tmp_path)
    once = drain(S.distinct_deliveries(s, ["query_id"], "at", "400 days"), "m1")
    assert once.count() == 40
    w = drain(S.windowed_counts(s, "at", ["source"]), "m2", "complete")
    assert w.agg(F.sum("n")).first()[0] == 45
    slide = drain(S.windowed_counts(s, "at", [], "2 days", "1 day"), "m3", "complete")
    assert slide.agg(F.sum("n")).first()[0] == 90
    f = drain(S.windowed_fdr(s, "at", "is_decoy"), "m4", "complete")
    assert f.agg(F.sum("n_psms"), F.sum("n_decoys")).first() == (45, 14 + 2)
    assert drain(S.sessions(s, "at", "source", "36 hours"), "m5", "complete").count() == 2


def test_running_state_and_batches(spark, tmp_path):
    s = folder(spark, tmp_path)
    r = drain(S.running_fdr(s), "m6", "update")
    last = {x.source: x.n_psms for x in r.groupBy("source").agg(F.max("n_psms").alias("n_psms")).collect()}
    assert last == {"s0": 23, "s1": 22}
    seen = []
    q = s.writeStream.foreachBatch(S.qvalues_per_batch("score", "is_decoy", lambda df, n: seen.append(df.count()), ranges=1)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sum(seen) == 45 and len(seen) == 2


def test_mgf_stream(spark, tmp_path):
    (tmp_path / "a.mgf").write_text("BEGIN IONS\nTITLE=x\nPEPMASS=5.5\n1.0 2.0\n3 4\nEND IONS\nBEGIN IONS\nTITLE=y\n5 6\nEND IONS\n")
    got = {r.title: (r.mz, r.intensity, r.pepmass) for r in drain(S.watch_mgf(spark, str(tmp_path)), "m7").collect()}
    assert got == {"x": ([1.0, 3.0], [2.0, 4.0], "5.5"), "y": ([5.0], [6.0], "")}
