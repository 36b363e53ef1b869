"""Structured Streaming over landing folders of spectra and identifications."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.operators import tda


def watch_parquet(spark: SparkSession, path: str, schema, max_files: int = 100) -> DataFrame:
    """New parquet files of a folder as a stream; at most ``max_files`` in a batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def watch_mgf(spark: SparkSession, path: str) -> DataFrame:
    """Spectra of new MGF files: source, title, pepmass (text), mz, intensity. File headers don't apply to a stream."""
    r = spark.readStream.option("lineSep", "BEGIN IONS").text(path).select(F.regexp_replace("value", "\r", "").alias("value"), F.col("_metadata.file_path").alias("source")).filter(F.contains("value", F.lit("END IONS")))
    lines = F.filter(F.transform(F.split(F.split(F.col("value"), "END IONS")[0], "\n"), lambda x: F.trim(x)), lambda x: x != "")
    r = r.withColumn("lines", lines)
    key = lambda k: F.regexp_extract("value", rf"(?im)^{k}=(.*)$", 1)
    peaks = F.transform(F.filter("lines", lambda x: x.rlike("^[0-9.]")), lambda x: F.split(x, r"\s+"))
    number = lambda k: F.transform(peaks, lambda p: F.get(p, F.lit(k)).try_cast("double"))
    return r.select("source", key("TITLE").alias("title"), key("PEPMASS").alias("pepmass"), number(0).alias("mz"), number(1).alias("intensity"))


def distinct_deliveries(stream: DataFrame, keys: list[str], event_time: str, delay: str = "30 days") -> DataFrame:
    """Rows delivered repeatedly come once, if the repetition is at most ``delay`` late."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_counts(stream: DataFrame, event_time: str, groups: list[str], width: str = "1 day", slide: str | None = None, delay: str = "7 days") -> DataFrame:
    """Counts by tumbling (or sliding) event-time window and group; rows later than ``delay`` are left out."""
    w = F.window(event_time, width, slide) if slide else F.window(event_time, width)
    return stream.withWatermark(event_time, delay).groupBy(w, *groups).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *groups, "n")


def sessions(stream: DataFrame, event_time: str, key: str, gap: str = "30 minutes", delay: str = "1 day") -> DataFrame:
    """Sessions of each key, closed after ``gap`` without a row."""
    return stream.withWatermark(event_time, delay).groupBy(F.session_window(event_time, gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def windowed_fdr(stream: DataFrame, event_time: str, is_decoy: str, width: str = "1 day", delay: str = "7 days") -> DataFrame:
    """Decoy-based FDR (formula 1) of each event-time window. q-values need the whole order, so they are made by batch (:func:`qvalues_per_batch`)."""
    d = F.sum(F.col(is_decoy).cast("bigint"))
    g = stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width)).agg(F.count("*").alias("n_psms"), d.alias("n_decoys"))
    return g.select(F.col("window.start").alias("start"), "n_psms", "n_decoys", F.when(F.col("n_psms") > F.col("n_decoys"), F.col("n_decoys") / (F.col("n_psms") - F.col("n_decoys"))).alias("fdr"))


def qvalues_per_batch(score: str, is_decoy: str, sink: Callable[[DataFrame, int], None], **kwargs) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that filters each micro-batch by its own q-values."""

    def run(batch: DataFrame, number: int) -> None:
        sink(tda.qvalues(batch, score, is_decoy, **kwargs), number)

    return run


def _running(key: tuple, frames: Iterator[pd.DataFrame], state: Any) -> Iterator[pd.DataFrame]:
    n, d = state.get if state.exists else (0, 0)
    for f in frames:
        n += len(f)
        d += int(f["is_decoy"].fillna(False).astype(bool).sum())
    state.update((n, d))
    yield pd.DataFrame({"source": [key[0]], "n_psms": [n], "n_decoys": [d], "fdr": [d / (n - d) if n > d else None]})


def running_fdr(stream: DataFrame, source: str = "source", is_decoy: str = "is_decoy") -> DataFrame:
    """Running counts and FDR of each source over all batches so far, kept as two numbers of state per source."""
    rows = stream.select(F.col(source).alias("source"), F.col(is_decoy).cast("boolean").alias("is_decoy"))
    return rows.groupBy("source").applyInPandasWithState(_running, "source string, n_psms bigint, n_decoys bigint, fdr double", "n bigint, d bigint", "update", "NoTimeout")
