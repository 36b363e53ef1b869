"""Spectra whose arrays lie outside the record, as slices of long shared arrays.

The shared arrays are a table of chunks (dataset, chunk, values), which stands in for a binary
container: any such container can be unloaded into it once, and parquet then serves single chunks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pepspark.functions import arrays as A

#: Elements of a chunk.
CHUNK = 1 << 20


def chunk_arrays(df: DataFrame, dataset: str, values: str, size: int = CHUNK) -> DataFrame:
    """Long arrays cut into chunks: dataset, chunk (from 0), values."""
    n = F.size(values)
    cut = F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.slice(F.col(values), i * size + 1, F.lit(size)))
    return df.filter(n > 0).select(F.col(dataset).alias("dataset"), F.posexplode(cut).alias("chunk", "values"))


def attach_arrays(refs: DataFrame, chunks: DataFrame, keys: list[str], dataset: str = "dataset", offset: str = "offset", length: str = "length", transform: str | None = None, size: int = CHUNK) -> DataFrame:
    """``keys`` and ``values``: for each reference the slice of its dataset, its prediction undone.

    An equi-join on dataset and chunk brings only the chunks a slice touches; the parts are put
    together in order. ``transform`` names a column with 'delta', 'linear' or something else (none). A
    slice of length 0 is empty, one beyond the end is shortened, one of an unknown dataset is null.
    Keys must be unique.
    """
    kind = F.col(transform) if transform else F.lit(None).cast("string")
    r = refs.select(*keys, F.col(dataset).alias("dataset"), F.col(offset).cast("bigint").alias("__o"), F.col(length).cast("bigint").alias("__l"), kind.alias("__t"))
    touched = r.filter(F.col("__l") > 0).withColumn("chunk", F.explode(F.sequence(F.floor(F.col("__o") / size), F.floor((F.col("__o") + F.col("__l") - 1) / size)))).withColumn("chunk", F.col("chunk").cast("int"))
    first = F.greatest(F.col("__o") - F.col("chunk") * F.lit(size), F.lit(0))
    last = F.least(F.col("__o") + F.col("__l") - F.col("chunk") * F.lit(size), F.lit(size))
    parts = touched.join(chunks.select("dataset", "chunk", "values"), ["dataset", "chunk"]).select(*keys, "chunk", F.slice("values", (first + 1).cast("int"), (last - first).cast("int")).alias("part"))
    whole = parts.groupBy(*keys).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "part"))), lambda x: x["part"])).alias("__v"))
    out = r.join(whole, keys, "left").withColumn("__v", F.when(F.col("__l") == 0, F.array().cast("array<double>")).otherwise(F.col("__v").cast("array<double>")))
    undone = F.when(F.col("__t") == "delta", A.delta_predict("__v")).when(F.col("__t") == "linear", A.linear_predict("__v")).otherwise(F.col("__v"))
    return out.select(*keys, undone.alias("values"))
