"""Access by id, position and key range; chaining of sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pepspark.session import BROADCAST_LIMIT


def by_ids(df: DataFrame, key: str, ids: list) -> DataFrame:
    """Rows of the given ids, with 'request' (their place in the request); unknown ids give no rows."""
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, x) for i, x in enumerate(ids)], f"request int, __id {df.schema[key].dataType.simpleString()}")
    if sum(len(str(x)) + 16 for x in ids) <= BROADCAST_LIMIT:
        wanted = F.broadcast(wanted)
    return df.join(wanted, F.col(key) == F.col("__id")).drop("__id")


def by_position(df: DataFrame, position: str, start: int | None = None, stop: int | None = None, step: int = 1) -> DataFrame:
    """Half-open slice by a position column counted from 0; negative ends count from the end."""
    if (start is not None and start < 0) or (stop is not None and stop < 0):
        n = df.agg(F.coalesce(F.max(position) + 1, F.lit(0))).first()[0]
        start = start if start is None or start >= 0 else max(0, n + start)
        stop = stop if stop is None or stop >= 0 else n + stop
    a = start or 0
    cond = (F.col(position) >= a) & ((F.col(position) - a) % step == 0)
    return df.filter(cond & (F.col(position) < stop) if stop is not None else cond)


def by_key_range(df: DataFrame, key: str, position: str, first, last) -> DataFrame:
    """Rows between two keys in order of position, both included, the keys in either order; an unknown key raises KeyError."""
    ends = {r[0]: r[1] for r in df.filter(F.col(key).isin(first, last)).groupBy(key).agg(F.max(position)).collect()}
    for k in (first, last):
        if k not in ends:
            raise KeyError(k)
    lo, hi = sorted((ends[first], ends[last]))
    return df.filter(F.col(position).between(lo, hi))


def chain(*dfs: DataFrame) -> DataFrame:
    """All rows of all tables; columns missing in some become null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), dfs)


def first_per_group(df: DataFrame, groups: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in ascending order of the given expressions (negate numbers for descending), by partial aggregation instead of a window."""
    others = [c for c in df.columns if c not in groups]
    best = df.groupBy(*groups).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("__row"))
    return best.select(*groups, *[F.col(f"__row.{c}").alias(c) for c in others])


def top_k(df: DataFrame, groups: list[str], value: str, k: int, tie: str, descending: bool = True) -> DataFrame:
    """The k largest (smallest) values of each group with rank; ties go to the smaller ``tie``."""
    from pyspark.sql import Window

    w = Window.partitionBy(*groups).orderBy(F.col(value).desc() if descending else F.col(value).asc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
