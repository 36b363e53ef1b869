"""Percentiles of very large numeric columns, mergeable, with bounded relative error.

Three steps, all in SQL terms: (1) reduce to group-value counts, where a value stands for its
logarithmic bin of relative half-width ``error``; (2) sort the bins into ranges (stripes), sum each
range and add up the ranges before it; (3) in the ranges that hold a target rank, run a cumulative
sum from that offset and pick the first value that reaches the rank. Counts of separate days or
partitions are put together by adding them (:func:`merge_counts`).
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins of positive values are shifted by this, so that sign and size order in one integer.
BIN_SHIFT = 1_000_000
#: Bins of the two infinities.
INF_BIN = 2_000_000
DEFAULT_ERROR = 0.005
DEFAULT_PERCENTS = (1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0)
#: Bins of one range.
STRIPE = 64


def log_gamma(error: float) -> float:
    """Width of a bin on the logarithmic scale."""
    if not 0 < error < 1:
        raise ValueError("error must be between 0 and 1")
    return math.log((1 + error) / (1 - error))


def value_bin(value: Column, error: float = DEFAULT_ERROR) -> Column:
    """Ordered integer bin of a double; null for null and NaN. Zero has a bin of its own."""
    size = (F.ceil(F.log(F.abs(value)) / F.lit(log_gamma(error))) + BIN_SHIFT).cast("int")
    return (
        F.when(value.isNull() | F.isnan(value), None)
        .when(value == 0, 0)
        .when(value == float("inf"), INF_BIN)
        .when(value == float("-inf"), -INF_BIN)
        .when(value > 0, size)
        .otherwise(-size)
    )


def bin_value(bin_: Column, error: float = DEFAULT_ERROR) -> Column:
    """The value that stands for a bin: within ``error`` (relative) of every value in it."""
    lg = log_gamma(error)
    size = F.exp((F.abs(bin_) - BIN_SHIFT) * F.lit(lg)) * F.lit(2 / (1 + math.exp(lg)))
    return (
        F.when(bin_ == 0, 0.0)
        .when(bin_ == INF_BIN, float("inf"))
        .when(bin_ == -INF_BIN, float("-inf"))
        .otherwise(F.signum(bin_.cast("double")) * size)
    )


def value_counts(df: DataFrame, groups: list[str], values: dict[str, str], error: float = DEFAULT_ERROR) -> DataFrame:
    """Group-value counts of array or scalar columns: groups, field, bin, n, in one scan and one aggregation.

    ``values`` maps the field's name in the result to the column. Nulls and NaNs aren't values and
    are left out, infinities count as the largest and smallest ones; null and empty arrays add
    nothing; arrays of one row may differ in length; repeated rows count as often as they occur; a null group is a group.
    """
    kinds = {f: df.select(F.col(c).alias("x")).schema[0].dataType.typeName() for f, c in values.items()}
    lists = [F.coalesce(F.col(c) if kinds[f] == "array" else F.array(c), F.array().cast(df.select(F.col(c) if kinds[f] == "array" else F.array(c)).schema[0].dataType)).alias(f"v{i}") for i, (f, c) in enumerate(values.items())]
    src = df.select(*[F.col(g).alias(f"g{i}") for i, g in enumerate(groups)], F.arrays_zip(*lists).alias("z"))
    rows = src.select(*[f"g{i}" for i in range(len(groups))], F.explode("z").alias("z"))
    cells = F.array(*[F.struct(F.lit(f).alias("field"), value_bin(F.col("z")[f"v{i}"].cast("double"), error).alias("bin")) for i, f in enumerate(values)])
    rows = rows.select(*[F.col(f"g{i}").alias(g) for i, g in enumerate(groups)], F.explode(cells).alias("c")).select(*groups, "c.field", "c.bin")
    return rows.filter("bin is not null").groupBy(*groups, "field", "bin").agg(F.count("*").alias("n"))


def merge_counts(counts: DataFrame, groups: list[str]) -> DataFrame:
    """Counts of fewer groups: days, partitions or shards put together by adding."""
    return counts.groupBy(*groups, "field", "bin").agg(F.sum("n").alias("n"))


def counts_by_level(counts: DataFrame, levels: dict[str, list[str]]) -> DataFrame:
    """Counts of several groupings at once: the column level, the groups of all levels (null where a level lacks one), field, bin, n."""
    names = list(dict.fromkeys(g for groups in levels.values() for g in groups))
    types = {f.name: f.dataType for f in counts.schema}
    keys = F.array(*[F.struct(F.lit(k).alias("level"), *[(F.col(g) if g in groups else F.lit(None).cast(types[g])).alias(g) for g in names]) for k, groups in levels.items()])
    spread = counts.select(F.explode(keys).alias("k"), "field", "bin", "n").select("k.*", "field", "bin", "n")
    return merge_counts(spread, ["level", *names])


def percentiles_of_counts(
    counts: DataFrame,
    groups: list[str],
    percents: tuple[float, ...] = DEFAULT_PERCENTS,
    error: float = DEFAULT_ERROR,
    stripe: int = STRIPE,
) -> DataFrame:
    """Percentiles from group-value counts: groups, field, percent, n_values, bin, value.

    The result is the smallest value whose cumulative count reaches ceil(percent/100 * n), at least 1.
    No group is gathered in one task: bins are gathered by ``stripe`` of them, and the window that adds up
    offsets holds one row for each stripe of a group (fewer than 5,000 for all doubles at the default error). Groups
    without values have no rows.
    """
    keys = [*groups, "field"]
    cut = counts.withColumn("__stripe", F.floor(F.col("bin") / stripe).cast("int"))
    stripes = cut.groupBy(*keys, "__stripe").agg(F.sum("n").alias("__in"), F.collect_list(F.struct("bin", "n")).alias("__bins"))
    group = Window.partitionBy(*keys)
    before = F.sum("__in").over(group.orderBy("__stripe").rowsBetween(Window.unboundedPreceding, -1))
    placed = stripes.withColumn("__before", F.coalesce(before, F.lit(0))).withColumn("n_values", F.sum("__in").over(group))
    ranks = F.array(*[F.struct(F.lit(float(p)).alias("percent"), F.greatest(F.lit(1), F.ceil(F.col("n_values") * F.lit(p / 100))).alias("rank")) for p in percents])
    held = F.filter(ranks, lambda r: (r["rank"] > F.col("__before")) & (r["rank"] <= F.col("__before") + F.col("__in")))
    targets = placed.select(*keys, "n_values", "__stripe", "__before", "__bins", F.explode(held).alias("__t"))
    bins = targets.select(*keys, "n_values", "__before", "__t.percent", "__t.rank", F.explode("__bins").alias("__b")).select(*keys, "n_values", "__before", "percent", "rank", "__b.*")
    run = Window.partitionBy(*keys, "percent").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    upto = bins.withColumn("__upto", F.col("__before") + F.sum("n").over(run))
    hit = upto.filter((F.col("__upto") >= F.col("rank")) & (F.col("__upto") - F.col("n") < F.col("rank")))
    return hit.select(*keys, "percent", "n_values", "bin", bin_value(F.col("bin"), error).alias("value"))


def value_counts_per_batch(groups: list[str], values: dict[str, str], sink: Callable[[DataFrame, int], None], error: float = DEFAULT_ERROR) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that hands on mergeable value counts of a stream; percentiles come from the merged counts."""

    def run(batch: DataFrame, number: int) -> None:
        sink(value_counts(batch, groups, values, error), number)

    return run
