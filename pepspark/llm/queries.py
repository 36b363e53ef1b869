"""Queries p2 and p6 to p8. SQL can't express the last three; the tests hold them against brute force."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pepspark.llm import leak, percentiles, residue, tokens


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Per source and day, and per source from the days' counts put together; one scan of the spectra."""
    spectra = _table(spark, d, "spectra").withColumn("day", F.date_format("acquired_at", "yyyy-MM-dd"))
    counts = percentiles.value_counts(spectra, ["source", "day"], {"intensity": "intensity", "mz": "mz"})
    levels = percentiles.counts_by_level(counts, {"source_day": ["source", "day"], "source": ["source"]})
    return percentiles.percentiles_of_counts(levels, ["level", "source", "day"]).withColumn("value", F.round("value", 3))


_LG = percentiles.log_gamma(percentiles.DEFAULT_ERROR)
# the exact value at each rank, found by sorting all values; only then rounded to the value of its bin
_P2 = f"""with v as (
 select source, strftime(acquired_at, '%Y-%m-%d') as day, 'intensity' as field, unnest(intensity) as x from spectra
 union all select source, strftime(acquired_at, '%Y-%m-%d'), 'mz', unnest(mz) from spectra),
l as (select 'source_day' as level, source, day, field, x from v where x is not null and not isnan(x) union all select 'source', source, null, field, x from v where x is not null and not isnan(x)),
r as (select level, source, day, field, x, row_number() over (partition by level, source, day, field order by x) as place, count(*) over (partition by level, source, day, field) as total from l),
t as (select unnest([1.0, 5.0, 25.0, 50.0, 75.0, 95.0, 99.0])::double as percent),
k as (select *, case when x = 0 then 0 when isinf(x) then case when x > 0 then 2000000 else -2000000 end
  when x > 0 then (ceil(ln(x) / {_LG!r}) + 1000000)::int else -(ceil(ln(-x) / {_LG!r}) + 1000000)::int end as bin from r, t where place = greatest(1, ceil(total * (percent / 100))))
select level, source, day, field, percent, total::bigint as n_values, bin, round(case when bin = 0 then 0.0::double when bin = 2000000 then 'inf'::double when bin = -2000000 then '-inf'::double
 else sign(bin) * exp((abs(bin) - 1000000) * {_LG!r}) * (2 / (1 + exp({_LG!r}))) end, 3) as value from k"""


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode_documents(_table(spark, d, "documents"), "doc_id", "text", tokens.vocabulary_path("byte_bpe_50k.tiktoken"), length_col="n_chars")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leak.leaked_items(_table(spark, d, "documents"), _table(spark, d, "eval_items"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue_documents(_table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    """With the kinds of residue found in each document."""
    return residue.residue_documents(_table(spark, d, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p2_percentiles, p6_ids, p7_found, p8_found, p8_kinds)}


def oracle_sql() -> dict[str, str]:
    return {"p2_percentiles": _P2}
