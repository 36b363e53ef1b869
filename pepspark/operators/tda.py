"""Target-decoy statistics: FDR, q-values and filtering.

Nothing here runs an unpartitioned window: the order is cut into ranges of scores, the sums before
each range are added up over the few ranges, and the windows run inside the ranges.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pepspark.session import materialize

#: Distinct scores of a range, and most ranges that one order is cut into.
RANGE_ROWS = 1_000_000
MAX_RANGES = 4096
#: Fewest ranges of an order that is not cut by groups.
RANGES = 64


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log_factorial(n: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(x + 1) for x in np.atleast_1d(n)])


def _log_pi(d: float, k: np.ndarray, p: float) -> np.ndarray:
    return k * math.log(p) + log_factorial(k + d) - log_factorial(k) - math.lgamma(d + 1) + (d + 1) * math.log(1 - p)


#: Standard deviations around the mean beyond which terms of the negative binomial are nothing in double precision.
_TAIL = 40


def _terms(d: int, t: int, p: float) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of false targets up to t that matter, and their probabilities: a stretch that grows with the root of d only."""
    mean, spread = (d + 1) * p / (1 - p), math.sqrt((d + 1) * p) / (1 - p)
    lo, hi = max(0, int(mean - _TAIL * spread)), min(int(t), int(mean + _TAIL * spread) + 2 * _TAIL)
    m = np.arange(min(lo, hi) if hi > mean else max(0, hi - int(_TAIL * spread) - 2 * _TAIL), hi + 1)
    # one log-gamma for the first term, ratios of neighbours for the others
    steps = np.log(p) + np.log(m[1:] + d) - np.log(m[1:])
    logs = _log_pi(d, m[:1], p)[0] + np.r_[0.0, np.cumsum(steps)]
    return m, np.exp(logs - logs.max())


def expected_false(d: int, t: int, p: float = 0.5) -> float:
    """Expected number of false targets among t, given d decoys (negative binomial, cut at t)."""
    m, pi = _terms(int(d), int(t), p)
    return float((m * pi).sum() / pi.sum())


def confident_false(level: float, d: int, t: int, p: float = 0.5) -> int:
    """Number of false targets that isn't exceeded with probability ``level``; a sum that equals the level but for rounding reaches it."""
    m, pi = _terms(int(d), int(t), p)
    sums = pi.cumsum()
    return int(m[np.searchsorted(sums, level * sums[-1] * (1 - 1e-12))])


def fdr(psms: DataFrame, is_decoy: Column | str | None = None, pep: Column | str | None = None, formula: int = 1, ratio: float = 1.0, correction: float = 0, by: list[str] | None = None) -> DataFrame:
    """One row (per group of ``by``) with n_psms, n_decoys and fdr, in one aggregation.

    Formula 1: D'/(T*ratio); 2: (D + D'/ratio)/N; with ``pep`` the mean error probability. D' is D
    plus 1 (correction 1), the expected number of false targets (2) or their confidence bound
    (between 0 and 1). Null flags count as targets; without targets formula 1 gives null.
    """
    if formula not in (1, 2):
        raise ValueError("formula must be 1 or 2")
    if ratio == 0:
        raise ValueError("ratio can't be zero")
    if pep is not None:
        return psms.groupBy(*(by or [])).agg(F.count("*").alias("n_psms"), F.avg(_col(pep)).alias("fdr"))
    decoy = F.coalesce(_col(is_decoy).cast("boolean"), F.lit(False))
    out = psms.groupBy(*(by or [])).agg(F.count("*").alias("n_psms"), F.sum(decoy.cast("bigint")).alias("n_decoys"))
    d, n = F.col("n_decoys"), F.col("n_psms")
    p = 1 / (1 + ratio)
    if correction == 0:
        false = d
    elif correction == 1:
        false = d + 1
    else:
        one = F.pandas_udf(lambda d, t: pd.Series([expected_false(a, b, p) if correction == 2 else float(confident_false(correction, a, b, p)) for a, b in zip(d, t)]), "double")
        false = one(d, n - d)
        if correction == 2:
            false = F.when((d > 0) & (n / d > 10), (d + 1).cast("double")).otherwise(false)
    value = F.when(n > d, false / (n - d) / ratio) if formula == 1 else F.when(n > 0, (d + false / ratio) / n)
    return out.withColumn("fdr", value)


def sigma_t(psms: DataFrame, is_decoy: Column | str, ratio: float = 1.0) -> DataFrame:
    """Standard error of the number of false positives: sqrt((D + 1) * (ratio + 1) / ratio^2)."""
    d = F.sum(F.coalesce(_col(is_decoy).cast("boolean"), F.lit(False)).cast("bigint"))
    return psms.agg(F.sqrt((d + 1) * (ratio + 1) / (ratio * ratio)).alias("sigma_t"))


def sigma_fdr(psms: DataFrame, is_decoy: Column | str, formula: int = 1, ratio: float = 1.0) -> DataFrame:
    """Standard error of the FDR estimate."""
    d = F.sum(F.coalesce(_col(is_decoy).cast("boolean"), F.lit(False)).cast("bigint"))
    n = F.count("*")
    sigma = F.sqrt((d + 1) * (ratio + 1) / (ratio * ratio))
    return psms.agg((sigma / (n - d) / ratio if formula == 1 else sigma / n / ratio).alias("sigma_fdr"))


def ordered_ranges(df: DataFrame, key: str, groups: list[str], ranges: int = RANGES) -> DataFrame:
    """``df`` with the column __range: consecutive ranges of ``key``, equal keys never parted.

    The bounds come from an approximate quantile summary over all rows, so they follow the data.
    """
    bounds = df.select(key).filter(F.col(key).isNotNull()).approxQuantile(key, [i / ranges for i in range(1, ranges)], 0.2 / ranges) if ranges > 1 else []
    bounds = sorted(set(bounds))
    if not bounds:
        return df.withColumn("__range", F.lit(0))
    cuts = F.array(*[F.lit(float(b)) for b in bounds])
    return df.withColumn("__range", F.size(F.filter(cuts, lambda b: F.col(key) > b)))


def qvalues(
    psms: DataFrame,
    score: Column | str,
    is_decoy: Column | str | None = None,
    pep: Column | str | None = None,
    reverse: bool = False,
    remove_decoy: bool = False,
    formula: int | None = None,
    ratio: float = 1.0,
    correction: float = 0,
    by: list[str] | None = None,
    ranges: int | None = None,
) -> DataFrame:
    """``psms`` with the columns score, is_decoy (or pep) and q.

    The best score comes first (lowest, or highest with ``reverse``), targets before decoys on ties.
    Equal scores share the worst q of the tie and q never falls. The formula is 1 if decoys are
    removed, else 2. With ``by`` each group (source, file) has its own order. Rows without score
    are left out; null flags count as targets. An empty table gives an empty result.
    """
    formula = formula or (1 if remove_decoy else 2)
    if formula not in (1, 2):
        raise ValueError("formula must be 1 or 2")
    if ratio == 0:
        raise ValueError("ratio can't be zero")
    by = by or []
    flag = "pep" if pep is not None else "is_decoy"
    mark = _col(pep).cast("double") if pep is not None else F.coalesce(_col(is_decoy).cast("boolean"), F.lit(False))
    rows = psms.withColumn("__score", _col(score).cast("double")).withColumn("__mark", mark).filter(F.col("__score").isNotNull())
    sign = -1.0 if reverse else 1.0
    rows = rows.withColumn("__key", F.col("__score") * sign)
    # reduce to one row per score first: all that q depends on, however many rows share a score
    # (written once, as the ranges, both windows and their offsets all read it)
    n = materialize(rows.groupBy(*by, "__key").agg(F.count("*").alias("__n"), F.sum(F.col("__mark").cast("double")).alias("__d")), "scores")
    if ranges is None:  # by the number of distinct scores; groups share the bounds, so the largest ones are cut finely too
        ranges = min(MAX_RANGES, max(RANGES, -(-n.count() // RANGE_ROWS)))
    n = ordered_ranges(n, "__key", by, ranges)
    w = Window.partitionBy(*by, "__range").orderBy("__key")
    totals = n.groupBy(*by, "__range").agg(F.sum("__n").alias("__tn"), F.sum("__d").alias("__td"))
    before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1) if by else Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*[F.col(b).alias(f"__by_{b}") for b in by], F.col("__range").alias("__r"), F.coalesce(F.sum("__tn").over(before), F.lit(0)).alias("__on"), F.coalesce(F.sum("__td").over(before), F.lit(0.0)).alias("__od"))
    same = F.col("__range") == F.col("__r")
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"__by_{b}"))
    n = n.withColumn("__cn", F.sum("__n").over(w)).withColumn("__cd", F.sum("__d").over(w)).join(offsets if by else F.broadcast(offsets), same)
    i, d = (F.col("__cn") + F.col("__on")).cast("double"), F.col("__cd") + F.col("__od")
    p = 1 / (1 + ratio)
    if pep is not None:
        raw = F.round(d / i, 12)  # so that the order in which errors are added doesn't matter at a threshold
    else:
        if correction == 0:
            false = d
        elif correction == 1:
            false = d + 1
        elif correction == 2 or 0 < correction < 1:
            def corrected(frames: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
                for dd, tt in frames:
                    pairs = pd.DataFrame({"d": dd, "t": tt})
                    one = {k: (expected_false(*k, p) if correction == 2 else float(confident_false(correction, *k, p))) for k in set(map(tuple, pairs.to_numpy().astype(int)))}
                    yield pd.Series([one[(int(a), int(b))] for a, b in zip(dd, tt)])

            from pyspark.sql.types import DoubleType

            false = F.pandas_udf(_series_iterator(corrected), DoubleType())(d, i - d)
        else:
            raise ValueError(f"invalid correction {correction!r}")
        raw = F.when(i > d, false / (i - d) / ratio).otherwise(float("inf")) if formula == 1 else (d + false / ratio) / i
    n = n.withColumn("__raw", raw)
    # running minimum from the worst end: inside the range, then over the ranges after it
    tail = Window.partitionBy(*by, "__range").orderBy(F.col("__key").desc())
    least = n.groupBy(*by, "__range").agg(F.min("__raw").alias("__least"))
    after = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    later = least.select(*[F.col(b).alias(f"__by2_{b}") for b in by], F.col("__range").alias("__r2"), F.min("__least").over(after).alias("__after"))
    same2 = F.col("__range") == F.col("__r2")
    for b in by:
        same2 = same2 & F.col(b).eqNullSafe(F.col(f"__by2_{b}"))
    q = n.withColumn("__in", F.min("__raw").over(tail)).join(later if by else F.broadcast(later), same2)
    q = q.select(*[F.col(b).alias(f"__q_{b}") for b in by], F.col("__key").alias("__qkey"), F.least("__in", F.coalesce("__after", F.col("__in"))).alias("__q"))
    cond = F.col("__key") == F.col("__qkey")
    for b in by:
        cond = cond & F.col(b).eqNullSafe(F.col(f"__q_{b}"))
    out = rows.join(q, cond)
    if remove_decoy and pep is None:
        out = out.filter(~F.col("__mark"))
    names = [c for c in psms.columns if c not in ("score", flag, "q")]
    return out.select(*names, F.col("__score").alias("score"), F.col("__mark").alias(flag), F.col("__q").alias("q"))


def _series_iterator(f):
    import typing

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        return f(it)

    run.__annotations__ = {"it": typing.Iterator[tuple[pd.Series, pd.Series]], "return": typing.Iterator[pd.Series]}
    return run


def filter_psms(psms: DataFrame, fdr: float, score: Column | str, is_decoy: Column | str | None = None, pep: Column | str | None = None, remove_decoy: bool = True, **kwargs) -> DataFrame:
    """The PSMs with q <= ``fdr``; decoys are dropped unless ``remove_decoy`` is False. ``by`` filters each file by itself and puts the results together."""
    return qvalues(psms, score, is_decoy, pep, remove_decoy=remove_decoy and pep is None, **kwargs).filter(F.col("q") <= fdr)


#: Default score column, order and decoy rule of the formats' flat tables.
FORMATS = {
    "mzid": {"score": "mascot_expectation_value", "reverse": False},
    "pepxml": {"score": "expect", "reverse": False},
    "protxml": {"score": "probability", "reverse": True},
    "tandem": {"score": "expect", "reverse": False},
    "idxml": {"score": "score", "reverse": False},
}


def filter_format(psms: DataFrame, fmt: str, fdr: float, protein: str = "protein", prefix: str = "DECOY_", suffix: str | None = None, **kwargs) -> DataFrame:
    """Filter a flat table with its format's default score; a PSM is a decoy if all its proteins are."""
    preset = FORMATS[fmt]
    return filter_psms(psms, fdr, kwargs.pop("score", preset["score"]), all_decoy(protein, prefix, suffix), reverse=kwargs.pop("reverse", preset["reverse"]), **kwargs)


def all_decoy(proteins: Column | str, prefix: str = "DECOY_", suffix: str | None = None) -> Column:
    """Do all proteins of an array carry the decoy mark? True for an empty array, null for null."""
    return F.forall(_col(proteins), lambda p: F.endswith(p, F.lit(suffix)) if suffix else F.startswith(p, F.lit(prefix)))


def qvalue_curve(q: DataFrame, ranges: int = RANGES) -> DataFrame:
    """(q, number of PSMs up to it): the curve of a q-value table, one row per q, summed range by range."""
    counts = ordered_ranges(q.groupBy("q").agg(F.count("*").alias("n")), "q", [], ranges)
    before = Window.partitionBy(F.lit(0)).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # at most ``ranges`` rows
    offsets = counts.groupBy("__range").agg(F.sum("n").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    inside = counts.withColumn("__in", F.sum("n").over(Window.partitionBy("__range").orderBy("q")))
    return inside.join(F.broadcast(offsets), "__range").select("q", (F.col("__in") + F.col("__offset")).alias("n_accepted"))
