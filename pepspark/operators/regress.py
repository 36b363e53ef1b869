"""Linear regressions and retention coefficients from sums that Spark aggregates."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pepspark.functions import seq as S

#: Tasks on which the sums of all tasks are added before the driver adds theirs.
GRAM_SLOTS = 8


def _sums(df: DataFrame, x: str, y: str, by: list[str]) -> DataFrame:
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.filter(a.isNotNull() & b.isNotNull())
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg(a).alias("mx"), F.avg(b).alias("my"), F.var_pop(a).alias("sxx"), F.var_pop(b).alias("syy"), F.covar_pop(a, b).alias("sxy"))


def linear_regression(df: DataFrame, x: str, y: str, by: list[str] | None = None, a: float | None = None, b: float | None = None) -> DataFrame:
    """Least squares in y: a (slope), b, r, stderr (population) per group, in one aggregation.

    ``a`` fixes the slope, ``a`` and ``b`` both. Rows with a null are left out; a constant x has a null slope.
    """
    s = _sums(df, x, y, by or [])
    slope = F.lit(float(a)) if a is not None else F.when(F.col("sxx") != 0, F.col("sxy") / F.col("sxx"))
    s = s.withColumn("a", slope)
    s = s.withColumn("b", F.lit(float(b)) if a is not None and b is not None else F.col("my") - F.col("a") * F.col("mx"))
    r = F.when((F.col("sxx") > 0) & (F.col("syy") > 0), F.col("sxy") / F.sqrt(F.col("sxx") * F.col("syy")))
    var = F.col("syy") - 2 * F.col("a") * F.col("sxy") + F.col("a") * F.col("a") * F.col("sxx")
    return s.select(*(by or []), "a", "b", r.alias("r"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("stderr"))


def linear_regression_perpendicular(df: DataFrame, x: str, y: str, by: list[str] | None = None) -> DataFrame:
    """Total least squares: a, b, r, stderr of the perpendicular distances, in closed form."""
    s = _sums(df, x, y, by or [])
    xx, yy, xy = F.col("sxx"), F.col("syy"), F.col("sxy")
    s = s.withColumn("a", F.when(xy != 0, (yy - xx + F.sqrt((yy - xx) * (yy - xx) + 4 * xy * xy)) / (2 * xy)))
    s = s.withColumn("b", F.col("my") - F.col("a") * F.col("mx"))
    var = (yy - 2 * F.col("a") * xy + F.col("a") * F.col("a") * xx) / (F.col("a") * F.col("a") + 1)
    r = F.when((xx > 0) & (yy > 0), xy / F.sqrt(xx * yy))
    return s.select(*(by or []), "a", "b", r.alias("r"), F.sqrt(F.greatest(var, F.lit(0.0))).alias("stderr"))


def _labels(residues: str, term_aa: bool) -> list[str]:
    return [*residues, *(f"nterm{a}" for a in residues), *(f"cterm{a}" for a in residues)] if term_aa else list(residues)


def _features(seq: str, labels: list[str], term_aa: bool) -> list[Column]:
    """Counts of each label in a plain sequence; with ``term_aa`` the outer residues count by themselves."""
    s = F.col(seq)
    first, last = F.substring(s, 1, 1), F.substring(s, -1, 1)
    inner = F.substring(s, F.lit(2), F.greatest(F.length(s) - 2, F.lit(0))) if term_aa else s
    out = []
    for a in labels:
        if a.startswith("nterm"):
            out.append((first == a[-1]).cast("double"))
        elif a.startswith("cterm"):
            out.append(((last == a[-1]) & (F.length(s) > 1)).cast("double"))
        else:
            out.append((F.length(inner) - F.length(F.replace(inner, F.lit(a), F.lit("")))).cast("double"))
    return out


def _gram(df: DataFrame, seq: str, rt: str, labels: list[str], term_aa: bool = False, fitted: tuple[np.ndarray, float] | None = None) -> np.ndarray:
    """Sums of products of (counts, counts * ln length, 1) with each other and with RT: all that any lcp needs.

    Each task adds up its own (2 * labels + 2)^2 numbers; those are added on GRAM_SLOTS tasks and
    then here. ``fitted`` (coefficients, lcp) weights each row by its inverse absolute residual.
    """
    n, k = len(labels), 2 * len(labels) + 2
    rows = df.filter(F.length(seq) > 0).filter(F.col(rt).isNotNull()).select(F.length(seq).cast("double").alias("n"), F.col(rt).cast("double").alias("rt"), *[f.alias(f"c{i}") for i, f in enumerate(_features(seq, labels, term_aa))])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros((k, k))
        for batch in batches:
            counts = np.column_stack([batch.column(i + 2).to_numpy() for i in range(n)])
            ln, y = np.log(batch.column(0).to_numpy()), batch.column(1).to_numpy()
            x = np.column_stack([counts, counts * ln[:, None], np.ones(len(counts)), y])
            if fitted is not None:
                coef, lcp = fitted
                residual = np.abs(counts @ coef[:n] * (1 + lcp * ln) + coef[n] - y)
                x = x / np.sqrt(np.maximum(residual, 1e-6))[:, None]
            g += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(k * k)
        for batch in batches:
            for b in batch.column(0).to_pylist():
                g += np.frombuffer(b)
        yield pa.RecordBatch.from_arrays([pa.array([g.tobytes()], pa.binary())], ["g"])

    parts = rows.mapInArrow(products, "g binary").repartition(GRAM_SLOTS).mapInArrow(add, "g binary").collect()
    g = np.sum([np.frombuffer(r[0]) for r in parts] or [np.zeros(k * k)], axis=0).reshape(k, k)
    if not g[2 * n, 2 * n]:
        raise ValueError("no rows to fit")
    return g


def _solve(g: np.ndarray, n: int, lcp: float) -> tuple[np.ndarray, float]:
    """Coefficients (labels, const) and the correlation of predicted and observed RT for a length correction."""
    k = 2 * n + 2
    m = np.zeros((n + 1, k))
    m[:n, :n] = np.eye(n)
    m[:n, n : 2 * n] = np.eye(n) * lcp
    m[n, 2 * n] = 1
    ata, aty = m @ g @ m.T, m @ g[:, k - 1]
    coef = np.linalg.lstsq(ata, aty, rcond=None)[0]
    w = coef @ m
    ones, rt = g[2 * n], g[k - 1]
    count = ones[2 * n]
    mean_p, mean_y = (w @ ones) / count, rt[2 * n] / count
    cov = (w @ rt) / count - mean_p * mean_y
    var = (w @ g @ w) / count - mean_p**2
    var_y = rt[k - 1] / count - mean_y**2
    return coef, cov / math.sqrt(var * var_y) if var > 0 and var_y > 0 else 0.0


def _as_set(coef: np.ndarray, g: np.ndarray, labels: list[str], lcp: float) -> dict:
    """The coefficient set; terminal residues that don't occur get the value of a line through the other terminal and inner ones."""
    n = len(labels)
    aa = dict(zip(labels, map(float, coef[:n])))
    seen = {a for i, a in enumerate(labels) if g[i, 2 * n] > 0}
    for end in ("nterm", "cterm"):
        known = [a for a in labels if a.startswith(end) and a in seen and a[-1] in seen]
        if len(known) > 1:
            slope, base = np.polyfit([aa[a[-1]] for a in known], [aa[a] for a in known], 1)
            aa |= {a: float(slope * aa[a[-1]] + base) for a in labels if a.startswith(end) and a not in seen}
    return {"aa": aa, "lcp": float(lcp), "const": float(coef[n])}


def fit_retention(df: DataFrame, seq: str, rt: str, lcp: float = -0.21, labels: str = S.AMINO_ACIDS, term_aa: bool = False, metric: str = "mse", steps: int = 15) -> dict:
    """Retention coefficients {'aa', 'lcp', 'const'} over plain sequences, from sums of bounded size.

    'mse' is one aggregation; 'mae' repeats it ``steps`` times with rows weighted by their inverse
    residual. Residues that don't occur get the minimum-norm coefficient 0 (terminal ones a value
    from a line through the others). An empty table raises ValueError.
    """
    if metric not in ("mse", "mae"):
        raise ValueError("metric must be mse or mae")
    names = _labels(labels, term_aa)
    g = _gram(df, seq, rt, names, term_aa)
    coef, _ = _solve(g, len(names), lcp)
    if metric == "mae":
        for _ in range(steps):
            coef, _ = _solve(_gram(df, seq, rt, names, term_aa, (coef, lcp)), len(names), lcp)
    return _as_set(coef, g, names, lcp)


def fit_retention_vary_lcp(df: DataFrame, seq: str, rt: str, lcp_range: tuple[float, float] = (-1.0, 1.0), accuracy: float = 0.1, labels: str = S.AMINO_ACIDS, term_aa: bool = False) -> dict:
    """As :func:`fit_retention`, with the length correction of the best correlation (a grid of 10 steps, refined to ``accuracy``).

    The data are read once: every grid point is solved from the same sums.
    """
    names = _labels(labels, term_aa)
    g = _gram(df, seq, rt, names, term_aa)
    lo, hi = lcp_range
    step = (hi - lo) / 10
    while True:
        best = max((lo + step * i for i in range(11)), key=lambda x: _solve(g, len(names), x)[1])
        if step <= accuracy:
            break
        lo, hi = best - step, best + step
        step = (hi - lo) / 10
    return _as_set(_solve(g, len(names), best)[0], g, names, best)


def histogram(df: DataFrame, value: Column | str, low: float, high: float, bins: int) -> DataFrame:
    """bin (1 .. bins; 0 and bins + 1 beyond the ends) and count."""
    v = F.col(value) if isinstance(value, str) else value
    return df.select(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).groupBy("bin").agg(F.count("*").alias("n"))
