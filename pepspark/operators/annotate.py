"""Spectra seen peak by peak: annotation with fragments, precursors, mirrored pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pepspark.functions import mass as M
from pepspark.operators import joins


def peaks(spectra: DataFrame, keys: list[str], mz: str = "mz", intensity: str = "intensity") -> DataFrame:
    """One row per peak: keys, peak (from 0), mz, intensity; a missing intensity is null."""
    return spectra.select(*keys, F.posexplode(F.arrays_zip(F.col(mz).alias("mz"), F.col(intensity).alias("intensity"))).alias("peak", "p")).select(*keys, "peak", "p.mz", "p.intensity")


def annotate(spectra: DataFrame, peptides: DataFrame, key: str, peptide: str = "peptide", ions: tuple[str, ...] = ("b", "y"), max_charge: int = 1, atol: float | None = None, rtol: float | None = None) -> DataFrame:
    """Peaks of each spectrum that a fragment of its peptide explains: key, name, calc_mz, mz, intensity.

    ``atol`` is absolute, ``rtol`` (1e-5 if neither is given) relative to the observed m/z, both
    strict. Every (fragment, peak) pair within the tolerance comes; repeated rows of a key multiply.
    """
    if atol is None and rtol is None:
        rtol = 1e-5
    calc = peptides.select(key, F.explode(M.fragment_series(peptide, ions, max_charge)).alias("f")).select(key, "f.name", F.col("f.mz").alias("calc_mz"))
    observed = peaks(spectra, [key]).drop("peak")
    return joins.tolerance_join(calc, observed, "calc_mz", "mz", rtol=rtol, atol=atol, on=[key]).select(key, "name", "calc_mz", "mz", "intensity")


def precursor_mz(*candidates: Column) -> Column:
    """The first m/z that is there: explicit, of the spectrum's parameters, of the selected ion."""
    return F.coalesce(*candidates)


def mirror(top: DataFrame, bottom: DataFrame, keys: list[str]) -> DataFrame:
    """Peaks of two spectra in one table, the lower one's intensities negative and both scaled to their own maximum."""
    def scaled(df: DataFrame, sign: int) -> DataFrame:
        high = F.array_max(F.filter("intensity", lambda x: ~F.isnan(x) & (x < float("inf"))))
        part = df.select(*keys, "mz", F.transform("intensity", lambda x: F.when(high > 0, x / high * sign)).alias("intensity"))
        return peaks(part, keys).withColumn("side", F.lit("top" if sign > 0 else "bottom"))

    return scaled(top, 1).unionByName(scaled(bottom, -1))


def trend_line(regression: DataFrame, x: Column, sigmas: tuple[float, ...] = (1.0, 2.0, 3.0)) -> DataFrame:
    """y of the line and of its bands of so many standard errors, for a regression row and a column of x."""
    y = F.col("a") * x + F.col("b")
    return regression.select(x.alias("x"), y.alias("y"), *[(y + s * F.col("stderr")).alias(f"upper_{s:g}") for s in sigmas], *[(y - s * F.col("stderr")).alias(f"lower_{s:g}") for s in sigmas])
