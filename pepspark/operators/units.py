"""Quantities recorded in different units -> one common unit per quantity, in pure SQL terms.

The number and a unit text are taken out by regular expressions, unit spellings are normalised by
a join with a small alias table, the unit is the first of unit field, text and (if asked for) the
source's default, and value = number * factor + offset.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit, dimension, factor and offset to the dimension's base unit (base = (number + offset) * num / den), spellings.
UNITS: list[tuple[str, str, float, float, float, tuple[str, ...]]] = [
    ("second", "time", 0, 1, 1, ("uo:0000010", "s", "sec", "secs", "second", "seconds")),
    ("millisecond", "time", 0, 1, 1e3, ("uo:0000028", "ms", "msec", "msecs", "millisecond", "milliseconds")),
    ("microsecond", "time", 0, 1, 1e6, ("uo:0000029", "us", "µs", "usec", "µsec", "microsecond", "microseconds")),
    ("nanosecond", "time", 0, 1, 1e9, ("uo:0000150", "ns", "nsec", "nanosecond", "nanoseconds")),
    ("minute", "time", 0, 60, 1, ("uo:0000031", "m", "min", "mins", "minute", "minutes")),
    ("hour", "time", 0, 3600, 1, ("uo:0000032", "h", "hr", "hrs", "hour", "hours")),
    ("day", "time", 0, 86400, 1, ("uo:0000033", "d", "day", "days")),
    ("electronvolt", "energy", 0, 1, 1, ("uo:0000266", "ev", "electronvolt", "electronvolts", "electron volt", "electron volts", "electron-volt")),
    ("kiloelectronvolt", "energy", 0, 1e3, 1, ("kev", "kiloelectronvolt", "kiloelectronvolts", "kiloelectron volt", "kiloelectron volts")),
    ("megaelectronvolt", "energy", 0, 1e6, 1, ("MeV", "megaelectronvolt", "megaelectronvolts")),
    ("millielectronvolt", "energy", 0, 1, 1e3, ("meV", "millielectronvolt", "millielectronvolts")),
    ("volt", "potential", 0, 1, 1, ("uo:0000218", "v", "volt", "volts")),
    ("millivolt", "potential", 0, 1, 1e3, ("uo:0000247", "mV", "mv", "millivolt", "millivolts")),
    ("microvolt", "potential", 0, 1, 1e6, ("uo:0000249", "uv", "µv", "microvolt", "microvolts")),
    ("kilovolt", "potential", 0, 1e3, 1, ("uo:0000248", "kv", "kilovolt", "kilovolts")),
    ("megavolt", "potential", 0, 1e6, 1, ("MV", "megavolt", "megavolts")),
    ("kelvin", "temperature", 0, 1, 1, ("uo:0000012", "k", "kelvin", "kelvins", "deg k", "degk", "°k")),
    ("degree Celsius", "temperature", 273.15, 1, 1, ("uo:0000027", "c", "°c", "℃", "degc", "deg c", "degree c", "degrees c", "celsius", "degree celsius", "degrees celsius", "centigrade")),
    ("degree Fahrenheit", "temperature", 459.67, 5, 9, ("uo:0000195", "f", "°f", "℉", "degf", "deg f", "degree f", "degrees f", "fahrenheit", "degree fahrenheit", "degrees fahrenheit")),
    ("pascal", "pressure", 0, 1, 1, ("uo:0000110", "pa", "pascal", "pascals")),
    ("hectopascal", "pressure", 0, 100, 1, ("hpa", "hectopascal", "hectopascals")),
    ("kilopascal", "pressure", 0, 1e3, 1, ("kpa", "kilopascal", "kilopascals")),
    ("megapascal", "pressure", 0, 1e6, 1, ("MPa", "megapascal", "megapascals")),
    ("millipascal", "pressure", 0, 1, 1e3, ("mPa", "millipascal", "millipascals")),
    ("bar", "pressure", 0, 1e5, 1, ("bar", "bars")),
    ("millibar", "pressure", 0, 100, 1, ("mbar", "mbars", "millibar", "millibars")),
    ("microbar", "pressure", 0, 1, 10, ("ubar", "µbar", "microbar", "microbars")),
    ("torr", "pressure", 0, 101325, 760, ("torr", "mmhg", "mm hg")),
    ("millitorr", "pressure", 0, 101325, 760e3, ("mtorr", "millitorr", "millitorrs")),
    ("atmosphere", "pressure", 0, 101325, 1, ("atm", "atmosphere", "atmospheres")),
    ("dalton", "mass", 0, 1, 1, ("uo:0000221", "da", "dalton", "daltons", "u", "amu")),
    ("kilodalton", "mass", 0, 1e3, 1, ("uo:0000222", "kda", "kilodalton", "kilodaltons")),
    ("megadalton", "mass", 0, 1e6, 1, ("megadalton", "megadaltons")),
    ("percent", "ratio", 0, 1, 100, ("uo:0000187", "%", "percent", "pct")),
    ("parts per million", "ratio", 0, 1, 1e6, ("uo:0000169", "ppm", "parts per million")),
]
#: Spellings that differ from another unit's only by case; they are looked up as written.
_CASED = ("MeV", "meV", "mV", "MV", "MPa", "mPa")

# Accession, quantity, common unit.
QUANTITIES: list[tuple[str, str, str]] = [
    ("MS:1000016", "scan start time", "second"),
    ("MS:1000927", "ion injection time", "millisecond"),
    ("MS:1000045", "collision energy", "electronvolt"),
    ("MS:1000875", "declustering potential", "volt"),
    ("MS:1002040", "inlet temperature", "kelvin"),
    ("MS:1000869", "collision gas pressure", "pascal"),
    ("MS:1000224", "molecular mass", "dalton"),
]

NUMBER = r"[-+]?(?:[0-9]+(?:[.,][0-9]*)?|[.,][0-9]+)(?:[eE][-+]?[0-9]+)?"
DURATION = r"^[^0-9A-Za-z]*[Pp][Tt](?:([0-9.,]+)[Hh])?(?:([0-9.,]+)[Mm])?(?:([0-9.,]+)[Ss])?\s*$"
COMPOSITE = r"^[^0-9]*(?:([0-9]+)\s*(?:h|hr|hrs|hours?)\.?[\s,]*)?([0-9]+)\s*(?:m|min|mins|minutes?|')\.?[\s,]*(?:and\s+)?([0-9]+(?:[.,][0-9]+)?)\s*(?:s|sec|secs|seconds?|'')\.?[^0-9]*$"
CLOCK = r"^[^0-9]*(?:([0-9]+):)?([0-9]+):([0-9]{2}(?:[.,][0-9]+)?)[^0-9]*$"
UNIT_IN_VALUE = NUMBER + r"\s*[\[(]?\s*([^-+\s0-9.,\[\]()][^0-9\[\]()]*?)\s*[\])]?\s*$"
UNIT_IN_NAME = r"(?:\[|\(|,|/|_|\s+in\s)\s*([^\[\]()/,_]+?)\s*[\])]?\s*$"


def unit_aliases(spark: SparkSession) -> DataFrame:
    """The alias table: alias, unit, dimension, shift, num, den. A fixed size of about 150 rows."""
    rows = [(a, u, d, float(s), float(n), float(m)) for u, d, s, n, m, names in UNITS for a in names]
    return spark.createDataFrame(rows, "alias string, unit string, dimension string, shift double, num double, den double").coalesce(1)


def quantities(spark: SparkSession) -> DataFrame:
    """The quantities: accession, quantity, common_unit and that unit's dimension and scale."""
    by = {u: (d, n, m) for u, d, _, n, m, _ in UNITS}
    rows = [(a, q, u, by[u][0], float(by[u][1]), float(by[u][2])) for a, q, u in QUANTITIES]
    return spark.createDataFrame(rows, "q_accession string, quantity string, common_unit string, q_dimension string, q_num double, q_den double").coalesce(1)


def normal_unit(text: Column) -> Column:
    """A unit spelling in the form of the alias table; null if empty."""
    t = F.regexp_replace(F.trim(F.translate(text, "μ", "µ")), r"[.\s]+$", "")
    t = F.regexp_replace(t, r"\s+", " ")
    return F.when(t.isin(*_CASED), t).when(t == "", None).otherwise(F.lower(t))


def _group(text: Column, pattern: str, k: int = 1) -> Column:
    x = F.regexp_extract(text, pattern, k)
    return F.when(x == "", None).otherwise(x)


def _double(text: Column) -> Column:
    return F.translate(text, ",", ".").try_cast("double")


def harmonize_units(cv: DataFrame, source_default: bool = True) -> DataFrame:
    """Every row of the known quantities with its number, unit, unit origin and value in the common unit.

    Columns: param_id, source, quantity, common_unit, number, unit, unit_origin ('field', 'text',
    'default' or null), value_milli (1000 times the value in the common unit, not rounded).
    A decimal comma counts as a point; times of hours, minutes and seconds in one text ('25 m 45.6
    s', 'PT38M54.3S', '38:54.3') are one value with unit 'second' and origin 'text'. Empty texts,
    'NaN' and words have a null number. A unit of another dimension (percent of an energy) gives a
    null value, as does no unit at all. ``source_default``: rows without any unit take the unit that
    the source uses most for the quantity; ties go to the first in the alphabet. Rows of other
    accessions are left out; letter case of the accession doesn't matter; repeated rows stay.
    """
    spark = cv.sparkSession
    q = F.broadcast(quantities(spark))
    rows = cv.select("param_id", "source", "accession", "param_name", "param_value", "unit_accession", "unit_name").withColumn("__acc", F.upper(F.trim("accession")))
    rows = rows.join(q, rows["__acc"] == q["q_accession"])
    v = F.translate("param_value", "−–", "--")
    is_time = F.col("q_dimension") == "time"
    compound = F.when(
        is_time & v.rlike("[0-9].*[0-9]") & v.rlike(r"[A-Za-z:']"),
        F.coalesce(
            *[
                F.when(v.rlike(p), F.coalesce(_double(_group(v, p, 1)), F.lit(0.0)) * 3600 + F.coalesce(_double(_group(v, p, 2)), F.lit(0.0)) * 60 + F.coalesce(_double(_group(v, p, 3)), F.lit(0.0)))
                for p in (DURATION, "(?i)" + COMPOSITE, CLOCK)
            ]
        ),
    )
    rows = rows.select(
        "param_id",
        "source",
        "quantity",
        "common_unit",
        "q_dimension",
        "q_num",
        "q_den",
        compound.alias("__compound"),
        F.when(F.lower(F.trim(v)).isin("nan", "inf", "-inf"), None).otherwise(_double(_group(v, f"({NUMBER})"))).alias("__number"),
        normal_unit(F.coalesce(F.when(F.trim("unit_accession") != "", F.col("unit_accession")), F.when(F.trim("unit_name") != "", F.col("unit_name")))).alias("__field"),
        normal_unit(F.coalesce(_group(v, UNIT_IN_VALUE), _group(F.col("param_name"), UNIT_IN_NAME))).alias("__text"),
    )
    rows = rows.withColumn("__unit", F.when(F.col("__compound").isNotNull(), "s").otherwise(F.coalesce("__field", "__text")))
    rows = rows.withColumn("unit_origin", F.when(F.col("__unit").isNull(), None).when(F.col("__compound").isNull() & F.col("__field").isNotNull(), "field").otherwise("text"))
    if source_default:
        # at most one row per source and quantity
        most = (
            rows.filter(F.col("__unit").isNotNull() & F.col("__compound").isNull())
            .groupBy("source", "quantity", "__unit")
            .agg(F.count("*").alias("n"))
            .groupBy("source", "quantity")
            .agg(F.min_by("__unit", F.struct(-F.col("n"), F.col("__unit"))).alias("__default"))
        )
        most = most.select(F.col("source").alias("__source"), F.col("quantity").alias("__quantity"), "__default")
        rows = rows.join(most, rows["source"].eqNullSafe(most["__source"]) & (rows["quantity"] == most["__quantity"]), "left")
        rows = rows.withColumn("unit_origin", F.when(F.col("__unit").isNull() & F.col("__default").isNotNull(), "default").otherwise(F.col("unit_origin"))).withColumn("__unit", F.coalesce("__unit", "__default"))
    rows = rows.join(F.broadcast(unit_aliases(spark)), F.col("__unit") == F.col("alias"), "left")
    number = F.coalesce("__compound", "__number")
    milli = (number + F.col("shift")) * (F.col("num") * F.col("q_den") * 1000) / (F.col("den") * F.col("q_num"))
    return rows.select(
        "param_id",
        "source",
        "quantity",
        "common_unit",
        number.alias("number"),
        "unit",
        "unit_origin",
        F.col("__compound").isNotNull().alias("is_compound"),
        F.when(F.col("dimension") == F.col("q_dimension"), milli).alias("value_milli"),
    )


def converted_values(cv: DataFrame) -> DataFrame:
    """Values that were given in a unit other than the common one: param_id, value_milli (rounded). Repeated rows count once."""
    rows = harmonize_units(cv, source_default=False)
    return rows.filter(F.col("value_milli").isNotNull() & (F.col("is_compound") | (F.col("unit") != F.col("common_unit")))).select("param_id", F.round(F.round("value_milli", 5)).try_cast("bigint").alias("value_milli")).distinct()
