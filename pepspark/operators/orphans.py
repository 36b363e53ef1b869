"""References to records that do not exist, or did not exist at the time of the reference.

Parents and references are put into one long form (target table, key, tag) and grouped by target
table and key: partial aggregation leaves one record per key and map task, so a key that holds a
third of all references costs no more than any other. Keys without a parent, or whose parents'
lives do not surely cover all their references, are the suspects; only their references are
looked at again, row by row, with keys of very many references spread over several tasks.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pepspark.session import BROADCAST_LIMIT, materialize

#: A key with more suspect references than this is spread over SPREAD tasks.
HOT_KEY = 200_000
SPREAD = 64


@dataclass(frozen=True)
class Target:
    """A referred-to table. Without ``deleted_at`` its rows live on from ``recorded_at``."""

    name: str
    df: DataFrame
    key: str = "id"
    recorded_at: str = "recorded_at"
    deleted_at: str | None = "deleted_at"


@dataclass(frozen=True)
class Reference:
    """A referring table and its reference columns: column -> name of the target table."""

    name: str
    df: DataFrame
    fields: dict[str, str]
    row_id: str = "id"
    at: str = "recorded_at"


def _key_type(targets: list[Target], references: list[Reference]) -> str:
    """Whole numbers if all keys are; else texts."""
    types = [t.df.schema[t.key].dataType for t in targets] + [r.df.schema[f].dataType for r in references for f in r.fields]
    return "bigint" if all(isinstance(x, T.IntegralType) for x in types) else "string"


def _references(references: list[Reference], key_type: str) -> DataFrame:
    """Long form: src_table, row_id, ref_field, target, key, at."""
    parts = None
    for r in references:
        refs = F.array(*[F.struct(F.lit(f).alias("ref_field"), F.lit(t).alias("target"), F.col(f).cast(key_type).alias("key")) for f, t in r.fields.items()])
        part = r.df.select(F.lit(r.name).alias("src_table"), F.col(r.row_id).alias("row_id"), F.col(r.at).alias("at"), F.explode(refs).alias("r"))
        part = part.select("src_table", "row_id", "at", "r.*").filter("key is not null")
        parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        raise ValueError("no references given")
    return parts


def orphan_references(targets: list[Target], references: list[Reference]) -> DataFrame:
    """References without a living target: src_table, row_id, ref_field, ref_month, orphan_kind.

    Alive at time t: recorded_at <= t and (deleted_at is null or deleted_at > t). Kind 'missing': no
    row of the target table has the key; 'late': all such rows were recorded later; else 'deleted'.
    Null references are none; a reference without a time is reported only if it is 'missing' (its
    month is null); a target row without recorded_at never lives. A repeated row counts once. Keys are compared
    as whole numbers if all key columns are such, else as texts, so a key in no target's form is missing. The distinct lives of one
    key are held in one row.
    """
    key_type = _key_type(targets, references)
    long = _references(references, key_type)
    parents = None
    for t in targets:
        life = F.struct(F.col(t.recorded_at).alias("born"), (F.col(t.deleted_at) if t.deleted_at else F.lit(None)).cast("timestamp_ntz").alias("died"))
        part = t.df.select(F.lit(t.name).alias("target"), F.col(t.key).cast(key_type).alias("key"), life.alias("life")).filter("key is not null")
        parents = part if parents is None else parents.unionByName(part)
    if parents is None:
        raise ValueError("no targets given")
    parents = parents.withColumn("life", F.struct(F.col("life.born").cast("timestamp_ntz").alias("born"), F.col("life.died").alias("died")))
    long = long.withColumn("at", F.col("at").cast("timestamp_ntz"))
    at_type, life_type = "timestamp_ntz", "struct<born:timestamp_ntz,died:timestamp_ntz>"
    tagged = parents.select("target", "key", "life", F.lit(None).cast(at_type).alias("at"), F.lit(True).alias("is_parent")).unionByName(
        long.select("target", "key", F.lit(None).cast(life_type).alias("life"), "at", F.lit(False).alias("is_parent"))
    )
    keys = tagged.groupBy("target", "key").agg(
        F.max("is_parent").alias("has_parent"),
        F.collect_set("life").alias("lives"),
        F.count(F.when(~F.col("is_parent"), 1)).alias("n_refs"),
        F.min("at").alias("first_at"),
        F.max("at").alias("last_at"),
    )
    covered = F.exists("lives", lambda x: (x["born"] <= F.col("first_at")) & (x["died"].isNull() | (x["died"] > F.col("last_at"))))
    suspects = keys.filter(F.col("n_refs") > 0).filter(~F.coalesce(covered, F.lit(False))).select("target", "key", "has_parent", "lives", "n_refs")
    suspects = materialize(suspects, "suspects")  # used twice; grouped once
    # hot keys: at most (number of references / HOT_KEY) of them; broadcast while their counted size allows
    hot = suspects.filter(F.col("n_refs") > HOT_KEY).select("target", "key", F.lit(True).alias("hot"))
    if (hot.agg(F.sum(F.length("target") + F.length(F.col("key").cast("string")) + 64)).first()[0] or 0) <= BROADCAST_LIMIT:
        hot = F.broadcast(hot)
    salted = long.join(hot, ["target", "key"], "left").withColumn("salt", F.when(F.col("hot"), F.pmod(F.xxhash64("row_id"), F.lit(SPREAD)).cast("int")).otherwise(0)).drop("hot")
    spread = suspects.withColumn("salt", F.explode(F.when(F.col("n_refs") > HOT_KEY, F.sequence(F.lit(0), F.lit(SPREAD - 1))).otherwise(F.array(F.lit(0)))))
    joined = salted.join(spread, ["target", "key", "salt"])
    at = F.col("at")
    alive = F.exists("lives", lambda x: (x["born"] <= at) & (x["died"].isNull() | (x["died"] > at)))
    kind = (
        F.when(~F.col("has_parent"), "missing")
        .when(at.isNull() | F.coalesce(alive, F.lit(False)), None)
        .when(F.coalesce(F.forall("lives", lambda x: x["born"] > at), F.lit(False)), "late")
        .otherwise("deleted")
    )
    return (
        joined.select("src_table", "row_id", "ref_field", F.date_format("at", "yyyy-MM").alias("ref_month"), kind.alias("orphan_kind"))
        .filter("orphan_kind is not null")
        .distinct()
    )


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphan references counted by table, field, month and kind."""
    return orphans.groupBy("src_table", "ref_field", "ref_month", "orphan_kind").agg(F.count("*").alias("n_orphans"))
