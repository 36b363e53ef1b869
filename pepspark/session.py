"""Session helpers: default settings, table loading, shared scratch space."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: dict[str, list[str]] = {}

#: Largest size in bytes of a plan side that this package itself marks for broadcast.
BROADCAST_LIMIT = 64 * 1024 * 1024


def session(app: str = "pepspark", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, UTC and Arrow switched on."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
    }
    for k, v in {**settings, **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One test table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` or the context's checkpoint folder.

    Only where the master is local (one machine) a temporary folder is made if neither is set; on a cluster that is an error.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            path = current.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            path = tempfile.mkdtemp(prefix="pepspark-")
            spark.conf.set("spark.checkpoint.dir", path)
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    return path.rstrip("/")


def scratch(spark: SparkSession, name: str = "stage") -> str:
    """A new path in the shared folder, deleted by :func:`drop_materialized`."""
    path = f"{shared_dir(spark)}/pepspark-{name}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Write ``df`` as a table into the shared folder and read it back.

    Cuts the lineage in a way that outlives the loss of executors.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)


def drop_materialized(spark: SparkSession) -> int:
    """Delete the tables that :func:`materialize` wrote in this application, once no DataFrame built on them is needed; returns their number."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return len(paths)
