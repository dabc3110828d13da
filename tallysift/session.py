"""Session factory and the shared scratch area."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "tallysift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect: ANSI, adaptive execution, UTC.

    Sizes (shuffle partitions, memory) belong to the cluster; pass them as keywords with
    underscores for dots, for example ``spark_sql_shuffle_partitions="2000"``.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("_", "."): v for k, v in conf.items()}
    for k, v in settings.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder URI under ``spark.checkpoint.dir``, which all executors share.

    Where the setting is unset, a temporary folder is set for a session in local mode (tests, a laptop); on a
    cluster that is an error. A folder without a scheme is one of Hadoop's default file system.
    """
    ctx = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or ctx.getConf().get("spark.checkpoint.dir")
    if not root:
        jvm_dir = ctx._jsc.sc().getCheckpointDir()
        root = jvm_dir.get() if jvm_dir.isDefined() else None
    if not root:
        if not ctx.master.startswith("local") or ctx.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tallysift-")
        ctx.setCheckpointDir(root)
    elif not ctx._jsc.sc().getCheckpointDir().isDefined():
        ctx.setCheckpointDir(root)
    if "://" not in root and not root.startswith("file:"):
        path = ctx._jvm.org.apache.hadoop.fs.Path(root)
        root = path.getFileSystem(ctx._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared scratch area and reads it back: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes the folders of settled tables, once what was made of them has been settled itself."""
    for df in tables:
        ctx = df.sparkSession.sparkContext
        path = ctx._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(ctx._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
