"""Session defaults and the one way lineage is cut."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def build_session(app: str = "dossier", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs are written for; a cluster's own settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
        "spark.ui.enabled": "false",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    session = builder.getOrCreate()
    ship(session)
    return session


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so Python tasks can import it."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="dossier-")) / "dossier_package.zip"
    with zipfile.ZipFile(archive, "w") as target:
        for path in sorted(package.rglob("*.py")):
            target.write(path, Path(package.name) / path.relative_to(package))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster; where none is named, a local one in local mode, else an error."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = os.path.join(tempfile.gettempdir(), "dossier-" + uuid.uuid4().hex)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder so a lost executor costs no recompute."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Write rows as a parquet table in the shared folder and read them back.

    For rows several branches of a plan read: the work is done once, later reads prune
    columns and partitions, and a lost executor costs one file read.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, by: list[str] | None = None, **more: Column) -> tuple[DataFrame, dict[str, int]]:
    """A materialised table, and its number of rows (``rows``) and other aggregates, observed while it is written."""
    seen = Observation()
    table = materialize(df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in more.items()]), by)
    return table, {"rows": 0, **dict.fromkeys(more, 0), **seen.get}


def bucketed(df: DataFrame, key: str, by: list[str], name: str | None = None, buckets: int | None = None, distinct: bool = False) -> DataFrame:
    """Write rows in the shared folder, by kind and within a kind in hash buckets of ``key``, and read them back as a table.

    Joins and groupings on the key need no shuffle of the table then. The table's name lives as long as the session; its files
    are those of a materialised table. Rows of a table that exists are added to it. ``distinct`` writes equal rows once, in the same shuffle.
    """
    spark = df.sparkSession
    buckets = buckets or shuffle_width(spark)
    name = name or "t_" + uuid.uuid4().hex
    path = f"{checkpoint_dir(spark).rstrip('/')}/tables/{name}"
    # One task per bucket, so that a kind has one file per bucket.
    dealt = df.repartition(buckets, key)
    dealt = dealt.distinct() if distinct else dealt
    writer = dealt.write.mode("append").partitionBy(*by).bucketBy(buckets, key).sortBy(key)
    writer.option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)
