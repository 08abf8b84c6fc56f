"""A Spark session with the settings that the operators expect."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


PACKAGE = os.path.dirname(os.path.abspath(__file__))
_shipped: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Let Python workers import this package wherever they run: Spark sends them a ZIP of its modules, once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        path = os.path.join(tempfile.mkdtemp(prefix="talweg-"), "talweg_package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(PACKAGE):
                for n in sorted(names):
                    if n.endswith(".py"):
                        z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), os.path.dirname(PACKAGE)))
        sc.addPyFile(path)
        _shipped.add(sc.applicationId)
    return spark


def session(master: str = "local[8]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("talweg")
    settings = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true", "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
    } | conf
    return builder.config(map=settings).getOrCreate()


def checkpointed(df: DataFrame, rows: int = 0) -> DataFrame:
    """`df` with its lineage cut: written once as a table in the folder that `spark.checkpoint.dir` names (a local one where that
    is unset and all is one machine) and read again. Unlike `DataFrame.checkpoint` nothing is computed twice, and the size is known to later joins.
    Files hold at most `rows` rows if given: a reader takes thousands at once, too many of rows of some megabytes."""
    spark = df.sparkSession
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="talweg-")
        sc.setCheckpointDir(named)
    path = f"{named.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str, rows: int = 25_000) -> DataFrame:
    """`df` over tasks of some `rows` rows each, one for each core at least: for rows that are few in bytes but much work, which
    a reader and adaptive execution would put into one task. Rows of equal `keys` stay together."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * (df.count() // (rows * cores) + 1), *keys)
