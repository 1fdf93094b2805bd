"""Spark session defaults and the shared checkpoint folder.

On a cluster the session is created by the platform; ``configure`` only
applies the SQL settings this library relies on (AQE, UTC, Arrow), sends the
package to the workers and never overrides a ``spark.checkpoint.dir`` the
cluster already names.
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()

SQL_DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 * 1024 * 1024),  # rows hold matrices
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SQL_DEFAULTS.items():
        spark.conf.set(key, value)
    ship_package(spark)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "marquee") -> SparkSession:
    """Session for tests and the local bench (``local[cores]``, UI off)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("MARQUEE_DRIVER_MEMORY", "16g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.default.parallelism", str(shuffle_partitions))
        .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024))
    )
    for key, value in SQL_DEFAULTS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster must name it: a folder made up here would be local to the driver
    and unseen by executors, so its absence raises. Only a single-process
    ``local`` session (tests, bench) gets a fresh scratch folder.
    """
    current = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not current:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        current = tempfile.mkdtemp(prefix="marquee-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder name for an intermediate table inside the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/marquee-{uuid.uuid4().hex}/{name}"


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: cuts the
    lineage, and a lost executor costs no recomputation of what came before."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", codec).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discarded(*tables: DataFrame) -> None:
    """Delete the files of tables that :func:`written` made and nothing reads any more, and let Spark's
    cleaner drop the shuffles they came from (it acts when the driver collects garbage)."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
            if "/marquee-" in folder:
                path = sc._jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)
    if tables:
        sc._jvm.System.gc()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers (once per application), so that
    tasks find it whatever folder the driver was started from."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="marquee-pkg-"), "marquee_pkg.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, dirs, names in os.walk(root):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for n in names:
                full = os.path.join(folder, n)
                z.write(full, os.path.join("marquee", os.path.relpath(full, root)))
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
