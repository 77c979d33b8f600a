"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_SETTING = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", name: str = "colophon", **settings: str) -> SparkSession:
    """A session for one machine; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", "8" if cores == "*" else str(cores))
        .config("spark.driver.memory", "8g")
        # Opening a local file costs next to nothing, so small inputs may be cut finely.
        .config("spark.sql.files.openCostInBytes", str(256 * 1024))
    )
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors can reach, as the session names it.

    Only a local-mode session without the setting gets a temporary folder.
    """
    folder = spark.conf.get(CHECKPOINT_SETTING, None)
    if folder is None:
        folder = spark.sparkContext.getCheckpointDir()
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"set {CHECKPOINT_SETTING} to a folder shared by all executors")
        folder = tempfile.mkdtemp(prefix="colophon-")
        spark.conf.set(CHECKPOINT_SETTING, folder)
    return folder.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def store(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """Write ``df`` as a table and read it back: cuts lineage, survives lost executors."""
    path = path or new_folder(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, parts: int, *keys: str) -> DataFrame:
    """Deal the rows to ``parts`` tasks, for work bound by the processor on files of one row group.

    The caller says how many; nothing depends on the size of the input.
    """
    return df.repartition(parts, *keys)
