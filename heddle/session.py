"""Session helpers: the shared checkpoint folder and reliable lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

SETTING = "spark.checkpoint.dir"


def local_session(cores: str | int = "*", shuffle: int = 8, name: str = "heddle") -> SparkSession:
    """A single-machine session as tests and the bench use it."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(shuffle))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("HEDDLE_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share.

    The cluster names it in ``spark.checkpoint.dir``. Only where that is unset
    (tests, one machine) a folder of this machine is made and set.
    """
    folder = spark.conf.get(SETTING, None) or spark.sparkContext.getConf().get(SETTING, None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError(f"{SETTING} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="heddle-")
        spark.conf.set(SETTING, folder)
    return folder


def scratch(spark: SparkSession, name: str = "part") -> str:
    """A new path in the application's own part of the shared folder, which is removed when the application ends."""
    root = f"{shared_folder(spark).rstrip('/')}/heddle/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Cut the lineage: write ``df`` once to the shared folder and read it from there.

    Parquet keeps column pruning and filter pushdown for later reads, which a
    checkpointed RDD does not; the files survive the loss of executors.
    """
    path = scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``rows`` rows, else as it is, for a shuffled join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def observed(df: DataFrame, **measures: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """``df`` with aggregates that are taken on the way, and a call that gives them once an action has run.

    Where the plan turned out to be empty nothing is taken, and they are computed.
    """
    seen = Observation()
    named = [c.alias(k) for k, c in measures.items()]

    def get() -> dict:
        try:
            return seen.get
        except Exception:  # the JVM's assertion on an empty set of metrics
            return df.agg(*named).first().asDict()

    return df.observe(seen, *named), get
