"""Session settings and tables kept between stages.

Iterative operators cut their lineage by writing a Parquet table to the folder that
``spark.checkpoint.dir`` names, which all executors share: a lost executor costs a re-read, not a
recomputation. Only where that setting is absent and Spark runs in one machine (tests, bench) is a
temporary folder made.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN_DIR: list[str] = []


def build_session(app: str = "poregrid", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the package assumes; on a cluster pass your own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
    )
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: ``spark.checkpoint.dir``, or a temporary one in local mode."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not _OWN_DIR:
        _OWN_DIR.append(tempfile.mkdtemp(prefix="poregrid-"))
        atexit.register(shutil.rmtree, _OWN_DIR[0], ignore_errors=True)
    return _OWN_DIR[0]


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return a scan of the written table."""
    spark = df.sparkSession
    path = f"{_own_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/poregrid/{spark.sparkContext.applicationId}"


def drop_tables(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that were not written yet are lost with them."""
    at = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def spread_rows(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores, for work that takes long over few bytes.

    A scan of a few small files gives fewer tasks than cores; only then are the rows shuffled, and
    they are few by that very condition. Larger inputs pass through as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))
