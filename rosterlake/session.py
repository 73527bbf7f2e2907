"""Session helpers: tables by name, lineage cuts in the shared folder, size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only when a count proves it has at most this many rows.
MAX_BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table `name` under `sf_dir`."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder named in spark.checkpoint.dir. Where none is named, a session in one process gets a folder of its
    own, which ends with it; on a cluster it is an error, for executors share no local folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="rosterlake-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    sc.setCheckpointDir(named)


def _storage(spark: SparkSession, path: str):
    """(file system, path) of a path on any storage that Spark reads."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _storage(spark, path)
    return fs.exists(p)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is not there."""
    fs, p = _storage(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def replace_table(df: DataFrame, path: str) -> DataFrame:
    """Write `df` as parquet in the place of `path`, which it may be read from: the new table is written beside the old
    one and takes its place when it is whole. A swap that was broken off is finished by the next `settle`."""
    spark = df.sparkSession
    settle(spark, path)
    df.write.mode("overwrite").parquet(path + ".next")
    fs, p = _storage(spark, path)
    fs.delete(p, True)
    settle(spark, path)
    return spark.read.parquet(path)


def settle(spark: SparkSession, path: str) -> None:
    """Put a whole new table in its place if the old one is already gone."""
    fs, p = _storage(spark, path)
    _, nxt = _storage(spark, path + ".next")
    if not fs.exists(p) and exists(spark, path + ".next/_SUCCESS"):
        fs.rename(nxt, p)


def cut(df: DataFrame) -> DataFrame:
    """Materialise `df` once in the shared checkpoint folder and forget its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, rows: int | None = None, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Hint a broadcast when `rows` (counted if not given) is within `limit`; else leave the join to the planner."""
    n = df.limit(limit + 1).count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df


def shuffle_width(spark: SparkSession) -> int:
    """Number of shuffle partitions of the session: the unit in which hot groups are salted."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
