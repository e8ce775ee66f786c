"""Session, table access and durable intermediate results."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOT_SHARE = 1000
"""A key is hot if it holds more than 1/HOT_SHARE of the rows, so at most HOT_SHARE keys are hot."""


def session(app: str = "quern", **conf: str) -> SparkSession:
    """A session with the settings the engine expects; existing settings win."""
    builder = SparkSession.builder.appName(app)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores if its files are too few to keep them busy; a table with more splits than cores is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a folder of our own where that is unset (tests)."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="quern-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    context.setCheckpointDir(own)
    return own


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small text file, on whatever file system the path names, as the executors see it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark._jsc.hadoopConfiguration()).create(where, True)
    out.write(bytearray(text.encode("utf-8")))
    out.close()


class Stash:
    """Intermediate results written as Parquet to the shared folder, which cut the lineage and outlive lost executors."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.root = f"{shared_folder(spark)}/quern-{uuid.uuid4().hex}"
        self._path(self.root, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, path: str, act) -> None:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        act(where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where)

    def put(self, df: DataFrame, codec: str | None = None) -> DataFrame:
        """Write df once; the returned frame reads the written rows. ``release`` takes the frame. ``codec``: in place of the session's."""
        path = f"{self.root}/{uuid.uuid4().hex}"
        (df.write.option("compression", codec) if codec else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quern_path = path
        return out

    def release(self, df: DataFrame | None) -> None:
        """Delete what put() wrote, once nothing reads it any more."""
        path = getattr(df, "_quern_path", None)
        if path:
            self._path(path, lambda fs, p: fs.delete(p, True))


def join_unique(left: DataFrame, right: DataFrame, key: str, total: int, count: str = "n_rows", how: str = "inner") -> DataFrame:
    """Join left with a right side that has one row per key and, in ``count``, how many rows of left have that key.

    Keys with more than 1/HOT_SHARE of all ``total`` rows number at most HOT_SHARE, so they are broadcast and their
    rows never move; the others are joined by a shuffle in which no key is large. ``how`` is inner or left.
    """
    limit = max(total // HOT_SHARE, 1000)
    hot = right.where(F.col(count) > limit).drop(count)
    cold = right.where(F.col(count) <= limit).drop(count)
    if total <= limit:
        return left.join(right.drop(count), key, how)
    marks = F.broadcast(hot.select(key))
    near = left.join(F.broadcast(hot), key, "inner")
    far = left.join(marks, key, "left_anti").join(cold, key, how)
    return near.unionByName(far)
