"""Tables that cut lineage, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_own: list[str] = []
_left: set[str] = set()


def root(spark: SparkSession) -> str:
    """The session's shared folder; one of our own only on a local master that names none (tests)."""
    named = spark.conf.get(_SETTING, None) or spark.sparkContext.getConf().get(_SETTING)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"{_SETTING} must name a folder that driver and executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="lexigrade-"))
    return _own[0]


class Scratch:
    """Names, writes, rereads and drops the intermediate tables of one run."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{root(spark)}/{name}-{uuid.uuid4().hex}"
        self.paths: dict[str, str] = {}
        self.saved = 0
        _left.add(self.base)

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """Write the rows as Parquet and read them back; they outlive lost executors.

        The write's own shuffle files are removed as soon as it ends, since the table
        replaces them; ``by`` is a column to make folders of.
        """
        path, self.saved = f"{self.base}/{name}-{self.saved}", self.saved + 1
        conf, was = self.spark.conf, self.spark.conf.get(_CLEANUP, "false")
        conf.set(_CLEANUP, "true")
        try:
            writer = df.write.mode("overwrite").option("compression", "zstd")
            (writer.partitionBy(by) if by else writer).parquet(path)
        finally:
            conf.set(_CLEANUP, was)
        self.paths[name] = path
        return self.spark.read.schema(df.schema).parquet(path)

    def read(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(self.paths[name])

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        for name in names:
            _delete(self.spark, self.paths.pop(name))

    def drop_part(self, name: str, folder: str) -> None:
        """Delete one folder of a table that was saved ``by`` a column."""
        _delete(self.spark, f"{self.paths[name]}/{folder}")


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def sweep(spark: SparkSession) -> None:
    """Delete all that this process' runs have left for their results to read.

    To be called once the results have been written: operators return lazy tables, so
    what those read can't go before.
    """
    while _left:
        _delete(spark, _left.pop())


def buckets(df: DataFrame, bytes_each: int = 8 << 20) -> int:
    """A power of two of hash buckets that keeps each one to about ``bytes_each`` of stored input.

    Follows the size of the input as Spark's planner knows it, so a bucket's share
    of postings stays the same; never fewer than shuffle partitions.  From 2^20 buckets
    (8 TB) on they grow instead, as a flush's rows would get too small: 100 MB at 100 TB.
    """
    spark = df.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return 1 << (max(least, min(size // bytes_each + 1, 1 << 20)) - 1).bit_length()
