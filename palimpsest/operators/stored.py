"""Tables written once to the folder in spark.checkpoint.dir, so that what follows starts from files that outlive executors."""

from __future__ import annotations

import hashlib
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a new local one is set on one machine, and elsewhere it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of that name that nothing has been written to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, name: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Writes df, in folders by some columns if wanted, and reads it back."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path, partitionBy=list(by) or None)
    read = df.sparkSession.read.schema(df.schema).parquet(path)
    read._written = path
    return read


def filesystem(spark: SparkSession, path: str):
    """(file system, path) of Hadoop for a path of any store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """What a query that starts within it has shuffled is deleted when it ends, and not when the driver collects its plan."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def discard(*tables: DataFrame) -> None:
    """Deletes tables that store wrote, once nothing reads them any more."""
    for df in tables:
        fs, at = filesystem(df.sparkSession, df._written)
        fs.delete(at, True)


def fingerprint(df: DataFrame) -> str:
    """A digest of the files that a table is read from: their names, sizes and times of change."""
    told = []
    for name in sorted(df.inputFiles()):
        fs, at = filesystem(df.sparkSession, name)
        status = fs.getFileStatus(at)
        told.append(f"{name}|{status.getLen()}|{status.getModificationTime()}")
    return hashlib.sha256("\n".join(told).encode()).hexdigest()
