"""Tables in the shared folder, and byte-bounded slices of Arrow batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task works on at once.
SLICE_BYTES = 4 << 20
#: Rows of a slice, so that short and empty texts do not add up to large arrays.
SLICE_ROWS = 8192


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset a new local one is set on one machine, and elsewhere it is an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", where)
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: what follows starts from files that outlive executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    read = spark.read.schema(df.schema).parquet(path)
    read._written = path
    return read


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialise wrote, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._written)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def remainder(id_col: str, modulus: int):
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Consecutive rows, at most `rows`, whose texts together hold about `limit` bytes; one longer text is a slice of its own."""
    for batch in batches:
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        begin, held = 0, 0
        for i, n in enumerate(sizes):
            if i > begin and (held + n > limit or i - begin >= rows):
                yield batch.slice(begin, i - begin)
                begin, held = i, 0
            held += int(n)
        if batch.num_rows > begin:
            yield batch.slice(begin)


_KEPT: dict[object, object] = {}


def kept(name: object, make: Callable):
    """What a worker keeps between tasks, made when it is first asked for. A worker serves one kind of work at a time, so what
    another kind had kept is dropped: caches do not add up over the stages of a pipeline."""
    if name not in _KEPT:
        _KEPT.clear()
        _KEPT[name] = make()
    return _KEPT[name]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


#: Groups that can each hold more than one in so many of all rows; there are fewer of them than this, whatever the data.
HOT_GROUPS = 1000


def join_back(rows: DataFrame, groups: DataFrame, key: str, copies: str, total: int) -> DataFrame:
    """Inner join of rows to the groups that they were made of; groups has a row for each key, and `copies` how many rows hold it.

    Groups that hold more than a thousandth of all `total` rows are fewer than a thousand, and are broadcast; the others are
    joined by a shuffle in which no key is hot. Keys may be null. Both tables are read twice, so they should be written.
    """
    least = total // HOT_GROUPS
    hot, rest = groups.filter(F.col(copies) > least), groups.filter(F.col(copies) <= least)
    names = [c for c in groups.columns if c != key]
    r, known = rows.alias("r"), F.col(f"r.{key}").eqNullSafe(F.col(f"g.{key}"))
    out = [F.col(f"r.{c}") for c in rows.columns] + [F.col(f"g.{c}") for c in names]
    found = r.join(F.broadcast(hot).alias("g"), known).select(*out)
    others = r.join(F.broadcast(hot.select(key)).alias("g"), known, "left_anti").alias("r")
    return found.unionByName(others.join(rest.alias("g"), known).select(*out))
