"""Intermediate tables in the folder that all executors share.

Lineage is cut by writing a table and reading it back, so that a lost executor
costs a re-read and never a re-computation of earlier phases.  The folder is
the one named by ``spark.checkpoint.dir``; a local folder is only ever chosen
for a ``local`` master, where driver and executors are one machine.
"""

from __future__ import annotations

import atexit
import gc
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Rows of a key table that may be broadcast (a few tens of MB); beyond it the same join is shuffled.
BROADCAST_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one when a local session names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    os.makedirs("/tmp/checkpoints", exist_ok=True)
    made = tempfile.mkdtemp(prefix="basisloom-", dir="/tmp/checkpoints")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{made}")
    return f"file://{made}"


class Scratch:
    """A folder of intermediate tables for one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.count = 0

    def write(self, df: DataFrame, name: str = "t", partition_by: str | None = None) -> DataFrame:
        """Write ``df`` and return it as read back."""
        self.count += 1
        path = f"{self.path}/{self.count:03d}-{name}"
        writer = df.write.option("compression", "zstd")
        if partition_by:
            writer = writer.partitionBy(partition_by)
        writer.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.path}/{self.count:03d}-{name}"

    def drop(self, *tables: DataFrame) -> None:
        """Delete written tables that nothing will read again."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            for name in {f.rpartition("/")[0] for f in table.inputFiles()}:
                while "/" in name and not name.rpartition("/")[0].endswith(self.path.rpartition("/")[2]):
                    name = name.rpartition("/")[0]  # up from partition folders to the table
                if self.path.rpartition("/")[2] in name:
                    path = jvm.org.apache.hadoop.fs.Path(name)
                    path.getFileSystem(conf).delete(path, True)

    def clear(self) -> None:
        """Delete the whole folder, once what was wanted of it is written elsewhere."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.release()

    def release(self) -> None:
        """Let Spark delete the shuffle files of frames that are no longer referenced."""
        gc.collect()
        self.spark._jvm.System.gc()


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the size of ``df`` (file sizes for a scan), which runs no job; where it has none, a count."""
    from pyspark.sql import functions as F

    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size < 1 << 55:
        return size
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, kind in df.dtypes if kind in ("string", "binary")]
    per_row = sum(texts, F.lit(16 * len(df.columns)))
    return int(df.agg(F.coalesce(F.sum(per_row.cast("long")), F.lit(0))).first()[0])


def parts_for(df: DataFrame, mb: float, least: int = 8, most: int = 200_000) -> int:
    """Number of parts so that each has about ``mb`` MB of the input."""
    return max(least, min(most, -(-input_bytes(df) // int(mb * 1e6))))


@contextmanager
def exchanges(spark: SparkSession, least: int) -> Iterator[None]:
    """Tables written inside are planned with at least this number of shuffle partitions.

    Unlike a repartition by a number, which Spark keeps as it is, it may still merge
    small partitions and divide skewed ones.  The session's own number comes back
    at the end and is never lowered.
    """
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(max(int(before), least)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep_only(df: DataFrame, keys: DataFrame, on: str, how: str) -> DataFrame:
    """Semi or anti join of ``df`` with a written key table; broadcast only when its counted rows are few."""
    from pyspark.sql import functions as F

    n = keys.count()
    if n == 0:
        return df if how == "left_anti" else df.limit(0)
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, on, how)


def few_rows(keys: DataFrame) -> DataFrame:
    """``keys``, to be broadcast in a join only when its counted rows are few."""
    from pyspark.sql import functions as F

    return F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys


def by_slot(df: DataFrame, slot: str, slots: int, each: int = 4) -> DataFrame:
    """``df`` with ``each`` of the numbered slots to a partition, so that none gathers more of them by chance; a grouping by the slot needs no other exchange."""
    from pyspark.sql import functions as F

    return df.repartitionById(max(8, -(-slots // each)), F.col(slot).cast("int"))
