"""Session-level helpers: shared scratch tables, size-checked broadcasts, bounded Arrow batches."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side may be broadcast when its counted rows times the caller's bytes per row stay under this.
BROADCAST_BYTES = 32 << 20
#: Rows in one Arrow batch handed to Python. Documents can be long, so this is far below Spark's default.
ARROW_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` where it is set.

    Where it is unset, a temporary folder is made, which is right only for a local master (tests).
    """
    known = spark.conf.get("spark.checkpoint.dir", None)
    if known:
        return known.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="lodestar-")
    spark.conf.set("spark.checkpoint.dir", own)
    spark.sparkContext.setCheckpointDir(own)
    return own


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a path in any Hadoop file system."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def complete_tables(spark: SparkSession, folder: str, prefix: str) -> list[str]:
    """Names of the tables under a folder whose write was finished."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []
    return [n for n in names if n.startswith(prefix) and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs a re-read and not a recomputation.

    ``write`` cuts lineage like a checkpoint does, but computes its input once and stores it as Parquet.
    ``drop`` frees a table when later ones no longer read it; what is left goes when the process ends.
    """

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        atexit.register(self._close)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, file_rows: int = 0) -> DataFrame:
        """``file_rows``: so many rows in a file at most, where rows are large: Parquet holds 100 of them before it looks at their size, and a reader takes a file's at once."""
        df.write.mode("overwrite").option("maxRecordsPerFile", file_rows).parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for n in names:
            delete_path(self.spark, self.path(n))

    def _close(self) -> None:
        try:
            if self.spark.sparkContext._jsc is not None:
                delete_path(self.spark, self.root)
        except Exception:  # noqa: BLE001  the session may be gone at exit; the folder is then the cluster's to clean
            pass


def small(df: DataFrame, rows: int, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its counted ``rows`` fit; else unchanged, for a shuffled join."""
    return F.broadcast(df) if rows * row_bytes <= limit else df


def spread(df: DataFrame, *cols: str) -> DataFrame:
    """``df`` dealt out by ``cols`` over as many partitions as a shuffle has, which are not merged again: for work that costs more than its bytes show."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism), *cols)


def bound_arrow(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Keep Arrow batches small: long texts would otherwise make batches of gigabytes."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > rows:
        spark.conf.set(key, str(rows))


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """So many rows in an Arrow batch for jobs that run inside, where single rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, "10000")
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)
