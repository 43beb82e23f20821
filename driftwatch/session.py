"""Where jobs read their tables and keep what must outlive an executor."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: The folder of the innermost ``scratch`` that is open in this thread.
_SCRATCH: ContextVar[str | None] = ContextVar("scratch", default=None)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the data folder ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir`` of the session.

    Only where that is unset in a local session, as in tests, a temporary folder is made and set, which goes when Python ends. On a cluster it must be set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="driftwatch-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def bound_batches(spark: SparkSession, size: int = 4 << 20) -> None:
    """Bounds the Arrow batches of the session to about ``size`` bytes, 1,000 rows at most: texts may be long, and a task holds several copies of a batch."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(size))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder, or in the open ``scratch``, that no other job uses."""
    return f"{_SCRATCH.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path in whatever store it lies; a path that isn't there is fine."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own for all intermediate files that jobs write within; they go at the end, also after an error.

    Results are lazy, so write or count them within. Yields the folder.
    """
    folder = fresh_path(spark, "scratch")
    before = _SCRATCH.set(folder)
    try:
        yield folder
    finally:
        _SCRATCH.reset(before)
        remove(spark, folder)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there.

    Unlike a local checkpoint the files outlive the executors that wrote them. They stay until they are deleted, or until an open ``scratch`` ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
