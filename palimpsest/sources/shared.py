"""Tables cut from their lineage, in the folder that the driver and all executors share.

What is read more than once is written as Parquet below ``spark.checkpoint.dir`` and read back, so a lost executor
costs only the tasks that it ran.  A ``Tables`` block deletes its tables when it ends, by an error too; what an
operator returns unread is deleted when the program ends.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession

#: Bytes of a batch of rows for Python, but for one row, where Spark's own bound of 64 MB is too wide: a worker holds two
#: batches, and there are two workers a core where a plan has two functions.
BATCH_BYTES = 4 << 20

_own: list[str] = []
_kept: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where it is unset a temporary one, on a local master alone."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that the driver and all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="palimpsest-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{shared_folder(spark)}/palimpsest/{uuid.uuid4().hex}/{tag}"


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is run in this block sends Python batches of ``BATCH_BYTES``; a session's narrower bound stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, held = spark.conf.get(key), spark._jsparkSession.sessionState().conf().arrowMaxBytesPerBatch()
    if not 0 < held <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _written(df: DataFrame, tag: str) -> tuple[DataFrame, str]:
    path = new_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def delete(sc: SparkContext, *paths: str) -> None:
    """Delete tables, with the folder that each has to itself."""
    for path in paths:
        at = sc._jvm.org.apache.hadoop.fs.Path(path).getParent()
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def _at_end() -> None:
    sc = SparkContext._active_spark_context
    if sc is not None and sc._jsc is not None:
        delete(sc, *_kept)
    else:
        for path in _kept:
            if path.startswith(("/", "file:")):
                shutil.rmtree(path.removeprefix("file:").rpartition("/")[0], ignore_errors=True)


atexit.register(_at_end)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there.  For what leaves an operator unread."""
    back, path = _written(df, tag)
    _kept.append(path)
    return back


class Tables:
    """``with Tables(spark) as t``: what ``t.cut`` writes lasts until the block ends, or ``t.drop`` says so."""

    def __init__(self, spark: SparkSession):
        self.sc = spark.sparkContext
        self.tables: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> Tables:
        return self

    def __exit__(self, *error) -> None:
        delete(self.sc, *(path for _, path in self.tables))

    def cut(self, df: DataFrame, tag: str) -> DataFrame:
        self.tables.append(_written(df, tag))
        return self.tables[-1][0]

    def drop(self, *frames: DataFrame) -> None:
        delete(self.sc, *(path for df, path in self.tables if any(df is f for f in frames)))
        self.tables = [(df, path) for df, path in self.tables if not any(df is f for f in frames)]
