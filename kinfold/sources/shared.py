"""Where intermediate tables go: the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_OPEN: ContextVar[list[tuple[str, bool]] | None] = ContextVar("scratch", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session names none, and all runs on one machine, is a local one made.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = os.path.join(tempfile.gettempdir(), "kinfold-checkpoints")
    return found.rstrip("/")


def fresh_folder(spark: SparkSession, name: str = "table", lasting: bool = True) -> str:
    """A new folder in the shared one; ``scratch`` removes it as it does stored tables."""
    path = f"{shared_dir(spark)}/kinfold/{name}-{uuid.uuid4().hex}"
    if (made := _OPEN.get()) is not None:
        made.append((path, lasting))
    return path


def stored(df: DataFrame, name: str = "table", lasting: bool = False) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage is cut, lost executors lose nothing.

    ``lasting``: a result still reads it, so it outlives the ``scratch`` it was made in.
    """
    spark = df.sparkSession
    path = fresh_folder(spark, name, lasting)
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession, everything: bool = False) -> Iterator[None]:
    """Tables stored inside are removed at the end; lasting ones only if ``everything``, or with a scratch around this one."""
    around, token = _OPEN.get(), _OPEN.set([])
    try:
        yield
    finally:
        made = _OPEN.get() or []
        _OPEN.reset(token)
        for path, lasting in made:
            if lasting and not everything:
                if around is not None:
                    around.append((path, lasting))
                continue
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def kept_table(df: DataFrame) -> DataFrame:
    """A table that a result still reads, written once."""
    return stored(df, lasting=True)


def kept_alone(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """``kept_table`` of what ``make`` gives; the tables that were stored to make it are removed."""
    path = fresh_folder(spark)
    with scratch(spark, everything=True):
        df = make()
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
