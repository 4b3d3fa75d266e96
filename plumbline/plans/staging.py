"""Tables written once between the steps of a plan.

A staged table cuts the lineage: what read it survives the loss of an executor, because the files
lie in the folder of ``spark.checkpoint.dir``, which all executors share. Only where that setting
is missing (local tests) is a folder of this machine used.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder for staged tables, set in the session where it is unset."""
    key = "spark.checkpoint.dir"
    base = spark.conf.get(key, None) or spark.sparkContext.getConf().get(key)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{key} must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        spark.conf.set(key, base)
    return base.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the session may be gone
        pass


def stage(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back, with the same columns."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes at its end every table staged within it, for sessions that run many queries: write or
    read the result before leaving."""
    before = len(_made)
    try:
        yield
    finally:
        while len(_made) > before:
            _remove(*_made.pop())


def clear() -> None:
    """Delete every table staged so far. Results not yet written can't be read afterwards."""
    while _made:
        _remove(*_made.pop())


atexit.register(clear)
