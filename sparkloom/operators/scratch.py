"""Scratch tables and checkpoints in the folder that the session names in spark.checkpoint.dir."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_scope: ContextVar[list | None] = ContextVar("scratch_scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session. Where none is set, a local session gets one of its own machine; any
    other raises, because executors could not share it."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.split("[")[0] == "local":
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            folder = f"{tempfile.gettempdir()}/checkpoints"
        sc.setCheckpointDir(folder)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    scratch_dir(df.sparkSession)
    return df.checkpoint()


def _file(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def fresh(spark: SparkSession) -> str:
    """A new folder's path, which goes with the scope around it, or else when the driver ends."""
    path = f"{scratch_dir(spark)}/{uuid.uuid4().hex}"
    if (held := _scope.get()) is not None:
        held.append((spark, path))
    return path


def opened(spark: SparkSession, path: str, schema) -> DataFrame:
    """What was written to a folder of fresh()."""
    p, fs = _file(spark, path)
    fs.deleteOnExit(p)
    table = spark.read.schema(schema).parquet(path)
    table.scratch = path
    return table


def written(df: DataFrame, *done: DataFrame) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, so a lost executor costs no recomputation of
    what stands above, and a table that is read twice is made once. done: tables of written() that nothing needs any
    more; they are deleted."""
    path = fresh(df.sparkSession)
    df.write.parquet(path)
    discard(*done)
    return opened(df.sparkSession, path, df.schema)


def settled(make: Callable[[], DataFrame], *done: DataFrame) -> DataFrame:
    """written(make(), *done), without the scratch tables that make() itself has written."""
    with scope():
        df = make()
        path = f"{scratch_dir(df.sparkSession)}/{uuid.uuid4().hex}"
        df.write.parquet(path)
    if (held := _scope.get()) is not None:
        held.append((df.sparkSession, path))
    discard(*done)
    return opened(df.sparkSession, path, df.schema)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of written() that nothing reads any more."""
    for t in tables:
        p, fs = _file(t.sparkSession, t.scratch)
        fs.delete(p, True)


@contextmanager
def scope() -> Iterator[None]:
    """Deletes all scratch tables that are written inside when it ends; what is to stay must be copied elsewhere."""
    token, held = _scope.get(), []
    _scope.set(held)
    try:
        yield
    finally:
        _scope.set(token)
        for spark, path in held:
            p, fs = _file(spark, path)
            fs.delete(p, True)
