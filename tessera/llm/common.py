"""Shared pieces of the training-data operators: the scratch folder that every
executor can reach, tables written there to cut lineage, and small helpers."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_dir

#: A word is a run of characters that are not ASCII white space; bytes.split() cuts the same words.
WORD = r"[^\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries that run inside go when each query ends: what it wrote is in the shared folder by then."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


_state: dict[object, object] = {}


def worker_state(key: object, make: Callable[[], object]) -> object:
    """What an operator keeps in a Python worker between tasks. Only the latest operator's is held, so that the stages of a pipeline do
    not add up in workers that Spark uses again."""
    if key not in _state:
        _state.clear()
        _state[key] = make()
    return _state[key]


_calls = [0]


def trim(every: int = 1) -> None:
    """Gives memory that a Python worker has freed back to the system, at each ``every``-th call: idle workers of earlier stages
    share an executor's memory with the JVM."""
    _calls[0] += 1
    if _calls[0] % every == 0:
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass


_made: list[str] = []


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


class Scratch:
    """Tables in the shared folder. table() writes a frame and reads it back, so that nothing later
    recomputes it or depends on an executor; drop() deletes those that no plan needs any longer. What an operator's result still reads
    stays until release()."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _made.append(self.base)

    def table(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        with shuffles_dropped(self.spark):
            df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        for name in names:
            _delete(self.spark, f"{self.base}/{name}")


def made() -> int:
    """A mark for release(): how many scratch folders there are."""
    return len(_made)


def release(spark: SparkSession, since: int = 0) -> None:
    """Deletes the scratch folders made after a mark. To be called when the results of the operators have been read or written."""
    while len(_made) > since:
        _delete(spark, _made.pop())


def spread(df: DataFrame) -> DataFrame:
    """Deals the rows out anew where they come from fewer files than there are cores: work by the row would leave the others idle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df._jdf.inputFiles()) < cores else df


def key_of(column: str) -> Column:
    """A never-null join key of a nullable string column: 's' and the value, or 'n'."""
    return F.when(F.col(column).isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), F.col(column).cast("string")))


def source_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
