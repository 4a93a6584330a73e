"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc

from pyspark.sql import DataFrame, SparkSession

from ..shipping import ship  # noqa: F401
from ..storage import dropped, folder as shared_dir, saved as stored  # noqa: F401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column over all rows."""
    from pyspark.sql import functions as F

    return int(df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0])


def portions(column, chars: int = 1_000_000):
    """Lists of texts (null: empty) of an Arrow column, cut after so many characters."""
    some, size = [], 0
    for x in column:
        t = x.as_py() or ""
        some.append(t)
        size += len(t)
        if size >= chars:
            yield some
            some, size = [], 0
    if some:
        yield some


def released() -> None:
    """Give memory that a worker no longer uses back to the system; a worker lives on for other tasks and stages."""
    import pyarrow as pa

    gc.enable()  # some tasks stop the collector
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def tidy(go):
    """A function for mapInArrow that leaves its worker's memory free."""

    def run(batches):
        try:
            yield from go(batches)
        finally:
            released()

    return run
