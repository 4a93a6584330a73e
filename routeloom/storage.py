"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table that dealt() marked is made in a pass for so many bytes of its inputs, up to the number of passes.
PASS_BYTES, MOST_PASSES = 1 << 26, 4


def folder(spark: SparkSession) -> str:
    """A new path in spark.checkpoint.dir. Only a session whose executors live in the driver may do without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        known = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = known.get() if known.isDefined() else None
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="shared")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/tables-{uuid.uuid4().hex}"


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder with all that it holds."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def renamed(spark: SparkSession, old: str, new: str) -> bool:
    """Move a file or folder to a name that is not taken; False if it is."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    a, b = path(old), path(new)
    fs = a.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return False if fs.exists(b) else fs.rename(a, b)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; none if there is no such folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


@contextmanager
def lean(spark: SparkSession):
    """Within it, an action's shuffle files go when it ends, not when the driver collects its garbage, and what dealt()
    marked is not shuffled for a join on its keys, be there other keys in the join or not."""
    held = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: spark.conf.get(k, None) for k in held}
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The frame, marked for saved() to deal its rows into buckets by the keys. A large one is made in passes over the
    inputs, some of the buckets in each, so that their shuffles are never on disk at once; needs lean() for that."""
    df._dealt_by = keys
    return df


def _input_bytes(df: DataFrame) -> int:
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _bucketed(df: DataFrame, keys: tuple[str, ...], path: str) -> DataFrame:
    """Only tables of the catalog have buckets; this one is there no longer than it takes to write and find it."""
    spark, name = df.sparkSession, "spark_catalog.default." + path.rsplit("/", 1)[1].replace("-", "_")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    passes = max(1, min(MOST_PASSES, n, _input_bytes(df) // PASS_BYTES))
    try:
        for i in range(passes):
            part = df if passes == 1 else df.where(F.pmod(F.hash(*keys), F.lit(n)) % passes == i)
            part.write.bucketBy(n, *keys).option("path", path).saveAsTable(name, format="parquet", mode="append")
        return spark.table(name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def saved(df: DataFrame) -> DataFrame:
    """Write and read back: cuts the lineage, and survives lost executors."""
    path = folder(df.sparkSession)
    if keys := vars(df).get("_dealt_by"):
        out = _bucketed(df, keys, path)
    else:
        df.write.parquet(path)
        out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files behind frames that saved() returned; others are left alone. Nothing may read them afterwards."""
    for df in frames:
        if path := vars(df).get("_saved_at"):
            removed(df.sparkSession, path)
