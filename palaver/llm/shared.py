"""Storage and graph helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Where spark.checkpoint.dir is unset and Spark runs in one process, as in tests.
LOCAL_SHARED = "file:///tmp/checkpoints"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or, in local mode only, one of this machine."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if not given and not spark.sparkContext.master.startswith("local"):
        raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all executors share")
    return (given or LOCAL_SHARED).rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/palaver-{name}-{uuid.uuid4().hex}"


def _store(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    """Deletes what was written under path."""
    store, where = _store(spark, path)
    store.delete(where, True)


def remove_at_exit(spark: SparkSession, path: str) -> None:
    """Deletes what was written under path when the driver ends: lazy results may read it until then."""
    store, where = _store(spark, path)
    store.deleteOnExit(where)


class Scratch:
    """Tables written to the shared folder, so that a lost executor costs no lineage.

    What is not dropped goes when the driver ends. Reading them back also forgets their partitioning: a join after it deals out
    both sides anew, which lets the adaptive planner split a hot key.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def put(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self.spark, name)
        df.write.parquet(path)
        remove_at_exit(self.spark, path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self.paths[name] = path
        return out

    def drop(self, *names: str) -> None:
        for n in names:
            remove(self.spark, self.paths.pop(n))


def lean(run):
    """run over Arrow batches, giving freed memory back to the system after each: workers live on between stages."""

    def batches(incoming):
        libc = ctypes.CDLL(None)
        for out in run(incoming):
            yield out
            pa.default_memory_pool().release_unused()
            if hasattr(libc, "malloc_trim"):
                libc.malloc_trim(0)

    return batches


def arrow_rows(spark: SparkSession, rows: int) -> None:
    """Bounds the Arrow batches that Python operators get, for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def spanning(a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
    """Links that join the same nodes as all of (a, b), fewer than there are nodes."""
    up, out = {}, []

    def find(i):
        while up.get(i, i) != i:
            up[i] = up.get(up[i], up[i])
            i = up[i]
        return i

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            up[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def components(scratch: Scratch, links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, label) with label the smallest node of the connected component.

    links: pairs of longs; nulls and loops are ignored. Every round each node takes the
    smallest label among its neighbours, then the label of its label, so the number of
    rounds is logarithmic for paths as well. A round's table is written to the shared folder.
    """
    both = links.select(F.col(a).alias("s"), F.col(b).alias("d")).where("s is not null and d is not null and s <> d")
    both = scratch.put(both.union(both.select("d", "s")).distinct(), "links")
    labels, k = scratch.put(both.groupBy(F.col("s").alias("node")).agg(F.least(F.min("d"), F.col("s")).alias("label")), "labels0"), 0
    while True:
        seen = both.join(labels, F.col("s") == F.col("node")).groupBy(F.col("d").alias("node")).agg(F.min("label").alias("near"))
        step = labels.join(seen, "node").select("node", "label", F.least("label", "near").alias("low"))
        step = scratch.put(step, f"step{k + 1}")
        up = step.select(F.col("node").alias("low"), F.col("low").alias("lower"))
        new = step.join(up, "low").select("node", F.col("lower").alias("label"), (F.col("lower") != F.col("label")).alias("moved"))
        new = scratch.put(new, f"labels{k + 1}")
        moved = new.where("moved").limit(1).count()
        scratch.drop(f"step{k + 1}", f"labels{k}")
        labels, k = new.select("node", "label"), k + 1
        if not moved:
            scratch.drop("links")
            scratch.paths["components"] = scratch.paths.pop(f"labels{k}")
            return labels
