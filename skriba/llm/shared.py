"""Shared folder, materialised tables, link components and bounded id filters."""

from __future__ import annotations

import contextlib
import gc
import re
import sys
import tempfile
import types
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import ArrowUDFType


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared folder of spark.checkpoint.dir.

    Only where that setting is missing on a single machine (tests) a temporary folder of
    the driver is used, and made the checkpoint folder; on a cluster that is an error."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir is not set: no folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skriba-")
        sc.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def store(df: DataFrame, folder: str, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: what follows no longer
    depends on the stages before it, and survives the loss of executors."""
    path = f"{folder}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def batch_rows(spark: SparkSession, rows: int):
    """While it holds, Python workers get at most so many rows at once: for wide rows."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def driver_rows(spark: SparkSession, rows: list[tuple], ddl: str) -> DataFrame:
    """A small table from rows of the driver, sent as Arrow: no Python worker reads it."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    wanted = StructType.fromDDL(ddl)
    schema = to_arrow_schema(wanted)
    return spark.createDataFrame(pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(schema)], schema=schema), wanted)


def relieve() -> None:
    """Give back to the system what this process has freed but its allocators keep."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


#: Bytes of batches after which a worker gives back what it has freed.
RELIEF_BYTES = 1 << 24


def worker_cache(owner: str) -> dict:
    """What a worker process keeps from task to task; one owner's at a time."""
    kept = sys.modules.setdefault("_skriba_kept", types.ModuleType("_skriba_kept")).__dict__
    if kept.get("_owner") != owner:
        kept.clear()
        kept["_owner"] = owner
    return kept


def lean(scan, owner: str = ""):
    """`scan` over batches (or columns), giving freed memory back now and then and at its
    end: worker processes outlive their tasks, and many idle ones add up. What another
    `owner` has left in the process goes first."""

    def run(batches):
        def counted():
            passed = 0
            for batch in batches:
                yield batch
                passed += batch.nbytes
                del batch
                if passed > RELIEF_BYTES:
                    relieve()
                    passed = 0

        worker_cache(owner)
        yield from scan(counted())
        relieve()

    return run


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of the shared store through Hadoop's file system, and have the driver
    collect its garbage: Spark's cleaner deletes the shuffle files of plans that are gone."""
    for path in paths:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    gc.collect()
    spark._jvm.System.gc()


def shards(df: DataFrame, per_shard: int, rows: int) -> int:
    """Number of shuffle partitions for `rows`, `per_shard` rows in each."""
    least = df.sparkSession.sparkContext.defaultParallelism
    return max(least, -(-rows // per_shard))


#: Bits of the id filter: 4 MB, whatever the number of ids.
FILTER_BITS = 1 << 25


def id_filter(ids: DataFrame, column: str, slot=None) -> np.ndarray:
    """A one-hash Bloom filter of the ids, always FILTER_BITS large: it only saves
    shuffling rows that a later join would drop, so being full loses nothing."""
    rows = (
        ids.select(((slot_of(column) if slot is None else slot) + 1).alias("s"))
        .select(F.bitmap_bucket_number("s").alias("b"), F.bitmap_bit_position("s").alias("p"))
        .groupBy("b")
        .agg(F.bitmap_construct_agg("p").alias("bits"))
        .collect()
    )
    out = np.zeros((FILTER_BITS // 32768, 4096), np.uint8)
    for r in rows:
        out[r.b - 1] = np.frombuffer(bytes(r.bits), np.uint8)
    return out.reshape(-1)


def probable(slots: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which slots of an id filter are set."""
    return ((bits[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1).astype(bool)


def slot_of(column: str):
    """The slot of an id in the filter."""
    return F.pmod(F.xxhash64(F.col(column)), F.lit(FILTER_BITS))


def likely(table: DataFrame, ids: DataFrame, column: str):
    """A condition on rows of `table`: `column` is probably in `ids`. Only the slots of the
    filter go to the Python workers, and only a mark for each comes back."""
    bits = table.sparkSession.sparkContext.broadcast(id_filter(ids, column))

    def marked(slots):
        import pyarrow as pa

        return pa.array(probable(slots.to_numpy(zero_copy_only=False), bits.value))

    return F.arrow_udf(marked, "boolean", ArrowUDFType.SCALAR)(slot_of(column))


def keep_listed(table: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """Rows of `table` whose `column` is in `ids` (distinct, already stored).

    The filter runs before the exchange, so only rows that probably match are
    shuffled; the join makes it exact."""
    return table.where(F.col(column).isNotNull()).where(likely(table, ids, column)).join(ids, column)


def drop_listed(table: DataFrame, ids: DataFrame, column: str, folder: str) -> DataFrame:
    """Rows of `table` whose `column` is null or not in `ids` (distinct, already stored).

    Rows that the filter passes by are kept without an exchange. Of the others only the
    values of `column` are looked up, once each; those not in `ids` are few while the
    filter is not full, so rows of `table` are not shuffled then either."""
    mark = likely(table, ids, column)
    unsure = table.where(F.col(column).isNotNull()).where(mark).select(column).distinct()
    spared = store(unsure.join(ids, column, "left_anti"), folder, "spared")
    sure = table.where(F.col(column).isNull() | ~mark)
    return sure.unionByName(table.where(F.col(column).isNotNull()).where(mark).join(spared, column, "left_semi").select(*table.columns))


#: Links that a task joins at once before it passes on what is left of them; links that are
#: few enough for one task to finish with (3 MB of them, whatever the input's size).
LOCAL_LINKS, LAST_LINKS = 500_000, 200_000


def _joined(batches):
    """Union-find over runs of (u, v) links of a task: each run's forest as stars."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def top(x):
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def stars():
        nodes = [x for x in up if top(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([top(x) for x in nodes], pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = sorted((top(u), top(v)))
            up[b] = a
        if len(up) > LOCAL_LINKS:
            yield stars()
            up.clear()
    yield stars()


def _with_roots(stars: DataFrame) -> DataFrame:
    """(node, component) of links (u, v) to centres, and of the centres themselves."""
    each = stars.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("component")), F.struct(F.col("v").alias("node"), F.col("v").alias("component")))).alias("x"))
    return each.select("x.*").distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """Connected components of (a, b) links: rows (node, component), component being
    the smallest node reachable; only nodes with links appear.

    Each round joins the links that a task holds, then links every node's larger neighbours
    to its smallest one, then its smaller ones likewise (large star, small star): the number
    of rounds grows with the logarithm of the longest path, the links never grow in number.
    What is left of them after a round's first step is finished by one task if it is little."""
    spark = edges.sparkSession
    now, kept, at = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v"), [], 0
    while True:
        now = store(now.mapInArrow(lean(_joined), "u long, v long"), folder, f"{name}-{at}")
        if now.limit(LAST_LINKS + 1).count() <= LAST_LINKS:
            remove(spark, *kept)
            return _with_roots(now.coalesce(1).mapInArrow(lean(_joined), "u long, v long"))
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: larger neighbours go to the least of the closed neighbourhood
        large = store(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), folder, f"{name}-{at}-l")
        # small star: smaller neighbours and the node itself go to the least
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = store(joined.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct(), folder, f"{name}-{at}-s")
        remove(spark, *kept)
        kept = [f"{folder}/{name}-{at}", f"{folder}/{name}-{at}-l", f"{folder}/{name}-{at}-s"]
        # Done when the links are stars: one centre for each node, and no centre linked on.
        ends = small.select(F.col("u").alias("x"), F.lit(1).alias("out"), F.lit(0).alias("centre")).union(small.select("v", F.lit(0), F.lit(1)))
        if ends.groupBy("x").agg(F.sum("out").alias("out"), F.max("centre").alias("centre")).where("out + centre > 1").isEmpty():
            return _with_roots(small)
        now, at = small, at + 1
