"""Plumbing shared by the corpus operators: checkpoints, batches, grouped streams, components."""

from __future__ import annotations

import ctypes
import gc
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a kernel holds as one block; a longer text is a block of its own.
BLOCK_BYTES = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or one of our own where it is unset and all runs on this machine (tests)."""
    if named := spark.sparkContext.getConf().get("spark.checkpoint.dir"):
        return named
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if not current.isDefined():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="psephos-"))
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
    return current.get()


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder: later reads neither recompute it nor need the executors that made it."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of plans that nothing refers to any more; it does so when it collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def give_back() -> None:
    """Returns a Python worker's freed memory to the system: idle workers stay for a while beside the next stages'."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def fresh(taken: list[str], name: str) -> str:
    """name, or it with underscores after it, so that no column of that name, in whatever case, is taken."""
    lower = {x.lower() for x in taken}
    while name.lower() in lower:
        name += "_"
    return name


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes of a string column; null is empty."""
    return [b if b is not None else b"" for b in column.cast(pa.binary()).to_pylist()]


def blocks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts together hold about limit bytes, with those texts as bytes."""
    for batch in batches:
        column = batch.column(text)
        sizes = pc.fill_null(pc.binary_length(column), 0).to_pylist()
        start = held = 0
        for i, n in enumerate([*sizes, limit + 1]):
            if (held and held + n > limit or i == len(sizes)) and start < i:
                yield batch.slice(start, i - start), texts_of(column.slice(start, i - start))
                start, held = i, 0
            held += n
    give_back()


def grouped(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Runs of equal keys from a partition that is sorted by them, each as one table."""
    held: list[pa.Table] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        columns = [table.column(k).to_numpy() for k in keys]
        change = np.zeros(table.num_rows, dtype=bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        bounds = [0, *np.flatnonzero(change).tolist(), table.num_rows]
        for a, b in zip(bounds, bounds[1:]):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.concat_tables(held)
                held = []
            held.append(table.slice(a, b - a))
            last = key
    if held:
        yield pa.concat_tables(held)
    give_back()


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[list[dict]]:
    """Runs of rows of equal key from a partition that is sorted by it."""
    held: list[dict] = []
    for batch in batches:
        for i in range(0, batch.num_rows, 64):
            for row in batch.slice(i, 64).to_pylist():
                if held and held[-1][key] != row[key]:
                    yield held
                    held = []
                held.append(row)
    if held:
        yield held
    give_back()


def map_groups(df: DataFrame, keys: list[str], fn: Callable[[Iterator[pa.Table]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """fn over the groups of df by keys, one partition's groups after another; a group must be small enough for one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return fn(grouped(batches, keys))

    return df.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v), root the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al., 2014) until nothing
    changes. Each step is an aggregate by node, which combines before the shuffle, and
    an equi-join, whose hot nodes adaptive execution can split. Self-loops and null
    ends are ignored; no edges give no rows.
    """
    e = edges.where(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
    e = cut(e.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct())
    del edges
    release(e.sparkSession)
    seen = None
    while True:
        state = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == seen or not state["n"]:
            break
        seen = state
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        e = cut(small.where("u != v").distinct())
    roots = e.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def gapless(df: DataFrame, group: list[str], order: list[str], name: str, buckets: int = 256) -> DataFrame:
    """df with a gapless number from 0 within each group, named name.

    The rows of a group are dealt to buckets by a hash of the order columns, numbered
    there, and shifted by the counts of the buckets before. A group of any size is so
    never in one task. Each bucket's rows stand in order, the buckets in any. order
    need not be unique: tied rows get different numbers.
    """
    from pyspark.sql import Window

    df = df.withColumn("_b", F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    counts = df.groupBy(*group, "_b").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*group, "_b").orderBy(*order)) - 1
    numbered = df.withColumn("_r", own)
    on = [numbered[c].eqNullSafe(starts[c]) for c in [*group, "_b"]]
    joined = numbered.join(starts, on, "left")
    return joined.select(*[numbered[c] for c in df.columns if c != "_b"], (F.col("_at") + F.col("_r")).cast("long").alias(name))
