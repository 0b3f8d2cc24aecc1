"""Embedding near-dedup: a subspace pigeonhole join.

Unit vectors of cosine c or more are within squared distance 2 - 2c. Vectors are
rotated onto the axes of their covariance and the coordinates split into blocks. Each
block gets a share of the squared distance in proportion to the variance it holds; if
two vectors are within the whole, they are within its share in some block. In each
block a range join finds the pairs within the share: the block's first coordinate is
cut into strips as wide as the share allows a pair to be apart, so partners stand in
the same or in neighbouring strips. A pair that several blocks find belongs to the
first, which its task can tell from the vectors, and is verified there by its cosine in
double precision. No pairs are written: tasks give each vector's number of links and a
root of its links. Strips too full for a task are dealt to chunks, and each pair of
chunks is a task. Equal vectors of one label are one throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster
from psephos.llm.jaccard_join import roots

COSINE, BLOCKS = 0.93, 4
#: Vectors of a strip that one chunk holds.
CHUNK = 1024
#: Pairs that are verified at once.
PAIRS = 32_768
#: Slack of squared distances and strips, against rounding.
SLACK = 1e-9


def unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled by their largest component first, so that no square leaves the range of doubles."""
    x = x / np.abs(x).max(axis=1, initial=0)[:, None]
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column without nulls, all of one length, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)


def rotation(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Axes (columns) of the covariance of all unit vectors, most variance first, and the variances."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, first, n = np.zeros((dim, dim)), np.zeros(dim), 0
        for batch in batches:
            if batch.num_rows:
                x = unit(matrix(batch.column("embedding"), dim))
                total, first, n = total + x.T @ x, first + x.sum(axis=0), n + len(x)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([first.tolist()]), pa.array([total.ravel().tolist()])], names=["n", "first", "total"])

    n, first, total = 0, np.zeros(dim), np.zeros(dim * dim)
    parts = vectors.select("embedding").mapInArrow(run, "n long, first array<double>, total array<double>")
    for r in parts.toLocalIterator():  # one row of dim * dim numbers for each partition, one partition at a time
        n, first, total = n + r["n"], first + np.array(r["first"]), total + np.array(r["total"])
    mean = first / max(n, 1)
    value, axes = np.linalg.eigh(total.reshape(dim, dim) / max(n, 1) - np.outer(mean, mean))
    return axes[:, ::-1], np.maximum(value[::-1], 0)


def split(variance: np.ndarray, blocks: int, cosine: float) -> tuple[list[np.ndarray], np.ndarray]:
    """Coordinates of each block, dealt in turn so that blocks hold like variance, and their shares of the squared distance."""
    own = [np.arange(b, len(variance), blocks) for b in range(min(blocks, len(variance)))]
    share = np.array([variance[o].sum() for o in own])
    share = share / share.sum() if share.sum() > 0 else np.full(len(own), 1 / len(own))
    return own, (2 - 2 * cosine) * share


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b)[None, :] - 2 * a @ b.T


def near_in(a: np.ndarray, b: np.ndarray, share: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a and b, the coordinates of one block, that are within its share of the squared distance."""
    return np.nonzero(_distances(a, b) <= share + 1e-6)


def join(rows: DataFrame, *, cosine: float = COSINE, blocks: int = BLOCKS, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector.

    Vectors link when their labels are equal and not null, they have one length, and
    their cosine in double precision is at least `cosine`. A vector that is null, empty
    or zero or holds null or non-finite numbers links with nothing, and so does one
    without an id, which gets no component and is not kept. n_links counts the other
    vectors linked directly; component_id is the smallest vec_id that links reach. Repeated rows
    are equal vectors. Other columns are ignored.
    """
    spark = rows.sparkSession
    rows = rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).alias("embedding"))
    double = F.col("embedding").cast("array<double>")
    fine = F.coalesce(F.forall(double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(double, lambda x: x != 0), F.lit(False))
    usable = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull()).where(fine)
    usable = usable.withColumn("vector", F.xxhash64("label", "embedding"))
    one = cluster.cut(usable.groupBy("label", "embedding").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector")))
    counts: DataFrame | None = None
    for (dim,) in one.select(F.size("embedding").alias("dim")).distinct().orderBy("dim").collect():
        found = _links(one.where(F.size("embedding") == dim), dim, cosine, blocks)
        counts = found if counts is None else counts.unionByName(found)
    none = "vec_id long, n_links long, component_id long, kept boolean"
    if counts is None:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    counts = cluster.cut(counts)
    root = cluster.components(counts.select(F.col("vector").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("vector"), "root")
    links = counts.groupBy("vector").agg(F.sum("links").alias("links"))
    all_ = one.select("vector", "least", "copies").join(links, "vector", "left").join(root, "vector", "left").withColumn("root", F.coalesce("root", "vector"))
    component = all_.groupBy("root").agg(F.min("least").alias("component_id"))
    special = all_.join(component, "root").select("vector", "component_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")).where("n_links > 0")
    able = F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & fine, F.xxhash64("label", "embedding"))
    out = rows.select("vec_id", able.alias("vector")).join(special, "vector", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component_id", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _links(one: DataFrame, dim: int, cosine: float, blocks: int) -> DataFrame:
    """(vector, root, links) from every task: how many rows the vector's links found there stand for."""
    axes, variance = rotation(one, dim)
    own, share = split(variance, blocks, cosine)
    one = one if dict(one.dtypes)["embedding"] in ("array<float>", "array<double>") else one.withColumn("embedding", F.col("embedding").cast("array<double>"))
    element = dict(one.dtypes)["embedding"]
    width = np.sqrt(share) + 1e-7

    def strips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(matrix(batch.column("embedding"), dim)) @ axes
            for b, coordinates in enumerate(own):
                at = np.floor(x[:, coordinates[0]] / width[b]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(np.full(len(at), b, dtype=np.int32)), pa.array(at), *(batch.column(c) for c in ("vector", "copies", "embedding"))], names=["bucket", "block", "at", "vector", "copies", "embedding"])

    placed = one.withColumn("bucket", F.xxhash64("label")).mapInArrow(strips, f"bucket long, block int, at long, vector long, copies long, embedding {element}")
    sizes = placed.groupBy("bucket", "block", "at").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
    # a strip meets itself and the next one; the next one's chunks are known only to itself, so it visits with its own
    ahead = sizes.select("bucket", "block", (F.col("at") - 1).alias("at"), F.col("chunks").alias("next"))
    back = sizes.select("bucket", "block", (F.col("at") + 1).alias("at"), F.col("chunks").alias("last"))
    known = cluster.cut(sizes.join(ahead, ["bucket", "block", "at"], "left").join(back, ["bucket", "block", "at"], "left"))
    rows = placed.join(known, ["bucket", "block", "at"]).withColumn("chunk", F.pmod("vector", "chunks").cast("int"))
    chunk = F.col("chunk")
    within = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda o: F.struct(F.col("at").alias("home"), F.least(chunk, o).alias("low"), F.greatest(chunk, o).alias("high"), F.lit(False).alias("visit")))
    none = F.array().cast("array<struct<home: long, low: int, high: int, visit: boolean>>")
    host = F.when(F.col("next").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("next") - 1), lambda o: F.struct(F.col("at").alias("home"), chunk.alias("low"), (-1 - o).alias("high"), F.lit(False).alias("visit")))).otherwise(none)
    visit = F.when(F.col("last").isNotNull(), F.transform(F.sequence(F.lit(0), F.col("last") - 1), lambda o: F.struct((F.col("at") - 1).alias("home"), o.alias("low"), (-1 - chunk).alias("high"), F.lit(True).alias("visit")))).otherwise(none)
    met = rows.withColumn("_m", F.explode(F.concat(within, host, visit))).select("bucket", "block", "_m.*", "chunk", "vector", "copies", "embedding")

    def compare(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0
        for g in groups:
            if g.num_rows < 2:
                continue
            vector, copies, chunk_, visit_ = (g.column(c).to_numpy() for c in ("vector", "copies", "chunk", "visit"))
            low, high, block = (g.column(c)[0].as_py() for c in ("low", "high", "block"))
            x = unit(matrix(g.column("embedding").combine_chunks(), dim))
            side = visit_ if high < 0 else chunk_ == high
            a, b = (np.arange(len(x)), np.arange(len(x))) if low == high else (np.flatnonzero(~side), np.flatnonzero(side))
            if not len(a) or not len(b):
                continue
            turned = x @ axes
            # only what is near in the block is compared as a whole
            i, j = near_in(turned[a][:, own[block]], turned[b][:, own[block]], share[block])
            kept = []
            for part in range(0, len(i), PAIRS):
                p, q = a[i[part : part + PAIRS]], b[j[part : part + PAIRS]]
                within = (np.einsum("ij,ij->i", x[p], x[q]) >= cosine) & (p != q)
                p, q = p[within], q[within]
                d = np.square(turned[p] - turned[q])
                near = np.stack([d[:, o].sum(axis=1) <= s + SLACK for o, s in zip(own[: block + 1], share)], axis=1)
                first = near[:, block] & ~near[:, :block].any(axis=1)
                kept.append((p[first], q[first]))
            i, j = (np.concatenate(c) for c in zip(*kept)) if kept else (i, j)
            if not len(i):
                continue
            both = np.zeros((len(x), len(x)), dtype=bool)
            both[i, j] = both[j, i] = True
            hit = np.flatnonzero(both.any(axis=1))
            out.append((vector[hit], vector[roots(both)][hit], (both @ copies)[hit]))
            held += len(hit)
            if held > 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["vector", "root", "links"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["vector", "root", "links"])

    return cluster.map_groups(met, ["bucket", "block", "home", "low", "high"], compare, "vector long, root long, links long")
