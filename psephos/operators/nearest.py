"""Exact k nearest donors of many targets, some coordinates missing: boxes of a k-d tree, two rounds, ties by key.

Rows that share the same coordinates form one problem each: which ones a target has and
which of those a donor has too. A problem's donors are cut into boxes by a k-d tree over a
bounded sample of them. The first round holds each target against the donors of its own
box; the k-th distance there bounds the search, and the second round holds it against
every other box that is not farther. No donor that could count is left out, and the work
grows about with the targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows from which the tree is built, about; it has a leaf for LEAF rows, if the sample has LEAST of them.
SAMPLE, LEAF, LEAST = 200_000, 2_000, 32
#: Targets that one task holds against a box, and distances that it computes at a time.
PIECE, BLOCK = 4_096, 1_000_000
XYZ = ["_x", "_y", "_z"]


def kept(df: DataFrame) -> DataFrame:
    """df computed once: in the checkpoint folder if one is set, else with the executors."""
    return df.checkpoint() if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isDefined() else df.localCheckpoint()


def distance(diffs: list[np.ndarray], shared: int) -> np.ndarray:
    """The root of 4 / shared times the squared differences; monotone in each, also as rounded."""
    total = 0.0
    for d in diffs:
        total = total + d * d
    return np.sqrt(4 / shared * total)


class Tree:
    """Leaves of a k-d tree of one problem's points."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.axis, self.at, self.low, self.high, self.leaves = [], [], [], [], 0
        self._grow(points, leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        me = len(self.axis)
        for x in (self.axis, self.at, self.low, self.high):
            x.append(0)
        wide = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        axis = int(wide.argmax())
        if len(points) <= leaf or not wide[axis]:
            self.axis[me], self.low[me] = -1, self.leaves
            self.leaves += 1
            return me
        own = np.sort(points[:, axis])
        middle = own[len(own) // 2]
        at = middle if middle > own[0] else own[own > middle][0]
        under = points[:, axis] < at
        self.axis[me], self.at[me] = axis, float(at)
        self.low[me], self.high[me] = self._grow(points[under], leaf), self._grow(points[~under], leaf)
        return me

    def leaf(self, points: np.ndarray) -> np.ndarray:
        axis, at, low, high = map(np.array, (self.axis, self.at, self.low, self.high))
        node, rows = np.zeros(len(points), dtype=np.int64), np.arange(len(points))
        while (inner := axis[node] >= 0).any():
            a = np.maximum(axis[node], 0)
            node = np.where(inner, np.where(points[rows, a] < at[node], low[node], high[node]), node)
        return low[node]


def _points(batch: pa.RecordBatch | pa.Table) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(c).to_numpy() for c in XYZ], axis=1)


def _boxed(df: DataFrame, trees: dict[int, tuple[int, Tree]]) -> DataFrame:
    """df with the box that each row is in; rows of problems without donors go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problem, points = batch.column("_p").to_numpy(), _points(batch)
            box = np.full(len(problem), -1, dtype=np.int32)
            for p in np.unique(problem).tolist():
                if p in trees:
                    own = problem == p
                    box[own] = trees[p][0] + trees[p][1].leaf(points[own])
            out = pa.RecordBatch.from_arrays([*batch.columns, pa.array(box)], names=[*batch.schema.names, "_box"])
            yield out.filter(pa.array(box >= 0))

    kinds = ", ".join(f"`{c}` {t}" for c, t in df.dtypes)
    return df.mapInArrow(run, f"{kinds}, _box int")


def _best(donors: np.ndarray, targets: np.ndarray, within: np.ndarray, shared: int, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(target, donor, distance) of each target's k nearest donors that are not farther than within; donors are in the order of their keys."""
    step = max(1, BLOCK // max(1, len(donors)))
    for i in range(0, len(targets), step):
        some = targets[i : i + step]
        d = distance([some[:, None, a] - donors[None, :, a] for a in range(3)], shared)
        far = within[i : i + step]
        if len(donors) > k:
            open_ = np.isinf(far)
            far = far.copy()
            far[open_] = np.partition(d[open_], k - 1, axis=1)[:, k - 1]
        t, j = np.nonzero(d <= far[:, None])
        own = d[t, j]
        order = np.lexsort((j, own, t))
        t, j, own = t[order], j[order], own[order]
        starts = np.searchsorted(t, np.arange(len(some)))
        near = np.arange(len(t)) - starts[t] < k
        yield t[near] + i, j[near], own[near]


def _search(targets: DataFrame, donors: DataFrame, at: list[str], k: int) -> DataFrame:
    """(*at, _p, *XYZ, _box, _near) of each target and box: its nearest donors there, k at most, none beyond _within."""
    spark = targets.sparkSession
    counts = targets.groupBy("_box").count().collect()
    pieces = spark.createDataFrame([(r["_box"], -(-r["count"] // PIECE)) for r in counts], "_box int, _pieces int")
    kind = dict(donors.dtypes)
    sent = targets.join(F.broadcast(pieces), "_box").withColumn("_piece", F.pmod(F.xxhash64(*at), F.col("_pieces")).cast("int"))
    met = donors.join(F.broadcast(pieces), "_box").withColumn("_piece", F.explode(F.sequence(F.lit(0), F.col("_pieces") - 1)))
    both = met.drop("_pieces").withColumn("_within", F.lit(None).cast("double")).unionByName(sent.drop("_pieces"), allowMissingColumns=True)
    names = [*at, "_p", *XYZ, "_box", "_near"]

    def run(group: pa.Table) -> pa.Table:
        given = pc.is_null(group.column("_within"))
        own, asked = group.filter(given).sort_by("_k"), group.filter(pc.invert(given))
        t, j, d = (np.concatenate(c) for c in zip(*_best(_points(own), _points(asked), asked.column("_within").to_numpy(), int(group.column("_p")[0].as_py() & 7).bit_count(), k), strict=True))
        ends = np.searchsorted(t, np.arange(asked.num_rows + 1)).astype(np.int32)
        rows = own.select(["_k", "_v"]).take(pa.array(j)).combine_chunks()
        flat = pa.StructArray.from_arrays([pa.array(d), *(pa.concat_arrays(rows.column(c).chunks) if rows.num_rows else pa.array([], type=rows.schema.field(c).type) for c in ("_k", "_v"))], names=["d", "k", "v"])
        return pa.table([*(asked.column(c) for c in names[:-1]), pa.ListArray.from_arrays(pa.array(ends), flat)], names=names)

    schema = ", ".join([*(f"{c} double" for c in at), "_p int", *(f"{c} double" for c in XYZ), "_box int", f"_near array<struct<d: double, k: {kind['_k']}, v: {kind['_v']}>>"])
    return both.groupBy("_box", "_piece").applyInArrow(run, schema)


def _spread(df: DataFrame, boxes: dict[int, tuple[np.ndarray, ...]], at: list[str], k: int) -> DataFrame:
    """A row for each target and further box that is not beyond its k-th distance so far; _within says that distance."""
    names = [*at, "_p", *XYZ, "_box", "_within"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            problem, points, home, within = batch.column("_p").to_numpy(), _points(batch), batch.column("_box").to_numpy(), batch.column("_within").to_numpy().copy()
            for p in np.unique(problem).tolist():
                box, low, high, count = boxes[p]
                own = np.flatnonzero(problem == p)
                for i in range(0, len(own), step := max(1, BLOCK // len(box))):
                    some = own[i : i + step]
                    x, shared = points[some][:, None, :], (p & 7).bit_count()
                    if (open_ := np.isinf(within[some])).any():  # so near are k donors at least, wherever in their boxes
                        far = distance([np.maximum(np.abs(x[open_, :, a] - low[:, a]), np.abs(x[open_, :, a] - high[:, a])) for a in range(3)], shared)
                        order = far.argsort(axis=1)
                        enough = count[order].cumsum(axis=1) >= k
                        least = np.take_along_axis(far, order, axis=1)[np.arange(len(far)), enough.argmax(axis=1)]
                        within[some[open_]] = np.where(enough.any(axis=1), least, np.inf)
                    d = distance([np.maximum(0, np.maximum(low[:, a] - x[:, :, a], x[:, :, a] - high[:, a])) for a in range(3)], shared)
                    t, j = np.nonzero((d <= within[some][:, None]) & (box[None, :] != home[some][:, None]))
                    rows = batch.take(pa.array(some[t]))
                    yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names[:-2]), pa.array(box[j]), pa.array(within[some[t]])], names=names)

    schema = ", ".join([*(f"{c} double" for c in at), "_p int", *(f"{c} double" for c in XYZ), "_box int, _within double"])
    return df.select(*names).mapInArrow(run, schema)


def _mask(columns: list[str]) -> Column:
    return sum((F.when(F.col(c).isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(columns)), F.lit(0))


def _problem(has: Column, shared: Column, at: list[str]) -> list[Column]:
    """The problem's number, and the coordinates that count in it; 0 for the others."""
    return [(has * 8 + shared).cast("int").alias("_p"), *(F.when(shared.bitwiseAND(F.lit(1 << i)) > 0, F.col(c)).otherwise(0.0).alias(x) for i, (c, x) in enumerate(zip(at, XYZ)))]


def neighbours(targets: DataFrame, donors: DataFrame, at: list[str], k: int) -> DataFrame:
    """(*at, _best) of every distinct target that shares a coordinate with a donor: its k nearest donors as structs (d, k, v), nearest first.

    at are three double columns, null where missing; donors also have _k, a key, and _v.
    Of donors at one distance the lower keys come first. Donors without a key are as far as others.
    """
    spark = targets.sparkSession
    targets = targets.select(*at).distinct().withColumn("_has", _mask(at)).where("_has > 0")
    has = [r["_has"] for r in targets.select("_has").distinct().collect()]
    shared = F.col("_t").bitwiseAND(_mask(at))
    rows = donors.withColumn("_t", F.explode(F.array(*map(F.lit, has)).cast("array<int>"))).where(shared > 0).select(*_problem(F.col("_t"), shared, at), "_k", "_v")
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("_p", *XYZ).orderBy("_k")))
    rows = kept(ranked.where(F.col("_r") <= k).drop("_r"))
    n = rows.count()
    every = max(1, n // SAMPLE)
    drawn = rows.where(F.pmod(F.xxhash64("_p", *XYZ, "_k"), F.lit(every)) == 0) if every > 1 else rows
    points: dict[int, list] = {p: [] for p in (r["_p"] for r in rows.select("_p").distinct().collect())}
    for p, own in drawn.select("_p", *XYZ).toPandas().groupby("_p") if n else ():
        points[p] = own[XYZ].to_numpy()
    trees, boxes_before = {}, 0
    for p, own in sorted(points.items()):
        trees[p] = boxes_before, Tree(np.asarray(own, dtype=np.float64).reshape(-1, 3), max(LEAST, LEAF // every))
        boxes_before += trees[p][1].leaves
    rows = _boxed(rows, trees)
    shape = rows.groupBy("_p", "_box").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{c}") for name, f in (("low", F.min), ("high", F.max)) for c in XYZ]).toPandas()
    boxes = {int(p): (g["_box"].to_numpy(np.int32), g[[f"low{c}" for c in XYZ]].to_numpy(), g[[f"high{c}" for c in XYZ]].to_numpy(), g["n"].to_numpy()) for p, g in shape.groupby("_p")}
    asked = targets.withColumn("_s", F.explode(F.sequence(F.lit(1), F.col("_has")))).where(F.col("_s").bitwiseAND(F.col("_has")) == F.col("_s"))
    asked = _boxed(asked.select(*at, *_problem(F.col("_has"), F.col("_s"), at)), trees).withColumn("_within", F.lit(float("inf")))
    first = kept(_search(asked, rows, at, k))
    bound = first.withColumn("_within", F.when(F.size("_near") >= k, F.element_at("_near", -1)["d"]).otherwise(float("inf")))
    second = _search(kept(_spread(bound, boxes, at, k)), rows, at, k)
    both = first.select(*at, "_near").union(second.select(*at, "_near"))
    return both.groupBy(*at).agg(F.slice(F.array_sort(F.flatten(F.collect_list("_near"))), 1, k).alias("_best")).where(F.size("_best") > 0)
