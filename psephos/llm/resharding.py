"""Resharding by minimum-cost flow: near-equal shards, with as few bytes moved as that needs.

Old shard sizes are supplies, new capacities demands; a byte that stays costs 0 and a
byte that moves costs 1 (or what a cost table says). The flow over shards, whose
number is a parameter and not the data's, is solved on the driver. Documents then
follow it: within an old shard they stand in hash order, and running sums of their
sizes cut that order into the blocks that the flow asks for. The running sums are
taken within many small hash ranges and shifted by the ranges' totals, so that no old
shard, however large, is in one task. Large documents go first and what their
rounding leaves is made good with the smaller ones.
"""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from psephos.llm import cluster

#: Bytes that a row has besides its text.
ROW_BYTES = 16
#: Documents are dealt in classes of falling size; a class holds sizes from its bound up.
CLASSES = (16_384, 2_048, 0)
#: Hash ranges of an old shard whose sums are taken apart.
RANGES = 256


def min_cost_flow(supply: list[int], demand: list[int], cost: list[list[int]]) -> list[list[int]]:
    """x[i][j] from supply i to demand j, of least total cost; as much as the smaller side allows.

    Successive shortest paths with potentials over the bipartite residual graph.
    """
    n, m = len(supply), len(demand)
    x = [[0] * m for _ in range(n)]
    left, room = list(supply), list(demand)
    pot_i, pot_j = [0] * n, [min((cost[i][j] for i in range(n)), default=0) for j in range(m)]
    while any(left) and any(room):
        dist_i = [0 if left[i] else None for i in range(n)]
        dist_j: list[int | None] = [None] * m
        via_i: list[int | None] = [None] * n
        via_j: list[int | None] = [None] * m
        heap = [(0, 0, i) for i in range(n) if left[i]]
        sealed: set[tuple[int, int]] = set()
        end = None
        while heap:
            d, side, k = heapq.heappop(heap)
            if (side, k) in sealed:
                continue
            sealed.add((side, k))
            if side == 0:
                for j in range(m):
                    e = d + cost[k][j] + pot_i[k] - pot_j[j]
                    if dist_j[j] is None or e < dist_j[j]:
                        dist_j[j], via_j[j] = e, k
                        heapq.heappush(heap, (e, 1, j))
            elif room[k]:
                end = k
                break
            else:
                for i in range(n):
                    if x[i][k]:
                        e = d - cost[i][k] - pot_i[i] + pot_j[k]
                        if dist_i[i] is None or e < dist_i[i]:
                            dist_i[i], via_i[i] = e, k
                            heapq.heappush(heap, (e, 0, i))
        if end is None:
            break
        far = dist_j[end]
        for i in range(n):
            pot_i[i] += min(far, dist_i[i]) if dist_i[i] is not None else far
        for j in range(m):
            pot_j[j] += min(far, dist_j[j]) if dist_j[j] is not None else far
        path, j = [], end
        while True:
            i = via_j[j]
            path.append((i, j, 1))
            if via_i[i] is None:
                break
            path.append((i, via_i[i], -1))
            j = via_i[i]
        push = min([left[path[-1][0]], room[end], *(x[i][j] for i, j, s in path if s < 0)])
        for i, j, s in path:
            x[i][j] += s * push
        left[path[-1][0]] -= push
        room[end] -= push
    return x


def equal_capacities(total: int, shards: int) -> list[int]:
    return [total // shards + (j < total % shards) for j in range(shards)]


def _blocks(todo: list[list[int]], own: list[int]) -> list[tuple[int, int, int, int]]:
    """(old, new, from, to): the part of a class's bytes in each old shard for each new one, in proportion to what is still to go there."""
    out = []
    for i, (row, size) in enumerate(zip(todo, own)):
        row = [max(0, x) for x in row]
        whole = sum(row)
        if not whole:
            row, whole = [int(j == i % len(row)) for j in range(len(row))], 1
        done = 0
        stays = [i, *(j for j in range(len(row)) if j != i)] if i < len(row) else list(range(len(row)))
        at = 0
        for j in stays:
            if row[j]:
                done += row[j]
                to = size * done // whole
                out.append((i, j, at, to))
                at = to
    return out


def reshard(docs: DataFrame, old_shard: Column, old_shards: int, shards: int, *, text: str = "text", doc_id: str = "doc_id", capacities: list[int] | None = None, cost: list[list[int]] | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, old_shard, shard, slot) of every document.

    size is the text's UTF-8 bytes, none for null, and ROW_BYTES; text_crc32 is 0 for a
    null or empty text. old_shard gives 0 to old_shards - 1; null counts as shard 0.
    capacities default to equal ones. slot is gapless from 0 in each shard. The law is one
    of sizes, so equal texts form no unit: a group of them can be larger than a shard.
    Repeated rows are rows of their own, and may part; a null doc_id is placed like any other.
    An empty table gives no rows. Other columns are ignored.
    """
    t = F.col(text)
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + ROW_BYTES
    key = F.xxhash64(F.lit(9), F.col(doc_id), F.crc32(F.coalesce(t, F.lit("")).cast("binary")))
    klass = sum((F.when(size < bound, 1).otherwise(0) for bound in CLASSES), F.lit(0))
    rows = cluster.cut(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), size.alias("size"), F.crc32(F.coalesce(t, F.lit("")).cast("binary")).alias("text_crc32"),
            F.coalesce(old_shard, F.lit(0)).cast("int").alias("old_shard"), key.alias("_key"), F.pmod(F.shiftright(key, 20), F.lit(RANGES)).cast("int").alias("_range"), klass.cast("int").alias("_class"),
        )
    )
    group = ["_class", "old_shard", "_range"]
    sums = rows.groupBy(*group).agg(F.sum("size").alias("_bytes"))
    spark = docs.sparkSession
    per_class = {(r["_class"], r["old_shard"]): r["b"] for r in sums.groupBy("_class", "old_shard").agg(F.sum("_bytes").alias("b")).collect()}
    old = [sum(per_class.get((c, i), 0) for c in range(len(CLASSES))) for i in range(old_shards)]
    caps = capacities or equal_capacities(sum(old), shards)
    moves = cost or [[int(i != j) for j in range(shards)] for i in range(old_shards)]
    todo = min_cost_flow(old, caps, moves)

    before = Window.partitionBy("_class", "old_shard").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("_start", F.coalesce(F.sum("_bytes").over(before), F.lit(0)))
    within = Window.partitionBy(*group).orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a document belongs to the block that holds the middle of its bytes
    middles = rows.withColumn("_sum", F.sum("size").over(within)).join(F.broadcast(starts.drop("_bytes")), group)
    middles = cluster.cut(middles.withColumn("_middle", F.col("_start") + F.col("_sum") - F.floor(F.col("size") / 2)).drop("_sum", "_start"))
    dealt: DataFrame | None = None
    for c in range(len(CLASSES)):
        own = [per_class.get((c, i), 0) for i in range(old_shards)]
        if not any(own):
            continue
        cuts = spark.createDataFrame(_blocks(todo, own), "old_shard int, shard int, _from long, _to long")
        ends = F.broadcast(cuts.groupBy("old_shard").agg(F.array_sort(F.collect_list(F.struct(F.col("_to").alias("t"), F.col("_from").alias("f"), F.col("shard").alias("s")))).alias("_cuts")))
        hit = F.filter("_cuts", lambda x: (x["f"] < F.col("_middle")) & (F.col("_middle") <= x["t"]))
        part = middles.where(F.col("_class") == c).join(ends, "old_shard").withColumn("shard", F.element_at(hit, 1)["s"]).drop("_cuts")
        dealt = part if dealt is None else dealt.unionByName(part)
        if c + 1 < len(CLASSES):
            for r in part.groupBy("old_shard", "shard").agg(F.sum("size").alias("b")).collect():
                todo[r["old_shard"]][r["shard"]] -= r["b"]
    if dealt is None:
        return cluster.empty(spark, "doc_id long, size long, text_crc32 long, old_shard int, shard int, slot long")
    out = cluster.gapless(cluster.cut(dealt), ["shard"], ["_key", "doc_id", "size"], "slot")
    return out.select("doc_id", "size", "text_crc32", "old_shard", "shard", "slot")


def _numbered(rows: DataFrame, alike: list[str]) -> DataFrame:
    """rows with a number _nth from 0 among those alike. _row is a row's own number, its partition's in the upper bits: rows alike are numbered by partition, so that no task has them all."""
    rows = rows.withColumn("_part", F.shiftright("_row", 33))
    counts = rows.groupBy(*alike, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*alike).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumn("_at", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = F.row_number().over(Window.partitionBy(*alike, "_part").orderBy("_row")) - 1
    return rows.withColumn("_nth", own).join(starts, [*alike, "_part"]).withColumn("_nth", F.col("_nth") + F.col("_at")).drop("_part", "_at")


def rewrite(docs: DataFrame, placed: DataFrame, path: str, *, text: str = "text", doc_id: str = "doc_id", old_shard: Column | None = None) -> list[int]:
    """Writes the shards that gain or lose a document to path/shard=N, texts and all; returns which those are.

    placed is reshard()'s result for docs. Every row of a touched shard is written once,
    null and repeated doc_ids too: rows that are alike in what reshard() places them by
    take its places one each. old_shard is what reshard() was given; without it, docs
    whose other columns could get into a wrong shard raise an error. Shards that keep
    exactly their documents are left alone.
    """
    alike = ["_null", "_id", "_size", "_crc", *(["_old"] if old_shard is not None else [])]
    same = lambda i: (i.isNull().alias("_null"), F.coalesce(i.cast("long"), F.lit(0)).alias("_id"))
    row = F.monotonically_increasing_id().alias("_row")
    at = cluster.cut(placed.select(*same(F.col("doc_id")), F.col("size").alias("_size"), F.col("text_crc32").alias("_crc"), F.col("old_shard").alias("_old"), "shard", "slot", row))
    if old_shard is None and set(docs.columns) - {text, doc_id} and at.groupBy(*alike).agg((F.min("_old") < F.max("_old")).alias("x")).where("x").head(1):
        raise ValueError("rows alike in id and text are in several old shards: old_shard must be given")
    touched = sorted(r[0] for r in at.where("_old <> shard").select(F.explode(F.array("_old", "shard")).alias("s")).distinct().collect())
    t = F.col(text)
    size = F.coalesce(F.octet_length(t), F.lit(0)).cast("long") + ROW_BYTES
    crc = F.crc32(F.coalesce(t, F.lit("")).cast("binary"))
    keyed = cluster.cut(docs.select("*", *same(F.col(doc_id)), size.alias("_size"), crc.alias("_crc"), F.coalesce(F.lit(0) if old_shard is None else old_shard, F.lit(0)).cast("int").alias("_old"), row))
    places = _numbered(at.where(F.col("shard").isin(touched)).select(*alike, "_row", "shard", "slot"), alike).drop("_row")
    places = _numbered(keyed.select(*alike, "_row"), alike).join(places, [*alike, "_nth"]).select("_row", "shard", "slot")
    rows = keyed.join(places, "_row").select(*docs.columns, "shard", "slot")
    rows.repartition("shard", F.pmod(F.col("slot"), F.lit(16))).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    return touched
