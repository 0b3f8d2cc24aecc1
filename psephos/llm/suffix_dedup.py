"""Exact removal of repeated passages: common-prefix interval trees over an enhanced suffix array.

A byte goes if a string of `least` bytes that covers it starts anywhere else too.

Which suffixes. Of all k-byte strings within a window of `least` bytes, the one of the
smallest hash is the window's anchor: equal windows have equal anchors at equal
places. A run of windows with one anchor is that anchor's context. Anchors that occur
once are dropped; the others, about one byte position in eighty, are the suffixes that
are sorted. They meet in one shuffle of packed arrays, to which a map task sends each
distinct context once. Contexts that occur twice go as a whole.

Intervals. Different contexts of an anchor are sorted by what follows the anchor's
start; neighbours' common prefixes give, by one scan with a stack, the tree of
common-prefix intervals, each with all its occurrences. In an interval the occurrences
are sorted by what precedes the anchor, backwards: where these left extensions
differ, neighbours tell how far each occurrence's repeat goes to the left; intervals
whose repeats are too short are passed by. Anchors with very many contexts are parted
by more of their surroundings first: a window has the anchor in its first or in its
second half, so occurrences that share a window share the bytes that all windows of
one half cover. This halves on, down to single windows if need be.

Texts are joined with their contexts by content, so documents need no key. Strings
are compared by 64-bit hashes of content (contexts) and by bytes (intervals).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster, kernels
from psephos.llm.kernels import U, mix

LEAST, ANCHOR = 200, 32
#: Contexts of one anchor that a task compares at once.
GROUP = 512
#: Anchors that a map task holds before it sends them.
HELD = 500_000
#: Low bits of a sliding minimum that hold a position; a text may have as many bytes.
PLACE = 31

ROW = np.dtype([("kh", "<u8"), ("ctx", "<u8"), ("key", "<i8"), ("n", "<u4"), ("a", "<u4"), ("left", "u1"), ("right", "u1"), ("many", "u1")])


def anchors(docs: list[bytes], keys: np.ndarray, least: int = LEAST, k: int = ANCHOR) -> np.ndarray:
    """ROWs of every anchor: its hash, its context's hash, whose text, where, and the context's bytes before and from it."""
    data = np.frombuffer(b" ".join(docs), dtype=np.uint8)
    sizes = np.fromiter(map(len, docs), dtype=np.int64, count=len(docs))
    at = np.concatenate(([0], np.cumsum(sizes[:-1] + 1))) if len(docs) else sizes
    w = least - k + 1
    if len(data) < least:
        return np.zeros(0, dtype=ROW)
    s, inverse = kernels.prefix_hash(data), kernels.powers(len(data) + 1)[1]
    kh = mix((s[k:] - s[:-k]) * inverse[: len(data) - k + 1])
    low = ((kh >> U(PLACE)) << U(PLACE)) | np.arange(len(kh), dtype=U)
    pad = -len(low) % w
    tiles = np.concatenate((low, np.full(pad, ~U(0)))).reshape(-1, w)
    ahead = np.minimum.accumulate(tiles, axis=1).ravel()
    behind = np.minimum.accumulate(tiles[:, ::-1], axis=1)[:, ::-1].ravel()
    count = len(data) - least + 1
    place = (np.minimum(behind[:count], ahead[w - 1 : w - 1 + count]) & U((1 << PLACE) - 1)).astype(np.int64)
    doc = np.repeat(np.arange(len(docs)), sizes + 1)[:count]
    valid = np.arange(count) + least <= at[doc] + sizes[doc]
    start = valid.copy()
    start[1:] &= (place[1:] != place[:-1]) | ~valid[:-1]
    end = valid.copy()
    end[:-1] &= (place[1:] != place[:-1]) | ~valid[1:]
    first, last = np.flatnonzero(start), np.flatnonzero(end) + least
    own = place[first]
    out = np.zeros(len(first), dtype=ROW)
    out["kh"], out["left"], out["right"] = kh[own], own - first, last - own
    out["ctx"] = mix((s[last] - s[first]) * inverse[first] + out["left"].astype(U) * U(kernels.BASE) + (last - first).astype(U))
    out["key"], out["n"], out["a"] = keys[doc[first]], sizes[doc[first]], own - at[doc[first]]
    return out


def covers(rows: np.ndarray) -> np.ndarray:
    """(key, n, from, to) of the rows' contexts, as they stand in their texts, overlapping ones joined."""
    rows = rows[np.lexsort((rows["a"].astype(np.int64) - rows["left"], rows["n"], rows["key"]))]
    a = rows["a"].astype(np.int64)
    return join_spans(np.stack((rows["key"], rows["n"].astype(np.int64), a - rows["left"], a + rows["right"]), axis=1))


def join_spans(spans: np.ndarray) -> np.ndarray:
    """Rows (key, n, from, to), sorted so, with those that overlap or touch as one."""
    if not len(spans):
        return spans.reshape(0, 4).astype(np.int64)
    out = [spans[0].tolist()]
    for key, n, a, b in spans[1:].tolist():
        last = out[-1]
        if key == last[0] and n == last[1] and a <= last[3]:
            last[3] = max(last[3], b)
        else:
            out.append([key, n, a, b])
    return np.array(out, dtype=np.int64)


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One row for each distinct context (marked many if it occurs again), the spans that this settles, and for each row whether its anchor has other contexts."""
    rows = rows[np.lexsort((rows["ctx"], rows["kh"]))]
    if not len(rows):
        return rows, np.zeros((0, 4), dtype=np.int64), np.zeros(0, dtype=bool)
    new = np.concatenate(([True], (rows["kh"][1:] != rows["kh"][:-1]) | (rows["ctx"][1:] != rows["ctx"][:-1])))
    group = np.cumsum(new) - 1
    count = np.bincount(group)
    marked = np.bincount(group, weights=rows["many"]) > 0
    many = (count > 1) | marked
    gone = covers(rows[many[group] & (rows["many"] == 0)])
    one = rows[new]
    one["many"] = many
    other = np.zeros(len(one), dtype=bool)
    same = one["kh"][1:] == one["kh"][:-1]
    other[1:] |= same
    other[:-1] |= same
    return one, gone, other


def common(a: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Common prefix lengths of a's rows with the rows before."""
    differ = a[1:] != a[:-1]
    first = np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1])
    return np.minimum(first, np.minimum(na, nb))


def intervals(lcp: list[int], least: int = 1) -> list[tuple[int, int, int]]:
    """(depth, first, last) of every common-prefix interval of at least that depth; lcp[i] is of places i - 1 and i, lcp[0] unused."""
    out: list[tuple[int, int, int]] = []
    stack: list[tuple[int, int]] = []  # depth, first
    for i in range(1, len(lcp) + 1):
        depth = lcp[i] if i < len(lcp) else -1
        first = i - 1
        while stack and stack[-1][0] > depth:
            d, first = stack.pop()
            if d >= least:
                out.append((d, first, i - 1))
        if depth > 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))
    return out


def _matrix(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    n = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
    width = max(1, int(n.max()))
    return np.frombuffer(b"".join(x.ljust(width, b"\x00") for x in strings), dtype=np.uint8).reshape(len(strings), width), n


def repeats(left: list[bytes], right: list[bytes], least: int = LEAST) -> list[tuple[int, int, int]]:
    """(occurrence, bytes to the left, bytes to the right) of the repeats of at least `least` bytes around a shared place.

    left are the bytes before it, backwards. Every repeat of an occurrence with another
    one is within one of those given for it.
    """
    if len(left) == 2:
        r = next((i for i, (x, y) in enumerate(zip(*right)) if x != y), min(map(len, right)))
        d = next((i for i, (x, y) in enumerate(zip(*left)) if x != y), min(map(len, left)))
        return [(0, d, r), (1, d, r)] if d + r >= least else []
    order = sorted(range(len(right)), key=right.__getitem__)
    m, n = _matrix([right[i] for i in order])
    lcp = [0, *common(m, n[1:], n[:-1]).tolist()]
    lefts, ln = _matrix([left[i] for i in order])
    by_left = sorted(range(len(order)), key=lambda i: left[order[i]])
    rank = np.empty(len(order), dtype=np.int64)
    rank[by_left] = np.arange(len(order))
    longest = int(np.sort(ln)[-2])
    out = []
    for depth, i, j in intervals(lcp, max(1, least - longest)):
        members = i + np.argsort(rank[i : j + 1])
        d = common(lefts[members], ln[members[1:]], ln[members[:-1]])
        best = np.maximum(np.concatenate(([0], d)), np.concatenate((d, [0])))
        for x in np.flatnonzero(best + depth >= least).tolist():
            out.append((order[members[x]], int(best[x]), depth))
    return out


SPANS = "key long, n long, start long, stop long"


def _batch(rows: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[:, i]) for i in range(4)], names=["key", "n", "start", "stop"])


def spans(docs: DataFrame, least: int = LEAST, k: int = ANCHOR) -> DataFrame:
    """(key, n, start, stop) of all that goes, by content: key is xxhash64(text), n its bytes. Spans may overlap and repeat."""
    spark = docs.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(partitions, total // 100_000_000 + 1)
    deal = 4 * partitions  # pieces, which a task takes one after another
    texts = docs.where(F.octet_length("text") >= least).select("text", F.xxhash64("text").alias("key"))

    def send(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        one, gone, _ = settle(np.concatenate(held))
        pid = (((mix(one["kh"]) >> U(32)) * U(deal)) >> U(32)).astype(np.int64)
        order = np.argsort(pid, kind="stable")
        bounds = np.searchsorted(pid[order], np.arange(deal + 1))
        rows = [(i, one[order[bounds[i] : bounds[i + 1]]].tobytes(), b"") for i in range(deal) if bounds[i] < bounds[i + 1]]
        if len(gone):
            rows.append((len(gone) % deal, b"", gone.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary()))], names=["pid", "rows", "gone"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        n = 0
        for batch, own in cluster.blocks(batches):
            held.append(anchors(own, batch.column("key").to_numpy(), least, k))
            n += len(held[-1])
            if n >= HELD:
                yield from send(held)
                held, n = [], 0
        yield from send(held)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["kh", "key", "n", "start", "stop", "a", "many"]
        for run in cluster.runs(batches, "pid"):
            one, settled, other = settle(np.concatenate([np.frombuffer(x["rows"], dtype=ROW) for x in run]))
            one = one[other]
            gone = np.concatenate([settled, *(np.frombuffer(x["gone"], dtype=np.int64).reshape(-1, 4) for x in run)])
            a = one["a"].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one["kh"].astype(np.int64), one["key"], one["n"].astype(np.int64), a - one["left"], a + one["right"], a, one["many"].astype(bool))], names=names)
            yield pa.RecordBatch.from_arrays([pa.array([None] * len(gone), type=pa.int64()), *(pa.array(gone[:, i]) for i in range(4)), pa.array(gone[:, 2]), pa.array([True] * len(gone), type=pa.bool_())], names=names)

    packed = texts.mapInArrow(find, "pid int, rows binary, gone binary").repartition(partitions, "pid").sortWithinPartitions("pid")
    met = cluster.cut(packed.mapInArrow(meet, "kh long, key long, n long, start long, stop long, a long, many boolean"))
    del packed
    cluster.release(spark)
    settled = met.where("kh is null").select("key", "n", "start", "stop")

    by_text = met.where("kh is not null").groupBy("key", "n").agg(F.collect_list(F.struct("kh", "start", "stop", "a", "many")).alias("contexts"))
    tagged = docs.where(F.octet_length("text") >= least).select("text", F.xxhash64("text").alias("key"), F.octet_length("text").cast("long").alias("n"))
    fields = "kh long, key long, n long, a long, many boolean, `left` binary, `right` binary"

    def surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        names = ["kh", "key", "n", "a", "many", "left", "right"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary()]
        for batch, own in cluster.blocks(batches):
            rows = []
            columns = (batch.column(c).to_pylist() for c in ("key", "n", "contexts"))
            for text, key, n, contexts in zip(own, *columns):
                if (key, n) in seen:
                    continue
                seen.add((key, n))
                for c in contexts:
                    rows.append((c["kh"], key, n, c["a"], c["many"], text[c["start"] : c["a"]][::-1], text[c["a"] : c["stop"]]))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    by_text = cluster.cut(by_text)  # so that adaptive execution can split the copies of one text
    rows = cluster.cut(tagged.join(by_text, ["key", "n"]).select("text", "key", "n", "contexts").mapInArrow(surroundings, fields))
    del by_text
    cluster.release(spark)
    rows = rows.select("*", F.col("kh").alias("part"), F.lit(0).alias("low"), F.lit(least - k).alias("high"))

    def scan(groups: Iterator[pa.Table]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int, int, int]] = []
        for g in groups:
            if g.num_rows < 2:
                continue
            key, n, a, many, left, right = (g.column(c).to_pylist() for c in ("key", "n", "a", "many", "left", "right"))
            for i, d, r in repeats(left, right, least):
                if not many[i]:
                    out.append((key[i], n[i], a[i] - d, a[i] + r))
            if len(out) >= 10_000:
                yield _batch(np.array(out, dtype=np.int64))
                out = []
        if out:
            yield _batch(np.array(out, dtype=np.int64))

    found = [settled]
    while True:
        sizes = rows.groupBy("part").agg(F.count("*").alias("size")).where("size > 1")
        sized = cluster.cut(sizes)
        small = rows.join(sized.where(F.col("size") <= GROUP), "part").drop("size")
        found.append(cluster.map_groups(small, ["part"], scan, SPANS))
        large = sized.where(F.col("size") > GROUP)
        if not large.head(1):
            break
        rows = cluster.cut(rows.join(large, "part").drop("size"))
        ready = rows.where("low = high and not many")  # all of a window is shared
        found.append(ready.select("key", "n", (F.col("a") - F.col("low")).alias("start"), (F.col("a") + least - F.col("low")).alias("stop")))
        middle = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
        halves = rows.where("low < high").withColumn("_h", F.explode(F.array(F.struct(F.col("low").alias("low"), middle.alias("high")), F.struct((middle + 1).alias("low"), F.col("high").alias("high")))))
        halves = halves.drop("low", "high").select("*", "_h.low", "_h.high").drop("_h")
        # windows that start low to high bytes before the anchor share low bytes to its left and least - high from it on
        halves = halves.where((F.length("left") >= F.col("low")) & (F.length("right") >= least - F.col("high")))
        core = F.xxhash64("kh", "low", "high", F.substring(F.col("left"), F.lit(1), F.col("low")), F.substring(F.col("right"), F.lit(1), least - F.col("high")))
        halves = halves.withColumn("part", core)
        # the bytes that any window of the half can cover; where they are the same again, all of its windows repeat, and one row stands for the rest
        halves = halves.withColumn("left", F.substring(F.col("left"), F.lit(1), F.col("high"))).withColumn("right", F.substring(F.col("right"), F.lit(1), least - F.col("low")))
        halves = cluster.cut(halves.where(F.length("left") + F.length("right") >= least).withColumn("whole", F.xxhash64("part", "left", "right")))
        wholes = halves.groupBy("part", "whole").agg(F.count("*").alias("size"), F.min(F.struct("key", "n", "a")).alias("one"))
        again = wholes.where("size > 1").select("part", "whole", "one")
        alike = cluster.cut(halves.join(again, ["part", "whole"]))
        found.append(alike.where("not many").select("key", "n", (F.col("a") - F.length("left")).alias("start"), (F.col("a") + F.length("right")).alias("stop")))
        rest = halves.join(again.drop("one"), ["part", "whole"], "left_anti")
        rest = rest.unionByName(alike.where(F.struct("key", "n", "a") == F.col("one")).drop("one").withColumn("many", F.lit(True)))
        rows = cluster.cut(rest.drop("whole"))
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out


def with_spans(docs: DataFrame, least: int = LEAST, text: str = "text") -> tuple[DataFrame, str]:
    """docs and a column, whose name is given too: the sorted bytes from and to that go; null where nothing does."""
    key, n, own = (cluster.fresh(docs.columns, x) for x in ("__key", "__n", "__spans"))
    texts = docs.select(F.col(text).alias("text"))
    merged = cluster.cut(spans(texts, least).groupBy("key", "n").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(own)))
    tagged = docs.withColumn(key, F.xxhash64(text)).withColumn(n, F.octet_length(text).cast("long"))
    return tagged.join(merged.withColumnsRenamed({"key": key, "n": n}), [key, n], "left").drop(key, n), own


def _cut(text: bytes, own: list[dict] | None) -> tuple[bytes, int, int]:
    """What is left of the text, bytes removed, removed runs."""
    if not own:
        return text, 0, 0
    runs: list[list[int]] = []
    for x in own:
        if runs and x["start"] <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], x["stop"])
        else:
            runs.append([x["start"], x["stop"]])
    kept, at = [], 0
    for a, b in runs:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    return b"".join(kept), sum(b - a for a, b in runs), len(runs)


def digest(docs: DataFrame, least: int = LEAST, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of every document.

    Matches never cross documents; strings are judged on the input. A null text is
    empty. Repeated rows repeat each other, so they go as a whole from `least` bytes on.
    doc_ids may be null or repeated; other columns are ignored.
    """
    own, spans_ = with_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), least)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in cluster.blocks(batches):
            cuts = [_cut(t, s) for t, s in zip(texts, batch.column(spans_).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, type=pa.int64()) for c in ([len(t) for t in texts], [c[1] for c in cuts], [c[2] for c in cuts])), pa.array([hashlib.sha256(c[0]).hexdigest() for c in cuts])],
                names=names,
            )

    return own.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove(docs: DataFrame, least: int = LEAST, *, text: str = "text") -> DataFrame:
    """docs with what repeats cut out of the text, columns as they were; a character that a cut parts goes.

    Null texts stay null, texts of fewer than `least` bytes as they are, and a text that
    repeats as a whole becomes empty, repeated rows too. Very long texts are taken
    whole. Other columns are passed on, whatever their names.
    """
    own, spans_ = with_spans(docs, least, text)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in cluster.blocks(batches, text):
            was = batch.column(text).is_valid().to_pylist()
            kept = [_cut(t, s)[0].decode("utf-8", "ignore") if v else None for t, s, v in zip(texts, batch.column(spans_).to_pylist(), was)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, type=pa.string()) if c == text else batch.column(c) for c in columns], names=columns)

    return own.mapInArrow(run, docs.schema)
