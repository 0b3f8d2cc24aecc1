"""N-gram Jaccard join by vertical partitioning of the global n-gram order.

Each text is the set of its distinct word n-grams, as 64-bit hashes; their numeric
order is the global order. That order is cut into fragments, so a set is cut into the
fragments' parts, and the overlap of two sets is the sum of their overlaps in each
fragment.

Shared parts. Sets a and b with 100 * |a & b| >= t * |a | b| differ in at most
D = (|a| + |b|) * (100 - t) / (100 + t) elements, and so in at most D fragments. Cut in
about 1.5 D fragments, a set that links has all its parts but D in common with one other
set. Each task counts which of the parts that it met several sets have; a set of which
more than D parts are its alone goes no further. Only shared parts are sent, and a
part of several n-grams is rarely shared by chance. Every task that met some of a set's
parts sends a count for it, so a set with all its parts shared would have as many counts as there are
tasks. Therefore a few parts of each set, the least by hash, are counted before: a set that
shares several of these goes on uncounted, as one that may link, and its parts are sent without saying whose they are.

Candidates. Cut in more than D fragments, two sets that link agree in at least one
entirely. The number of fragments follows from the size, in
levels that grow by about a third, and each set is cut for every level that the larger set of a
pair it may link in can have. Sets that share an equal part of a fragment are
candidates. Empty parts say nothing: each level has so many fragments more that equal
parts can't all be empty, and a set that is still emptier gives its empty parts too.
No pair can be missed. Parts meet as packed arrays, one shuffle, and each map task
sends one set for each part, so that parts shared by very many sets stay light. What a
task finds to hang together leaves it as a forest: at most one edge for each set.

Tasks. Parts are dealt to as many tasks as the session shuffles to, in
pieces of bounded size that a task takes one after another; its counts and forests are
sent once, or whenever they have reached a bounded size.

Verification. Candidates are grouped by connectivity, and each group's sets are
compared in one task, fragment by fragment: presence matrices give all partial
overlaps of a fragment at once, the sum of which is the exact overlap. Groups that are
too large for a task are cut by size and dealt to chunks; each pair of chunks of sizes
that can link is a task, in rounds of bounded size. No pairs are written: a task gives each set's number of links and a root of its links.

Equal sets are one vertex throughout. Vertices, parts and n-grams have 64-bit hashes. Where
shared parts are counted, a set's tag has 48 bits, and so it would take two different sets
with one tag that share parts to lose one.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster, kernels
from psephos.llm.kernels import U, mix

#: Most sets, and most n-grams, of one chunk of a group of candidates.
CHUNK_SETS, CHUNK_GRAMS = 512, 1_000_000
#: N-grams that may be sent to chunks in one round, if the sets hold fewer than half of it.
ROUND = 50_000_000
#: Parts that a map task holds before it sends them.
HELD_PARTS = 1_000_000
#: Parts of one piece that a task takes at a time.
PIECE = 200_000
#: Tags have 48 bits: with each part one is sent.
TAG = (1 << 48) - 1
#: Of each set at each level so many parts, the least by hash, are counted first; a set that shares LIKELY of them is kept without counting all.
LEAST, LIKELY = 8, 3
#: Bits, as a power of 2, in which sets that are kept so, and texts that are wanted, are marked.
MARKS = 26
#: Counts, or edges, that a task gathers before it sends them.
GATHERED = 500_000
#: Fragments in which shared parts are counted, as a multiple of the elements in which linked sets can differ.
COUNTED = 1.5
#: Rows of ids, about 10 MB, that may be broadcast to their texts; beyond that both sides are shuffled, with the same result.
BROADCAST_ROWS = 200_000
#: N-grams of one fragment's presence matrix.
FRAGMENT = 4096


def most_different(a: int, b: int, percent: int) -> int:
    """Elements in which linked sets of these sizes can differ."""
    return (a + b) * (100 - percent) // (100 + percent)


@functools.lru_cache(maxsize=None)
def sizes(k: int) -> tuple[int, int]:
    """(largest size of the level before, largest size) of a level."""
    below, hi = 0, 4
    for _ in range(k):
        below, hi = hi, hi + max(1, hi * 7 // 20)
    return below, hi


def levels(n: int, percent: int) -> Iterator[int]:
    """The levels of the larger sets of the pairs that a set of n elements can link in."""
    k = 0
    while sizes(k)[1] < n:
        k += 1
    yield k
    while sizes(k)[1] < n * 100 // percent:
        k += 1
        yield k


@functools.lru_cache(maxsize=None)
def level(k: int, percent: int) -> tuple[int, int]:
    """(fragments, empty fragments allowed) of a level; 0 fragments where only equal sets link."""
    below, hi = sizes(k)
    low = max(1, below * percent // 100)
    if not (d := most_different(hi, hi, percent)):
        return 0, 0
    spare = 1
    while True:
        mean = (d + 1 + spare) * math.exp(-low / (d + 1 + spare))
        need = math.ceil(mean + 4 * math.sqrt(mean))
        if spare >= need or spare >= 3 * d + 8:
            return d + 1 + spare, spare
        spare = need


def vertex_of(grams: np.ndarray) -> int:
    """Signed 64-bit identity of a set that is not empty; never 0."""
    with np.errstate(over="ignore"):
        return int(mix(mix(grams).sum(dtype=U).reshape(1) + U(len(grams)) * U(kernels.BASE)).view(np.int64)[0]) or 1


def _cut_up(grams: np.ndarray, fragments: int) -> tuple[np.ndarray, np.ndarray]:
    """Which fragments have n-grams of the sorted set, and where each begins."""
    own = ((grams >> U(32)) * U(fragments)) >> U(32)
    starts = np.concatenate(([0], np.flatnonzero(own[1:] != own[:-1]) + 1))
    return own[starts], starts


def _hashed(weights: np.ndarray, own: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    return mix(np.add.reduceat(weights, starts) + mix(own + U(k << 40)))


def _weights(grams: np.ndarray) -> np.ndarray:
    return mix(grams ^ U(0xA5A5A5A5))


def parts(grams: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of the set's parts, at every level that a pair it links in can have."""
    out = []
    weights = None
    for k in levels(len(grams), percent):
        fragments, spare = level(k, percent)
        if not fragments:
            continue
        weights = _weights(grams) if weights is None else weights
        own, starts = _cut_up(grams, fragments)
        out.append(_hashed(weights, own, starts, k))
        if fragments - len(starts) > spare:
            void = np.setdiff1d(np.arange(fragments, dtype=U), own)
            out.append(mix(mix(void + U(k << 40)) ^ U(0x5851F42D4C957F2D)))
    return np.concatenate(out) if out else np.zeros(0, dtype=U)


def counted(grams: np.ndarray, vertex: int, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """(tag, need, fragments, starts, level) of every level at which the set can link with a different one.

    The set has at least need parts in common with any set that it links with at that
    level. The tag stands for the vertex at the level.
    """
    n = len(grams)
    for k in levels(n, percent):
        hi = sizes(k)[1]
        if not (d := most_different(hi, hi, percent)):
            continue
        own, starts = _cut_up(grams, int(COUNTED * d) + 1)
        tag = int(mix(np.array([vertex], dtype=np.int64).view(U) + U(k + 1))[0] & U(TAG)) or 1
        yield tag, len(own) - most_different(n, min(hi, n * 100 // percent), percent), own, starts, k


def least(found: np.ndarray) -> np.ndarray:
    """The least parts of a set, LEAST of them or all."""
    return np.partition(found, LEAST - 1)[:LEAST] if len(found) > LEAST else found


def digests(docs: DataFrame, k: int, percent: int) -> DataFrame:
    """(doc_id, text_hash, n_shingles, vertex, needs) of docs' (doc_id, text); vertex is null for an empty set, needs are its (tag, need, least parts)."""
    names = ["doc_id", "text_hash", "n_shingles", "vertex", "needs"]
    needs_type = pa.list_(pa.struct([("tag", pa.int64()), ("need", pa.int64()), ("least", pa.binary())]))

    def needs_of(s: np.ndarray, v: int) -> Iterator[dict]:
        weights = _weights(s)
        for tag, need, own, starts, at in counted(s, v, percent):
            yield {"tag": tag, "need": need, "least": least(_hashed(weights, own, starts, at)).tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in cluster.blocks(batches):
            sets = kernels.shingle_sets(texts, k)
            vertices = [vertex_of(s) if len(s) else None for s in sets]
            n = pa.array([len(s) for s in sets], type=pa.int64())
            needs = [list(needs_of(s, v)) if v else [] for s, v in zip(sets, vertices)]
            columns = [batch.column("doc_id"), batch.column("text_hash"), n, pa.array(vertices, type=pa.int64()), pa.array(needs, type=needs_type)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, text_hash long, n_shingles long, vertex long, needs array<struct<tag: long, need: long, least: binary>>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, schema)


def forest(edges: np.ndarray) -> np.ndarray:
    """(node, root) for every node but the roots of the edges' components; roots are the least nodes."""
    ids, at = np.unique(edges, return_inverse=True)
    u, v = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        a, b = label[u], label[v]
        low = np.minimum(a, b)
        lower = label.copy()
        for ends in (u, v, a, b):
            np.minimum.at(lower, ends, low)
        lower = lower[lower]
        if (lower == label).all():
            break
        label = lower
    below = label != np.arange(len(ids))
    return np.stack((ids[below], ids[label[below]]), axis=1)


def _summed(counts: np.ndarray) -> np.ndarray:
    """Rows (tag, count), one for each tag."""
    ids, at = np.unique(counts[:, 0], return_inverse=True)
    return np.stack((ids, np.bincount(at, weights=counts[:, 1], minlength=len(ids)).astype(np.int64)), axis=1)


def _gathered(pieces: Iterator[np.ndarray], reduce, names: list[str]) -> Iterator[pa.RecordBatch]:
    """The pieces' rows of two numbers, reduced together, in batches of bounded size."""
    held, n = [], 0

    def send(rows: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=names)

    for piece in pieces:
        held.append(piece)
        n += len(piece)
        if n > GATHERED:
            held = [reduce(np.concatenate(held))]
            n = len(held[0])
            if n > GATHERED // 2:
                yield send(held[0])
                held, n = [], 0
    if n:
        yield send(reduce(np.concatenate(held)))


def _star(parts_: np.ndarray, vertices: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each part once, a vertex of it, and rows (vertex, least) that connect the vertices of a part; the vertex of a part is the least one connected."""
    order = np.argsort(parts_, kind="stable")
    parts_, vertices = parts_[order], vertices[order]
    head = np.concatenate(([True], parts_[1:] != parts_[:-1])) if len(parts_) else np.zeros(0, dtype=bool)
    first = vertices[head]
    center = first[np.cumsum(head) - 1] if len(parts_) else vertices
    apart = center != vertices
    edges = forest(np.stack((vertices[apart], center[apart]), axis=1))
    at = np.minimum(np.searchsorted(edges[:, 0], first), max(0, len(edges) - 1))
    if len(edges):
        first = np.where(edges[at, 0] == first, edges[at, 1], first)
    return parts_[head], first, edges


def _pieces(partitions: int, n: int) -> int:
    """The number of pieces that n n-grams are dealt to."""
    return partitions * (4 + n // (partitions * PIECE))


def _packed(bounds: np.ndarray, keys: np.ndarray, vertices: np.ndarray) -> Iterator[tuple[int, int, bytes, bytes, bytes]]:
    """(piece, keys, vertices, which of them) of each piece that has keys."""
    for i in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
        own = slice(bounds[i], bounds[i + 1])
        table, at = np.unique(vertices[own], return_inverse=True)
        yield i, keys[own].tobytes(), table.tobytes(), at.astype("<u2" if len(table) <= 1 << 16 else "<u4").tobytes()


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    keys = np.frombuffer(row["keys"], dtype=U)
    at = np.frombuffer(row["at"], dtype="<u2" if len(row["at"]) == 2 * len(keys) else "<u4")
    return keys, np.frombuffer(row["vertices"], dtype=np.int64)[at]


PACKED, PACKED_NAMES = "pid int, keys binary, vertices binary, at binary, rest binary", ["pid", "keys", "vertices", "at", "rest"]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), (pa.int32(), *[pa.binary()] * 4))], names=PACKED_NAMES)


def _dealt(keys: np.ndarray, deal: int) -> np.ndarray:
    """Where each piece begins among sorted keys, which are spread evenly."""
    return np.searchsorted(((keys >> U(32)) * U(deal)) >> U(32), np.arange(deal + 1, dtype=U))


def _short(tags: np.ndarray) -> bytes:
    """Six bytes of each tag."""
    return np.ascontiguousarray(tags, dtype="<i8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _tags(short: bytes, n: int) -> np.ndarray:
    """n tags, those given and then 0."""
    out = np.zeros((n, 8), dtype=np.uint8)
    given = np.frombuffer(short, dtype=np.uint8).reshape(-1, 6)
    out[: len(given), :6] = given
    return out.view("<i8").reshape(-1)


def _shared(rows: DataFrame, sets: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[int, bool, np.ndarray]]], partitions: int, n: int) -> DataFrame:
    """(tag, shared), in several rows to be summed: how many of the parts of each tag other sets have too, or more; no row if none.

    sets gives (tag, whether to count for it, parts). A map task sends each part once: one that
    several of its sets have is counted for them at once and sent without a tag, which says so; parts of
    sets that aren't counted go without a tag too. Within a piece parts have 32-bit keys: two that
    are the same by chance can only add to what a set shares. n is at least about the number of parts.
    """
    deal = _pieces(partitions, n)

    def send(found: list[np.ndarray], tags: list[int]) -> Iterator[pa.RecordBatch]:
        if not found:
            return
        p, at = np.concatenate(found), np.repeat(np.arange(len(found)), [len(x) for x in found])
        order = np.argsort(p, kind="stable")
        p, at = p[order], at[order]
        head = np.concatenate(([True], p[1:] != p[:-1]))
        group = np.cumsum(head) - 1
        several = np.bincount(group, minlength=int(head.sum())) > 1
        v = np.array(tags, dtype=np.int64)
        shared = np.where(v != 0, np.bincount(at[several[group]], minlength=len(v)), 0)
        p, at = p[head], at[head]
        bare = several | (v[at] == 0)
        bounds = _dealt(p, deal)
        order = np.lexsort((bare, np.repeat(np.arange(deal), np.diff(bounds))))  # in each piece those with a tag first
        keys, own = p[order].astype("<u4").tobytes(), _short(v[at[order]][~bare[order]])
        ends = np.concatenate(([0], np.cumsum(~bare[order])))[bounds] * 6
        full = np.flatnonzero(np.diff(bounds)).tolist()
        pieces = [*full, int(mix(p[:1])[0] % U(deal))]
        columns = ([keys[4 * bounds[i] : 4 * bounds[i + 1]] for i in full] + [b""], [own[ends[i] : ends[i + 1]] for i in full] + [b""], [b""] * len(full) + [np.stack((v, shared), axis=1)[shared > 0].tobytes()])
        yield pa.RecordBatch.from_arrays([pa.array(pieces, type=pa.int32()), *(pa.array(c, type=pa.binary()) for c in columns)], names=["pid", "keys", "tags", "rest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = []
        tags: list[int] = []
        seen: set[int] = set()
        held = 0
        for tag, count, some in sets(batches):
            if tag in seen:
                continue
            seen.add(tag)
            found.append(some)
            tags.append(tag if count else 0)
            held += len(some)
            if held >= HELD_PARTS:
                yield from send(found, tags)
                found, tags, held, seen = [], [], 0, set()
        yield from send(found, tags)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for run in cluster.runs(batches, "pid"):
            p = np.frombuffer(b"".join(row["keys"] for row in run), dtype="<u4")
            v = np.concatenate([_tags(row["tags"], len(row["keys"]) // 4) for row in run])
            order = np.argsort(p, kind="stable")
            p, v = p[order], v[order]
            head = np.concatenate(([True], p[1:] != p[:-1])) if len(p) else np.zeros(0, dtype=bool)
            group = np.cumsum(head) - 1
            # a set's own copies in other tasks are not other sets, unless it was counted there
            apart = np.bincount(group, weights=(v != v[head][group]) | (v == 0), minlength=int(head.sum())) > 0
            met = v[apart[group] & (v != 0)]
            # a set's copies in several tasks each count, which can only add to what a set that links has
            yield _summed(np.concatenate([np.stack((met, np.ones_like(met)), axis=1), *(np.frombuffer(row["rest"], dtype=np.int64).reshape(-1, 2) for row in run)]))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(counts(batches), _summed, ["tag", "shared"])

    packed = rows.mapInArrow(cut, "pid int, keys binary, tags binary, rest binary").repartition(partitions, "pid").sortWithinPartitions("pid")
    return packed.mapInArrow(meet, "tag long, shared long")


def likely(known: DataFrame, partitions: int, n: int) -> DataFrame:
    """The vertices of digests that share several of their least parts with other sets. n is the number of those parts, or more."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
        for batch in batches:
            for tag, some in zip(batch.column("tag").to_pylist(), batch.column("least")):
                yield tag, True, np.frombuffer(some.as_buffer(), dtype=U)

    needs = known.select("vertex", F.explode("needs").alias("need"))
    shared = _shared(needs.select("need.tag", "need.least"), sets, partitions, n).groupBy("tag").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= LIKELY)
    # equal sets have one tag: distinct before the join, or all copies would be in one task
    return needs.select("vertex", "need.tag").distinct().join(shared, "tag", "left_semi").select("vertex").distinct()


def shared_parts(docs: DataFrame, k: int, percent: int, partitions: int, n: int, marks: Broadcast) -> DataFrame:
    """(tag, shared), in several rows to be summed, of docs' sets at each level, but for those marked by vertex. n is about the number of n-grams."""

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, bool, np.ndarray]]:
        last: set[int] = set()  # of the block before, so that repeated rows are rarely cut again
        for _, texts in cluster.blocks(batches):
            now: set[int] = set()
            for s in kernels.shingle_sets(texts, k):
                if not len(s) or (v := vertex_of(s)) in now:
                    continue
                now.add(v)
                if v in last:
                    continue
                weights = _weights(s)
                count = not is_set(marks.value, np.array([v]).view(U) >> U(64 - MARKS))[0]
                for tag, _, own, starts, at in counted(s, v, percent):
                    yield tag, count, _hashed(weights, own, starts, at)
            last = now

    return _shared(docs.select("text"), sets, partitions, n)


def candidates(sets: DataFrame, percent: int, partitions: int, n: int) -> DataFrame:
    """(u, v) edges between vertices; every linked pair is connected by them, through pairs that share a part. n is about the number of n-grams."""
    deal = _pieces(partitions, n)

    def send(held: list[tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        p, v, edges = _star(np.concatenate([x for x, _ in held]), np.repeat(np.array([y for _, y in held], dtype=np.int64), [len(x) for x, _ in held]))
        rows = [(*r, b"") for r in _packed(_dealt(p, deal), p, v)]
        if len(edges):
            rows.append((int(mix(edges[:1, 0].astype(U))[0] % U(deal)), b"", b"", b"", edges.tobytes()))
        yield _rows(rows)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, int]] = []
        some = 0
        for batch in batches:
            for v, grams in zip(batch.column("vertex").to_pylist(), batch.column("grams")):
                if len(p := parts(np.frombuffer(grams.as_buffer(), dtype=U), percent)):
                    held.append((p, v))
                    some += len(p)
                if some >= HELD_PARTS:
                    yield from send(held)
                    held, some = [], 0
        yield from send(held)
        cluster.give_back()

    def forests(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        for run in cluster.runs(batches, "pid"):
            p, v = (np.concatenate(c) for c in zip(*(_unpacked(row) for row in run)))
            yield np.concatenate([_star(p, v)[2], *(np.frombuffer(row["rest"], dtype=np.int64).reshape(-1, 2) for row in run)])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _gathered(forests(batches), forest, ["u", "v"])

    packed = sets.select("vertex", "grams").mapInArrow(cut, PACKED).repartition(partitions, "pid").sortWithinPartitions("pid")
    return packed.mapInArrow(meet, "u long, v long")


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Exact overlaps of all pairs: partial counts by fragment of the n-grams' order, summed."""
    grams, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    shared = counts > 1
    column = np.cumsum(shared) - 1
    keep = shared[at]
    row, column = row[keep], column[at[keep]]
    total = np.zeros((len(sets), len(sets)), dtype=np.float64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    width = int(shared.sum())
    for low in range(0, width, FRAGMENT):
        a, b = np.searchsorted(column, (low, low + FRAGMENT))
        part = np.zeros((len(sets), min(FRAGMENT, width - low)), dtype=np.float32)
        part[row[a:b], column[a:b] - low] = 1
        total += part @ part.T
    return total


def roots(linked: np.ndarray) -> np.ndarray:
    """The smallest index that each index reaches, of a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(label)).min(axis=1, initial=len(label)))
        low = low[low]
        if (low == label).all():
            return label
        label = low


def _compare(groups: Iterator[pa.Table], percent: int) -> Iterator[pa.RecordBatch]:
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    names = ["vertex", "root", "links"]

    def send() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=names)

    for group in groups:
        vertex, first = np.unique(group.column("vertex").to_numpy(), return_index=True)
        if len(vertex) < 2:
            continue
        grams = group.column("grams").to_pylist()
        sets = [np.frombuffer(grams[i], dtype=U) for i in first]
        chunk, copies = (group.column(c).to_numpy()[first] for c in ("chunk", "copies"))
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        n = np.array([len(s) for s in sets], dtype=np.float64)
        common = overlaps(sets)
        linked = 100 * common >= percent * (n[:, None] + n[None, :] - common)
        np.fill_diagonal(linked, False)
        if low != high:
            linked &= chunk[:, None] != chunk[None, :]
        out.append((vertex, vertex[roots(linked)], linked @ copies))
        if len(out) >= 500:
            yield send()
            out = []
    if out:
        yield send()


def chunked(members: DataFrame, percent: int) -> tuple[DataFrame, int]:
    """members (vertex, comp, n) with their chunk and the others that it meets, itself included; the n-grams that are sent so.

    A group that is too large for a task is cut by size, in steps of the largest ratio of
    sizes that link: sets link within a step or between neighbouring ones. Only chunks of
    such steps meet.
    """
    small = members.groupBy("comp").agg(((F.count("*") <= CHUNK_SETS) & (F.sum("n") <= CHUNK_GRAMS)).alias("small"))
    step = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent * 1.001)).cast("long")
    stepped = members.join(small, "comp").withColumn("step", F.when(F.col("small"), 0).otherwise(step)).drop("small")
    pieces = stepped.groupBy("comp", "step").agg(F.greatest(F.ceil(F.count("*") / CHUNK_SETS), F.ceil(F.sum("n") / CHUNK_GRAMS)).cast("long").alias("pieces"), F.sum("n").alias("grams"))
    pieces = cluster.cut(pieces)
    near = pieces.select("comp", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"), F.struct(F.col("step").alias("s"), F.col("pieces").alias("p")).alias("_near"))
    ids = lambda x: F.transform(F.sequence(F.lit(0).cast("long"), x["p"] - 1), lambda i: F.shiftleft(x["s"], 32) + i)
    meets = pieces.join(near.groupBy("comp", "step").agg(F.flatten(F.transform(F.collect_list("_near"), ids)).alias("others")), ["comp", "step"])
    sent = meets.agg(F.sum(F.col("grams") * F.size("others"))).first()[0] or 0
    own = F.shiftleft(F.col("step"), 32) + F.pmod(F.xxhash64("vertex"), F.col("pieces"))
    return stepped.join(meets.drop("grams"), ["comp", "step"]).withColumn("chunk", own), sent


def is_set(marks: np.ndarray, spots: np.ndarray) -> np.ndarray:
    return (marks[spots >> spots.dtype.type(6)] >> (spots & spots.dtype.type(63)).astype(np.int64)) & 1 == 1


def marks_of(rows: DataFrame, spot: Column) -> Broadcast:
    """Bits, one of which is set for each row's spot."""
    bit = F.expr("shiftleft(1L, CAST(_spot & 63 AS INT))")
    words = rows.select(spot.alias("_spot")).select(F.shiftright("_spot", 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()
    marks = np.zeros(1 << (MARKS - 6), dtype=np.int64)
    marks[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return rows.sparkSession.sparkContext.broadcast(marks)


def with_mark(rows: DataFrame, spot: Column, marks: Broadcast) -> DataFrame:
    """rows whose spot is marked."""

    @F.pandas_udf("boolean")
    def is_marked(spots: pd.Series) -> pd.Series:
        return pd.Series(is_set(marks.value, spots.to_numpy()))

    return rows.where(is_marked(spot))


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs' rows of wanted's (doc_id, text_hash), and by chance a few others: what needn't be shuffled to meet wanted stays behind."""
    spot = F.shiftrightunsigned(F.xxhash64("doc_id", "text_hash"), 64 - MARKS)
    return with_mark(docs, spot, marks_of(wanted, spot))


def join(docs: DataFrame, *, k: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) of every document.

    Words are `[^\\x20\\x09-\\x0D]+` of the text, A-Z in lower case. Documents link when
    100 * |a & b| >= percent * |a | b| over their sets of k-word n-grams; a text of fewer
    words, but not none, is one n-gram. A text without words, or null, has n_shingles 0
    and links with nothing. component_id is the smallest doc_id that links reach, n_links
    the number of other documents linked directly. A null doc_id has no component and
    gives none. Repeated rows are copies of each other. Other columns are ignored.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    digest = cluster.cut(digests(docs, k, percent))
    grams, tags = (x or 0 for x in digest.agg(F.sum("n_shingles"), F.sum(F.size("needs"))).first())
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    known = digest.where("doc_id is not null and vertex is not null")
    vertices = known.groupBy("vertex").agg(F.min(F.struct("doc_id", "text_hash")).alias("first"), F.count("*").alias("copies"), F.max("n_shingles").alias("n"))
    # sets that can link with a larger one
    some = known.where(F.col("n_shingles") * (100 - percent) >= percent)
    spot = F.shiftrightunsigned("vertex", 64 - MARKS)
    marks = marks_of(likely(some, partitions, LEAST * tags), spot)
    shared = shared_parts(docs.where("doc_id is not null"), k, percent, partitions, grams, marks)
    shared = cluster.cut(shared.groupBy("tag").agg(F.sum("shared").alias("shared")))
    cluster.release(spark)
    # those that weren't counted, or of which few enough parts are theirs alone
    needs = some.select("vertex", F.explode("needs").alias("need")).select("vertex", "need.tag", "need.need").distinct()
    able = needs.join(shared, "tag", "left").where(F.coalesce("shared", F.lit(0)) >= F.col("need")).select("vertex")
    able = able.union(with_mark(some.select("vertex"), spot, marks)).distinct()
    wanted = cluster.cut(vertices.join(able, "vertex", "left_semi").select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), "vertex", "copies", "n"))

    def cut_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vertex", "copies", "n"]
        last: set[int] = set()  # of the block before, so that repeated rows are rarely cut again
        for batch, texts in cluster.blocks(batches):
            now: set[int] = set()
            fresh = []
            for i, v in enumerate(batch.column("vertex").to_pylist()):
                if v not in last and v not in now:
                    fresh.append(i)
                now.add(v)
            last = now
            if fresh:
                sets = kernels.shingle_sets([texts[i] for i in fresh], k)
                rows = batch.take(pa.array(fresh))
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in names), pa.array([s.tobytes() for s in sets], type=pa.binary())], names=[*names, "grams"])

    tagged = docs.where("doc_id is not null").withColumn("text_hash", F.xxhash64("text"))
    if wanted.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        side = F.broadcast(wanted)
    else:
        side, tagged = wanted, marked(tagged, wanted)
    kept = tagged.join(side, ["doc_id", "text_hash"]).select("text", "vertex", "copies", "n").mapInArrow(cut_sets, "vertex long, copies long, n long, grams binary")
    kept = cluster.cut(kept.dropDuplicates(["vertex"]))  # repeated rows may stand in many tasks
    cluster.release(spark)
    group = cluster.components(candidates(kept, percent, partitions, grams)).select(F.col("node").alias("vertex"), F.col("root").alias("comp"))
    members = cluster.cut(group.join(kept.select("vertex", "n"), "vertex"))
    dealt, sent = chunked(members, percent)
    # what is sent at a time takes no more disk than twice the sets themselves, or 400 MB
    total = members.agg(F.sum("n")).first()[0] or 0
    rounds = -(-sent // max(2 * total, ROUND))
    sets = kept.join(dealt.select("vertex", "comp", "chunk", "others"), "vertex")
    met = sets.withColumn("other", F.explode("others")).select(
        "comp", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "vertex", "copies", "grams"
    )
    found = None
    for r in range(max(1, rounds)):
        some = met.where(F.pmod(F.xxhash64("comp", "low", "high"), F.lit(rounds)) == r) if rounds > 1 else met
        some = cluster.cut(cluster.map_groups(some, ["comp", "low", "high"], lambda groups: _compare(groups, percent), "vertex long, root long, links long"))
        found = some if found is None else found.union(some)
        cluster.release(spark)
    del some
    del sets, met
    cluster.release(spark)

    root = cluster.components(found.select(F.col("vertex").alias("u"), F.col("root").alias("v"))).select(F.col("node").alias("vertex"), "root")
    links = found.groupBy("vertex").agg(F.sum("links").alias("links")).where("links > 0")
    linked = vertices.join(links, "vertex", "left").join(root, "vertex", "left").where("copies > 1 or links > 0")
    linked = linked.select("vertex", F.coalesce("root", "vertex").alias("root"), F.col("first.doc_id").alias("least"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    component = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    special = linked.join(component, "root").select("vertex", "component_id", "n_links")
    return digest.join(special, "vertex", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
    )


def keep_one(docs: DataFrame, *, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one of the smallest doc_id; repeated rows of it become one.

    Documents without words, or without a doc_id, all stay, and so do null and empty
    texts. Of rows that share a doc_id but not a text, the first by text stays. Very long
    texts are compared whole; an empty table stays empty.
    """
    gone_, again_, id_, row_ = (cluster.fresh(docs.columns, x) for x in ("_gone", "_again", "_id", "_row"))
    joined = cluster.cut(join(docs, k=k, percent=percent, text=text, doc_id=doc_id).where("n_links > 0"))
    gone = joined.where("component_id <> doc_id").select(F.col("doc_id").alias(gone_)).distinct()
    left = docs.join(gone, F.col(doc_id) == F.col(gone_), "left_anti")
    again = cluster.cut(joined.where("component_id = doc_id").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias(again_)))
    if not again.head(1):
        return left
    ordered = [text, *(c for c in docs.columns if c != text)]
    one = left.join(again, F.col(doc_id) == F.col(again_), "left_semi")
    one = one.groupBy(F.col(doc_id).alias(id_)).agg(F.min(F.struct(*[F.col(f"`{c}`") for c in ordered])).alias(row_)).select(*[F.col(f"{row_}.`{c}`") for c in docs.columns])
    return left.join(again, F.col(doc_id) == F.col(again_), "left_anti").unionByName(one)
