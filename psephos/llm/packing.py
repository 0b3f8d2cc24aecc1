"""Best-fit packing of tokenised documents into sequences, with matching of large pieces.

The lengths of pieces are integers of at most the sequence length, so their histogram
is all that a plan needs, however many pieces there are. The plan is made on the
driver from those few thousand counts; every piece then finds its place by its rank
among the pieces of its length. No piece, only counts, leaves the executors.

Plan: pieces of full length stand alone. Pieces above a third of the capacity, at
most two of which share a sequence, are taken in falling length, each matched with
the longest such piece that still fits. All smaller lengths, falling, go where the
remaining gap is least; where none is wide enough, new sequences open.
"""

from __future__ import annotations

import bisect
import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster, kernels

CAPACITY = 2048
#: Distinct words that a worker remembers the ids of, in each of two generations.
CACHE = 250_000

#: A word of letters that lower case and NFC leave alone, then ASCII punctuation but the apostrophe.
_PLAIN = re.compile("([a-zß-öø-ÿ]*)([!-&(-/:-@\\[-`{-~]*)")


class _Generations(dict):
    """A mapping that computes what it lacks and forgets what was not used lately."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key):
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Encoder:
    """Ids of a text as packed little-endian 32-bit integers, the same as encode(text, add_special_tokens=False).

    The pre-tokeniser never joins across white space, so words are encoded apart and
    remembered. Texts that may hold a special token's string are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in set(shown)]
        self.byte_chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
        self.pieces = _Generations(self._piece)
        self.words = _Generations(self._word)

    def _piece(self, piece: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.byte_chars))]
        return np.array(ids, dtype="<u4").tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if plain := _PLAIN.fullmatch(text.lower()):
            return b"".join(self.pieces[p] for p in plain.groups() if p)
        return self._whole(text)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def __call__(self, text: bytes) -> bytes:
        if b"<|" in text:
            return self._whole(text.decode())
        return b"".join(map(self.words.__getitem__, text.split()))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The process's encoder of that vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def pieces(docs: DataFrame, tokenizer: str, *, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): each document's ids and end_id, cut only where longer than capacity.

    tokenizer is the path of a vocabulary file that every executor can read. A null or
    empty text is end_id alone. A very long text is encoded whole, in memory in
    proportion to it.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        for batch, docs_ in cluster.blocks(batches):
            rows: list[tuple] = []
            for key, doc in zip(batch.column("doc_id").to_pylist(), docs_):
                ids = encode(doc) + end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    own = ids[at : at + 4 * capacity]
                    rows.append((key, piece, at // 4, len(own) // 4, zlib.crc32(own), *([np.frombuffer(own, dtype="<i4")] if with_ids else [])))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.list_(pa.int32())] if with_ids else [])]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


class _Sequences:
    """n sequences of one make: (length, first rank, pieces in each) in order, and the gap left in each."""

    __slots__ = ("n", "items", "gap")

    def __init__(self, n: int, items: list[tuple[int, int, int]], gap: int):
        self.n, self.items, self.gap = n, items, gap

    def split(self, k: int) -> _Sequences:
        """Takes the first k sequences out."""
        head = _Sequences(k, list(self.items), self.gap)
        self.items = [(length, rank + k * each, each) for length, rank, each in self.items]
        self.n -= k
        return head


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[_Sequences]:
    """Sequences for counts[length] pieces of each length, as the module describes."""
    left = {length: n for length, n in counts.items() if n}
    used = dict.fromkeys(left, 0)
    done: list[_Sequences] = []

    def take(length: int, n: int) -> int:
        at = used[length]
        used[length] += n
        left[length] -= n
        return at

    large = sorted(length for length in left if 3 * length > capacity)
    opened: list[_Sequences] = []
    while large:
        length = large[-1]
        n = left[length]
        if not n:
            large.pop()
            continue
        i = bisect.bisect_right(large, capacity - length) - 1
        while i >= 0 and not left[large[i]]:
            i -= 1
        other = large[i] if i >= 0 else None
        if other == length:
            if n >= 2:
                opened.append(_Sequences(n // 2, [(length, take(length, n // 2 * 2), 2)], capacity - 2 * length))
                continue
            other = next((x for x in reversed(large[:i]) if left[x]), None)
        if other is None:
            opened.append(_Sequences(n, [(length, take(length, n), 1)], capacity - length))
        else:
            m = min(n, left[other])
            opened.append(_Sequences(m, [(length, take(length, m), 1), (other, take(other, m), 1)], capacity - length - other))
        if other is not None and not left[other]:
            large.remove(other)

    by_gap: dict[int, list[_Sequences]] = {}
    gaps: list[int] = []

    def put(s: _Sequences) -> None:
        if not s.gap:
            done.append(s)
            return
        if s.gap not in by_gap:
            by_gap[s.gap] = []
            bisect.insort(gaps, s.gap)
        by_gap[s.gap].append(s)

    for s in opened:
        put(s)
    small = [-length for length in left if 3 * length <= capacity]
    heapq.heapify(small)
    while small:
        length = -heapq.heappop(small)
        while n := left[length]:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                own = by_gap[gaps[i]]
                s = own.pop()
                if not own:
                    del by_gap[gaps[i]], gaps[i]
            else:
                s = _Sequences(max(1, n // (capacity // length)), [], capacity)
            each = min(s.gap // length, n)
            k = min(s.n, n // each)
            head = s.split(k) if k < s.n else s
            if head is not s:
                put(s)
            head.items.append((length, take(length, k * each), each))
            head.gap -= each * length
            put(head)
    return done + [s for own in by_gap.values() for s in own]


def places(plan_: list[_Sequences]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, pieces in each sequence, first sequence, offset), by rank."""
    out: dict[int, list[tuple[int, int, int, int]]] = {}
    first = 0
    for s in plan_:
        offset = 0
        for length, rank, each in s.items:
            out.setdefault(length, []).append((rank, each, first, offset))
            offset += length * each
        first += s.n
    return {length: np.array(sorted(rows), dtype=np.int64) for length, rows in out.items()}


def pack(cut_pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut_pieces with sequence_id and offset added.

    cut_pieces must not change between reads (it is read for the histogram and again
    for the ranks): give it through cluster.cut(). No pieces give no rows. The
    histogram has at most capacity rows, and the plan's places are broadcast; their
    number depends on the lengths alone.
    """
    ranked = cluster.gapless(cut_pieces, ["length"], ["doc_id", "piece", "ids_crc32"], "_rank")
    counts = {r["length"]: r["n"] for r in cut_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    spread = cut_pieces.sparkSession.sparkContext.broadcast(places(plan(counts, capacity)))
    kept = [c for c in ranked.columns if c != "_rank"]
    schema = pa_schema = ", ".join(f"`{c}` {t}" for c, t in ranked.dtypes if c != "_rank") + ", sequence_id long, offset long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = spread.value
        for batch in batches:
            lengths, ranks = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            sequence, offset = np.zeros(len(ranks), dtype=np.int64), np.zeros(len(ranks), dtype=np.int64)
            order = np.argsort(lengths, kind="stable")
            bounds = np.flatnonzero(np.diff(lengths[order])) + 1
            for own in np.split(order, bounds) if len(order) else []:
                length = int(lengths[own[0]])
                rows = table[length]
                row = rows[np.searchsorted(rows[:, 0], ranks[own], side="right") - 1]
                within = ranks[own] - row[:, 0]
                sequence[own] = row[:, 2] + within // row[:, 1]
                offset[own] = row[:, 3] + within % row[:, 1] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    return ranked.mapInArrow(run, pa_schema)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, *, text: str = "text", doc_id: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of every document.

    Null doc_ids stay null. Repeated rows are packed each. Other columns are ignored.
    """
    cut_pieces = cluster.cut(pieces(docs, tokenizer or vocabulary(), text=text, doc_id=doc_id, capacity=capacity))
    return pack(cut_pieces, capacity)
