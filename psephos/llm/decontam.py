"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items, texts scanned once.

Texts and items are normalised to lower-case words parted by single spaces. A window
is a run of words of an item; the automaton holds every window, spaces at both ends,
so that matches begin and end with words. Places are mapped back to the words, and to
the bytes, of the original text. A benchmark too large for one automaton is cut into
parts, and texts are scanned for one part after another.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from psephos.llm import cluster, kernels

#: Words of a window.
WINDOW = 10
#: Bytes of item text that one automaton may hold, some 200 MB of it; of a larger benchmark each part is searched for in a scan of its own.
AUTOMATON_BYTES = 400_000


def windows(text: bytes, n: int = WINDOW) -> set[bytes]:
    """The item's windows of n words; an item of fewer, but not none, is one."""
    words = kernels.words_of(text)
    return {b" " + b" ".join(words[i : i + n]) + b" " for i in range(max(1, len(words) - n + 1))} if words else set()


def automaton(items: list[tuple[int | None, bytes]], n: int = WINDOW):
    """Windows to (how many words they have, which items they are of); an item without an id has windows, but is not named."""
    import ahocorasick

    owners: dict[bytes, set[int]] = {}
    for item, text in items:
        for w in windows(text, n):
            owners.setdefault(w, set()).update(() if item is None else (item,))
    a = ahocorasick.Automaton()
    for w, own in owners.items():
        a.add_word(w.decode(), (w.count(b" ") - 1, frozenset(own)))
    if owners:
        a.make_automaton()
    return a if owners else None


def hits(a, words: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
    """Maximal runs [from, to) of words inside windows, and the items whose windows occur."""
    if a is None or not words:
        return [], set()
    text = b" " + b" ".join(words) + b" "
    chars = text.decode("utf-8", "replace")
    runs: list[list[int]] = []
    items: set[int] = set()
    ends = None
    for end, (n, own) in a.iter(chars):
        if ends is None:  # a space's place to the number of words before it
            ends = np.flatnonzero(np.frombuffer(chars.encode("utf-32-le"), dtype="<u4") == 32)
        to = int(np.searchsorted(ends, end))
        items |= own
        if runs and to - n <= runs[-1][1]:
            runs[-1][0] = min(runs[-1][0], to - n)
            runs[-1][1] = max(runs[-1][1], to)
            while len(runs) > 1 and runs[-1][0] <= runs[-2][1]:
                last = runs.pop()
                runs[-1] = [min(runs[-1][0], last[0]), max(runs[-1][1], last[1])]
        else:
            runs.append([to - n, to])
    return [(x, y) for x, y in runs], items


def byte_spans(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The bytes of the original text from the first to the last word of each run."""
    if not runs:
        return []
    data, _ = kernels.joined([text])
    starts, ends = kernels.word_bounds(data, kernels.WORD)
    return [(int(starts[a]) - 1, int(ends[b - 1]) - 1) for a, b in runs]


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[list[tuple[int | None, bytes]]]:
    """The items, in blocks of AUTOMATON_BYTES of text; an item of more is a block alone.

    Test sets are the stated, small side of the scan; they pass through the driver a
    block at a time. Items without text are left out.
    """
    block: list[tuple[int | None, bytes]] = []
    held = 0
    rows = benchmark.select(F.col(item_id).alias("i"), F.col(text).alias("t")).where("t is not null").distinct().orderBy("i", "t")
    for r in rows.toLocalIterator():
        t = r["t"].encode()
        if block and held + len(t) > AUTOMATON_BYTES:
            yield block
            block, held = [], 0
        block.append((r["i"], t))
        held += len(t)
    yield block


_automata: dict[str, object] = {}
SPAN = "array<struct<from_byte: long, to_byte: long>>"
KINDS = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("from_byte", pa.int64()), ("to_byte", pa.int64())]))]


def _search(docs: DataFrame, block: list[tuple[int | None, bytes]], window: int, text: str, names: list[str]) -> DataFrame:
    """docs' columns and n_words, n_hit, items and spans, by names, as one automaton finds them."""
    key = uuid.uuid4().hex
    spread = docs.sparkSession.sparkContext.broadcast(block)
    columns = docs.columns
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in zip(names, ("long", "long", "array<string>", SPAN)))).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _automata:
            _automata.clear()
            _automata[key] = automaton(spread.value, window)
        for batch, texts in cluster.blocks(batches, text):
            rows = []
            for doc in texts:
                words = kernels.words_of(doc)
                runs, items = hits(_automata[key], words)
                rows.append((len(words), sum(y - x for x, y in runs), sorted(map(str, items)), [{"from_byte": x, "to_byte": y} for x, y in byte_spans(doc, runs)]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), *(pa.array(c, type=t) for c, t in zip(zip(*rows), KINDS))], names=[*columns, *names])

    return docs.mapInArrow(run, schema)


def _merged(doc: bytes, spans: list[dict]) -> list[tuple[int, int]]:
    """The spans as runs, those without a word between them as one."""
    out: list[tuple[int, int]] = []
    for x, y in sorted((s["from_byte"], s["to_byte"]) for s in spans):
        if out and (x <= out[-1][1] or not kernels.words_of(doc[out[-1][1] : x])):
            out[-1] = (out[-1][0], max(out[-1][1], y))
        else:
            out.append((x, y))
    return out


def scan(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, names: tuple[str, str, str, str] = ("n_words", "n_hit", "items", "spans")) -> DataFrame:
    """docs' other columns, and (by names) n_words, n_hit, items (sorted as strings), spans (bytes from and to) of every document.

    A word inside any occurrence of a window is hit. Texts that are null, empty or
    without words have no words, hits or items; a very long text is scanned whole. Items
    without an id hit words and are not among the items; an empty benchmark hits none.
    Neither ids nor rows need be unique. Columns of docs that are named like a new one
    are replaced. Of a benchmark of several blocks, each is searched for in a scan of
    its own, and what is found is joined to the texts by their 64-bit hash and length.
    """
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in names])
    blocks_ = item_blocks(benchmark, item_id, item_text)
    block, more = next(blocks_), next(blocks_, None)
    if more is None:
        return _search(docs, block, window, text, list(names))

    texts = docs.select(F.col(text).alias("text")).where("text is not null").select("text", F.xxhash64("text").alias("k"), F.octet_length("text").alias("z"))
    found: DataFrame | None = None
    while block:
        own = cluster.cut(_search(texts, block, window, "text", ["n_words", "n_hit", "items", "spans"]).where("n_hit > 0").select("k", "z", "items", "spans").distinct())
        found = own if found is None else found.unionByName(own)
        block, more = more, next(blocks_, None)
    k, z, items, spans = (cluster.fresh([*docs.columns, *names], x) for x in ("_k", "_z", "_items", "_spans"))
    of = found.groupBy("k", "z").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias(items), F.flatten(F.collect_list("spans")).alias(spans)).withColumnsRenamed({"k": k, "z": z})
    both = docs.withColumn(k, F.xxhash64(text)).withColumn(z, F.octet_length(text)).join(of, [k, z], "left")
    kept = docs.columns
    schema = StructType([*docs.schema.fields, *StructType.fromDDL(", ".join(f"`{name}` {kind}" for name, kind in zip(names, ("long", "long", "array<string>", SPAN)))).fields])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, own in cluster.blocks(batches, text):
            rows = []
            for doc, i, s in zip(own, batch.column(items).to_pylist(), batch.column(spans).to_pylist()):
                runs = _merged(doc, s or [])
                rows.append((len(kernels.words_of(doc)), sum(len(kernels.words_of(doc[x:y])) for x, y in runs), i or [], [{"from_byte": x, "to_byte": y} for x, y in runs]))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *(pa.array(c, type=t) for c, t in zip(zip(*rows), KINDS))], names=[*kept, *names])

    return both.mapInArrow(gather, schema)


def digest(scanned: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) of scan()'s rows."""
    return scanned.select(
        F.col(doc_id).cast("long").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", **kw) -> DataFrame:
    """docs without the documents that hold a window, columns as they were.

    Null and empty texts hold none and stay, repeated rows stay or go together, and very
    long texts are scanned whole.
    """
    names = tuple(cluster.fresh(docs.columns, x) for x in ("_n_words", "_n_hit", "_items", "_spans"))
    return scan(docs, benchmark, text=text, names=names, **kw).where(F.col(names[1]) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
