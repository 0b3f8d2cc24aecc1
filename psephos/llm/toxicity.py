"""Toxicity: subword-bag embeddings, averaged, into a linear softmax, trained jointly in numpy.

A word's vector is the mean of those of its character n-grams (3 to 5 bytes with a
mark at either end) and of the word itself, all hashed into one table, so a
misspelling that was never seen shares most of its vector with the word it spells. A
passage of six words is the mean of its words; half of it overlaps the next. The
document's score is its most toxic passage's, so that a few words weigh as much in a
long text as in a short one. Labels are of documents: in training, a toxic document
is held to its most toxic passage, a clean one to its most toxic ones and to others
drawn at random. A toxic document counts the less the less the model finds in it, as
some hold nothing that tells. A table row's step is the smaller the more texts it is in,
so that common n-grams don't drown rare telling ones, and rows in too few texts are
not learned at all, so that no text is learned by heart.

Everything between a table row and the two scores is linear. The trained model is
hence folded into one number for each table row, and scoring is a lookup.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster, kernels
from psephos.llm.kernels import U, mix
from psephos.llm.langid import fold

#: The bounded sample of labelled rows that is learned from: clean and toxic texts, and bytes of a text at most.
PER_LABEL, SAMPLE_BYTES = (6000, 2000), 6_144
BITS, WIDTH, HALF = 20, 8, 3
#: Passages that training takes at a time.
PASSAGES = 50_000
#: Momentum descent; after WARM epochs in which all passages count.
EPOCHS, WARM, RATE, MOMENTUM, SEED = 50, 4, 1000.0, 0.9, 6
#: A row's step is RATE over the number of its texts to this power; rows in fewer than FEWEST are not learned.
POWER, FEWEST = 0.7, 3
#: Of a clean text, its most toxic passages, how much they weigh, and about how many others are drawn.
HARD, WEIGHT, DRAWN = 4, 3.0, 8
#: What a toxic text counts at least.
FLOOR = 0.2
THRESHOLD = 0.3


def features(docs: list[bytes]) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray, np.ndarray]:
    """N-grams' table rows with whether they are in a word (for each n, by start), starts and ends of words, and each text's first word."""
    data, at = kernels.joined(docs)
    starts, ends = kernels.word_bounds(data, kernels.WORD)
    own = kernels.WORD[data]
    b = np.where(own, data, 1).astype(U)
    apart = np.concatenate(([0], np.cumsum(~own)))
    grams = []
    code = b[:-1] << U(8) | b[1:]
    for n in (3, 4, 5):
        code = code[:-1] << U(8) | b[n - 1 :]
        inside = apart[n - 1 : n - 1 + len(code)] == apart[1 : 1 + len(code)]
        grams.append(((mix(code + U(n)) >> U(64 - BITS)).astype(np.int32), inside))
    return grams, starts, ends, np.searchsorted(starts, at)


def whole_words(words: np.ndarray) -> np.ndarray:
    return (mix(words + U(99)) >> U(64 - BITS)).astype(np.int32)


def word_values(docs: list[bytes], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The mean table value of each word's features; its hash; each text's first word."""
    grams, starts, ends, first = features(docs)
    if not len(starts):
        return np.zeros(0), np.zeros(0, dtype=U), first
    words = kernels.word_hashes(kernels.joined(docs)[0], starts, ends)
    total = np.zeros(len(grams[0][0]), dtype=np.float64)
    count = np.zeros(len(total), dtype=np.int32)
    for rows, inside in grams:
        total[: len(rows)] += np.where(inside, table[rows], 0)
        count[: len(rows)] += inside
    values = np.add.reduceat(total, starts - 1) + table[whole_words(words)]
    return values / (np.add.reduceat(count, starts - 1) + 1), words, first


def passages(first: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each half passage: its first word, its number of words, and its text."""
    sizes = np.diff(np.append(first, n_words))
    halves = -(-sizes // HALF)
    doc = np.repeat(np.arange(len(first)), halves)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(halves) - halves, halves)
    at = np.repeat(first, halves) + within * HALF
    size = np.minimum(HALF, np.repeat(sizes, halves) - within * HALF)
    return at, size, doc


def again(word: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether each word stood before in its half passage; it then adds nothing, so that repetition doesn't heat a text up."""
    half = np.repeat(np.arange(len(size), dtype=U), size)
    order = np.argsort(mix(word.astype(U)) ^ (half * U(kernels.BASE)), kind="stable")
    out = np.zeros(len(word), dtype=bool)
    out[order[1:]] = (word[order[1:]] == word[order[:-1]]) & (half[order[1:]] == half[order[:-1]])
    return out


def best_passage(values: np.ndarray, words: np.ndarray, first: np.ndarray, n_docs: int) -> np.ndarray:
    """The largest mean of a passage's words, for each text; minus infinity without words. words are the words' hashes."""
    at, size, doc = passages(first, len(values))
    out = np.full(n_docs, -np.inf)
    if len(doc):
        total = np.add.reduceat(np.where(again(words, size), 0, values), at)
        np.maximum.at(out, doc[np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))], (total / size)[np.append(True, doc[1:] != doc[:-1])])
        two = np.flatnonzero(doc[1:] == doc[:-1])
        np.maximum.at(out, doc[two], (total[two] + total[two + 1]) / (size[two] + size[two + 1]))
    return out


@dataclass
class Model:
    table: np.ndarray  # log odds that a feature adds
    bias: float

    constant: bool = False  # one score for all texts

    def scores(self, docs: list[bytes]) -> np.ndarray:
        if self.constant:
            return np.full(len(docs), self.bias)
        values, words, first = word_values(docs, self.table)
        best = best_passage(values, words, first, len(docs))
        return 1 / (1 + np.exp(-np.clip(np.where(np.isinf(best), -30, best + self.bias), -30, 30)))


def _moved(value: np.ndarray, velocity: np.ndarray, step: np.ndarray) -> None:
    velocity *= MOMENTUM
    velocity -= step
    value += velocity


def fit(texts: list[bytes], toxic: list[int], epochs: int = EPOCHS) -> Model:
    """Trains embeddings and softmax together over the passages that count in each epoch.

    Without texts of both labels every text gets one score, the share of toxic ones, 0 if there are none.
    """
    rng = np.random.default_rng(SEED)
    y = np.array(toxic, dtype=np.int64)
    if not (0 < y.sum() < len(y)):
        return Model(np.zeros(1), float(y.mean()) if len(y) else 0.0, True)
    known: dict[int, bytes] = {}
    hashes, sizes = [], []
    for i in range(0, len(texts), 100):
        data, at = kernels.joined(texts[i : i + 100])
        starts, ends = kernels.word_bounds(data, kernels.WORD)
        own = kernels.word_hashes(data, starts, ends)
        hashes.append(own)
        sizes.append(np.diff(np.append(np.searchsorted(starts, at), len(starts))))
        for h, j in zip(*(x.tolist() for x in np.unique(own, return_index=True))):
            if h not in known:
                known[h] = bytes(data[starts[j] : ends[j]])
    hashes, sizes = np.concatenate(hashes), np.concatenate(sizes)
    if not len(hashes):
        return Model(np.zeros(1), float(y.mean()), True)
    first = np.cumsum(sizes) - sizes
    distinct = np.unique(hashes)
    of = np.searchsorted(distinct, hashes).astype(np.int32)
    grams, starts, ends, _ = features([known[h] for h in distinct.tolist()])
    del known
    row, word = [whole_words(distinct)], [np.arange(len(distinct), dtype=np.int32)]
    length = ends - starts
    for n, (rows, _) in zip((3, 4, 5), grams):
        for j in range(int(length.max())):
            w = np.flatnonzero(length + 3 - n > j)
            row.append(rows[starts[w] - 1 + j])
            word.append(w.astype(np.int32))
    row, word = np.concatenate(row), np.concatenate(word)
    order = np.argsort(word, kind="stable")
    row, word = row[order], word[order]
    used = np.unique(row)  # features never met stay 0
    row = np.searchsorted(used, row).astype(np.int32)
    size = len(used)
    begin = np.searchsorted(word, np.arange(len(distinct) + 1))
    k = np.diff(begin).astype(np.float32)
    del grams, order
    in_texts = np.unique(of.astype(np.int64) * len(texts) + np.repeat(np.arange(len(texts)), sizes)) // len(texts)
    texts_of = np.bincount(row, weights=np.bincount(in_texts, minlength=len(distinct))[word], minlength=size)
    step = (RATE * (texts_of >= FEWEST) / np.power(texts_of + 1, POWER)).astype(np.float32)
    del in_texts, texts_of
    half_at, half_size, half_doc = passages(first, len(hashes))
    fresh = (~again(hashes, half_size)).astype(np.float32)
    nxt = np.append(half_doc[1:] == half_doc[:-1], False)
    count = half_size.copy()
    count[nxt] += half_size[1:][nxt[:-1]]
    own_passages = np.bincount(half_doc, minlength=len(y))
    del hashes

    e = rng.uniform(-1e-3, 1e-3, (WIDTH, size)).astype(np.float32) * (step > 0)
    w = rng.normal(0, 1, (WIDTH, 2)).astype(np.float32)
    w /= np.linalg.norm(w[:, 1] - w[:, 0])
    bias = np.zeros(2, dtype=np.float32)
    velocity = [np.zeros_like(x) for x in (e, w, bias)]
    for epoch in range(epochs):
        vector = np.stack([np.add.reduceat(own[row], begin[:-1]) for own in e], axis=1) / k[:, None]
        value = vector @ (w[:, 1] - w[:, 0])
        halves = np.add.reduceat(value[of].astype(np.float64) * fresh, half_at)
        total = halves.copy()
        total[nxt] += halves[1:][nxt[:-1]]
        mean = total / count
        order = np.lexsort((-mean, half_doc))
        doc = half_doc[order]
        rank = np.arange(len(order)) - np.searchsorted(doc, doc)
        drawn = (rank < HARD) | (rng.random(len(order)) < DRAWN / own_passages[doc])
        counts = np.ones(len(order), dtype=bool) if epoch < WARM else np.where(y[doc] == 1, rank < 1, drawn)
        take, rank, doc = order[counts], rank[counts], doc[counts]
        label = y[doc]
        p = 1 / (1 + np.exp(-np.clip(mean[take] + bias[1] - bias[0], -30, 30)))
        if epoch < WARM:
            weight = 1 / own_passages[doc]
        else:
            weight = np.where(label == 1, np.clip(2 * p, FLOOR, 1), np.where(rank < HARD, WEIGHT, 1) / (HARD + DRAWN))
        g = (p - label) * weight / len(y)  # of the toxic logit; the clean one's is the opposite
        per_word = np.zeros(len(distinct))
        for c in range(0, len(take), PASSAGES):
            part = take[c : c + PASSAGES]
            n = count[part]
            ends_ = np.cumsum(n)
            places = np.repeat(half_at[part], n) + (np.arange(ends_[-1]) - np.repeat(ends_ - n, n))
            per_word += np.bincount(of[places], weights=np.repeat(g[c : c + PASSAGES] / n, n) * fresh[places], minlength=len(distinct))
        per_row = np.bincount(row, weights=(per_word / k)[word], minlength=size).astype(np.float32)
        to_w = vector.T @ per_word.astype(np.float32)
        for d in range(WIDTH):
            _moved(e[d], velocity[0][d], step * per_row * (y.sum() * (w[d, 1] - w[d, 0])).astype(np.float32))
        _moved(w, velocity[1], 0.01 * np.stack((-to_w, to_w), axis=1))
        _moved(bias, velocity[2], 0.1 * np.array([-g.sum(), g.sum()], dtype=np.float32))
    table = np.zeros(1 << BITS)
    table[used] = (w[:, 1] - w[:, 0]) @ e
    return Model(table, float(bias[1] - bias[0]))


def sample(docs: DataFrame, labels: DataFrame) -> tuple[list[bytes], list[int]]:
    """Texts and labels of at most PER_LABEL distinct texts of each label, those of the smallest hashes.

    docs are (doc_id, text), labels (doc_id, toxic); labels that are null or neither 0 nor 1 are left out.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = docs.where(F.octet_length("text").between(1, SAMPLE_BYTES)).select("doc_id", "text", F.xxhash64("text").alias("h"))
    own = hashed.drop("text").join(known, "doc_id").select("toxic", "h").distinct()
    picked = [(label, r["h"]) for label in (0, 1) for r in own.where(F.col("toxic") == label).orderBy("h").limit(PER_LABEL[label]).collect()]
    # texts are read for the chosen hashes only, so that no others are shuffled
    chosen = F.broadcast(docs.sparkSession.createDataFrame(picked, "toxic int, h long"))
    texts: list[bytes] = []
    toxic: list[int] = []
    for r in hashed.drop("doc_id").join(chosen, "h").distinct().orderBy("toxic", "h", "text").toLocalIterator():
        texts.append(r["text"].encode())
        toxic.append(r["toxic"])
    return texts, toxic


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs' other columns and score, the probability of label 1, of every document's whole text.

    Texts that are null, empty or without words get the lowest score, unless all texts
    get one, as nothing was learned. A very long text is a block of its own; repeated
    rows get one score each. A column of that name is replaced.
    """
    kept = [c for c in docs.columns if c != "score"]
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in cluster.blocks(batches, text):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(spread.value.scores(texts), type=pa.float64())], names=[*kept, "score"])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def detect(docs: DataFrame, labels: DataFrame, *, folds: int = 4, held_out: int = 2, threshold: float = THRESHOLD, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted): learned from labelled documents outside of one fold, scored for all.

    A null doc_id is in no fold: it is neither learned from nor held out. Without both
    labels to learn from, all documents get one score: 0 without any label or with clean
    ones only, else 1. Repeated rows are scored each.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    model = fit(*sample(rows.where(fold("doc_id", folds) != held_out), labels.select(F.col(doc_id).cast("long").alias("doc_id"), "toxic")))
    out = score(rows.withColumn("held_out", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False))), model)
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
