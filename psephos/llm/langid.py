"""Language identification with string kernels.

A text is the set of its byte n-grams of 1 to 3 bytes (blended spectrum, presence
only), lower-cased, all but letters as spaces. The kernel of two texts is the number
of n-grams they share over the geometric mean of how many each has. Landmarks give a
Nystroem map of it; a ridge regression for each language against the rest is solved
in that map. A block of texts is scored by two matrix products: presence with the
landmarks' presence, and the kernel rows with the weights. N-grams that no landmark
has add nothing to any kernel value, so they are left out of the sets.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster

#: The bounded sample of labelled texts that is learned from: texts in all, texts of a language, and bytes of a text at most. Every language has its part of it.
SAMPLE, PER_LANGUAGE, SAMPLE_BYTES = 32_000, 500, 16_384
#: Landmarks of each language, and in all.
LANDMARKS, ALL_LANDMARKS = 48, 3_072
RIDGE = 1e-2
#: Scores are a softmax of the regressions' values over this.
TEMPERATURE = 0.25
UNDETERMINED = "und"

_SPACED = bytes(b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in _LETTER.finditer(text))


def codes(text: str) -> list[np.ndarray]:
    """N-grams of the text as integers, one array for each n, repeats and all."""
    b = np.frombuffer(text.lower().encode().translate(_SPACED), dtype=np.uint8)
    wide = b.astype(np.int32)
    two = (wide[:-1] << 8) | wide[1:]
    return [b, two, (two[:-1] << 8) | b[2:]]


@dataclass
class Model:
    languages: list[str]
    vocabulary: list[np.ndarray]  # sorted codes, for each n
    landmarks: np.ndarray  # presence, over the root of its n-grams
    weights: np.ndarray  # landmarks x languages
    id: str

    def lookup(self) -> list[np.ndarray]:
        """For each n, from a code to its column; 0 is no column."""
        out, at = [], 1
        for n, own in enumerate(self.vocabulary, 1):
            table = np.zeros(1 << 8 * n, dtype=np.int16 if sum(map(len, self.vocabulary)) < 32_000 else np.int32)
            table[own] = np.arange(at, at + len(own))
            at += len(own)
            out.append(table)
        return out

    def presence(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        p = np.zeros((len(texts), self.landmarks.shape[1] + 1), dtype=np.float32)
        for row, text in zip(p, texts):
            for c, table in zip(codes(text), tables):
                row[table[c]] = 1
        p = p[:, 1:]
        return p / np.sqrt(np.maximum(p.sum(axis=1, keepdims=True), 1))

    def values(self, texts: list[str], tables: list[np.ndarray]) -> np.ndarray:
        return (self.presence(texts, tables) @ self.landmarks.T) @ self.weights


def fit(sample: list[tuple[str, str]], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """From (language, text) pairs, whose first of each language become landmarks, as many of each as fit into ALL_LANDMARKS."""
    of: dict[str, list[str]] = {}
    for lang, text in sample:
        of.setdefault(lang, []).append(text)
    languages = sorted(of)
    each = min(landmarks, max(1, ALL_LANDMARKS // max(1, len(languages))))
    chosen = [text for lang in languages for text in of[lang][:each]][:ALL_LANDMARKS]
    vocabulary = [np.unique(np.concatenate([c[n] for c in map(codes, chosen)] or [np.zeros(0, dtype=np.int32)])) for n in range(3)]
    width = sum(map(len, vocabulary))
    model = Model(languages, vocabulary, np.zeros((0, width), dtype=np.float32), np.zeros((0, 0)), uuid.uuid4().hex)
    if not chosen:
        return model
    tables = model.lookup()
    model.landmarks = model.presence(chosen, tables)
    among = (model.landmarks @ model.landmarks.T).astype(np.float64)
    value, vector = np.linalg.eigh(among)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-6))) @ vector.T
    texts = [t for _, t in sample]
    mapped = np.concatenate([model.presence(texts[i : i + 256], tables) @ model.landmarks.T for i in range(0, len(texts), 256)]) @ root
    target = np.array([[1.0 if lang == own else -1.0 for own in languages] for lang, _ in sample])
    solved = np.linalg.solve(mapped.T @ mapped + ridge * len(sample) / len(chosen) * np.eye(len(chosen)), mapped.T @ target)
    model.weights = (root @ solved).astype(np.float32)
    return model


def sample(docs: DataFrame, lang: str = "lang", text: str = "text") -> list[tuple[str, str]]:
    """(language, text) of at most PER_LANGUAGE distinct texts of each language, fewer of each if they would be more than SAMPLE.

    The texts with the smallest hashes of those of SAMPLE_BYTES at most; the driver
    gets about three times as many as it keeps. Null languages and texts and texts
    without a letter are not learned from.
    """
    usable = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}") & (F.octet_length(text) <= SAMPLE_BYTES))
    usable = usable.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h"))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("own")).orderBy(F.desc("n"), "lang").limit(SAMPLE).collect()
    if not counts:
        return []
    each = max(1, min(PER_LANGUAGE, SAMPLE // len(counts)))
    share = [(r["lang"], min(1_000_003, 3_000_009 * each // r["own"] + 1)) for r in counts]
    part = F.broadcast(docs.sparkSession.createDataFrame(share, "lang string, part long"))  # one row a language, SAMPLE at most
    picked = usable.join(part, "lang").where(F.pmod("h", F.lit(1_000_003)) < F.col("part")).drop("part").distinct()
    own: dict[str, list[str]] = {r["lang"]: [] for r in counts}
    for r in picked.orderBy("h", "lang", "text").limit(8 * each * len(counts)).toLocalIterator():
        if len(own[r["lang"]]) < each and has_letter(r["text"]):
            own[r["lang"]].append(r["text"])
    return [(lang, t) for lang in sorted(own) for t in own[lang]]


_tables: dict[str, list[np.ndarray]] = {}


def predict(docs: DataFrame, model: Model, text: str = "text", names: tuple[str, str, str] = ("lang_pred", "score", "value")) -> DataFrame:
    """docs' other columns and, by names, each document's language, score and the regression's value for that language, from its whole text and nothing else.

    A text that is null, empty or without a letter is UNDETERMINED, with score 0 and
    value -1; so are all if nothing was learned. A very long text is a block of its own.
    Repeated rows are predicted each. Columns of docs with those names are replaced.
    """
    kept = [c for c in docs.columns if c not in names]
    spread = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select(*[F.col(f"`{c}`") for c in kept]).schema.add(names[0], "string").add(names[1], "double").add(names[2], "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = spread.value
        if m.id not in _tables:
            _tables.clear()
            _tables[m.id] = m.lookup()
        for batch, _ in cluster.blocks(batches, text):
            texts = batch.column(text).to_pylist()
            known = [i for i, t in enumerate(texts) if t and m.languages and has_letter(t)]
            pred, score, value = [UNDETERMINED] * len(texts), [0.0] * len(texts), [-1.0] * len(texts)
            for a in range(0, len(known), 256):
                own = known[a : a + 256]
                v = m.values([texts[i] for i in own], _tables[m.id]).astype(np.float64)
                e = np.exp((v - v.max(axis=1, keepdims=True)) / TEMPERATURE)
                e /= e.sum(axis=1, keepdims=True)
                for i, k, s, x in zip(own, e.argmax(axis=1).tolist(), e.max(axis=1).tolist(), v.max(axis=1).tolist()):
                    pred[i], score[i], value[i] = m.languages[k], s, x
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(pred, type=pa.string()), pa.array(score, type=pa.float64()), pa.array(value, type=pa.float64())], names=[*kept, *names])

    return docs.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


#: Below this every language's regression says that a text is one of the rest; it doesn't depend on how many languages there are.
LEAST_VALUE = 0.0


def known(docs: DataFrame, *, text: str = "text", lang: str = "lang", least: float = LEAST_VALUE) -> DataFrame:
    """docs whose language can be told, learned from their own labels; columns as they were.

    Null, empty and letterless texts go, and those of which every language's regression
    says that they are another's. Very long texts are judged whole. Repeated rows stay
    or go together. Without any label all go; an empty table stays empty.
    """
    names = tuple(cluster.fresh(docs.columns, x) for x in ("_lang_pred", "_score", "_value"))
    out = predict(docs, fit(sample(docs, lang, text)), text, names)
    return out.where((F.col(names[0]) != UNDETERMINED) & (F.col(names[2]) >= least)).select(*[F.col(f"`{c}`") for c in docs.columns])


def fold(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo `of`; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


def identify(docs: DataFrame, *, folds: int = 5, held_out: int = 0, text: str = "text", lang: str = "lang", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learned from the labelled documents outside of one fold, predicted for all.

    A null doc_id is in no fold: it is neither learned from nor held out. Repeated rows
    are predicted each; other columns are ignored.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    model = fit(sample(rows.where(fold("doc_id", folds) != held_out)))
    out = predict(rows.select("doc_id", F.coalesce(fold("doc_id", folds) == held_out, F.lit(False)).alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", "lang_pred", "score")
