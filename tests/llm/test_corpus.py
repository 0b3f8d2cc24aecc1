"""Corpus operators against brute force on small, awkward tables."""

import hashlib
import os
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from psephos.llm import cluster, decontam, embed_dedup, jaccard_join, kernels, langid, licenses, packing, quotes, resharding, suffix_dedup, toxicity

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, lang string, source string, score double, n_words string"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def make(spark, texts):
    """A documents table with ids from 0, and other columns of clashing names."""
    return spark.createDataFrame([(i, t, "en", "s", 1.0, "x") for i, t in enumerate(texts)], DOCS)


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(4)
    base = [prose(rng, n, 3000) for n in (40, 90, 200, 400, 7, 12)]
    out = [None, "", " \n", "one", "two words", *base, *base[:3]]
    for text in base:
        words = text.split()
        for changes in (1, 2, len(words) // 30 + 1, len(words) // 12 + 1):
            copy = list(words)
            for _ in range(changes):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            out.append(" ".join(copy).upper())
    passage = prose(rng, 60, 5000)
    out += [f"{prose(rng, 60, 5000)} {passage} {prose(rng, 30, 5000)}" for _ in range(12)]
    out += ["é" * 300, "ab" * 400, "x" * 199, "x" * 200, "y " * 150]
    return out


def brute_links(texts, k, percent):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", low(t))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root, links = list(range(len(sets))), Counter()

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                links[i] += 1
                links[j] += 1
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return sets, [find(i) for i in range(len(sets))], links


@pytest.mark.parametrize(("k", "percent", "chunk"), [(3, 90, 512), (5, 80, 512), (3, 90, 3)])
def test_jaccard_join(spark, corpus, monkeypatch, k, percent, chunk):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", chunk)
    sets, root, links = brute_links(corpus, k, percent)
    got = {r.doc_id: r for r in jaccard_join.join(make(spark, corpus), k=k, percent=percent).collect()}
    assert len(got) == len(corpus)
    assert [(got[i].n_shingles, got[i].component_id, got[i].n_links) for i in range(len(corpus))] == [(len(s), root[i], links[i]) for i, s in enumerate(sets)]


def test_jaccard_join_of_one_row_in_many_partitions(spark, corpus):
    texts = [corpus[7], corpus[7] + " more", *corpus[20:24]]
    _, root, links = brute_links([*texts, *texts[:1] * 160], 3, 90)
    docs = make(spark, texts)
    many = docs.unionByName(spark.range(160).repartition(40).crossJoin(docs.where("doc_id = 0")).select(*docs.columns))
    got = {(r.doc_id, r.component_id, r.n_links) for r in jaccard_join.join(many, k=3, percent=90).collect()}
    assert got == {(i, root[i], links[i]) for i in range(len(texts))}


def test_jaccard_tasks_send_bounded_batches(spark, corpus, monkeypatch):
    monkeypatch.setattr(jaccard_join, "GATHERED", 20)
    monkeypatch.setattr(jaccard_join, "HELD_PARTS", 300)
    monkeypatch.setattr(jaccard_join, "PIECE", 50)
    monkeypatch.setattr(jaccard_join, "BROADCAST_ROWS", 0)
    _, root, links = brute_links(corpus, 3, 80)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(make(spark, corpus), k=3, percent=80).collect()}
    assert [got[i] for i in range(len(corpus))] == [(root[i], links[i]) for i in range(len(corpus))]


def test_forest():
    edges = np.array([(5, 4), (4, 3), (9, 8), (3, 2), (8, 7), (7, 7), (20, 2)])
    assert sorted(map(tuple, jaccard_join.forest(edges).tolist())) == [(3, 2), (4, 2), (5, 2), (8, 7), (9, 7), (20, 2)]
    assert len(jaccard_join.forest(edges[:0])) == 0


def test_every_linked_pair_shares_a_part():
    rng = np.random.default_rng(1)
    for percent in (80, 90):
        for n in (5, 9, 10, 19, 40, 170, 600):
            a = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
            for _ in range(30):
                gone = rng.integers(0, n * (100 - percent) // (100 + percent) + 1)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**63, gone).astype(np.uint64))))
                common = len(np.intersect1d(a, b))
                if 100 * common >= percent * (len(a) + len(b) - common) and len(a) + len(b) != 2 * common:
                    assert len(np.intersect1d(jaccard_join.parts(a, percent), jaccard_join.parts(b, percent)))


def test_linked_pairs_have_the_parts_they_need_in_common():
    rng = np.random.default_rng(2)
    met = 0
    for percent in (80, 90):
        for n in (5, 9, 10, 19, 40, 170, 600):
            for _ in range(60):
                a = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
                gone, more = rng.integers(0, n * (100 - percent) // 100 + 2, 2)
                b = np.unique(np.concatenate((rng.permutation(a)[gone:], rng.integers(0, 2**64, more, dtype=np.uint64))))
                common = len(np.intersect1d(a, b))
                if len(a) + len(b) == 2 * common or 100 * common < percent * (len(a) + len(b) - common):
                    continue
                met += 1
                tables = [{k: (need, jaccard_join._hashed(jaccard_join._weights(x), own, starts, k)) for _, need, own, starts, k in jaccard_join.counted(x, 7, percent)} for x in (a, b)]
                level = next(jaccard_join.levels(max(len(a), len(b)), percent))
                shared = len(np.intersect1d(*(t[level][1] for t in tables)))
                assert all(shared >= t[level][0] for t in tables)
    assert met > 200


def test_keep_one_leaves_one_of_each_group(spark, corpus):
    docs = make(spark, corpus)
    twice = docs.unionByName(docs.where("doc_id = 5"))
    kept = sorted(r.doc_id for r in jaccard_join.keep_one(twice).collect())
    _, root, links = brute_links(corpus, 5, 80)
    assert kept == [i for i in range(len(corpus)) if root[i] == i]
    assert jaccard_join.keep_one(docs).columns == docs.columns


def brute_removed(texts, least=200):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in data for i in range(len(b) - least + 1))
    out = []
    for b in data:
        gone = np.zeros(len(b), dtype=bool)
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                gone[i : i + least] = True
        runs = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        out.append((len(b), int(gone.sum()), runs, hashlib.sha256(bytes(np.frombuffer(b, dtype=np.uint8)[~gone])).hexdigest()))
    return out


@pytest.mark.parametrize("group", [512, 2])
def test_suffix_dedup(spark, corpus, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.digest(make(spark, corpus)).collect()}
    want = brute_removed(corpus)
    assert [got[i] for i in range(len(corpus))] == want
    assert sum(w[1] > 0 for w in want) > 10


def test_suffix_remove_keeps_columns_and_nulls(spark, corpus):
    docs = make(spark, corpus).withColumn("key", F.lit(1)).withColumn("n", F.lit(2)).withColumn("__key", F.lit(3)).withColumn("__N", F.lit(4)).withColumn("__spans", F.lit(5))
    out = suffix_dedup.remove(docs)
    assert out.columns == docs.columns
    texts = {r.doc_id: r.text for r in out.collect()}
    assert texts[0] is None and texts[1] == "" and texts[3] == "one" and texts[5] == ""


def test_intervals_are_those_of_the_array():
    suffixes = sorted(["banana"[i:] for i in range(6)])
    lcp = [0] + [len(next(p for p in (a[:n] for n in range(len(a), -1, -1)) if b.startswith(p))) for a, b in zip(suffixes, suffixes[1:])]
    assert sorted(suffix_dedup.intervals(lcp)) == [(1, 0, 2), (2, 4, 5), (3, 1, 2)]


@pytest.mark.parametrize("size", [400_000, 100])
def test_decontamination(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "AUTOMATON_BYTES", size)
    rng = random.Random(2)
    items = [(0, prose(rng, 30)), (7, prose(rng, 12)), (10, "Short one"), (3, ""), (4, None), (None, "no identity"), (8, prose(rng, 30))]
    docs = [None, "", "...", items[0][1].upper(), f"a {items[1][1]} b {items[0][1][40:160]} c", "x SHORT... one; short oney", prose(rng, 300), "shorté one", "it has no-identity, nor", f"{items[0][1]} {items[6][1]}"]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: tuple(r)[1:] for r in decontam.digest(decontam.scan(make(spark, docs), bench)).collect()}
    windows = {}
    for item, text in items:
        w = WORDS.findall(low(text))
        for i in range(max(1, len(w) - 9) if w else 0):
            windows.setdefault(tuple(w[i : i + 10]), set()).update([item] if item is not None else [])
    for i, text in enumerate(docs):
        w = WORDS.findall(low(text))
        hit, found = set(), set()
        for win, own in windows.items():
            for a in range(len(w) - len(win) + 1):
                if tuple(w[a : a + len(win)]) == win:
                    hit |= set(range(a, a + len(win)))
                    found |= own
        assert got[i] == (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest(), bool(hit))
    spans = {r.doc_id: r.spans for r in decontam.scan(make(spark, docs), bench).collect()}
    assert [docs[5].encode()[s.from_byte : s.to_byte] for s in spans[5]] == [b"SHORT... one"]
    kept = decontam.clean(make(spark, docs), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 6, 7] and kept.columns == make(spark, docs).columns


def test_license_scan(spark):
    docs = [None, "", "Released under the MIT License. MIT-License", "GNU General  Public\nLicense, version 3; CC-BY 4.0", "Licensed under the Apache License, Version 2.0", "commit license", "mit licensed"]
    got = {r.doc_id: r for r in licenses.scan(make(spark, docs)).collect()}
    phrases = {("gnu", "general", "public", "license"): "gpl", ("apache", "license"): "apache", ("cc", "by"): "cc-by", ("mit", "license"): "mit"}
    for i, text in enumerate(docs):
        w = WORDS.findall(low(text))
        at = [(a, lab) for p, lab in phrases.items() for a in range(len(w)) if tuple(w[a : a + len(p)]) == p]
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(at), min((a for a, _ in at), default=None), max((a for a, _ in at), default=None))
        assert r.base_labels == ",".join(sorted({lab for _, lab in at})) and {lab for _, lab in at} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert "gpl-3" in got[3].labels and "apache-2.0" in got[4].labels and got[5].labels == ""
    assert len(licenses.rules()) > 200 and all(r.keyword for r in licenses.rules())


def written(tree, full):
    """A text that a parsed pattern matches: with all that is optional, or without."""
    out = ""
    for op, arg in tree:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name == "IN":
            kind, value = arg[0]
            out += chr(value) if str(kind) == "LITERAL" else chr(value[0]) if str(kind) == "RANGE" else "7" if "DIGIT" in str(value) else "x"
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += written(arg[2], full) * (max(1, arg[0]) if full else arg[0])
        elif name == "SUBPATTERN":
            out += written(arg[3], full)
        elif name == "BRANCH":
            out += written(arg[1][-1 if full else 0], full)
        else:
            assert name in ("ASSERT_NOT",), name
    return out


def test_license_gate_drops_no_match(spark):
    s = licenses.scanner()
    every = licenses.Scanner()
    for rule in every.rules:
        # pieces of optional spaces, joined and apart
        for full in (True, False):
            text = written(re._parser.parse(rule.pattern), full)
            folded = f" {text} ".encode()
            assert re.search(f" {rule.pattern}(?= )".encode(), folded), (rule, text)
            every.by_keyword = {w: list(range(len(every.rules))) for w in folded.split()}
            assert s.detections(folded.split(), folded) == every.detections(folded.split(), folded) != [], (rule, text)
    docs = ["Licensed under the Beerware license", "under the CreativeML OpenRAIL license", "beer ware license", "Open RAIL license", "openrail"]
    assert [r.labels for r in licenses.scan(make(spark, docs)).orderBy("doc_id").collect()] == ["beerware", "rail", "beerware", "rail", ""]


def test_license_labels_against_a_plain_scan(spark):
    rng = random.Random(12)
    rules = licenses.rules()
    pieces = [written(re._parser.parse(r.pattern), full) for r in rules for full in (True, False)]
    docs = [" ".join(rng.choice(pieces) if rng.random() < 0.6 else prose(rng, 3) for _ in range(rng.randint(1, 25))) for _ in range(150)] + ["copyright 2020 x " * 3000]
    got = {r.doc_id: r for r in licenses.scan(make(spark, docs)).collect()}
    for i, text in enumerate(docs):
        words = WORDS.findall(low(text))
        folded = f" {' '.join(words)} "
        found = [(m.start(), m.end(), j) for j, r in enumerate(rules) for m in re.finditer(f" {r.pattern}(?= )", folded)] if i < 150 else []
        rank = lambda d: (-rules[d[2]].priority, d[0] - d[1], d[2], d[0])
        kept = [d for d in found if not any(e[0] <= d[0] and d[1] <= e[1] and rank(e) < rank(d) for e in found)]
        if i < 150:
            assert sorted((folded.count(" ", 0, a), folded.count(" ", 0, b), rules[j].label) for a, b, j in kept) == sorted((d.from_word, d.to_word, d.label) for d in got[i].detections)
            base = set(got[i].base_labels.split(",")) - {""}
            assert got[i].labels == ",".join(sorted(base | {rules[j].label for *_, j in kept})) and got[i].score == max([0.0, *[0.7 for _ in base], *[rules[j].score for *_, j in kept]])
        else:
            assert len(got[i].detections) == 3000


def test_packing(spark):
    from tokenizers import Tokenizer

    rng = random.Random(3)
    docs = [None, "", "Don't STOP ½ é <|endoftext|> é x\x1cy", *[prose(rng, rng.choice((3, 40, 500, 900, 5000)), 10**6) for _ in range(40)]]
    docs[7] = docs[6]
    path = packing.vocabulary()
    t = Tokenizer.from_file(path)
    rows = packing.pack_documents(make(spark, docs)).collect()
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, text in enumerate(docs):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [(r.start, r.length) for r in own] == [(a, min(2048, len(ids) - a)) for a in range(0, len(ids), 2048)]
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], dtype="<u4").tobytes()) for r in own]
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) <= 1.03 * sum(r.length for r in rows) / 2048 + 1


def test_packing_plan_is_tight():
    rng = random.Random(5)
    for _ in range(50):
        counts = {rng.randint(1, 2048): rng.randint(1, 50) for _ in range(30)}
        plan = packing.plan(counts)
        got = Counter()
        for s in plan:
            assert sum(length * each for length, _, each in s.items) + s.gap == 2048
            for length, _, each in s.items:
                got[length] += s.n * each
        assert got == counts


def test_min_cost_flow_is_least():
    rng = random.Random(6)
    for _ in range(60):
        n, m = rng.randint(1, 6), rng.randint(1, 6)
        supply = [rng.randrange(50) for _ in range(n)]
        demand = resharding.equal_capacities(sum(supply), m)
        x = resharding.min_cost_flow(supply, demand, [[int(i != j) for j in range(m)] for i in range(n)])
        assert [sum(r) for r in x] == supply and [sum(c) for c in zip(*x)] == demand
        stays = sum(min(s, d) for s, d in zip(supply, demand))
        assert sum(x[i][i] for i in range(min(n, m))) == stays


def test_resharding(spark, corpus, tmp_path):
    docs = make(spark, [f"{t or ''}{i}" if i % 3 else t for i, t in enumerate(corpus * 8)])
    rows = resharding.reshard(docs, F.pmod(F.col("doc_id"), F.lit(3)), 3, 5).collect()
    assert len(rows) == len(corpus) * 8
    for s in range(5):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows)))
    sizes = [sum(r.size for r in rows if r.shard == s) for s in range(5)]
    assert max(sizes) - min(sizes) < 0.1 * sum(sizes) / 5
    placed = resharding.reshard(docs, F.pmod(F.col("doc_id"), F.lit(3)), 3, 5)
    resharding.rewrite(docs, placed, f"{tmp_path}/s")
    assert spark.read.parquet(f"{tmp_path}/s").count() == len(rows)
    assert resharding.reshard(docs.limit(0), F.lit(0), 1, 2).count() == 0


def test_rewrite_writes_null_and_repeated_ids_once(spark, tmp_path):
    rows = [(None, "no id", 0), (None, None, 0), (None, None, 1), (None, "no id", 2), *[(7, "same", i % 3) for i in range(9)], (8, "one", 0), (8, "other", 1), (None, "no id", 2), *[(i, f"text {i}" * (i % 5), 0) for i in range(20, 60)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, old int").repartition(3)
    placed = resharding.reshard(docs, F.col("old"), 3, 4)
    touched = resharding.rewrite(docs, placed, f"{tmp_path}/s", old_shard=F.col("old"))
    out = spark.read.parquet(f"{tmp_path}/s").collect()
    left = [r for r in placed.collect() if r["shard"] in touched]
    assert 0 in touched and 3 in touched
    assert Counter((r.doc_id, r.text, r.old) for r in out) == Counter(r for r in rows if r[2] in touched)
    assert sorted((r["shard"], r.slot) for r in out) == sorted((r["shard"], r.slot) for r in left)
    full = lambda r, old: (r["shard"], old, r.doc_id, r.text_crc32 if "text_crc32" in r else zlib.crc32((r.text or "").encode()))
    assert Counter(full(r, r.old) for r in out) == Counter(full(r, r.old_shard) for r in left)
    # texts and ids alone need no old_shard; other columns could be exchanged without it
    resharding.rewrite(docs.select("doc_id", "text"), placed, f"{tmp_path}/t")
    assert Counter((r.doc_id, r.text) for r in spark.read.parquet(f"{tmp_path}/t").collect()) == Counter((r.doc_id, r.text) for r in out)
    with pytest.raises(ValueError):
        resharding.rewrite(docs, placed, f"{tmp_path}/u")


def test_embeddings(spark, monkeypatch):
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 16))
    vectors = [list(map(float, base[rng.integers(6)] + rng.normal(size=16) * rng.choice([0, 0.1, 0.25, 0.5]))) for _ in range(160)]
    vectors += [None, [0.0] * 16, [float("nan")] * 16, [None] + [1.0] * 15, [], [1.0, 2.0], [2.0, 4.0], vectors[0]]
    labels = [int(rng.integers(2)) for _ in vectors]
    labels[3], labels[-1], labels[-2] = None, labels[0], labels[-3]
    df = spark.createDataFrame([(i, v, c) for i, (v, c) in enumerate(zip(vectors, labels))], "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(embed_dedup, "CHUNK", 7)
    got = {r.vec_id: r for r in embed_dedup.join(df).collect()}
    clean = {i: np.array(v, dtype=np.float32).astype(np.float64) for i, v in enumerate(vectors) if v and None not in v and np.isfinite(v).all() and any(v) and labels[i] is not None}
    root, links = {i: i for i in range(len(vectors))}, Counter()
    for i in clean:
        for j in clean:
            if j < i and labels[i] == labels[j] and len(clean[i]) == len(clean[j]) and clean[i] @ clean[j] / np.linalg.norm(clean[i]) / np.linalg.norm(clean[j]) >= 0.93:
                links[i] += 1
                links[j] += 1
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(vectors))] == [(links[i], root[i], root[i] == i) for i in range(len(vectors))]
    assert embed_dedup.join(df.limit(0)).count() == 0


def test_embeddings_of_any_scale_and_few_whole_comparisons(spark):
    big = [[1e200, 2e200], [2e200, 4.001e200], [1e-200, 2e-200], [-1.0, 1.0]]
    got = embed_dedup.join(spark.createDataFrame([(i, v, "a") for i, v in enumerate(big)], "vec_id long, embedding array<double>, label string"))
    assert [(r.n_links, r.component_id) for r in got.orderBy("vec_id").collect()] == [(2, 0), (2, 0), (2, 0), (0, 3)]
    x = embed_dedup.unit(np.random.default_rng(1).normal(size=(400, 64)))
    value, axes = np.linalg.eigh(np.cov(x.T))
    own, share = embed_dedup.split(value[::-1], 4, 0.93)
    turned = x @ axes[:, ::-1]
    whole = sum(len(embed_dedup.near_in(turned[:, o], turned[:, o], s)[0]) - len(x) for o, s in zip(own, share))
    assert whole < len(x) * (len(x) - 1) / 3


def test_language_id(spark):
    rng = random.Random(8)
    syllables = {"en": "the and ing er th ou".split(), "de": "sch ein ung ich der ü".split(), "fr": "eau le ment é que oi".split()}
    texts = []
    for _ in range(240):
        lang = rng.choice(sorted(syllables))
        texts.append((lang, " ".join("".join(rng.choice(syllables[lang]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(3, 60)))))
    rows = [(i, t, lang if i % 10 else None) for i, (lang, t) in enumerate(texts)] + [(500, None, "en"), (501, "12 !?", "en"), (None, "the and", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert (got[500].lang_pred, got[500].score, got[501].lang_pred) == ("und", 0.0, "und")
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i].held_out == (i in held) for i in range(240))
    assert sum(got[i].lang_pred == texts[i][0] for i in held) >= 0.97 * len(held)
    assert sorted(r.doc_id for r in langid.known(df.where("doc_id is not null")).collect()) == list(range(240))
    assert langid.identify(df.limit(0)).count() == 0


def test_every_language_is_learned(spark):
    rng = random.Random(11)
    words = {f"l{i}": ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 6))) for _ in range(12)] for i in range(70)}
    rows = [(i * 100 + j, " ".join(rng.choices(words[lang], k=30)), lang, 7.5, "own") for i, lang in enumerate(words) for j in range(12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, _score double, _lang_pred string")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert {r.lang_pred for r in got.values()} == set(words)
    assert sum(got[r[0]].lang_pred == r[2] for r in rows if got[r[0]].held_out) >= 0.95 * sum(r.held_out for r in got.values())
    junk = spark.createDataFrame([(9000, "привет как дела", None, 7.5, "own")], df.schema)
    kept = langid.known(df.unionByName(junk)).collect()
    assert 9000 not in {r.doc_id for r in kept} and len(kept) >= 0.99 * len(rows) and {(r._score, r._lang_pred) for r in kept} == {(7.5, "own")}


def test_toxicity(spark):
    rng = random.Random(9)
    bad = ["idiot", "moron", "worthless"]
    rows, labels = [], []
    for i in range(300):
        words = [f"{rng.choice(['an', 'th', 'er', 'on'])}{rng.choice(['ou', 'in', 'es', 'at'])}{rng.choice(['', 'ly', 'ed'])}" for _ in range(rng.randint(5, 80))]
        toxic = int(i % 3 == 0)
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, toxic))
    rows += [(900, None), (901, ""), (902, "an ou moronn es er in at on")]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1), (5, None)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in toxicity.detect(docs, lab).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(got[i].predicted == labels[i][1] for i in held) >= 0.95 * len(held)
    assert got[900].predicted == got[901].predicted == 0 and got[902].predicted == 1
    assert all(got[i].held_out == (i in held) for i in range(300))


def test_samples_are_thinned_by_distinct_texts(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "PER_LABEL", (40, 40))
    monkeypatch.setattr(langid, "PER_LANGUAGE", 40)
    texts = [f"copy {i % 2}" if i < 6000 else f"text {i}" for i in range(6060)]
    docs = spark.createDataFrame([(i, t, "xx") for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    labels = docs.select("doc_id", F.lit(1).alias("toxic"))
    assert len(toxicity.sample(docs, labels)[0]) == len(set(langid.sample(docs))) == 40


def test_toxicity_is_trained_the_same_in_parts(monkeypatch):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    labels = [i % 2 for i in range(40)]
    texts = [" ".join(rng.choices(words, k=60) + ["vile"] * y).encode() for y in labels]
    whole = toxicity.fit(texts, labels, 6)
    monkeypatch.setattr(toxicity, "PASSAGES", 7)
    assert np.allclose(toxicity.fit(texts, labels, 6).scores(texts), whole.scores(texts), atol=1e-3)


@pytest.mark.parametrize(("toxic", "score"), [([], 0.0), ([0, 0], 0.0), ([1, 1], 1.0)])
def test_toxicity_without_both_labels_is_one_score(spark, toxic, score):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["one", "two", None, "", "idiot", "..."])], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in zip((0, 1), toxic)], "doc_id long, toxic int")
    assert {(r.score, r.predicted) for r in toxicity.detect(docs, labels).collect()} == {(score, int(score))}


#: Words of the given tables' toxic texts, of which no clean one has any.
TELLING = re.compile("trash|pathetic|idiot|worthless|disgusting|stupid|clown|loser|scum|moron")


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_toxicity_of_held_out_rows(spark, sf):
    folder = f"/root/testdata/{sf}"
    if not os.path.isdir(folder):
        pytest.skip("no test data")
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    known = labels.where("toxic in (0, 1)").select("doc_id", "toxic").join(docs, "doc_id").select("doc_id", "toxic", "text")
    got = toxicity.detect(docs, labels).where("held_out").join(known, "doc_id").toPandas()
    toxic, told = got.toxic == 1, got.text.str.lower().str.contains(TELLING)
    assert got[toxic & told].predicted.mean() >= 0.85 and got[~toxic].predicted.mean() < 0.02
    rank = got.score.rank()
    assert (rank[toxic].sum() - toxic.sum() * (toxic.sum() + 1) / 2) / (toxic.sum() * (~toxic).sum()) > 0.78


def test_quotation_linking(spark):
    rows = [
        (1, 0, "u", "Hello all\nwhat is up?"), (1, 1, "a", "Not much"), (1, 2, "b", "On Monday u wrote:\n> Hello all\n> what is UP?\nfine here"),
        (1, 3, "c", "> fine here\n>> what is up?\nok"), (1, 4, "d", "> Not  much\nwell"), (1, 1600, "e", "> ok\nlate"), (2, 0, "x", None), (None, 1, "q", "> a"), (2, 1, "y", ""), (2, 1, "y", ""),
    ]
    got = quotes.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    one = [(r.turn, r.parent_turn, r.root_turn, r.text) for r in got.where("conv_id = 1").orderBy("position").collect()]
    assert one == [(0, None, 0, "Hello all\nwhat is up?"), (2, 0, 0, "fine here"), (3, 2, 0, "ok"), (1600, 3, 0, "late"), (1, None, 1, "Not much"), (4, 1, 1, "well")]
    assert [r.position for r in got.where("conv_id = 2").orderBy("position").collect()] == [0, 1, 2]
    assert got.where("conv_id is null").first().position is None and got.count() == len(rows)


def test_quotes_wrapped_anew_and_in_part(spark):
    long = "The first sentence of this line is here. A second one, about the weather, follows it. The third ends the line."
    texts = [
        long, "Something else\nthat has two lines", "> The first sentence of this\n> line is here. A second\n> one, about the weather, follows it.\n> The third ends the line.\nwrapped",
        "> A second one, about the weather, follows it.\nsentence", "> something ELSE that has\n> two lines\njoined", "> else\n> that\nwords", "> wrapped\n> The third ends the line.\nunlike",
        "> On Monday a wrote:\n>> the third\n>> ends\n> sentence\nlevels", "> ends line the\nabsent", ">> levels\n> not there at all\ndeep", "> first sentence\n>\n> that has two\nparagraphs",
    ]
    got = quotes.link(spark.createDataFrame([(1, i, "u", t) for i, t in enumerate(texts)], "conv_id long, turn long, role string, text string"))
    assert [r.parent_turn for r in got.orderBy("turn").collect()] == [None, None, 0, 0, 1, 1, 2, 3, None, 7, 1]
    one = quotes.link(spark.createDataFrame([(1, 0, "u", "yes"), (1, 1, "u", "yes but"), (1, 2, "u", "> yes\nso"), (2, 0, "u", "> yes\nno")], "conv_id long, turn long, role string, text string"))
    assert [r.parent_turn for r in one.orderBy("conv_id", "turn").collect()] == [None, None, 0, None]


def test_components(spark):
    edges = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 7), (7, 7), (20, 2), (None, 1)]
    got = {r.node: r.root for r in cluster.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {2: 2, 3: 2, 4: 2, 5: 2, 20: 2, 7: 7, 8: 7, 9: 7}
    assert cluster.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_empty_tables(spark):
    docs = make(spark, ["x"]).limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    talk = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for out in (
        decontam.digest(decontam.scan(docs, bench)), decontam.clean(docs, bench), licenses.scan(docs), jaccard_join.join(docs), jaccard_join.keep_one(docs),
        suffix_dedup.digest(docs), suffix_dedup.remove(docs), toxicity.detect(docs, labels), packing.pack_documents(docs), quotes.link(talk), langid.known(docs),
    ):
        assert out.count() == 0
    assert [r.n_hit for r in decontam.scan(make(spark, ["some words", None]), bench).collect()] == [0, 0]


def test_shingles_of_few_words():
    sets = kernels.shingle_sets([b"", b"a", b"A", b"a b", b"a b c", b"b c a", "é Ü x".encode()], 3)
    assert [len(s) for s in sets] == [0, 1, 1, 1, 1, 1, 1]
    assert sets[1][0] == sets[2][0] and len({int(s[0]) for s in sets[1:]}) == 5


def test_pipeline_runs(spark, tmp_path, corpus):
    import corpus_pipeline

    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(corpus)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, corpus[7])], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    kept = {r.doc_id for r in out.select("doc_id").distinct().collect()}
    assert {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert 0 not in kept and 1 not in kept and 3 in kept and 11 not in kept


def test_large_groups_of_candidates_send_sets_only_to_sizes_that_link(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 8)
    members = spark.range(640).selectExpr("id AS vertex", "7L AS comp", "10 + id AS n")
    dealt, sent = jaccard_join.chunked(members, 80)
    rows = dealt.collect()
    chunks = {r.vertex: (r.n, r.chunk, set(r.others)) for r in rows}
    assert len(chunks) == 640 and sent == sum(r.n * len(r.others) for r in rows) < 0.6 * sum(r.n for r in rows) * len({r.chunk for r in rows})
    for n, chunk, others in chunks.values():
        for m, other, back in chunks.values():
            assert not (80 * n <= 100 * m and 80 * m <= 100 * n) or other in others and chunk in back


def test_only_wanted_texts_are_shuffled(spark):
    docs = spark.range(3000).selectExpr("id AS doc_id", "xxhash64(id) AS text_hash")
    wanted = docs.where("doc_id % 10 = 3").withColumn("n", F.lit(1))
    left = jaccard_join.marked(docs, wanted)
    assert left.join(wanted, ["doc_id", "text_hash"], "left_semi").count() == 300 and left.count() < 330


def test_chunks_of_a_large_group_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK_SETS", 3)
    monkeypatch.setattr(jaccard_join, "ROUND", 1)
    texts = [" ".join(f"w{i}" for i in range(a, a + 60)) for a in range(30)]
    got = jaccard_join.join(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), k=1, percent=80)
    # 60 words each, a apart: (60 - a) / (60 + a) >= 0.8 up to a = 6
    assert {r.doc_id: (r.component_id, r.n_links) for r in got.collect()} == {i: (0, min(6, i) + min(6, 29 - i)) for i in range(30)}


def test_counts_of_shared_parts_do_not_grow_with_the_tasks(spark):
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(400)]
    texts = [" ".join([*base[:at], f"x{i}", *base[at + 1 :]]) for i, at in enumerate(rng.integers(0, 400, 60))]
    docs = make(spark, texts).repartition(30)
    known = jaccard_join.digests(docs, 5, 80)
    spot = F.shiftrightunsigned("vertex", 64 - jaccard_join.MARKS)
    none = jaccard_join.marks_of(known.where("false"), spot)
    marks = jaccard_join.marks_of(jaccard_join.likely(known, 4, 10_000), spot)
    rows = {(p, m is marks): jaccard_join.shared_parts(docs, 5, 80, p, 30_000, m).count() for p in (2, 12) for m in (none, marks)}
    # each set of the group was counted by every task; sets that are known to share parts no longer are
    assert rows[12, False] > 3 * rows[2, False] and rows[12, True] == 0 == rows[2, True]
    _, root, links = brute_links(texts, 5, 80)
    got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(docs, k=5, percent=80).collect()}
    assert [got[i] for i in range(len(texts))] == [(root[i], links[i]) for i in range(len(texts))]


def test_sets_that_share_parts_only_with_uncounted_ones_are_found(spark, monkeypatch):
    base = [f"w{i}" for i in range(300)]
    near = [" ".join([*base[: 40 * i], f"x{i}", *base[40 * i + 1 :]]) for i in range(6)]
    far = [" ".join([*base[:264], *(f"y{i}" for i in range(26))])]  # links with some, and shares few least parts
    texts = [*near, *far, *near[:1], "other words " * 40]
    _, root, links = brute_links(texts, 3, 80)
    for kept in (1, 3, 9):  # from all that share anything to none
        monkeypatch.setattr(jaccard_join, "LIKELY", kept)
        got = {r.doc_id: (r.component_id, r.n_links) for r in jaccard_join.join(make(spark, texts).repartition(5), k=3, percent=80).collect()}
        assert [got[i] for i in range(len(texts))] == [(root[i], links[i]) for i in range(len(texts))]
