"""License scan by ordered signature rules.

Each rule is a regex over normalised text (lower case, words parted by single
spaces), a label, a priority and a keyword: words parted by |, without all of which it
can't match. Only rules with such a word among a text's words are tried. Detections that lie within another of higher priority, or of the same priority
and longer, are suppressed. Base phrases are found everywhere, apart from the rules,
and their labels are never suppressed.
"""

from __future__ import annotations

import bisect
import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from psephos.llm import cluster, kernels

#: Phrases that the contract of the scan fixes, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


@dataclass(frozen=True)
class Rule:
    label: str
    pattern: str
    keyword: str
    priority: int
    score: float


def _keyword(pattern: str, liked: str) -> str:
    """Words, parted by |, of which every match holds one: for each way to write the optional spaces liked if it is a word there, else the longest that stands outside of groups."""
    bare = pattern
    while (less := re.sub(r"\([^()]*\)[?*+]?(?:\{[^}]*\}\??)?", " | ", bare)) != bare:
        bare = less
    first, *others = bare.split(" ?")
    forms = [first]
    for piece in others:
        forms = [f"{form}{space}{piece}" for form in forms for space in (" ", "")]
    words = []
    for form in forms:
        plain = re.findall(r"(?<![\w\\])[a-z0-9]+(?![\w?*+{\[])", form)
        words.append(liked if liked in plain else max(plain, key=len, default=""))
    return "|".join(dict.fromkeys(words))


def _family(label: str, name: str, keyword: str, spdx: tuple[str, ...] = (), versions: tuple[str, ...] = (), more: tuple[str, ...] = ()) -> list[Rule]:
    """Rules of one license: more (own clauses), its name with versions, its SPDX tags, and ways to refer to it."""
    rules = [Rule(label, p, keyword, 90, 1.0) for p in more]
    for v in versions:
        w = v.replace(".", " ")
        rules.append(Rule(f"{label}-{v}", rf"{name}(?: license)?(?: as published by the free software foundation)?(?: either)? (?:version |v ?){w}(?! \d)", keyword, 80, 0.95))
    for tag in spdx:
        rules.append(Rule(label, rf"spdx license identifier (?:\w+ ){{0,6}}?{tag}(?: only| or later)?", "spdx", 100, 1.0))
    rules.append(Rule(label, rf"(?:licensed|released|distributed|available|provided|published) under (?:the )?(?:terms of (?:the )?)?{name}(?: license)?", keyword, 60, 0.9))
    rules.append(Rule(label, rf"(?:subject to|governed by|see) (?:the )?(?:terms of (?:the )?)?{name}(?: license)?", keyword, 50, 0.8))
    rules.append(Rule(label, rf"{name}(?: public)? license", keyword, 40, 0.7))
    return rules


def rules() -> list[Rule]:
    """All rules, in the order in which ties are resolved."""
    out: list[Rule] = []
    add = lambda *a, **k: out.extend(_family(*a, **k))
    add("gpl", r"gnu (?:gpl|general public license)", "gnu", ("gpl",), ("1", "2", "3"), (r"this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", r"you should have received a copy of the gnu general public license"))
    add("lgpl", r"gnu (?:lgpl|lesser general public license|library general public license)", "gnu", ("lgpl",), ("2", "2.1", "3"), (r"this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license",))
    add("agpl", r"gnu (?:agpl|affero general public license)", "gnu", ("agpl",), ("3",), (r"remote network interaction use with the gnu general public license",))
    add("gfdl", r"gnu (?:fdl|free documentation license)", "gnu", ("gfdl",), ("1.1", "1.2", "1.3"), (r"with no invariant sections no front cover texts and no back cover texts",))
    add("apache", r"apache(?: software)?", "apache", ("apache",), ("1.0", "1.1", "2.0"), (r"you may not use this file except in compliance with the license", r"www apache org licenses license 2 0", r"apache 2(?: 0)? license"))
    add("mit", r"mit(?: x11)?", "mit", ("mit",), (), (r"permission is hereby granted free of charge to any person obtaining a copy of this software", r"opensource org licenses mit", r"the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability"))
    add("bsd", r"(?:the )?(?:\w+ clause )?(?:simplified |modified |new |revised )?bsd", "bsd", ("bsd",), (), (r"redistributions of source code must retain the above copyright notice", r"redistributions in binary form must reproduce the above copyright notice", r"[234] clause bsd", r"neither the name of (?:\w+ ){1,8}nor the names of its contributors"))
    add("isc", r"isc", "isc", ("isc",), (), (r"permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",))
    add("mpl", r"mozilla public", "mozilla", ("mpl",), ("1.0", "1.1", "2.0"), (r"this source code form is subject to the terms of the mozilla public license", r"mozilla org mpl"))
    add("epl", r"eclipse public", "eclipse", ("epl",), ("1.0", "2.0"), (r"eclipse org legal epl",))
    add("edl", r"eclipse distribution", "eclipse", (), ("1.0",))
    add("cddl", r"common development and distribution", "cddl", ("cddl",), ("1.0", "1.1"), (r"cddl 1 [01]",))
    add("cpl", r"common public", "common", ("cpl",), ("1.0",))
    add("ipl", r"ibm public", "ibm", ("ipl",), ("1.0",))
    add("eupl", r"european union public", "eupl", ("eupl",), ("1.0", "1.1", "1.2"), (r"eupl 1 [0-2]",))
    add("artistic", r"(?:perl )?artistic", "artistic", ("artistic",), ("1.0", "2.0"))
    add("zlib", r"zlib(?: libpng)?", "zlib", ("zlib",), (), (r"altered source versions must be plainly marked as such",))
    add("boost", r"boost software", "boost", ("bsl",), ("1.0",), (r"www boost org license 1 0 txt",))
    add("unlicense", r"unlicense", "unlicense", ("unlicense",), (), (r"this is free and unencumbered software released into the public domain",))
    add("wtfpl", r"wtfpl", "wtfpl", ("wtfpl",), ("2",))
    add("beerware", r"beer ?ware", "ware", ("beerware",), (), (r"if we meet some day and you think this stuff is worth it you can buy me a beer",))
    add("public-domain", r"public domain", "domain", (), (), (r"(?:dedicated|released|placed) (?:in|into|to) the public domain", r"waives? all copyright"))
    add("cc0", r"cc0", "cc0", ("cc0",), ("1.0",), (r"creativecommons org publicdomain zero", r"cc0 1 0 universal"))
    for label, name, words in (("cc-by", "cc by", "attribution"), ("cc-by-sa", "cc by sa", "attribution share ?alike"), ("cc-by-nd", "cc by nd", "attribution no ?derivatives"), ("cc-by-nc", "cc by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "cc by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "cc by nc nd", "attribution non ?commercial no ?derivatives")):
        add(label, rf"{name}(?! (?:sa|nd|nc))", "cc", (), ("1.0", "2.0", "2.5", "3.0", "4.0"), (rf"creativecommons org licenses {name[3:]}(?! (?:sa|nd|nc))",))
        out.append(Rule(label, rf"creative commons {words}(?! (?:share|non|no))", "commons", 70, 0.95))
        out.append(Rule(label, rf"{name} [1-4] [05](?: international| unported)?", "cc", 65, 0.95))
    add("python", r"python software foundation", "python", ("psf", "python"), ("2",), (r"psf license agreement",))
    add("ruby", r"ruby", "ruby", ("ruby",))
    add("php", r"php", "php", ("php",), ("3.0", "3.01"))
    add("postgresql", r"postgresql", "postgresql", ("postgresql",))
    add("openssl", r"openssl", "openssl", ("openssl",), (), (r"this product includes software developed by the openssl project",))
    add("sqlite", r"sqlite blessing", "blessing", ("blessing",), (), (r"may you do good and not evil may you find forgiveness for yourself and forgive others",))
    add("ofl", r"sil open font", "sil", ("ofl",), ("1.0", "1.1"), (r"scripts sil org ofl",))
    add("odbl", r"open database", "database", ("odbl",), ("1.0",))
    add("odc-by", r"open data commons attribution", "commons", ("odc",), ("1.0",))
    add("pddl", r"public domain dedication and", "dedication", ("pddl",), ("1.0",))
    add("osl", r"open software", "open", ("osl",), ("1.0", "2.0", "2.1", "3.0"))
    add("afl", r"academic free", "academic", ("afl",), ("1.1", "1.2", "2.0", "2.1", "3.0"))
    add("apsl", r"apple public source", "apple", ("apsl",), ("1.0", "1.1", "1.2", "2.0"))
    add("ms-pl", r"microsoft public", "microsoft", ("ms",))
    add("ms-rl", r"microsoft reciprocal", "microsoft")
    add("ncsa", r"(?:university of illinois )?ncsa", "ncsa", ("ncsa",))
    add("upl", r"universal permissive", "universal", ("upl",), ("1.0",))
    add("w3c", r"w3c(?: software(?: notice and)?)?", "w3c", ("w3c",))
    add("zpl", r"zope public", "zope", ("zpl",), ("1.1", "2.0", "2.1"))
    add("qpl", r"q public", "public", ("qpl",), ("1.0",))
    add("sleepycat", r"sleepycat", "sleepycat", ("sleepycat",))
    add("vim", r"vim", "vim", ("vim",))
    add("x11", r"x11", "x11", ("x11",))
    add("curl", r"curl", "curl", ("curl",))
    add("json", r"json", "json", ("json",), (), (r"the software shall be used for good not evil",))
    add("sspl", r"server side public", "sspl", ("sspl",), ("1",), (r"server side public license",))
    add("busl", r"business source", "business", ("busl",), ("1.0", "1.1"))
    add("elastic", r"elastic", "elastic", ("elastic",), ("1.0", "2.0"))
    add("llama", r"llama(?: \d)? community", "llama")
    add("rail", r"(?:creativeml )?open ?rail", "rail", (), (), (r"responsible ai licenses?",))
    add("mulan", r"mulan (?:psl|permissive software)", "mulan", ("mulanpsl",), ("1", "2"))
    add("cecill", r"cecill", "cecill", ("cecill",), ("1.0", "1.1", "2.0", "2.1"))
    add("ecl", r"educational community", "educational", ("ecl",), ("1.0", "2.0"))
    add("rpl", r"reciprocal public", "reciprocal", ("rpl",), ("1.1", "1.5"))
    add("naumen", r"naumen public", "naumen", ("naumen",))
    add("proprietary", r"proprietary", "proprietary", (), (), (r"proprietary and confidential",))
    out.append(Rule("all-rights-reserved", r"all rights reserved", "reserved", 20, 0.6))
    out.append(Rule("copyright", r"copyright (?:c )?(?:19|20)\d\d", "copyright", 10, 0.5))
    return [replace(r, keyword=_keyword(r.pattern, r.keyword)) for r in out]


class Scanner:
    """The rules, compiled once a process."""

    def __init__(self, rule_list: list[Rule] | None = None):
        self.rules = rules() if rule_list is None else rule_list
        self.compiled = [re.compile(f" {r.pattern}(?= )".encode()) for r in self.rules]
        self.by_keyword: dict[bytes, list[int]] = {}
        for i, r in enumerate(self.rules):
            for word in r.keyword.encode().split(b"|"):
                self.by_keyword.setdefault(word, []).append(i)
        self.base = [(f" {p} ".encode(), label) for p, label in BASE.items()]

    def base_places(self, folded: bytes) -> list[tuple[int, str]]:
        """(place of the space before, label) of every place of a base phrase."""
        out = []
        for phrase, label in self.base:
            at = folded.find(phrase)
            while at >= 0:
                out.append((at, label))
                at = folded.find(phrase, at + 1)
        return out

    def detections(self, words: list[bytes], folded: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) over folded text that nothing suppresses, in order."""
        tried = sorted({i for word in self.by_keyword.keys() & set(words) for i in self.by_keyword[word]})
        levels: dict[int, list[tuple[int, int, int]]] = {}
        for i in tried:
            levels.setdefault(self.rules[i].priority, []).extend((m.start(), -m.end(), i) for m in self.compiled[i].finditer(folded))
        kept: list[tuple[int, int, int]] = []
        above: list[tuple[int, int, int]] = []
        starts: list[int] = []
        reach: list[int] = []  # the furthest end of all detections above that start there or before
        for priority in sorted(levels, reverse=True):
            level = sorted(levels[priority])
            furthest = -1
            for a, b, i in level:
                if -b <= furthest:
                    continue
                furthest = -b
                k = bisect.bisect_right(starts, a)
                if not k or reach[k - 1] < -b:
                    kept.append((a, -b, i))
            above = sorted(above + level)
            starts = [a for a, *_ in above]
            reach = list(itertools.accumulate((-b for _, b, _ in above), max))
        return sorted(kept)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner())
    return _scanner[0]


#: Score of a base phrase.
BASE_SCORE = 0.7


def scan(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections) of every document.

    detections are structs of label, score and the words from and to (exclusive) that a
    rule matched, after suppression. score is the best of all, 0 without any. A null or
    empty text has no words and empty label strings; a very long one is scanned whole,
    in time that grows with its length and its detections. Null doc_ids and repeated
    rows give a row each; other columns are passed by.
    """
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<label: string, score: double, from_word: long, to_word: long>>"
    spans = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("from_word", pa.int64()), ("to_word", pa.int64())]))
    kinds = [pa.int64()] * 5 + [pa.string(), pa.string(), pa.float64(), spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = scanner()
        for batch, texts in cluster.blocks(batches):
            rows = []
            for key, doc in zip(batch.column("doc_id").to_pylist(), texts):
                words = kernels.words_of(doc)
                folded = b" " + b" ".join(words) + b" "
                base, found = s.base_places(folded), s.detections(words, folded)
                if base or found:  # a space's place to the number of words before it
                    spaces = np.flatnonzero(np.frombuffer(folded, dtype=np.uint8) == 0x20)
                    before = lambda place: int(np.searchsorted(spaces, place))
                    base = [(before(a), label) for a, label in base]
                    found = [(s.rules[i].label, s.rules[i].score, before(a), before(b)) for a, b, i in found]
                base_labels = {label for _, label in base}
                labels = base_labels | {label for label, *_ in found}
                at = [w for w, _ in base]
                score = max([0.0, *(BASE_SCORE for _ in base[:1]), *(x[1] for x in found)])
                rows.append((key, len(words), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), score, [dict(zip(("label", "score", "from_word", "to_word"), f)) for f in found]))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows), kinds)], names=[x.split(" ")[0] for x in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections")])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)
