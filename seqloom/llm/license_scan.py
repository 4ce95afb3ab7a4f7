"""License scans: an exact set-similarity join of text blocks with license templates.

Words are lower-cased runs of letters, digits and non-ASCII characters. A template with m words meets the blocks of 2 m words
that start at every m-th word, so any stretch of m words lies whole in a block. A block is found if it contains at least
``CONTAINMENT`` of the template's distinct words. The join is exact and its filters lose nothing: the template's words are
ordered by their frequency in all texts, rarest first, and

* prefix: a found block holds one of the first |T| - need + 1 words, so only blocks with one of them are looked at;
* length: a block with fewer words than ``need`` can't be found;
* position: the template's words in the block and the template itself stand in the same order. Where the k-th common word is a
  prefix word, k plus the words behind it can match, in the block or in the template, whichever has fewer left.

Words of no template come first in that order, before the rarest word of a template, so they are never behind a common one.
The frequencies are one pass over all texts, of which the driver gets one number for each word of the templates. Besides, fixed
phrases are found wherever their words stand consecutively.

Null and empty texts have no words and no labels. Texts are read whole, however long, in chunks. Repeated rows get equal
results, and an empty table an empty result. Where words are equally frequent, their order is alphabetical. Only doc_id and text
are looked at, whatever other columns there are.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import flattext as ft
from .tables import table

CONTAINMENT = 0.9

#: Fixed phrases and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Templates and their labels: wordings of public licenses and of the notices that refer to them.
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc0", "to the extent possible under law the person who associated cc0 with this work has waived all copyright and related or neighboring rights to this work"),
    ("gpl", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files to deal in the software without restriction"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
)


def _hash(word: str) -> int:
    raw = np.frombuffer(word.encode(), dtype=np.uint8)
    return int(ft.hash_runs(raw, np.array([0]), np.array([len(raw)]))[0])


def need(words: int) -> int:
    """Distinct words of a template that a found block holds at least."""
    return math.ceil(round(CONTAINMENT * words, 9))


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, text in templates for w in text.split()})


class Numbers:
    """Numbers of words: their places in a list."""

    def __init__(self, words: list[str]):
        hashes = np.array([_hash(w) for w in words], dtype=np.uint64)
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]
        raw = [w.encode() for w in words]
        self.ends = np.cumsum([len(w) for w in raw], dtype=np.int64)
        self.starts = self.ends - np.array([len(w) for w in raw], dtype=np.int64)
        self.body = np.frombuffer(b"".join(raw), dtype=np.uint8)

    def __call__(self, body: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each run of the body, or -1; equal hashes are looked at byte by byte."""
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        out = np.where(self.hashes[at] == hashes, self.order[at], -1)
        hit = np.flatnonzero(out >= 0)
        same = ft.equal(body, starts[hit], ends[hit], self.body, self.starts[out[hit]], self.ends[out[hit]])
        out[hit[~same]] = -1
        return out


def frequencies(documents: DataFrame, templates=TEMPLATES) -> dict[str, int]:
    """How often each word of the templates stands in all texts."""
    words = vocabulary(templates)
    numbers = Numbers(words)

    def counted(batches):
        total = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for _, _, data, offsets in ft.chunks(ft.filled(batch.column("text"))):
                body, runs = ft.LOWER[data], ft.runs(ft.WORD[data], offsets)
                found = numbers(body, *runs, ft.hash_runs(body, *runs))
                total += np.bincount(found[found >= 0], minlength=len(words))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["word", "n"])

    got = documents.select("text").mapInArrow(counted, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {w: 0 for w in words} | {words[r["word"]]: r["n"] for r in got}


@dataclass
class Index:
    """Templates over numbered words, the numbers in global order of frequency: rarest first."""

    count: dict[str, int]
    templates: tuple = TEMPLATES
    phrases: tuple = PHRASES
    items: list = field(default_factory=list)

    def __post_init__(self):
        words = sorted(vocabulary(self.templates), key=lambda w: (self.count.get(w, 0), w))
        self.numbers = Numbers(words)
        self.size = len(words)
        number = {w: i for i, w in enumerate(words)}
        for label, text in self.templates:
            own = text.split()
            tokens = np.array(sorted({number[w] for w in own}))
            least = need(len(tokens))
            place = np.full(len(words), -1)  # of the template's words in its order
            place[tokens] = np.arange(len(tokens))
            self.items.append((label, len(own), len(tokens), least, place, (place >= 0) & (place < len(tokens) - least + 1)))
        self.spelled = [([_hash(w) for w in p.split()], p, label) for p, label in self.phrases]

    def blocks(self, item, start: np.ndarray, end: np.ndarray, known: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
        """Of blocks of words from start to end that hold a prefix word of the template: those that are found, how many of its words
        each holds, and how many blocks there were and passed the length and the position filter.

        known: places of the words of templates, ascending; token: their numbers.
        """
        _, _, size, least, place, prefix = item
        passed = [len(start)]
        keep = np.flatnonzero(end - start >= least)
        passed.append(len(keep))
        a, b = np.searchsorted(known, start[keep]), np.searchsorted(known, end[keep])
        # the distinct words of templates in each block, in the global order
        key = np.unique(np.repeat(np.arange(len(keep)), b - a) * self.size + token[ft.spread(a, b - a)])
        block, word = key // self.size, key % self.size
        last = np.searchsorted(block, np.arange(len(keep)), side="right")
        common = place[word] >= 0
        upto = np.cumsum(common)
        before = np.concatenate([[0], upto])[np.searchsorted(block, np.arange(len(keep)))]
        meets = np.flatnonzero(prefix[word])
        of = block[meets]
        behind = np.minimum(size - 1 - place[word[meets]], last[of] - 1 - meets)
        bound = np.full(len(keep), size)
        np.minimum.at(bound, of, upto[meets] - before[of] + behind)
        live = bound >= least
        passed.append(int(live.sum()))
        held = np.bincount(block[common], minlength=len(keep))
        found = np.flatnonzero(live & (held >= least))
        return keep[found], held[found], passed

    def scan(self, texts: pa.Array):
        """Of each text: words, places of phrases, first and last place, labels of phrases, labels of templates, containment."""
        for low, high, data, offsets in ft.chunks(texts):
            body = ft.LOWER[data]
            starts, ends = ft.runs(ft.WORD[data], offsets)
            words = ft.hash_runs(body, starts, ends)
            cut = np.searchsorted(starts, offsets)
            n = np.diff(cut)
            row = np.repeat(np.arange(high - low), n)
            places: list[list[tuple[int, str]]] = [[] for _ in range(high - low)]
            for hashes, phrase, label in self.spelled:
                at = np.flatnonzero(words == np.uint64(hashes[0]))
                at = at[at + len(hashes) <= cut[row[at] + 1]]
                for k, h in enumerate(hashes[1:], 1):
                    at = at[words[at + k] == np.uint64(h)]
                for i in at.tolist():
                    if [bytes(body[starts[i + k] : ends[i + k]]).decode() for k in range(len(hashes))] == phrase.split():
                        places[row[i]].append((i - int(cut[row[i]]), label))
            labels: list[set[str]] = [set() for _ in range(high - low)]
            best = np.zeros(high - low)
            token = self.numbers(body, starts, ends, words)
            known = np.flatnonzero(token >= 0)
            token = token[known]
            for item in self.items:
                label, m, size, _, _, prefix = item
                first = known[prefix[token]]
                if not len(first):
                    continue
                block = (first - cut[row[first]]) // m
                start = np.unique(np.concatenate([cut[row[first]] + block * m, (cut[row[first]] + (block - 1) * m)[block > 0]]))
                found, held, _ = self.blocks(item, start, np.minimum(start + 2 * m, cut[row[start] + 1]), known, token)
                for r, n_held in zip(row[start[found]].tolist(), held.tolist(), strict=True):
                    labels[r].add(label)
                    best[r] = max(best[r], n_held / size)
            for i in range(high - low):
                at = [p for p, _ in places[i]]
                yield int(n[i]), len(at), min(at, default=None), max(at, default=None), {x for _, x in places[i]}, labels[i], float(best[i])


def scan(documents: DataFrame, templates=TEMPLATES, phrases=PHRASES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row.

    score is the largest containment of a found block, 1 where a phrase stands, else 0.
    """
    shared = documents.sparkSession.sparkContext.broadcast(Index(frequencies(documents, templates), templates, phrases))
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]

    def found(batches):
        for batch in batches:
            rows = [(w, n, a, b, ",".join(sorted(base)), ",".join(sorted(base | more)), 1.0 if n else s) for w, n, a, b, base, more, s in shared.value.scan(ft.filled(batch.column("text")))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([r[i] for r in rows], t) for i, t in enumerate(types))], ["doc_id", *names])

    return documents.select("doc_id", "text").mapInArrow(found, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def sql_of() -> str:
    """The same by looking at every block of every template."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tokens = f"list_filter(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
    phrase = []
    for p, label in PHRASES:
        same = " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p.split()))
        phrase.append(f"list_transform(list_filter(range(0, len(w)), lambda i: {same}), lambda i: {{'at': i, 'label': '{label}'}})")
    shares = []
    for label, text in TEMPLATES:
        m, own = len(text.split()), sorted(set(text.split()))
        listed = "[" + ", ".join(f"'{x}'" for x in own) + "]"
        share = f"coalesce(list_max(list_transform(range(0, len(w), {m}), lambda i: len(list_filter({listed}, lambda x: list_contains(list_slice(w, i + 1, i + {2 * m}), x))))), 0)"
        shares.append(f"{{'label': '{label}', 'share': CASE WHEN {share} >= {need(len(own))} THEN {share} / {len(own)}.0 ELSE 0.0 END}}")
    return f"""WITH words AS (SELECT doc_id, {tokens} AS w FROM documents),
found AS (SELECT doc_id, len(w) AS n_words, list_concat(list_concat({phrase[0]}, {phrase[1]}), {phrase[2]}) AS base, list_filter([{', '.join(shares)}], lambda s: s.share > 0) AS more FROM words)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(len(base) AS BIGINT) AS n_base,
  CAST(list_min(list_transform(base, lambda b: b.at)) AS BIGINT) AS first_word, CAST(list_max(list_transform(base, lambda b: b.at)) AS BIGINT) AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(base, lambda b: b.label))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(base, lambda b: b.label), list_transform(more, lambda s: s.label)))), ','), '') AS labels,
  CASE WHEN len(base) > 0 THEN 1.0 ELSE coalesce(list_max(list_transform(more, lambda s: s.share)), 0.0) END::DOUBLE AS score
FROM found"""
