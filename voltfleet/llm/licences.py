"""Licence scans by a trained paragraph classifier.

A paragraph is a line of a text. Its word n-grams go into a multinomial logistic
regression with one class per licence family, one for licence wording of no known family
(``unknown``) and one for other text (``none``). It learns from notices below, whole and in
parts, from paragraphs of the corpus that carry a notice, and from a bounded sample of those which
don't. On a fold set aside, a temperature is fitted and a threshold chosen
below which a prediction counts as unknown. A prediction stands if the paragraph also
contains the notice of its family by word shingles; otherwise it is unknown. Notices that
run over several lines, or share one, are found by their shingles in runs of lines without
a blank one; such a stretch of words is classified on its own.
"""

from __future__ import annotations

import re
import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_texts, staged

UNKNOWN, NONE = "unknown", "none"
SAMPLE = 2000  # paragraphs of the corpus to learn from, at most, with and without a notice each
SHINGLE = 5
SIMILARITY = 0.8
WRONG_SHARE = 0.01  # of paragraphs of no known family that the threshold may let pass
_STEPS = 150
_FOLD = 5  # every fifth example is set aside
_SEED = 11

# Notices of licence families: fixed values. Numbers count as equal to each other.
NOTICES = {
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
        " software and associated documentation files",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": ("under the terms of the GNU Lesser General Public License",),
    "agpl": ("under the terms of the GNU Affero General Public License",),
    "bsd": (
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted",
    ),
    "mpl": ("This Source Code Form is subject to the terms of the Mozilla Public License",),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc0": ("dedicated to the public domain under CC0 1.0 Universal",),
    "isc": ("Permission to use, copy, modify, and or distribute this software for any purpose",),
}
#: Licence wording of no family above, to learn the unknown class from.
OTHERS = (
    "All rights reserved.",
    "Used with permission of the copyright holder.",
    "This material may not be reproduced without written permission.",
    "Licensed under the terms of the agreement between the parties.",
    "Released under a custom license, see the license file.",
    "Copyright by the authors, no license is granted.",
    "Distributed under the terms of an open license.",
    "Licensed for personal use only, version 1.0.",
)
CLASSES = (*NOTICES, UNKNOWN, NONE)

_WORD = re.compile(r"[^\W_]+")
_NUMBER = re.compile(r"\d+")
_HINT = re.compile(r"licen[sc]|copyright|rights|permi(?:ssion|tted)|creative commons|public domain|\bcc[ -]?(?:by|0)\b|redistribut")


def words_of(text: str) -> list[str]:
    return ["0" if _NUMBER.fullmatch(w) else w for w in _WORD.findall(text.lower())]


def grams(words: list[str]) -> list[str]:
    """N-grams of one to three words."""
    return words + [" ".join(words[i : i + n]) for n in (2, 3) for i in range(len(words) - n + 1)]


def shingles(words: list[str]) -> set[tuple[str, ...]]:
    if len(words) <= SHINGLE:
        return {tuple(words)}
    return {tuple(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)}


_TEMPLATES = [(family, shingles(words_of(n))) for family, notices in NOTICES.items() for n in notices]


def template_match(words: list[str]) -> tuple[str | None, float]:
    """The family whose notice the words contain most of, and how much of it."""
    by_width: dict[int, set] = {}
    best, family = 0.0, None
    for name, parts in _TEMPLATES:
        width = len(next(iter(parts)))
        if width not in by_width:
            by_width[width] = {tuple(words[i : i + width]) for i in range(len(words) - width + 1)}
        share = len(parts & by_width[width]) / len(parts)
        if share > best:
            best, family = share, name
    return family, best


_WIDTHS = sorted({len(next(iter(parts))) for _, parts in _TEMPLATES})
_HOLDERS: dict[tuple[str, ...], list[int]] = {}
for _k, (_, _parts) in enumerate(_TEMPLATES):
    for _shingle in _parts:
        _HOLDERS.setdefault(_shingle, []).append(_k)
_OPENINGS = {shingle[:2] for shingle in _HOLDERS}


def notices_in(words: list[str]) -> list[tuple[str, int, int]]:
    """``family, start, end`` of each stretch of the words that has ``SIMILARITY`` of a
    notice's shingles and is at most a quarter longer than the notice."""
    hits: dict[int, list[tuple[int, tuple[str, ...]]]] = {}
    for i, pair in enumerate(zip(words, words[1:])):
        if pair in _OPENINGS:
            for width in _WIDTHS:
                shingle = tuple(words[i : i + width])
                for k in _HOLDERS.get(shingle, ()) if len(shingle) == width else ():
                    hits.setdefault(k, []).append((i, shingle))
    found = []
    for k, at in hits.items():
        family, parts = _TEMPLATES[k]
        width = len(next(iter(parts)))
        longest = (len(parts) + width - 1) * 5 // 4
        need = SIMILARITY * len(parts) - 1e-9
        j = 0
        while j < len(at):
            near = [x for x in at[j : j + longest] if x[0] + width - at[j][0] <= longest]
            if len({shingle for _, shingle in near}) >= need:
                found.append((family, at[j][0], near[-1][0] + width))
                j += len(near)
            else:
                j += 1
    return found


class Model:
    """Weights of the regression, its temperature and threshold.

    Its features are the n-grams of licence wording; a paragraph's features share a unit
    of length, and n-grams beyond them do not count.
    """

    def __init__(self, examples: list[tuple[list[str], int]]):
        wording = {g for n in (*sum(NOTICES.values(), ()), *OTHERS) for g in grams(words_of(n))}
        wording = {g for g in wording if set(g) - set("0 ")}  # a number alone says nothing
        self._number = {g: i for i, g in enumerate(sorted(wording))}
        self.weights = np.zeros((len(wording), len(CLASSES)), np.float32)
        self.bias = np.zeros(len(CLASSES), np.float32)
        self.temperature, self.threshold = 1.0, 0.5
        ids = [self.features(words) for words, _ in examples]
        labels = np.array([y for _, y in examples])
        aside = np.arange(len(ids)) % _FOLD == 0
        self._fit([ids[i] for i in np.flatnonzero(~aside)], labels[~aside])
        self._calibrate([ids[i] for i in np.flatnonzero(aside)], labels[aside])

    def features(self, words: list[str]) -> np.ndarray:
        number = self._number
        return np.array(sorted({number[g] for g in grams(words) if g in number}), np.int64)

    def logits(self, ids: list[np.ndarray]) -> np.ndarray:
        out = np.tile(self.bias, (len(ids), 1)).astype(np.float64)
        for i, x in enumerate(ids):
            if len(x):
                out[i] += self.weights[x].sum(axis=0) / np.sqrt(len(x))
        return out

    def _fit(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        """Full gradient steps with a little weight decay; classes count alike, whatever
        the number of their examples."""
        sizes = np.array([len(x) for x in ids])
        rows = np.repeat(np.arange(len(ids)), sizes)
        cols = np.concatenate(ids)
        scale = (1 / np.sqrt(np.maximum(sizes, 1)))[rows].astype(np.float32)
        w = self.weights
        x = np.zeros((len(ids), len(w)), np.float32)  # some thousand rows, some hundred columns
        x[rows, cols] = scale
        truth = np.eye(len(CLASSES), dtype=np.float32)[labels]
        share = (1 / np.maximum(truth.sum(axis=0), 1))[labels][:, None]
        share = share / share.sum()
        for _ in range(_STEPS):
            error = (_softmax(x @ w + self.bias) - truth) * share
            w -= 30.0 * (x.T @ error + 1e-6 * w)
            self.bias -= 3.0 * error.sum(axis=0)

    def _calibrate(self, ids: list[np.ndarray], labels: np.ndarray) -> None:
        """The temperature with the least log loss on the fold set aside, and the least
        threshold that lets few of its paragraphs of no known family pass."""
        if not len(ids):
            return
        scores = self.logits(ids)
        loss = {t: -np.log(_softmax(scores / t)[np.arange(len(ids)), labels] + 1e-12).mean() for t in np.geomspace(0.1, 10, 41)}
        self.temperature = float(min(loss, key=loss.get))
        sure = _softmax(scores / self.temperature)[:, : len(NOTICES)].max(axis=1)
        strange = np.sort(sure[labels >= len(NOTICES)])
        if len(strange):
            allowed = strange[int((1 - WRONG_SHARE) * (len(strange) - 1))]
            self.threshold = float(min(max(0.5, allowed), 0.95))

    def predict(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The class of each paragraph and its probability. A family below the threshold
        is unknown, and unknown below it is none."""
        p = _softmax(self.logits(ids) / self.temperature)
        best, sure = p.argmax(axis=1), p.max(axis=1)
        unknown, none = CLASSES.index(UNKNOWN), CLASSES.index(NONE)
        best[(best == unknown) & (sure < self.threshold)] = none
        best[(best < len(NOTICES)) & (sure < self.threshold)] = unknown
        return best, sure


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _examples(carrying: list[str], others: list[str]) -> list[tuple[list[str], int]]:
    """Labelled word lists: notices whole, and in runs of at least 80% of their words among words of the
    corpus; wording of no family; halves of notices of two families; other paragraphs, whole and a few words of each."""
    rng = np.random.default_rng(_SEED)
    plain = [words_of(text) for text in others]
    pool = [w for words in plain for w in words[:30]] or ["text"]

    def noise(most: int) -> list[str]:
        return [pool[i] for i in rng.integers(0, len(pool), rng.integers(0, most + 1))]

    made = []
    notices = [(f, words_of(n)) for f, all_of in NOTICES.items() for n in all_of]
    unknown = CLASSES.index(UNKNOWN)
    for family, words in notices:
        for k in range(40):
            drop = int(rng.integers(0, len(words) // 5 + 1))
            part = words[drop:] if k % 2 else words[: len(words) - drop]
            made.append((noise(k) + part + noise(k), CLASSES.index(family)))
    for text in OTHERS:
        made += [(noise(k) + words_of(text) + noise(k), unknown) for k in range(40)]
    for k in range(200):
        (f, a), (g, b) = (notices[i] for i in rng.integers(0, len(notices), 2))
        if f != g:
            made.append((noise(k % 10) + a[: len(a) // 2] + b[(len(b) + 1) // 2 :], unknown))
    for text in carrying:
        words = words_of(text)
        family, share = template_match(words)
        if family is not None and share >= SIMILARITY:
            made.append((words, CLASSES.index(family)))
    none = CLASSES.index(NONE)
    for words in plain:
        start = int(rng.integers(0, len(words) + 1))
        made += [(words, none), (words[start : start + int(rng.integers(1, 12))], none)]
    made = [(words, y) for words, y in made if words]
    return [made[i] for i in rng.permutation(len(made))]


def train(docs: DataFrame) -> Model:
    """A classifier from the notices and a bounded sample of the corpus' paragraphs:
    the ``SAMPLE`` different ones with the least hash of those with licence wording, and as
    many of the others. All paragraphs take part in the choice.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        kept: dict[bool, dict[int, bytes]] = {True: {}, False: {}}
        for text in raw_texts(batch.column(0)):
            for line in (text or b"").split(b"\n"):
                if line.strip():
                    hint = _HINT.search(line.lower().decode("utf-8", "replace")) is not None
                    kept[hint][zlib.crc32(line)] = line
        rows = [
            (hint, mark, lines[mark].decode("utf-8", "replace"))
            for hint, lines in kept.items()
            for mark in sorted(lines)[:SAMPLE]
        ]
        columns = list(zip(*rows)) or [()] * 3
        kinds = (pa.bool_(), pa.int64(), pa.string())
        return pa.record_batch(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=["hint", "mark", "line"]
        )

    found = map_batches(docs.select("text"), each, "hint boolean, mark long, line string")
    found = staged(found.distinct(), "paragraphs")
    # The bits of the hash tell which rows can be among the least: 33 counts for each kind.
    bits = F.length(F.bin("mark"))
    counts = found.groupBy("hint", bits.alias("bits")).count().collect()
    lines = {}
    for hint in (True, False):
        so_far, most = 0, 0
        for row in sorted((r for r in counts if r["hint"] == hint), key=lambda r: r["bits"]):
            if so_far < SAMPLE:
                so_far, most = so_far + row["count"], row["bits"]
        least = found.where((F.col("hint") == hint) & (bits <= most))
        rows = least.orderBy("mark", "line").limit(SAMPLE).collect()
        lines[hint] = [r["line"] for r in rows]
    return Model(_examples(lines[True], lines[False]))


def scan(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, families, n_paragraphs, n_licence, n_unknown, confidence`` for every row.

    ``families`` are the confirmed licence families, in order; ``n_licence`` counts the
    paragraphs that have one of these or a part of it, ``n_unknown`` other ones with licence wording of no known or no
    confirmed family; ``confidence`` is the largest probability of a confirmed prediction
    (null without one). A null text has no paragraphs. Rows are judged alone, equal rows
    alike; an empty table gives no rows; other columns are ignored.
    """
    # Paragraphs without a word of licence wording have nothing to be told by: the
    # features of the notices are a few hundred, and text beyond them is class none.
    telling = {w for n in (*sum(NOTICES.values(), ()), *OTHERS) for w in words_of(n)} - {"0"}

    def wrapped(lines: list[list[str]]) -> tuple[set[str], set[int], float | None]:
        """Families of the notices in a run of lines, the numbers of the lines that have a
        part of one, and the largest probability."""
        words = [w for line in lines for w in line]
        of = [k for k, line in enumerate(lines) for _ in line]
        spans = notices_in(words)
        families, touched, sure = set(), set(), None
        if spans:
            best, p = model.predict([model.features(words[a:b]) for _, a, b in spans])
            for (family, a, b), k, share in zip(spans, best.tolist(), p.tolist()):
                if CLASSES[k] == family:
                    families.add(family)
                    touched |= set(of[a:b])
                    sure = max(sure or 0.0, share)
        return families, touched, sure

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for text in raw_texts(batch.column(1)):
            given = (text or b"").decode("utf-8", "replace").split("\n")
            families, sure, touched = set(), None, set()
            paragraphs = []
            for filled, run in groupby(given, key=lambda x: bool(x.strip())):
                if filled:
                    run = [words_of(x) for x in run]
                    more, at, share = wrapped(run)
                    families |= more
                    touched |= {len(paragraphs) + k for k in at}
                    sure = max((x for x in (sure, share) if x is not None), default=None)
                    paragraphs += run
            tried = [k for k, w in enumerate(paragraphs) if not telling.isdisjoint(w)]
            unknown = 0
            if tried:
                best, p = model.predict([model.features(paragraphs[k]) for k in tried])
                for at, k, share in zip(tried, best.tolist(), p.tolist()):
                    if CLASSES[k] == NONE:
                        continue
                    family, like = template_match(paragraphs[at])
                    if CLASSES[k] != UNKNOWN and family == CLASSES[k] and like >= SIMILARITY:
                        families.add(family)
                        touched.add(at)
                        sure = max(sure or 0.0, share)
                    elif at not in touched:
                        unknown += 1
            licence = len(touched)
            out.append((sorted(families), len(paragraphs), licence, unknown, sure))
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
        names = ["doc_id", "families", "n_paragraphs", "n_licence", "n_unknown", "confidence"]
        return pa.record_batch(
            [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names
        )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(
        given, each,
        "doc_id long, families array<string>, n_paragraphs long, n_licence long, n_unknown long, confidence double",
    )
