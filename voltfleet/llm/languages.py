"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1. An n-gram's vector binds (multiplies) its
letters' vectors, each permuted (rotated) by its place. A text's vector bundles (adds) those
of its n-grams, a language's prototype those of its texts, and a text is told to be of the language whose
prototype has the largest cosine with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_batches, raw_texts

DIMENSIONS = 1024
GRAM = 3
SEED = 7
UNKNOWN = "und"
_GRAM_CACHE = 30_000  # n-grams whose vectors a task remembers
_PART = 1 << 20  # characters of a text that are counted in one go
_OTHERS = re.compile(r"[\W\d_]+")


def letter_vector(code: int) -> np.ndarray:
    """The vector of a letter, the same on every machine."""
    bits = np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8)
    return 2 * bits - 1


class Profiler:
    """Vectors of texts; remembers those of letters and n-grams."""

    def __init__(self):
        self._letters: dict[int, np.ndarray] = {}
        self._rows: dict[int, int] = {}
        self._vectors = np.empty((_GRAM_CACHE, DIMENSIONS), np.int8)

    def _letter(self, code: int) -> np.ndarray:
        if code not in self._letters:
            self._letters[code] = letter_vector(code)
        return self._letters[code]

    def _row(self, gram: int) -> int:
        if gram not in self._rows:
            if len(self._rows) == _GRAM_CACHE:
                raise KeyError
            vector = np.ones(DIMENSIONS, np.int8)
            for place in range(GRAM):
                code = gram >> 21 * (GRAM - 1 - place) & 0x1FFFFF
                vector = vector * np.roll(self._letter(code), place)
            self._vectors[len(self._rows)] = vector
            self._rows[gram] = len(self._rows)
        return self._rows[gram]

    def bundle(self, text: str) -> np.ndarray | None:
        """The exact sum of a text's n-gram vectors; None without letters.

        Letters are lower-cased, and whatever stands between them counts as one blank.
        """
        plain = " " + _OTHERS.sub(" ", text.lower()).strip() + " "
        if not plain.strip():
            return None
        total = np.zeros(DIMENSIONS, np.int64)
        for at in range(0, len(plain), _PART):
            codes = np.frombuffer(plain[at : at + _PART + GRAM - 1].encode("utf-32-le"), "<u4").astype(np.int64)
            grams = codes[: len(codes) - GRAM + 1]
            for place in range(1, GRAM):
                grams = grams << 21 | codes[place : place + len(grams)]
            found, counts = np.unique(grams, return_counts=True)
            for start in range(0, len(found), _GRAM_CACHE):
                self._add(total, found[start : start + _GRAM_CACHE], counts[start : start + _GRAM_CACHE])
        return total

    def _add(self, total: np.ndarray, grams: np.ndarray, counts: np.ndarray) -> None:
        try:
            rows = [self._row(g) for g in grams.tolist()]
        except KeyError:
            self._rows.clear()
            rows = [self._row(g) for g in grams.tolist()]
        # Counts below 2^23 are exact in single precision up to sums of 2^24.
        if counts.sum() < 1 << 24:
            total += (counts.astype(np.float32) @ self._vectors[rows].astype(np.float32)).astype(np.int64)
        else:
            total += counts @ self._vectors[rows].astype(np.int64)


def prototypes(docs: DataFrame) -> dict[str, list[int]]:
    """The vector (exact sums) of each language, by its name, from all rows with a language and a text with letters.

    Tasks add up their own rows; what they send is one vector per language and task, added
    by language and dimension. The result has one row per language, not per document.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        profiler, sums = Profiler(), {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for lang, text in zip(langs, raw_texts(batch.column(1))):
                vector = profiler.bundle(text.decode("utf-8", "replace"))
                if vector is not None:
                    sums[lang] = sums[lang] + vector if lang in sums else vector
        yield pa.record_batch(
            [pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.int64()))],
            names=["lang", "vector"],
        )

    known = docs.where("lang is not null and text is not null").select("lang", "text")
    sums = known.mapInArrow(each, "lang string, vector array<long>")
    by_place = sums.select("lang", F.posexplode("vector").alias("place", "x")).groupBy("lang", "place")
    whole = by_place.agg(F.sum("x").alias("x")).groupBy("lang")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda s: s["x"])
    rows = whole.agg(ordered.alias("vector")).collect()
    return dict(sorted((row["lang"], row["vector"]) for row in rows))


def identify(docs: DataFrame, learned: dict[str, list[int]]) -> DataFrame:
    """``doc_id, lang_pred, score`` for every row.

    ``score`` is the cosine with the language told, from 0 (or below) to 1. A text that is
    null, has no letter, or meets no learned language is ``und`` with score 0; of languages
    with equal cosine the first by code point is told. Equal rows are returned each; an
    empty table gives none; other columns are ignored.
    """
    langs = list(learned)
    matrix = np.array(list(learned.values()), np.float64).reshape(len(langs), DIMENSIONS)
    matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-9)
    profilers: list[Profiler] = []  # one per task

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not profilers:
            profilers.append(Profiler())
        told, scores = [], []
        for text in raw_texts(batch.column(1)):
            vector = None if text is None else profilers[0].bundle(text.decode("utf-8", "replace"))
            if vector is None or not langs:
                told.append(UNKNOWN)
                scores.append(0.0)
                continue
            cosines = matrix @ vector / max(np.linalg.norm(vector), 1e-9)
            best = int(np.argmax(cosines))
            told.append(langs[best])
            scores.append(float(min(max(cosines[best], 0.0), 1.0)))
        return pa.record_batch(
            [batch.column(0), pa.array(told, pa.string()), pa.array(scores, pa.float64())],
            names=["doc_id", "lang_pred", "score"],
        )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(given, each, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a row is of the fold that nothing is learned from; false for a null id."""
    fold = F.crc32(doc_id.cast("string").cast("binary")) % 3
    return F.coalesce(fold == 1, F.lit(False))
