"""Line-first cleaning: rules per line first, then a judgement of what is left."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import map_batches, raw_texts, small_batches

WINDOW = 8  # words; a power of two, as windows are numbered by doubling
MIN_WORDS = 20
MAX_REPEATED_PERCENT = 30
MAX_LOST_PERCENT = 50  # of the characters in words
SHORT_LINE = 10  # words; a shorter line needs a mark at its end
SYMBOLS = b"#*$%&|<>"
_SPACE = b" \t\n\x0b\x0c\r"

_END = re.compile(r"[.!?…:;。！？。।॥؟۔։჻።។၊။][\"'”’»›)\]}」』]*$")
_SEPARATOR = re.compile(r"^(?:[|>»›·•/]|::|->|→)$")
_BOILERPLATE = re.compile(
    r"all rights reserved|cookie|privacy policy|terms of (?:use|service)|terms and conditions"
    r"|enable javascript|javascript is disabled|lorem ipsum|skip to (?:main )?content"
    r"|back to top|click here|read more|sign (?:in|up)|log ?in\b|subscribe|newsletter"
    r"|share (?:this|on)|follow us|powered by|page not found"
)
_BOILERPLATE_WORDS = 30  # a longer line is prose which happens to have such a phrase


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of ``WINDOW`` words that occur twice or more.

    Windows are numbered by doubling: equal pairs of equal halves get equal numbers.
    """
    n = len(words)
    if n <= WINDOW:
        return 0
    known: dict[bytes, int] = {}
    number = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, n)
    kinds, half = len(known), 1
    while half < WINDOW:
        pair = number[:-half] * kinds + number[half:]
        distinct, number, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(distinct) == len(pair):
            return 0  # nothing longer can repeat either
        kinds, half = len(distinct), 2 * half
    edge = np.zeros(n + 1, np.int64)
    starts = np.flatnonzero(counts[number] > 1)
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return int((np.cumsum(edge) > 0).sum())


def _characters(text: bytes) -> int:
    """Code points in words."""
    packed = text.translate(None, _SPACE)
    return len(packed.decode("utf-8", "replace"))


def line_failure(line: bytes) -> str | None:
    """The rule that a line with a word fails, if any.

    ``navigation``: at least two separators between items, and one for each four words;
    ``symbols``: a symbol in over a third of the words; ``boilerplate``: a stock phrase in a
    line of at most 30 words; ``punctuation``: under 10 words without a mark at the end.
    """
    words = line.split()
    marks = sum(len(w) < 5 and bool(_SEPARATOR.match(w.decode("utf-8", "replace"))) for w in words)
    if marks >= 2 and 4 * marks >= len(words):
        return "navigation"
    if len(line) - len(line.translate(None, SYMBOLS)) and 3 * sum(
        len(w) > len(w.translate(None, SYMBOLS)) for w in words
    ) > len(words):
        return "symbols"
    if len(words) <= _BOILERPLATE_WORDS:
        text = line.decode("utf-8", "replace")
        if _BOILERPLATE.search(text.lower()):
            return "boilerplate"
        if len(words) < SHORT_LINE and not _END.search(text.rstrip(" \t\x0b\x0c\r")):
            return "punctuation"
    return None


def assess(text: bytes | None) -> tuple:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
    cleaned`` of one text; the last is what is left of it."""
    text = text or b""
    words = text.split()
    chars = _characters(text)
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = text.split(b"\n")
    seen: set[bytes] = set()
    copies = lost = 0
    left = []
    for line in lines:
        if not line.strip():
            left.append(line)
            continue
        copies += line in seen
        seen.add(line)
        if line_failure(line):
            lost += _characters(line)
        else:
            left.append(line)
    repeated = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeated > MAX_REPEATED_PERCENT * len(words)
    kept = not failed and 100 * lost <= MAX_LOST_PERCENT * chars
    cleaned = text if len(left) == len(lines) else b"\n".join(left)
    return len(words), chars, symbols, copies, repeated, failed, kept, cleaned


MEASURES = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, cleaned string"
)


def _columns(texts: pa.Array) -> list[pa.Array]:
    found = list(zip(*(assess(t) for t in raw_texts(texts)))) or [()] * 8
    kinds = [pa.int64()] * 5 + [pa.bool_()] * 2
    return [pa.array(x, k) for x, k in zip(found, kinds)] + [
        pa.array(found[7], pa.binary()).cast(pa.string())
    ]


def line_quality(docs: DataFrame) -> DataFrame:
    """``doc_id``, the measures of its whole text, the verdict and the cleaned text.

    A null text counts as one without words, and fails as any text under 20 words does.
    Each row is judged alone: equal rows give equal rows, an empty table none. Other
    columns are ignored. Memory is that of one batch of texts.
    """

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = ["doc_id", *(x.split()[0] for x in MEASURES.split(", "))]
        return pa.record_batch([batch.column(0), *_columns(batch.column(1))], names=names)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_batches(given, each, f"doc_id long, {MEASURES}")


def _cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ``text, row`` that pass, with their cleaned texts; a few texts at a time."""
    for batch in small_batches(batches):
        *_, kept, cleaned = _columns(batch.column(0))
        found = pa.record_batch([cleaned, batch.column(1)], names=["text", "row"])
        yield found.filter(kept)


def clean_lines(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that pass, without the lines that fail.

    All columns stay; ``text`` is the cleaned text and ``n_chars``, where there is one, its
    length. The verdict is the one of :func:`line_quality`.
    """
    packed = docs.select("text", other_columns(docs).alias("row"))
    schema = StructType([StructField("text", StringType()), packed.schema["row"]])
    cleaned = packed.mapInArrow(_cleaned, schema)
    return cleaned.select(*with_text(docs, F.col("text")))


def other_columns(docs: DataFrame) -> Column:
    """The columns of ``docs`` which do not follow its text, as a struct."""
    names = [c for c in docs.columns if c not in ("text", "n_chars")]
    quoted = [F.col("`" + c.replace("`", "``") + "`").alias(c) for c in names]
    return F.struct(*quoted or [F.lit(True).alias("none")])


def with_text(docs: DataFrame, text) -> list:
    """The columns of ``docs`` out of a struct ``row``, with another text."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return [
        new.get(c, F.col("row").getField(c)).cast(docs.schema[c].dataType).alias(c)
        for c in docs.columns
    ]
