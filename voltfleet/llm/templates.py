"""Line deduplication by a tree of log templates.

A line goes down a tree of fixed depth: by its number of tokens, then by its leading
tokens. Tokens with digits count as variable fields from the start. In a leaf, two lines are
alike if they have at least 80% of their tokens in common, place by place; lines that are
connected by alike ones share a template, in which the tokens that differ are variable
fields as well. So templates depend neither on an order nor on how lines were dealt to tasks. A
template that occurs in more than one document is recurring: the document with the smallest
id keeps its lines, all others lose them.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import raw_texts, small_batches, staged
from .components import connected_components
from .lines import other_columns, with_text

DEPTH = 4  # leading tokens
MIN_TOKENS = 3
SIMILARITY = 0.8  # share of tokens which lines of a template have in common
LEAF_ROWS = 4096  # lines that are compared with each other in one go, at most
CELLS = 1 << 22  # tokens of such lines, at most
FIELD = b"<*>"
_DIGIT = re.compile(rb"[0-9]")


def tokens_of(line: bytes) -> list[bytes]:
    words = line.split()
    if _DIGIT.search(line):
        return [FIELD if _DIGIT.search(w) else w for w in words]
    return words


def _seal(tokens: list[bytes]) -> bytes:
    return xxhash.xxh3_128_digest(b" ".join(tokens))


def _leaf(tokens: list[bytes]) -> int:
    key = b"%d " % len(tokens) + b" ".join(tokens[:DEPTH])
    return xxhash.xxh3_64_intdigest(key) - (1 << 63)


def _lines(text: bytes | None) -> Iterator[tuple[bytes, list[bytes]]]:
    """Lines and their tokens, of those long enough."""
    for line in (text or b"").split(b"\n"):
        tokens = tokens_of(line)
        if len(tokens) >= MIN_TOKENS:
            yield line, tokens


def line_seals(docs: DataFrame) -> DataFrame:
    """``doc, anon, leaf, seal`` of each different line of each row."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            at, leaf, seal = [], [], []
            for row, text in enumerate(raw_texts(batch.column(2))):
                found = {_seal(t): t for _, t in _lines(text)}
                at += [row] * len(found)
                leaf += map(_leaf, found.values())
                seal += found
            yield pa.record_batch(
                [
                    *(batch.column(k).take(pa.array(at, pa.int64())) for k in range(2)),
                    pa.array(leaf, pa.int64()), pa.array(seal, pa.binary()),
                ],
                names=["doc", "anon", "leaf", "seal"],
            )

    return docs.select(*_document(), "text").mapInArrow(each, "doc long, anon boolean, leaf long, seal binary")


def _document() -> tuple[Column, Column]:
    """``doc, anon``: which document a row belongs to. One without an id stands for itself."""
    own = F.xxhash64(F.coalesce("text", F.lit("")))
    return F.coalesce(F.col("doc_id").cast("long"), own).alias("doc"), F.col("doc_id").isNull().alias("anon")


def _documents() -> list[Column]:
    """Aggregates: ``several`` documents or one, and the ``first``, one with an id if any."""
    several = (F.min("doc") != F.max("doc")) | (F.min("anon") != F.max("anon"))
    first = F.coalesce(F.min(F.when(~F.col("anon"), F.col("doc"))), F.min("doc"))
    return [several.alias("several"), first.alias("first"), F.min("anon").alias("first_anon")]


def _line_texts(docs: DataFrame) -> DataFrame:
    """``leaf, seal, line``: the masked lines themselves."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            found = {}
            for text in raw_texts(batch.column(0)):
                for _, tokens in _lines(text):
                    found[_seal(tokens)] = tokens
            yield pa.record_batch(
                [
                    pa.array(map(_leaf, found.values()), pa.int64()),
                    pa.array(found, pa.binary()),
                    pa.array([b" ".join(t) for t in found.values()], pa.binary()),
                ],
                names=["leaf", "seal", "line"],
            )

    return docs.select("text").mapInArrow(each, "leaf long, seal binary, line binary")


def _need(n: int) -> int:
    """How many of ``n`` tokens alike lines have in common, at least."""
    return math.ceil(SIMILARITY * n - 1e-9)


def spanning_links(tokens: np.ndarray, differ: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows with at most ``differ`` unequal tokens that connect all rows which such
    pairs connect: a tree for each connected part."""
    rows = np.arange(len(tokens))
    a, b = [], []
    while len(rows):
        front, rows, tokens = [(rows[0], tokens[0])], rows[1:], tokens[1:]
        while front and len(rows):
            x, line = front.pop()
            hit = (tokens != line).sum(axis=1) <= differ
            if hit.any():
                front += zip(rows[hit], tokens[hit])
                a += [x] * int(hit.sum())
                b += rows[hit].tolist()
                rows, tokens = rows[~hit], tokens[~hit]
    return np.array(a, np.int64), np.array(b, np.int64)


def _meetings(lines: DataFrame) -> DataFrame:
    """``leaf, key, seal, line`` of lines ``leaf, seal, line, whole``.

    Lines with one leaf and key are to be compared. A leaf that is compared as a ``whole`` has
    one key. In others lines share their leading tokens and are alike if at most ``d`` others
    differ: these are dealt to ``d + 1`` blocks, so that alike lines have equal tokens in one
    of them, and each block is a key.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1 << 20):
            at, keys = [], []
            for row, (line, whole) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
                if whole:
                    at.append(row)
                    keys.append(0)
                    continue
                tokens = line.split(b" ")
                blocks = len(tokens) - _need(len(tokens)) + 1
                for block in range(blocks):
                    key = b"%d " % block + b" ".join(tokens[DEPTH + block :: blocks])
                    at.append(row)
                    keys.append(xxhash.xxh3_64_intdigest(key) - (1 << 63))
            leaf, seal, line = (batch.column(k).take(pa.array(at, pa.int64())) for k in range(3))
            yield pa.record_batch([leaf, pa.array(keys, pa.int64()), seal, line], names=["leaf", "key", "seal", "line"])

    given = lines.select("leaf", "seal", "line", "whole")
    return given.mapInArrow(each, "leaf long, key long, seal binary, line binary")


def _links(dealt: DataFrame) -> DataFrame:
    """``a, b``: seals that connect what alike lines connect, among the rows
    ``leaf, key, i, j, seal, line`` of the same first four columns."""

    def rows_of(batches):
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns))

    def made(a, b):
        return pa.record_batch([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        for _, group in groupby(rows_of(batches), key=lambda r: r[:4]):
            number, seals, lines = {}, [], []
            for *_, seal, line in group:
                seals.append(seal)
                lines.append(np.array([number.setdefault(t, len(number)) for t in line.split(b" ")], np.int32))
            if len(lines) > 1:
                n = len(lines[0])
                i, j = spanning_links(np.stack(lines)[:, DEPTH:], n - _need(n))
                a += [seals[k] for k in i]
                b += [seals[k] for k in j]
            if len(a) > 10_000:
                yield made(a, b)
                a, b = [], []
        yield made(a, b)

    order = ["leaf", "key", "i", "j"]
    sorted_rows = dealt.select(*order, "seal", "line").repartition(*order).sortWithinPartitions(*order)
    return sorted_rows.mapInArrow(each, "a binary, b binary")


def line_templates(docs: DataFrame, seals: DataFrame) -> DataFrame:
    """``seal, template`` of lines that share a template with another line, out of leaves with
    several lines and several documents; a template goes by the least seal of its lines.

    Lines that meet (see ``_meetings``) are compared in one go up to ``LEAF_ROWS`` lines and
    ``CELLS`` tokens. Larger meetings are dealt to tiles, and each tile meets each other. How
    lines are dealt does not change the links' connected parts.
    """
    leaves = (
        seals.groupBy("leaf")
        .agg(F.min("seal").alias("s0"), F.max("seal").alias("s1"), *_documents(), F.count("*").alias("n"))
        .where("s0 <> s1 and several")
        .select("leaf", "n")
    )
    lines = _line_texts(docs).join(leaves, "leaf").dropDuplicates(["leaf", "seal"])
    # Lines of a leaf have the same number of tokens.
    fits = _fits(F.regexp_count(F.col("line").cast("string"), F.lit(" ")) + 1)
    lines = lines.withColumn("whole", F.col("n") <= fits)
    meetings = staged(_meetings(lines), "meetings")
    sizes = meetings.groupBy("leaf", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = meetings.join(sizes, ["leaf", "key"])
    # Two tiles fit together.
    tiles = F.when(F.col("n") <= fits, 1).otherwise(F.ceil(2 * F.col("n") / fits)).cast("int")
    tile = F.pmod(F.xxhash64("seal"), F.col("tiles")).cast("int")
    dealt = (
        met.withColumn("tiles", tiles)
        .withColumn("tile", tile)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
        # With its own tile alone a line would meet nobody new, unless there is one tile.
        .where("tiles = 1 or tile <> other")
        .withColumn("i", F.least("tile", "other"))
        .withColumn("j", F.greatest("tile", "other"))
    )
    links = staged(_links(dealt), "alike-lines")
    return connected_components(links).select(F.col("node").alias("seal"), F.col("root").alias("template"))


def _fits(tokens: Column) -> Column:
    """How many lines of so many tokens are compared in one go."""
    return F.greatest(F.lit(4), F.least(F.lit(LEAF_ROWS), F.floor(F.lit(CELLS) / tokens)))


def dropped_lines(docs: DataFrame) -> DataFrame:
    """``doc, anon, seal`` of the lines that go: of recurring templates, in all documents but
    the first."""
    seals = staged(line_seals(docs).distinct(), "line-seals")
    members = line_templates(docs, seals)
    known = seals.join(members, "seal", "left").select(
        "doc", "anon", "seal", F.coalesce("template", "seal").alias("template")
    )
    known = staged(known, "line-templates")
    recurring = known.groupBy("template").agg(*_documents()).where("several").drop("several")
    # Written, so that both sides of the join are plain shuffles: a template with a large
    # share of all lines can then be split.
    recurring = staged(recurring, "recurring")
    others = "doc <> first or anon <> first_anon"
    return known.join(recurring, "template").where(others).select("doc", "anon", "seal")


def drop_recurring_lines(docs: DataFrame, count: str | None = "n_dropped") -> DataFrame:
    """The rows of ``docs`` without the lines of recurring templates, and how many each row
    has lost, as the column ``count`` if it has a name (one of that name is replaced).

    All other columns stay but ``text``, which loses lines, and ``n_chars``, which follows it.
    Lines under 3 tokens are left alone. Rows with one ``doc_id`` count as one document. A row
    without an id is a document of its own, after all with an id and in the order of a hash of
    its text; repeated ones with equal texts count as one. Which lines share a template depends
    on the lines alone, not on order, ties or repeats. Whole texts of any length are read. A
    null text stays null; a document whose lines all go keeps an empty text. An empty table
    gives no rows.
    """
    drops = dropped_lines(docs).groupBy("doc", "anon").agg(F.collect_list("seal").alias("seals"))
    others = docs.select(*[c for c in docs.columns if count is None or c.lower() != count.lower()])
    packed = docs.select(*_document(), "text", other_columns(others).alias("row"))
    packed = packed.join(drops, ["doc", "anon"], "left").select("text", "seals", "row")
    schema = StructType([StructField("text", StringType()), StructField("n_dropped", LongType()), packed.schema["row"]])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts, counts = [], []
            for text, seals in zip(raw_texts(batch.column(0)), batch.column(1).to_pylist()):
                if not seals or text is None:
                    texts.append(text)
                    counts.append(0)
                    continue
                gone = set(seals)
                lines = text.split(b"\n")
                left = [x for x in lines if _seal(tokens_of(x)) not in gone]
                texts.append(b"\n".join(left))
                counts.append(len(lines) - len(left))
            yield pa.record_batch(
                [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), batch.column(2)],
                names=["text", "n_dropped", "row"],
            )

    cleaned = packed.mapInArrow(each, schema)
    if count is None:
        return cleaned.select(*with_text(docs, F.col("text")))
    return cleaned.select(*with_text(others, F.col("text")), F.col("n_dropped").alias(count))

