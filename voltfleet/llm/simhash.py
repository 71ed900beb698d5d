"""SimHash fingerprints, and links between them by tables of pivot distances.

Pairs are compared only where they can be close: of seven pieces of a fingerprint, four
differing bits leave at least three untouched, so a linked pair agrees in one of the 35
choices of three pieces. Rows which agree there meet, and a table of their Hamming
distances to fixed reference fingerprints (pivots) is computed once. By the triangle
inequality two fingerprints are at least as far apart as any two of these coordinates, so
pairs with a coordinate difference above the limit are discarded; the rest is verified.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import LOWER, map_batches, raw_texts, staged
from .components import connected_components

SEED = 42
PIVOTS = 32
TILE = 4096  # rows of one meeting that are compared in one go
FEW = 8  # up to so many rows, all pairs of a meeting are tried at once
_CHUNK = 1 << 16
_FOUND = "combo int, key long, tile int, a long, b long"
_FOUND_ARROW = pa.schema(
    [("combo", pa.int32()), ("key", pa.int64()), ("tile", pa.int32()), ("a", pa.int64()), ("b", pa.int64())]
)


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64 bits set in over half of the hashes of a text's shingles."""
    words = (text or b"").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = ends[min(width, len(words)) - 1 :].tolist()
    first = starts[: len(last)].tolist()
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(last), _CHUNK):
        spans = zip(first[at : at + _CHUNK], last[at : at + _CHUNK])
        hashes = np.array([digest(joined[s:e], SEED) for s, e in spans], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(last), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4, *others: Column) -> DataFrame:
    """``doc_id, fp`` and ``others`` for every row; ``fp`` is the fingerprint as a signed long."""
    given = docs.select("text", F.col("doc_id").cast("long").alias("doc_id"), *others)

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [fingerprint(text, width) for text in raw_texts(batch.column(0))]
        fp = pa.array(np.array(found, np.uint64).view(np.int64))
        return pa.record_batch(
            [batch.column(1), fp, *batch.columns[2:]],
            names=["doc_id", "fp", *batch.schema.names[2:]],
        )

    schema = StructType([given.schema["doc_id"], StructField("fp", LongType()), *given.schema[2:]])
    return map_batches(given, each, schema)


def pivot_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint to every pivot."""
    pivots = np.random.default_rng(SEED).integers(0, 2**64, PIVOTS, np.uint64)
    return np.bitwise_count(fps[:, None] ^ pivots[None, :]).astype(np.int8)


def _close(fps, table, i, j, bits: int) -> np.ndarray:
    """Which of the pairs (i, j) differ in at most ``bits`` bits."""
    near = np.abs(table[i] - table[j]).max(axis=1, initial=0) <= bits
    near[near] = np.bitwise_count(fps[i[near]] ^ fps[j[near]]) <= bits
    return near


def spanning_links(fps: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what all links within ``bits`` bits connect, one less than rows
    at most. Rows reached are not compared again."""
    table = pivot_table(fps)
    left = np.arange(len(fps))
    a, b = [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            hit = _close(fps, table, np.full(len(left), x), left, bits)
            reached = left[hit]
            left = left[~hit]
            a.append(np.full(len(reached), x))
            b.append(reached)
            front.extend(reached.tolist())
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *a]), np.concatenate([empty, *b])


def _pairs_of_small(fps, table, start, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within meetings of at most ``FEW`` rows; ``start``: number of each row's meeting."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for lag in range(1, FEW):
        i = np.flatnonzero(start[:-lag] == start[lag:])
        if not len(i):
            break
        i = i[_close(fps, table, i, i + lag, bits)]
        a.append(i)
        b.append(i + lag)
    return np.concatenate(a), np.concatenate(b)


def _meet(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """Links of rows sorted by meeting (combo, key).

    A meeting of over ``TILE`` rows is dealt to tiles: its rows are also passed on with
    their tile, for the links between tiles (``b`` is null there).
    """

    def made(combo, key, tile, a, b):
        return pa.record_batch(
            [pa.array(combo, pa.int32()), pa.array(key, pa.int64()), pa.array(tile, pa.int32()), pa.array(a, pa.int64()), b],
            schema=_FOUND_ARROW,
        )

    def links(a, b):
        zero = np.zeros(len(a), np.int64)
        return made(zero, zero, zero, a, pa.array(b, pa.int64()))

    def passed_on(combo, key, tile, fps):
        n = len(fps)
        return made(
            np.full(n, combo), np.full(n, key), np.full(n, tile), fps, pa.nulls(n, pa.int64())
        )

    combo = key = fps = np.zeros(0, np.int64)
    tiles = 0  # of the first meeting that have been dealt with
    for batch in _ended(batches):
        if batch is not None:
            combo, key, fps = (
                np.concatenate((old, new.to_numpy(zero_copy_only=False)))
                for old, new in zip((combo, key, fps), batch.columns)
            )
        if not len(fps):
            continue
        change = np.flatnonzero((combo[1:] != combo[:-1]) | (key[1:] != key[:-1])) + 1
        starts = np.concatenate(([0], change))
        stop = np.concatenate((change, [len(fps)]))
        done = len(fps) if batch is None else starts[-1]
        # All meetings but the last, which may go on in the next batch.
        whole = stop <= done
        size = stop - starts
        values = fps.view(np.uint64)
        if tiles and whole[0]:  # the end of a meeting whose tiles came before
            part = fps[: stop[0]]
            yield passed_on(combo[0], key[0], tiles, part)
            i, j = spanning_links(values[: stop[0]], bits)
            yield links(part[i], part[j])
            whole[0], tiles = False, 0
        few = np.flatnonzero(whole & (size > 1) & (size <= FEW))
        if len(few):
            at = np.repeat(starts[few], size[few])
            rows = at + _within(size[few])
            table = pivot_table(values[rows])
            i, j = _pairs_of_small(values[rows], table, at, bits)
            yield links(fps[rows[i]], fps[rows[j]])
        for m in np.flatnonzero(whole & (size > FEW)):
            for t, s in enumerate(range(starts[m], stop[m], TILE)):
                e = min(s + TILE, stop[m])
                if size[m] > TILE:
                    yield passed_on(combo[s], key[s], t, fps[s:e])
                i, j = spanning_links(values[s:e], bits)
                yield links(fps[s + i], fps[s + j])
        combo, key, fps = combo[done:], key[done:], fps[done:]
        while batch is not None and len(fps) > TILE:  # a large meeting: leave no more than a tile
            part = fps[:TILE]
            yield passed_on(combo[0], key[0], tiles, part)
            i, j = spanning_links(part.view(np.uint64), bits)
            yield links(part[i], part[j])
            combo, key, fps, tiles = combo[TILE:], key[TILE:], fps[TILE:], tiles + 1


def _ended(batches):
    yield from batches
    yield None


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each size in turn."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1]) - np.repeat(ends - sizes, sizes)


def _between(bits: int):
    """Links between two tiles of a meeting."""

    def join(group: pd.DataFrame) -> pd.DataFrame:
        fps = np.unique(group["a"].to_numpy())
        i, j = spanning_links(fps.view(np.uint64), bits)
        return pd.DataFrame({"a": fps[i], "b": fps[j]})

    return join


def _masks(bits: int, spare: int) -> list[int]:
    """Masks of ``spare`` untouched pieces out of ``bits + spare``, as signed longs."""
    pieces = bits + spare
    cuts = [64 * i // pieces for i in range(pieces + 1)]
    piece = [(1 << hi) - (1 << lo) for lo, hi in zip(cuts, cuts[1:])]
    masks = [sum(chosen) for chosen in combinations(piece, spare)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def close_links(fps: DataFrame, bits: int = 4, spare: int = 3) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints (``fp``) that connect the same
    fingerprints as all links of at most ``bits`` differing bits do.

    ``spare`` pieces besides one for each differing bit: a higher number makes smaller
    meetings and more of them, with the same answer. The default suits up to some 10^9
    fingerprints. A meeting larger than ``TILE`` rows is split into tiles, and pairs of
    tiles are tasks of their own.
    """
    keys = [F.col("fp").bitwiseAND(F.lit(m)) for m in _masks(bits, spare)]
    met = fps.select(F.posexplode(F.array(*keys)).alias("combo", "key"), "fp")
    met = met.repartition("combo", "key").sortWithinPartitions("combo", "key")
    found = staged(met.mapInArrow(lambda batches: _meet(batches, bits), _FOUND), "meetings")
    tiled = found.where("b is null").select("combo", "key", "tile", "a")
    tiles = tiled.groupBy("combo", "key").agg(F.max("tile").alias("last"))
    pairs = (
        tiled.join(tiles, ["combo", "key"])
        .select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
        .where("tile <> other")
        .select(
            "combo", "key", "a",
            F.least("tile", "other").alias("low"), F.greatest("tile", "other").alias("high"),
        )
    )
    across = pairs.groupBy("combo", "key", "low", "high").applyInPandas(
        _between(bits), "a long, b long"
    )
    return found.where("b is not null").select("a", "b").union(across)


def _with_components(rows: DataFrame, bits: int) -> DataFrame:
    distinct = rows.groupBy("fp").agg(F.min("doc_id").alias("first"))
    roots = connected_components(close_links(distinct.select("fp"), bits))
    named = distinct.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first", F.coalesce("root", "fp").alias("root")
    )
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return rows.join(named.join(least, "root").select("fp", "root", "component_id"), "fp")


def simhash_components(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """``doc_id, fp, root, component_id`` for every row.

    Fingerprints of ``width``-word shingles link at ``bits`` or fewer differing bits.
    ``root`` names the component by its least fingerprint, ``component_id`` by the smallest
    ``doc_id`` in it (null if all its ids are null). A null or empty text has fingerprint
    zero, and is linked like any other. Equal rows are returned each. An empty table gives
    no rows; other columns are ignored.
    """
    rows = staged(fingerprints(docs, width), "fingerprints")
    return _with_components(rows, bits).select("doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, width: int = 4, bits: int = 4) -> DataFrame:
    """The rows of ``docs``, one of each component: the one with the smallest ``doc_id``.

    If several rows have that id, one with the least MD5 of its text stays. A null id stays
    only where its component has no other. All columns are returned as they came.
    """
    seal = F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("seal")
    rows = staged(fingerprints(docs, width, seal), "fingerprints")
    stay = (
        _with_components(rows, bits)
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "component_id")
        .agg(F.min("seal").alias("least"))
    )
    given = docs.select(
        F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), seal
    )
    same = F.col("id").eqNullSafe(F.col("component_id")) & (F.col("seal") == F.col("least"))
    return given.join(stay, same, "left_semi").dropDuplicates(["id", "seal"]).select("row.*")
