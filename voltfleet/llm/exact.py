"""Exact deduplication against a minimal perfect hash of the texts seen before.

Digests of the history are dealt to shards by their first bytes. Each shard holds a
minimal perfect hash (levels of bits; a key lives in the first level where it collides
with no other key) which gives every digest a slot of its own, and in that slot the full
digest with the locator of the text that stays. A hash of this kind answers for any
key, so a lookup compares all bytes before it calls a digest a member.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

SPREAD = 2.0  # bits of a level for each key that is still to be placed
LEVELS = 64  # with two bits a key, each level places over half of the rest
_INDEX = "shard int, sizes array<int>, bits binary, digests binary, winners array<long>, copies array<long>"
_FOUND = "digest binary, winner long, copies long, known boolean"


def _words(digests: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each digest; its bytes are random already."""
    words = digests.view("<u8")
    return words[:, 1], words[:, 2] | np.uint64(1)


def _as_matrix(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 32)


def _place(h1: np.ndarray, h2: np.ndarray, level: int, size: int) -> np.ndarray:
    """A place for each key, for every level another one."""
    x = h1 + np.uint64(level) * h2
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return ((x ^ x >> np.uint64(31)) % np.uint64(size)).astype(np.int64)


def perfect_hash(digests: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes of the levels and their bits, one after the other, for distinct digests."""
    h1, h2 = _words(digests)
    sizes, levels = [], []
    while len(h1):
        if len(sizes) == LEVELS:
            raise ValueError("digests are not distinct")
        size = max(1, math.ceil(SPREAD * len(h1)))
        at = _place(h1, h2, len(sizes), size)
        alone = np.bincount(at, minlength=size) == 1
        left = ~alone[at]
        h1, h2 = h1[left], h2[left]
        sizes.append(size)
        levels.append(alone)
    return sizes, np.concatenate(levels) if levels else np.zeros(0, bool)


def slots(digests: np.ndarray, sizes: list[int], bits: np.ndarray) -> np.ndarray:
    """The slot of each digest, -1 where no level has a bit for it."""
    rank = np.cumsum(bits) - 1
    h1, h2 = _words(digests)
    found = np.full(len(digests), -1, np.int64)
    todo, base = np.arange(len(digests)), 0
    for level, size in enumerate(sizes):
        at = base + _place(h1[todo], h2[todo], level, size)
        hit = bits[at]
        found[todo[hit]] = rank[at[hit]]
        todo = todo[~hit]
        base += size
    return found


def _build(group: pd.DataFrame) -> pd.DataFrame:
    digests = _as_matrix(group["digest"])
    sizes, bits = perfect_hash(digests)
    order = np.empty(len(digests), np.int64)
    order[slots(digests, sizes, bits)] = np.arange(len(digests))
    return pd.DataFrame(
        {
            "shard": group["shard"].iloc[:1].to_numpy(),
            "sizes": [sizes],
            "bits": [np.packbits(bits).tobytes()],
            "digests": [digests[order].tobytes()],
            # Locators may be null, so they stay Python numbers.
            "winners": [[None if pd.isna(x) else int(x) for x in group["winner"].iloc[order]]],
            "copies": [group["copies"].to_numpy()[order].tolist()],
        }
    )


def _find(index: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
    known = np.zeros(len(batch), bool)
    if len(index) and len(batch):
        row = index.iloc[0]
        sizes = [int(x) for x in row["sizes"]]
        bits = np.unpackbits(np.frombuffer(row["bits"], np.uint8))[: sum(sizes)].astype(bool)
        stored = np.frombuffer(row["digests"], np.uint8).reshape(-1, 32)
        digests = _as_matrix(batch["digest"])
        slot = slots(digests, sizes, bits)
        known = (slot >= 0) & (stored[slot] == digests).all(axis=1)
    return batch.drop(columns="shard").assign(known=known)


def _shard(digest: Column, shards: int) -> Column:
    return (F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long") % shards).cast("int")


def build_index(texts: DataFrame, shards: int) -> DataFrame:
    """One row per shard from distinct ``digest, winner, copies``."""
    dealt = texts.select(
        _shard(F.col("digest"), shards).alias("shard"), "digest", "winner", "copies"
    )
    return dealt.groupBy("shard").applyInPandas(_build, _INDEX)


def look_up(index: DataFrame, texts: DataFrame, shards: int) -> DataFrame:
    """``texts`` (distinct ``digest, winner, copies``) with ``known``: in the index or not."""
    dealt = texts.select(
        _shard(F.col("digest"), shards).alias("shard"), "digest", "winner", "copies"
    )
    return (
        index.groupBy("shard").cogroup(dealt.groupBy("shard")).applyInPandas(_find, _FOUND)
    )


def exact_dedup(
    docs: DataFrame, history: Column | None = None, keys_per_shard: int = 50_000
) -> DataFrame:
    """Groups of equal texts: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when identical after lower-casing A-Z; null counts as empty. Of equal
    texts the largest ``doc_id`` stays. ``history`` tells the rows seen before (a condition
    on ``doc_id``; without one, the lower half of the ids): they make the index, the others are
    looked up in it, and those not found are grouped among themselves. The answer does not
    depend on where the history ends.

    A null ``doc_id`` is smaller than any other. Rows with the same text and id are
    returned one by one, and one of them is kept. An empty table gives no rows. Other
    columns are ignored.

    A shard holds about ``keys_per_shard`` digests of either side, whatever the size of
    the table, and copies are folded into one row per text before they move.
    """
    text = ascii_lower(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.sha2(text, 256)).alias("digest")
    )
    rows = staged(rows.groupBy("digest", "doc_id").agg(F.count("*").alias("n")), "digests")
    if history is None:
        low, high = rows.agg(F.min("doc_id"), F.max("doc_id")).first()
        history = F.col("doc_id") <= F.lit(0 if low is None else (low + high) // 2)
    seen = F.coalesce(history, F.lit(False))

    def texts(part: DataFrame) -> DataFrame:
        return part.groupBy("digest").agg(
            F.max("doc_id").alias("winner"), F.sum("n").alias("copies")
        )

    old, new = texts(rows.where(seen)), texts(rows.where(~seen))
    distinct = rows.groupBy("digest").count().count()
    shards = max(1, math.ceil(distinct / keys_per_shard))
    found = staged(look_up(build_index(old, shards), new, shards), "lookups")
    groups = old.union(found.where("known").drop("known")).groupBy("digest").agg(
        F.max("winner").alias("keep_id"), F.sum("copies").alias("group_size")
    )
    groups = groups.union(found.where("not known").drop("known"))
    return (
        rows.join(groups, "digest")
        .select("*", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )
    )
