"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Every source is one long stream: its documents in a fixed random order, passed over again
up to the cap, cut into blocks. Its target says how many blocks of the stream the mix
takes. A tree deals these quotas to output shards: a node splits the blocks it has into
the shares of its two halves by a multivariate-hypergeometric draw, as if all blocks were
shuffled together, down to single shards. A shard then takes its own, disjoint range of
each source's permuted blocks, and its documents are shuffled within the shard. What no
shard has drawn is not in the mix.

Each node draws by a seed of its own, so that its children are the same wherever they are
worked out: the tree is grown some levels at a time, by a task for each node of the level.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, staged
from .lines import with_text

CAP = 3
WEIGHTS = (1, 2, 3)
BLOCK_WORDS = 65_536
SHARD_BLOCKS = 64  # blocks of a shard, if the number of shards is not given
LEVELS = 10  # of the tree that one task grows below a node
_DIGITS = 3  # hexadecimal digits that tell the slice of a source: 4096 slices


def split_tree(
    quotas: np.ndarray, shards: int, seed: int, first: int = 0, levels: int | None = None
) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """The nodes ``levels`` below a node, or its single shards, in order:
    ``first, shards, blocks, before``.

    A node holds the ``shards`` from ``first`` on; ``quotas`` and ``blocks`` tell its blocks of
    each source, ``before`` how many blocks of the given node lie in nodes to its left. Blocks of
    all nodes add up to ``quotas``; shards differ by about one block at most at each split.
    """
    if shards == 1 or levels == 0:
        return [(first, shards, quotas, np.zeros_like(quotas))]
    left, below = shards // 2, None if levels is None else levels - 1
    total = int(quotas.sum())
    # marginals: one draw per source, whatever the number of blocks.
    taken = (
        np.random.default_rng([seed, first, shards]).multivariate_hypergeometric(
            quotas, total * left // shards, method="marginals"
        )
        if total
        else quotas
    )
    lower = split_tree(taken, left, seed, first, below)
    upper = split_tree(quotas - taken, shards - left, seed, first + left, below)
    return lower + [(f, n, blocks, before + taken) for f, n, blocks, before in upper]


# A node, and of each of its sources: rank, blocks it has and where they start among the
# permuted ones; the source's blocks in all, and its permutation.
_NODE = "first long, shards long, rank array<int>, blocks array<long>, start array<long>, " + (
    "total array<long>, inverse array<long>, shift array<long>"
)
_OF_SOURCE = ("rank", "blocks", "start", "total", "inverse", "shift")


def _root(shards: int, seed: int):
    def root(sources: pd.DataFrame) -> pd.DataFrame:
        sources = sources[sources["blocks"] > 0].sort_values("rank", ignore_index=True)
        if sources["blocks"].sum() >= 10**9:
            raise ValueError("over 10^9 blocks: raise block_words")
        inverses, shifts = [], []
        for rank, n in zip(sources["rank"].tolist(), sources["blocks"].tolist()):
            # A bijection of the blocks: block b stands at (b * step + shift) mod n.
            rng = np.random.default_rng([seed, rank, n])
            step = int(rng.integers(1, max(n, 2)))
            while math.gcd(step, n) > 1:
                step += 1
            inverses.append(pow(step, -1, n) if n > 1 else 0)
            shifts.append(int(rng.integers(0, n)))
        blocks = sources["blocks"].tolist()
        columns = [sources["rank"].tolist(), blocks, [0] * len(blocks), blocks, inverses, shifts]
        return pd.DataFrame([[0, shards, *columns]], columns=["first", "shards", *_OF_SOURCE])

    return root


def _grown(nodes: DataFrame, seed: int) -> DataFrame:
    """The nodes ``LEVELS`` below; those without blocks are left out."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node in frame.itertuples():
                given = {c: np.asarray(getattr(node, c)) for c in _OF_SOURCE}
                rows = []
                below = split_tree(given["blocks"].astype(np.int64), node.shards, seed, node.first, LEVELS)
                for first, shards, blocks, before in below:
                    has = blocks > 0
                    of = {**given, "blocks": blocks, "start": given["start"] + before}
                    rows.append([first, shards, *(of[c][has] for c in _OF_SOURCE)])
                found = pd.DataFrame(rows, columns=["first", "shards", *_OF_SOURCE])
                yield found[found["blocks"].map(len) > 0]

    return nodes.mapInPandas(each, _NODE)


def _drawn(shards: DataFrame) -> DataFrame:
    """``rank, block, shard`` of each block that a shard draws."""

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for node in frame.itertuples():
                counts = np.asarray(node.blocks)
                ends = np.cumsum(counts)
                within = np.arange(ends[-1]) - np.repeat(ends - counts, counts)
                start, total, inverse, shift = (
                    np.repeat(np.asarray(x), counts) for x in (node.start, node.total, node.inverse, node.shift)
                )
                block = (start + within - shift) % total * inverse % total
                yield pd.DataFrame({"rank": np.repeat(np.asarray(node.rank), counts), "block": block, "shard": node.first})

    return shards.mapInPandas(each, "rank int, block long, shard long")


def deal_blocks(quotas: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """``rank, block, shard``: the shard that draws each block of each source, for
    ``rank, blocks``. Each block is drawn once. Sources are one row each; a node of the tree
    holds the sources that it has blocks of."""
    nodes = quotas.select("rank", "blocks").groupBy().applyInPandas(_root(shards, seed), _NODE)
    for _ in range(max(1, math.ceil(math.log2(shards) / LEVELS))):
        nodes = _grown(nodes, seed).repartition("first")
    return _drawn(nodes)


def targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, rank, weight, target`` from ``source, source_size``.

    Weights go round by code point of the source, null last. A target is the share of all
    words by weight, at most ``CAP`` times the source's size; what is cut off is shared
    among the others by weight until none is above. That level is found from the sources in
    the order in which they reach their cap. One row per source.
    """
    order = Window.orderBy(F.col("source").isNull(), "source")
    ranked = sizes.withColumn("rank", F.row_number().over(order) - 1).withColumn(
        "weight",
        F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int")).cast("long"),
    )
    cap = (F.lit(CAP) * F.col("source_size")).cast("long")
    by_cap = Window.orderBy(cap / F.col("weight"), "rank")
    every = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_cap.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum(cap).over(before), F.lit(0))
    weights = F.sum("weight").over(onward)
    # A source is free if its share of what the sources before it leave is below its cap.
    found = ranked.select(
        "*", cap.alias("cap"), left.alias("left"), weights.alias("weights")
    ).withColumn("free", F.col("left") * F.col("weight") <= F.col("cap") * F.col("weights"))
    place = F.row_number().over(by_cap)
    found = found.withColumn("place", place)
    first = F.min_by(F.struct("left", "weights", "place"), F.when(F.col("free"), F.col("place")))
    found = found.withColumn("level", first.over(every))
    share = F.col("level.left") * F.col("weight") / F.col("level.weights")
    capped = F.coalesce(F.col("place") < F.col("level.place"), F.lit(True))
    return found.select(
        "source", "source_size", "rank", "weight",
        F.when(capped, F.col("cap").cast("double")).otherwise(share.cast("double")).alias("target"),
    )


def allocate(rows: DataFrame, seed: int = 0) -> DataFrame:
    """The place of each row in its source's stream, for rows with ``source, size, key``.

    Adds ``source_size, rank, target`` and ``start``, the words before it in the order of
    the MD5 of the seed and ``key``. A source is cut into 4096 slices by that hash; slices are summed
    first, so that a source with a third of all rows is never one task.
    """
    rows = rows.withColumn("place", F.md5(F.concat(F.lit(f"{seed}:"), "key").cast("binary")))
    rows = rows.withColumn("slice", F.substring("place", 1, _DIGITS))
    slices = rows.groupBy("source", "slice").agg(F.sum("size").alias("words"))
    so_far = Window.partitionBy("source").orderBy("slice")
    slices = slices.select(
        F.col("source").alias("of"), F.col("slice").alias("part"),
        (F.sum("words").over(so_far) - F.col("words")).alias("before"),
    )
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    known = targets(sums).withColumnRenamed("source", "of")
    slices = slices.join(known, slices["of"].eqNullSafe(known["of"])).select(
        slices["of"], "part", "before", "source_size", "rank", "target"
    )
    within = Window.partitionBy("source", "slice").orderBy("place", "size", "row_key")
    return (
        rows.withColumn("in_slice", F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .join(slices, F.col("source").eqNullSafe(F.col("of")) & (F.col("slice") == F.col("part")))
        .withColumn("start", F.col("before") + F.col("in_slice"))
        .drop("slice", "in_slice", "of", "part", "before")
    )


def _words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _row_key(docs: DataFrame) -> Column:
    """Tells rows by their id, source and text."""
    text = F.md5(F.col("text").cast("binary"))
    return F.md5(F.to_json(F.struct("doc_id", "source", text.alias("text"))).cast("binary"))


def mix(
    docs: DataFrame, shards: int | None = None, block_words: int = BLOCK_WORDS, seed: int = 0
) -> DataFrame:
    """One row for each time that the mix takes a document, or one if it never does:
    ``row_key, doc_id, source, size, source_size, target, start, pass, words, shard, place``.

    A document belongs to the block in which it begins, and is taken by the shard that draws
    this block. ``words`` is how many words are taken: all, but for the one document per source at which
    its quota ends, of which the mix takes the first words; 0 if the document is not taken
    (``pass`` and ``shard`` are null then). Order by ``shard, place`` gives the shuffled
    shards.

    The size of a document is the words of its text, null counting as empty; a document
    without words is taken in no pass. Null sources are one source, the last. Equal rows are
    documents of their own; the order of rows with one ``doc_id`` is that of their sizes. An
    empty table gives no rows; texts of any length are counted whole. The same rows and seed give the same mix. Without a number of
    ``shards`` there is one for each ``SHARD_BLOCKS`` blocks.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = docs.select(
        _row_key(docs).alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "source",
        _words(F.col("text")).alias("size"), key.alias("key"),
    )
    rows = staged(rows, "sizes")
    if shards is None:
        words = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, math.ceil(words / (SHARD_BLOCKS * block_words)))
    rows = allocate(rows, seed)
    quota = F.round("target").cast("long")
    passes = F.when(
        F.col("source_size") > 0,
        F.ceil((F.col("quota") - F.col("start")) / F.col("source_size")),
    ).otherwise(0)
    taken = F.when((F.col("size") > 0) & (passes > 0), F.sequence(F.lit(0), (passes - 1).cast("int")))
    copies = (
        rows.withColumn("quota", quota)
        .select("*", F.explode_outer(taken).alias("pass"))
        .withColumn("at", F.col("pass") * F.col("source_size") + F.col("start"))
        .withColumn(
            "words",
            F.when(F.col("pass").isNull(), F.lit(0))
            .otherwise(F.least("size", F.col("quota") - F.col("at")))
            .cast("long"),
        )
        .withColumn("block", F.floor(F.col("at") / block_words))
    )
    # Rows that are in no block are spread; they meet none.
    copies = copies.withColumn(
        "block", F.coalesce("block", -1 - F.pmod(F.xxhash64("place"), F.lit(1 << 16)))
    )
    blocks = F.ceil(quota / block_words).cast("long").alias("blocks")
    quotas = rows.select("rank", "target").groupBy("rank").agg(F.max("target").alias("target"))
    dealt = staged(deal_blocks(quotas.select("rank", blocks), shards, seed), "blocks")
    mixed = copies.join(dealt, ["rank", "block"], "left")
    in_mix = F.col("shard").isNotNull()
    return mixed.where(in_mix | F.coalesce(F.col("pass") == 0, F.lit(True))).select(
        "row_key", "doc_id", "source", "size", "source_size", "target", "start",
        F.when(in_mix, F.col("pass")).alias("pass"),
        F.when(in_mix, F.col("words")).otherwise(F.lit(0)).cast("long").alias("words"), "shard",
        F.md5(F.concat_ws(":", F.lit(seed), "pass", "place").cast("binary")).alias("place"),
    )


def mixed_documents(docs: DataFrame, shards: int | None = None, seed: int = 0) -> DataFrame:
    """The mix itself: one row of ``docs`` for each time a document is taken, dealt to
    shards and shuffled within each.

    All columns are as they came, but for the document at the end of a source's quota,
    which is cut after the words taken (``text``, and ``n_chars`` with it). Rows with the
    same id, source and text count as copies of one of them. The mix is settled without
    the texts, which then move once to their place in it and once to their shard.
    """
    taken = mix(docs, shards, seed=seed).where("words > 0")
    taken = taken.select("row_key", "size", "words", "shard", "place")
    given = docs.select(_row_key(docs).alias("row_key"), F.struct("*").alias("row"))
    given = given.dropDuplicates(["row_key"])
    head = F.concat(
        F.lit(r"^(?:[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++){"), F.col("words").cast("string"), F.lit("}+")
    )
    text = F.col("row.text")
    text = F.when(F.col("words") < F.col("size"), F.regexp_substr(text, head)).otherwise(text)
    dealt = given.join(taken, "row_key").withColumn("text", text)
    dealt = dealt.repartition("shard").sortWithinPartitions("shard", "place")
    return dealt.select(*with_text(docs, F.col("text")))
