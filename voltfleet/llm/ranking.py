"""Ranked lexical search: MaxScore over blocks of documents, with bounds of term pairs.

The index is an inverted one in blocks: each holds the postings of all terms of up to
``BLOCK_DOCS`` documents, so no posting list is longer than a block, however common its
term. A search takes the lists of the terms asked for, turns counts into impacts and, per
block and for each pair of neighbouring terms of an item, keeps the intersection of the two
lists with the largest sum of impacts in it. Two terms bound a score by that sum where
both occur and by the larger of the two else, which is less than the sum of both maxima.
With these bounds an item skips blocks, then lists, then documents which cannot reach the
threshold: the k-th largest of the scores known so far, over all blocks.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, arrow_schema, ascii_lower, raw_texts, staged

#: A term, as a pattern over code points and over UTF-8 bytes.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_TERM_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

#: A block ends with either so many documents or so many bytes of text.
BLOCK_DOCS, BLOCK_BYTES = 4096, 16 << 20
#: Items searched together: their terms and pairs are what a task holds besides a block.
ITEMS_AT_ONCE = 1024

_INDEX = "block long, term string, ids array<long>, places array<int>, counts array<int>"


def _inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents to blocks: a row with their ids and lengths, and a row per term."""
    number = TaskContext.get().partitionId() << 32
    ids, lengths, terms, size = [], [], {}, 0

    def block() -> Iterator[pa.RecordBatch]:
        yield _index_rows(number, [None], [ids], [[]], [lengths])
        names = list(terms)
        for start in range(0, len(names), 20_000):
            some = names[start : start + 20_000]
            yield _index_rows(
                number, [t.decode() for t in some], [None] * len(some),
                [terms[t][0] for t in some], [terms[t][1] for t in some],
            )

    for batch in batches:
        columns = batch.column("doc_id").to_pylist(), raw_texts(batch.column("text"))
        for doc_id, text in zip(*columns):
            found = Counter(_TERM_BYTES.findall((text or b"").translate(LOWER)))
            for term, count in found.items():
                lists = terms.get(term)
                if lists is None:
                    lists = terms[term] = ([], [])
                lists[0].append(len(ids))
                lists[1].append(count)
            ids.append(doc_id)
            lengths.append(found.total())
            size += len(text or b"")
            if len(ids) == BLOCK_DOCS or size >= BLOCK_BYTES:
                yield from block()
                number, ids, lengths, terms, size = number + 1, [], [], {}, 0
    if ids:
        yield from block()


def _index_rows(block: int, *columns: list) -> pa.RecordBatch:
    types = pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())
    arrays = [pa.array([block] * len(columns[0]), pa.int64())]
    arrays += [pa.array(c, t) for c, t in zip(columns, types)]
    return pa.RecordBatch.from_arrays(arrays, ["block", "term", "ids", "places", "counts"])


def build_index(docs: DataFrame) -> DataFrame:
    """The inverted index of all terms of all documents, written to the shared folder.

    Each row of ``docs`` is a document of its own, rows that repeat an id or lack one too.
    A null or empty text has no term; such a document is indexed and never found. Texts of
    any length are taken whole; a block with a very long one ends with it. Other columns are
    left aside. Built without a shuffle; a block is in one task, its size is bounded.
    """
    return staged(docs.select("doc_id", "text").mapInArrow(_inverted, _INDEX), "index")


def _asked(items: DataFrame) -> DataFrame:
    """The terms of each item with a number for it, and the group which it is searched in."""
    numbered = staged(
        items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()),
        "items",
    )
    terms = F.array_distinct(F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(TERM), F.lit(0)))
    group = F.pmod(F.xxhash64("item"), F.lit(-(-max(1, numbered.count()) // ITEMS_AT_ONCE)))
    return staged(
        numbered.select("item_id", "item", group.alias("items"), F.explode(terms).alias("term")),
        "asked",
    )


def _packed(values, kind) -> bytes:
    return np.asarray(values, kind).tobytes()


class _Lists:
    """The posting lists of a block which a group of items asks for, with their impacts."""

    def __init__(self, rows: list[dict], n_docs: int, n_terms: int):
        header = next(r for r in rows if r["term"] is None)
        self.ids = header["ids"]
        lengths = np.asarray(header["counts"], np.int64)
        # Python's integers, as 90 * n * N can pass 64 bits on a large corpus.
        share = {int(n): (90 * int(n) * n_docs) // max(1, n_terms) for n in np.unique(lengths)}
        m = 10 + np.array([share[int(n)] for n in lengths], np.int64)
        self.items: dict[int, list[int]] = {}
        self.places, self.impacts = [], []
        lists = [r for r in rows if r["term"] is not None]
        # By weight, so that neighbours of an item are terms of like rarity.
        for row in sorted(lists, key=lambda r: (-r["weight"], r["term"])):
            places = np.asarray(row["places"], np.int32)
            counts = np.asarray(row["counts"], np.int64)
            score = (1_000_000_000 * counts) // (1000 * counts + 8 * m[places])
            for item in row["askers"]:
                self.items.setdefault(item, []).append(len(self.places))
            self.places.append(places)
            self.impacts.append(row["weight"] * score)
        self.largest = [int(i.max()) if len(i) else 0 for i in self.impacts]
        self.pairs: dict[tuple[int, int], tuple[np.ndarray, int]] = {}
        for terms in self.items.values():
            for pair in zip(terms[::2], terms[1::2]):
                if pair not in self.pairs:
                    self.pairs[pair] = self._intersection(*pair)

    def _intersection(self, a: int, b: int) -> tuple[np.ndarray, int]:
        """Places of both terms, and the largest sum of their impacts in one document."""
        both, at_a, at_b = np.intersect1d(
            self.places[a], self.places[b], assume_unique=True, return_indices=True
        )
        joint = self.impacts[a][at_a] + self.impacts[b][at_b]
        return both, int(joint.max()) if len(joint) else 0

    def scores(self, terms: list[int]) -> np.ndarray:
        found = np.zeros(len(self.ids), np.int64)
        for t in terms:
            found[self.places[t]] += self.impacts[t]
        return found


_BLOCK = (
    "items long, block long, ids array<long>, askers array<struct<item: long, terms: array<int>>>, "
    "starts array<int>, places binary, impacts binary, largest array<long>, "
    "pairs array<struct<a: int, b: int, joint: long, both: binary>>, "
    "known array<struct<item: long, best: array<long>>>"
)


def _block_lists(top: int, n_docs: int, n_terms: int):
    """Rows of blocks in order, to a row per block: lists, pair lists, first known scores."""

    schema = arrow_schema(_BLOCK)

    def folded(rows: list[dict]) -> dict:
        lists = _Lists(rows, n_docs, n_terms)
        known = []
        for item, terms in lists.items.items():
            # What two pairs of its rarest terms give is a lower bound of a document's score.
            part = lists.scores(terms[:4])
            best = np.sort(part[part > 0])[::-1][:top]
            known.append({"item": item, "best": best.tolist()})
        starts = np.cumsum([0, *map(len, lists.places)])
        empty = [np.zeros(0, np.int32)]
        return {
            "items": rows[0]["items"], "block": rows[0]["block"], "ids": lists.ids,
            "askers": [{"item": i, "terms": t} for i, t in lists.items.items()],
            "starts": starts.tolist(),
            "places": np.concatenate(empty + lists.places).astype("<i4").tobytes(),
            "impacts": np.concatenate(empty + lists.impacts).astype("<i8").tobytes(),
            "largest": lists.largest,
            "pairs": [
                {"a": a, "b": b, "joint": joint, "both": _packed(both, "<i4")}
                for (a, b), (both, joint) in lists.pairs.items()
            ],
            "known": known,
        }

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["items", "block", "term", "ids", "places", "counts", "weight", "askers"]
        waiting: list[dict] = []
        for batch in batches:
            for row in zip(*(_values(batch.column(n)) for n in names)):
                this = dict(zip(names, row))
                if waiting and (this["items"], this["block"]) != (
                    waiting[0]["items"], waiting[0]["block"],
                ):
                    yield pa.RecordBatch.from_pylist([folded(waiting)], schema)
                    waiting = []
                waiting.append(this)
        if waiting:
            yield pa.RecordBatch.from_pylist([folded(waiting)], schema)

    return each


def _values(column: pa.Array) -> Iterator:
    """Values of a column; a list of numbers without a null as an array."""
    if not pa.types.is_list(column.type) or column.values.null_count:
        yield from column.to_pylist()
        return
    for value in column:
        yield value.values.to_numpy(zero_copy_only=False) if value.is_valid else None


def _best(row: dict, top: int) -> Iterator[tuple[int, int | None, int]]:
    """MaxScore in one block: ``item, doc_id, score`` of what may be among the best."""
    starts = row["starts"]
    places = np.frombuffer(row["places"], "<i4")
    impacts = np.frombuffer(row["impacts"], "<i8")
    lists = [(places[a:b], impacts[a:b]) for a, b in zip(starts, starts[1:])]
    pairs = {
        (p["a"], p["b"]): (np.frombuffer(p["both"], "<i4"), p["joint"]) for p in row["pairs"]
    }
    ids, largest = row["ids"], row["largest"]
    # Ids in order, none last, for ties.
    order = np.argsort(
        np.array([np.iinfo(np.int64).max if i is None else i for i in ids], np.int64), kind="stable"
    )
    rank = np.empty(len(ids), np.int64)
    rank[order] = np.arange(len(ids))
    threshold_of = {t["item"]: t["least"] for t in row["thresholds"] or ()}
    for asker in row["askers"]:
        terms, least = asker["terms"], max(1, threshold_of.get(asker["item"], 1))
        units = []
        for pair in zip(terms[::2], terms[1::2]):
            both, joint = pairs[pair]
            single = max(largest[pair[0]], largest[pair[1]])
            units.append((max(joint, single), single, both, pair))
        if len(terms) % 2:
            units.append((largest[terms[-1]], 0, None, terms[-1:]))
        units.sort(key=lambda u: -u[0])
        left = np.cumsum([u[0] for u in units][::-1])[::-1].tolist() + [0]
        if left[0] < least:
            continue  # no document of the block can reach the threshold
        essential = next(k for k in range(1, len(units) + 1) if left[k] < least)
        scores, touched = np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
        for _, _, _, members in units[:essential]:
            for t in members:
                scores[lists[t][0]] += lists[t][1]
                touched[lists[t][0]] = True
        alive = np.flatnonzero(touched)
        for k in range(essential, len(units)):
            if len(alive) > top:
                least = max(least, int(np.partition(scores[alive], -top)[-top]))
            _, single, both, members = units[k]
            # A document outside of the intersection has one term of the pair at most.
            bound = np.full(len(alive), units[k][0] if both is None else single, np.int64)
            if both is not None:
                bound[np.isin(alive, both, assume_unique=True)] = units[k][0]
            alive = alive[scores[alive] + bound + left[k + 1] >= least]
            if not len(alive):
                break
            open_ = np.zeros(len(ids), bool)
            open_[alive] = True
            for t in members:
                here = open_[lists[t][0]]
                scores[lists[t][0][here]] += lists[t][1][here]
        alive = alive[scores[alive] >= least]
        for place in alive[np.lexsort((rank[alive], -scores[alive]))][:top]:
            yield asker["item"], ids[place], int(scores[place])


def _ranked(df: DataFrame, keys: list[str], order: list[Column], top: int) -> DataFrame:
    """The first rows of each group; each task cuts its own rows before the shuffle."""
    in_group = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(in_group)).where(F.col("rank") <= top)


def search(index: DataFrame, items: DataFrame, top: int = 10) -> DataFrame:
    """The ``top`` best documents for each row of ``items``: ``item_id, rank, doc_id, score``.

    Scores are those of the contract, in whole numbers; equal ones go by ``doc_id``, none
    last. Only documents with a score above 0 count. Items without a term, or whose text is
    null, have no rows; repeated items are searched each on its own. Empty tables give
    no rows. The result does not depend on how documents fall into blocks: a block gives its
    own best, with every document that the threshold leaves.
    """
    spark = index.sparkSession
    asked = _asked(items)
    headers = index.where("term IS NULL")
    sums = headers.select(F.explode("counts").alias("n")).agg(
        F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))
    )
    n_docs, n_terms = sums.first()
    askers = asked.groupBy("items", "term").agg(F.collect_list("item").alias("askers"))
    wanted = staged(askers, "terms")
    found = staged(
        index.where("term IS NOT NULL").join(wanted, "term")
        .select("items", "block", "term", "places", "counts", "askers"), "postings"
    )
    frequency = found.groupBy("items", "term").agg(F.sum(F.size("places")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1)))
    weights = staged(frequency.select("items", "term", weight.alias("weight")), "weights")
    postings = found.join(weights, ["items", "term"])
    # Every block of the index goes to each group of items that has a term in it.
    blocks = headers.select("block", "ids", "counts").join(
        found.select("items", "block").distinct(), "block"
    )
    rows = postings.unionByName(blocks, allowMissingColumns=True)
    lists = staged(
        rows.select("items", "block", "term", "ids", "places", "counts", "weight", "askers")
        .repartition("items", "block")
        .sortWithinPartitions("items", "block")
        .mapInArrow(_block_lists(top, n_docs, n_terms), _BLOCK),
        "lists",
    )
    known = lists.select("items", F.explode("known").alias("k")).select(
        "items", "k.item", F.explode("k.best").alias("score")
    )
    thresholds = (
        _ranked(known, ["items", "item"], [F.col("score").desc()], top)
        .groupBy("items", "item")
        .agg(F.when(F.count("*") == top, F.min("score")).otherwise(1).alias("least"))
        .groupBy("items")
        .agg(F.collect_list(F.struct("item", "least")).alias("thresholds"))
    )

    schema = arrow_schema("item long, doc_id long, score long")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                hits = list(_best(batch.slice(at, 1).to_pylist()[0], top))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, pa.int64()) for c in (zip(*hits) if hits else ((), (), ()))],
                    schema=schema,
                )

    hits = lists.join(staged(thresholds, "thresholds"), "items", "left").mapInArrow(
        best, "item long, doc_id long, score long"
    )
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    ranked = _ranked(hits, ["item"], order, top)
    names = asked.select("item", "item_id").distinct()
    return ranked.join(names, "item").select("item_id", "rank", "doc_id", "score")
