"""Repeated passages: a logarithmic family of suffix arrays over batches of documents.

A string of ``LENGTH`` bytes which an earlier document has too is removed. Suffix arrays of
all bytes would take some ten times the text, so they are sparse: of the ``LENGTH``-byte
window at each place, the suffix with the least hash of its first ``PREFIX`` bytes is taken,
so equal windows, wherever they stand, take the suffix at the same place of them. No match is
lost, and one suffix in sixteen is kept.

* **Arrays.** A batch's suffixes are dealt to buckets and sorted there, by the hash of their
  first bytes, one row per bucket. A suffix that several documents of the batch share is a
  candidate; one holder of it stays in the array.
* **Family.** The array of a new batch is merge-scanned against that of every level; what
  both have is a candidate. Then it joins the family: levels of equal size merge, so that a
  suffix is rewritten a logarithmic number of times. Arrays are bucketed tables, so that
  scans and merges move nothing.
* **Check.** Around every candidate the text of its windows is gathered by key, all windows
  are sorted as suffixes by their whole ``LENGTH`` bytes, and the earliest document of each
  group of equal ones is found. Hashes bring windows together; bytes decide.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltfleet.session import working_dir

from .common import arrow_schema, raw_texts, small_batches, staged

#: Bytes of a repeated string (contract), and of what suffixes are chosen and sorted by.
LENGTH, PREFIX = 50, 20
#: Batches of a whole table, suffixes of a bucket and windows' strings of a part aimed at.
BATCHES, BUCKET_SUFFIXES, PART_STRINGS = 4, 500_000, 50_000
#: Holders of a suffix from which its windows go by their text, so that they spread.
HOT = 20_000
#: Text handled at a time, and text and strings gathered before rows are made of them.
_PIECE, _GATHER, _GATHER_STRINGS, _PLACE_BITS = 1 << 15, 1 << 22, 1 << 23, 20

_LOW = np.uint64((1 << 32) - 1)
_FACTOR = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    high = x >> np.uint64(32)
    x = x ^ high
    for _ in range(2):
        x *= np.uint64(0xD6E8FEB86659FD93)
        np.right_shift(x, np.uint64(32), out=high)
        x ^= high
    return x


_BYTES = _mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_FACTOR))


def prefix_hashes(data: np.ndarray, length: int = PREFIX) -> np.ndarray:
    """A hash of the ``length`` bytes from each place on."""
    power = [_FACTOR]  # factor to the size of a block, modulo 2 ** 64
    block, whole, done, size = _BYTES[data], None, 0, 1
    rest = length
    while rest:
        if rest & 1:
            if whole is None:
                whole = block
            else:
                n = len(data) - done - size + 1
                whole = whole[:n] * np.uint64(power[0])
                whole += block[done : done + n]
            done += size
        rest >>= 1
        if rest:
            block, later = block[:-size] * np.uint64(power[0]), block[size:]
            block += later
            power[0], size = power[0] * power[0] % (1 << 64), 2 * size
    return _mixed(whole)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The place of the least of ``width`` values from each place on, the first of near equals.

    Values give way in their low bits to their place, so that minima carry it along.
    """
    low = np.uint64((1 << _PLACE_BITS) - 1)
    least, size = values & ~low, 1
    least |= np.arange(len(values), dtype=np.uint64)
    while size < width:
        step = min(size, width - size)
        least = np.minimum(least[:-step], least[step:])
        size += step
    return (least & low).astype(np.int32)


class _Runs:
    """The windows of some texts, in runs which take the same suffix."""

    def __init__(self, texts: list[bytes]):
        self.data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = [len(t) for t in texts]
        ends = np.cumsum(sizes)
        hashes = prefix_hashes(self.data)
        taken = _least(hashes, LENGTH - PREFIX + 1)
        text = np.repeat(np.arange(len(texts), dtype=np.int32), sizes)
        new = np.ones(len(taken), bool)
        new[1:] = taken[1:] != taken[:-1]
        new[(ends - sizes)[1:]] = True  # every text has a window, as pieces have
        new &= text[: len(taken)] == text[LENGTH - 1 :]
        self.start = np.flatnonzero(new)
        self.key = hashes[taken[self.start]]
        self.text = text[self.start]
        stop = np.minimum(np.append(self.start[1:], len(taken)), ends[self.text] - LENGTH + 1)
        self.windows = stop - self.start
        self.offset = self.start - (ends - sizes)[self.text]


def _pieces(texts: Iterator[bytes]) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Texts by number, in pieces of bounded size which share their last bytes with the next."""
    numbers, offsets, found, size = [], [], [], 0
    for number, text in enumerate(texts):
        for offset in range(0, max(0, len(text) - LENGTH + 1), _PIECE):
            piece = text[offset : offset + _PIECE + LENGTH - 1]
            numbers.append(number)
            offsets.append(offset)
            found.append(piece)
            size += len(piece)
            if size >= _PIECE:
                yield numbers, offsets, found
                numbers, offsets, found, size = [], [], [], 0
    if found:
        yield numbers, offsets, found


def _key(bits: int, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """The number of a suffix: its bucket and the low bits of its hash.

    With the buckets that a table gets, two suffixes in some ten thousand share a number by
    chance at 100 TB, fewer below; they are looked at in vain, as bytes decide.
    """
    return ((high.astype(np.uint64) << np.uint64(64 - bits)) | low).view(np.int64)


def _pack(low: np.ndarray) -> bytes:
    return low.astype("<u4").tobytes()


def _unpack(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u4").astype(np.uint64)


def _slices(values: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Runs of equal values in sorted ones: value, start, end."""
    cut = np.flatnonzero(np.diff(values)) + 1
    for start, end in zip([0, *cut.tolist()], [*cut.tolist(), len(values)]):
        yield int(values[start]), start, end


_ARRAY = "bucket int, keys binary, rows binary, nameless binary"


def _suffixes(bits: int):
    """Documents to their suffixes, a row per bucket of what is gathered."""

    def rows(held: list[tuple], compress) -> pa.RecordBatch:
        key, row, nameless = (np.concatenate(c) for c in zip(*held))
        bucket = (key >> np.uint64(64 - bits)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        key, row, nameless, bucket = key[order], row[order], nameless[order], bucket[order]
        # Rows come in the order of the input: what lies between them packs well.
        out = [
            (b, _pack(key[s:e] & _LOW), *_squeezed_rows(row[s:e], nameless[s:e], compress))
            for b, s, e in _slices(bucket)
        ]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, compress = [], 0, zstandard.ZstdCompressor().compress
        for batch in small_batches(batches):
            ids = batch.column("row").to_numpy()
            flags = batch.column("nameless").to_numpy(zero_copy_only=False).astype(np.int8)
            for numbers, _, texts in _pieces(t or b"" for t in raw_texts(batch.column("text"))):
                runs = _Runs(texts)
                number = np.asarray(numbers)[runs.text]
                # A suffix which a text has several times counts once; numbers ascend.
                order = np.argsort(runs.key, kind="stable")
                key, of = runs.key[order], number[order]
                again = np.zeros(len(key), bool)
                again[1:] = (key[1:] == key[:-1]) & (of[1:] == of[:-1])
                new = np.ones(len(key), bool)
                new[order[again]] = False
                held.append((runs.key[new], ids[number[new]], flags[number[new]]))
                size += sum(map(len, texts))
                if size >= _GATHER:
                    yield rows(held, compress)
                    held, size = [], 0
        if held:
            yield rows(held, compress)

    schema = arrow_schema(_ARRAY)
    return each


def _squeezed_rows(row: np.ndarray, nameless: np.ndarray, compress) -> tuple[bytes, bytes]:
    steps = np.diff(row, prepend=np.int64(0))
    return compress(steps.tobytes()), compress(nameless.tobytes())


def _plain_entries(row: dict, plain) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps = np.frombuffer(plain(row["rows"]), np.int64)
    nameless = np.frombuffer(plain(row["nameless"]), np.int8)
    return _unpack(row["keys"]), np.cumsum(steps), nameless


def _entries(row: dict, side: str = "") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if row[f"{side}keys"] is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int8)
    return (
        _unpack(row[f"{side}keys"]),
        np.frombuffer(row[f"{side}rows"], np.int64),
        np.frombuffer(row[f"{side}nameless"], np.int8),
    )


def _entry(keys: np.ndarray, rows: np.ndarray, nameless: np.ndarray, side: str = "") -> dict:
    return {
        f"{side}keys": _pack(keys),
        f"{side}rows": np.ascontiguousarray(rows, np.int64).tobytes(),
        f"{side}nameless": np.ascontiguousarray(nameless, np.int8).tobytes(),
    }


def _sorted_arrays(schema: pa.Schema, hot: int):
    """Rows of buckets in order, to a sorted array of each and the candidates within it.

    ``hot_keys`` are those of more than ``hot`` holders.
    """

    def folded(bucket: int, rows: list[dict]) -> pa.RecordBatch:
        plain = zstandard.ZstdDecompressor().decompress
        key, row, nameless = (np.concatenate(c) for c in zip(*(_plain_entries(r, plain) for r in rows)))
        order = np.lexsort((nameless, row, key))
        key, row, nameless = key[order], row[order], nameless[order]
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        other = np.zeros(len(key), bool)
        other[1:] = (row[1:] != row[:-1]) | (nameless[1:] != nameless[:-1])
        group = np.cumsum(first) - 1
        several = np.bincount(group, other & ~first) > 0
        shared = several[group] & (first | other)
        often = np.flatnonzero(np.bincount(group, first | other) > hot)
        found = {"bucket": bucket, "hot_keys": _pack(key[first][often])} | _entry(key[first], row[first], nameless[first])
        found |= _entry(key[shared], row[shared], nameless[shared], "shared_")
        return pa.RecordBatch.from_pylist([found], schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if waiting and row["bucket"] != waiting[0]["bucket"]:
                    yield folded(waiting[0]["bucket"], waiting)
                    waiting = []
                waiting.append(row)
        if waiting:
            yield folded(waiting[0]["bucket"], waiting)

    return each


def _one_by_one(function, schema: pa.Schema):
    """``mapInArrow`` for a function from one row to some columns."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                found = function(batch.slice(at, 1).to_pylist()[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(found, schema.types)], schema=schema
                )

    return each


def _merged(row: dict) -> list:
    """Two sorted arrays of a bucket as one; the holder in the older one stays."""
    new, old = _entries(row), _entries(row, "old_")
    key, row_, nameless = (np.concatenate(c) for c in zip(old, new))
    order = np.argsort(key, kind="stable")
    key, row_, nameless = key[order], row_[order], nameless[order]
    first = np.ones(len(key), bool)
    first[1:] = key[1:] != key[:-1]
    found = _entry(key[first], row_[first], nameless[first])
    return [[row["bucket"]], *([v] for v in found.values())]


_CANDIDATES = "key long, row long, nameless boolean"


class Family:
    """Suffix arrays of batches, on levels which hold twice as many batches each.

    ``bits``: the number of buckets, as a power of two. A batch is a table of ``row`` (long),
    ``nameless`` (whether the row has no id) and ``text`` (binary).
    """

    def __init__(self, bits: int):
        self.bits, self.levels, self.names, self.often = bits, {}, [], []

    def _table(self, df: DataFrame, label: str) -> DataFrame:
        """Written to the shared folder as a table whose files are the buckets."""
        spark = df.sparkSession
        name = f"{label}_{uuid.uuid4().hex}"
        self.names.append(name)
        path = working_dir(spark, label)
        rows = df.write.bucketBy(1 << self.bits, "bucket").sortBy("bucket")
        rows.option("path", path).option("compression", "zstd").saveAsTable(name)
        return spark.table(name)

    def forget(self, spark: SparkSession) -> None:
        """Take the tables out of the catalog; their files stay in the shared folder."""
        for name in self.names:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.names = []

    def _told(self, candidates: DataFrame, side: str = "") -> DataFrame:
        """Candidates as rows."""
        bits = self.bits

        def rows(row: dict) -> list:
            key, holder, nameless = _entries(row, side)
            return [_key(bits, np.full(len(key), row["bucket"]), key), holder, nameless != 0]

        names = [F.col(side + c) for c in ("keys", "rows", "nameless")]
        packed = candidates.select("bucket", *names)
        return packed.mapInArrow(_one_by_one(rows, arrow_schema(_CANDIDATES)), _CANDIDATES)

    def hot_keys(self) -> DataFrame:
        """``key`` of the suffixes that more than ``hot`` texts of a batch share."""
        bits = self.bits

        def rows(row: dict) -> list:
            key = _unpack(row["hot_keys"])
            return [_key(bits, np.full(len(key), row["bucket"]), key)]

        each = _one_by_one(rows, arrow_schema("key long"))
        packed = self.often[0]
        for other in self.often[1:]:
            packed = packed.union(other)
        return packed.mapInArrow(each, "key long").distinct()

    def _joined(self, new: DataFrame, old: DataFrame, how: str) -> DataFrame:
        renamed = old.select("bucket", *[F.col(c).alias(f"old_{c}") for c in ("keys", "rows", "nameless")])
        return new.select("bucket", "keys", "rows", "nameless").join(renamed, "bucket", how)

    def scan(self, new: DataFrame, old: DataFrame) -> DataFrame:
        """What two arrays share, with its holder in each."""
        bits = self.bits

        def common(row: dict) -> list:
            mine, theirs = _entries(row), _entries(row, "old_")
            key, a, b = np.intersect1d(mine[0], theirs[0], assume_unique=True, return_indices=True)
            other = (mine[1][a] != theirs[1][b]) | (mine[2][a] != theirs[2][b])
            key, a, b = key[other], a[other], b[other]
            number = _key(bits, np.full(len(key), row["bucket"]), key)
            holders = [np.concatenate([m[a], t[b]]) for m, t in zip(mine[1:], theirs[1:])]
            return [np.concatenate([number, number]), holders[0], holders[1] != 0]

        both = self._joined(new, old, "inner")
        return both.mapInArrow(_one_by_one(common, arrow_schema(_CANDIDATES)), _CANDIDATES)

    def add(self, batch: DataFrame, last: bool = False, hot: int = HOT) -> DataFrame:
        """Take a batch in; its suffixes that other documents have too, with all holders.

        Suffixes that more than ``hot`` texts of the batch share are noted, for
        :meth:`hot_keys`. After the ``last`` batch the levels stay as they are.
        """
        pair = f"{_ARRAY}, shared_keys binary, shared_rows binary, shared_nameless binary, hot_keys binary"
        found = batch.mapInArrow(_suffixes(self.bits), _ARRAY)
        dealt = found.repartition(1 << self.bits, "bucket").sortWithinPartitions("bucket")
        new = self._table(dealt.mapInArrow(_sorted_arrays(arrow_schema(pair), hot), pair), "array")
        out = self._told(new.where(F.octet_length("shared_keys") > 0), "shared_")
        self.often.append(new.where(F.octet_length("hot_keys") > 0).select("bucket", "hot_keys"))
        for old in self.levels.values():
            out = out.union(self.scan(new, old))
        size = 1
        while not last and size in self.levels:
            both = self._joined(new, self.levels.pop(size), "full")
            each = _one_by_one(_merged, arrow_schema(_ARRAY))
            new, size = self._table(both.mapInArrow(each, _ARRAY), "array"), 2 * size
        if not last:
            self.levels[size] = new
        return out


def _rows(docs: DataFrame) -> DataFrame:
    """Documents with a number to join by; of one without an id it comes from its text."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return docs.select("doc_id", text.alias("text")).select(
        F.coalesce(F.col("doc_id"), F.xxhash64("text")).alias("row"),
        F.col("doc_id").isNull().alias("nameless"),
        # Tells texts of one id apart.
        F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long").alias("tag"),
        "doc_id",
        "text",
    )


def _copies(rows: DataFrame) -> DataFrame:
    """Rows whose whole text an earlier document has, by their tags."""
    texts = rows.select("row", "nameless", "tag", "doc_id", F.sha2("text", 256).alias("digest"))
    each = texts.groupBy("digest").agg(F.min("doc_id").alias("least"))
    later = (F.col("least") < F.col("doc_id")) | F.col("doc_id").isNull()
    found = texts.join(each.where("least IS NOT NULL"), "digest").where(later)
    return found.groupBy("row", "nameless").agg(F.collect_set("tag").alias("copies"))


def _several(rows: DataFrame) -> DataFrame:
    """Rows of one number but several texts, which their tags tell apart."""
    spread = rows.groupBy("row", "nameless").agg(F.min("tag").alias("a"), F.max("tag").alias("b"))
    return spread.where("a <> b").select("row", "nameless", F.lit(True).alias("several"))


_PARTS = "part int, n int, strings binary, notes binary"
_NOTES = np.dtype([("row", "<i8"), ("tag", "<i8"), ("start", "<u4"), ("length", "<u4"), ("nameless", "i1")])
_WINDOWS = "window binary, row long, is_nameless boolean, tag long, start long"


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Whether each value is in a sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    return of[np.minimum(np.searchsorted(of, values), len(of) - 1)] == values


class _Lists:
    """The numbers in a column of lists, by rows."""

    def __init__(self, column: pa.Array):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        self.ends = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.values = column.flatten().to_numpy(zero_copy_only=False)
        self.last, self.found = None, None

    def of(self, first: int, last: int) -> np.ndarray:
        """Those of some rows in order; the last answer is kept, as texts come in pieces."""
        if self.last != (first, last):
            self.last = first, last
            self.found = np.sort(self.values[self.ends[first] : self.ends[last + 1]])
        return self.found


def _runs_of(batch: pa.RecordBatch, bits: int) -> Iterator[tuple]:
    """The runs of texts, piece by piece, with their keys, rows and places in the text, and
    which have a candidate or a hot one.

    All holders of a suffix are its candidates, so what one text of a piece looks for is
    looked for in all of them.
    """
    plain = zstandard.ZstdDecompressor().decompress
    keys, hot = _Lists(batch.column("keys")), _Lists(batch.column("hot"))
    for numbers, offsets, texts in _pieces(plain(t.as_py()) for t in batch.column("packed")):
        runs = _Runs(texts)
        key = _key(bits, runs.key >> np.uint64(64 - bits), runs.key & _LOW)
        between = numbers[0], numbers[-1]
        often = _member(key, hot.of(*between))
        some = _member(key, keys.of(*between)) & ~often
        place = np.asarray(offsets, np.int64)[runs.text] + runs.offset
        yield runs, key, np.asarray(numbers)[runs.text], place, some, often


def _holders(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    names = ("row", "nameless", "tag")
    return tuple(batch.column(n).to_numpy(zero_copy_only=False) for n in names)


def _strings(bits: int, parts: int):
    """Texts with their candidates, to the strings which hold all windows of these.

    A part gathers the strings of a key; the hot keys are left to :func:`_windows`.
    """
    schema = arrow_schema(_PARTS)

    def packed(held: list[tuple], compress) -> pa.RecordBatch:
        strings = [s for h in held for s in h[0]]
        part, notes = (np.concatenate(c) for c in list(zip(*held))[1:])
        order = np.argsort(part, kind="stable")
        notes, out = notes[order], []
        names = _NOTES.names
        for p, s, e in _slices(part[order]):
            joined = b"".join([strings[i] for i in order[s:e].tolist()])
            columns = b"".join([notes[c][s:e].tobytes() for c in names])
            out.append((p, e - s, compress(joined), compress(columns)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema
        )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, compress = [], 0, zstandard.ZstdCompressor().compress
        for batch in small_batches(batches):
            ids, nameless, tags = _holders(batch)
            for runs, key, number, place, some, _ in _runs_of(batch, bits):
                run = np.flatnonzero(some)
                if not len(run):
                    continue
                data = runs.data.tobytes()
                starts, ends = runs.start[run], runs.start[run] + runs.windows[run] + LENGTH - 1
                notes, of = np.empty(len(run), _NOTES), number[run]
                notes["row"], notes["tag"], notes["nameless"] = ids[of], tags[of], nameless[of]
                notes["start"], notes["length"] = place[run], ends - starts
                part = (_mixed(key[run].view(np.uint64)) % np.uint64(parts)).astype(np.int64)
                held.append(([data[a:b] for a, b in zip(starts.tolist(), ends.tolist())], part, notes))
                size += int((ends - starts).sum())
                if size >= _GATHER_STRINGS:
                    yield packed(held, compress)
                    held, size = [], 0
        if held:
            yield packed(held, compress)

    return each


def _windows(bits: int):
    """Texts with hot candidates, to the windows of these, each a row."""
    schema = arrow_schema(_WINDOWS)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            ids, nameless, tags = _holders(batch)
            for runs, _, number, place, _, often in _runs_of(batch, bits):
                run = np.flatnonzero(often)
                n = runs.windows[run]
                step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                at = np.repeat(runs.start[run], n) + step
                found = np.lib.stride_tricks.sliding_window_view(runs.data, LENGTH)[at]
                windows = pa.FixedSizeBinaryArray.from_buffers(
                    pa.binary(LENGTH), len(at), [None, pa.py_buffer(found.tobytes())]
                )
                of = np.repeat(number[run], n)
                yield pa.RecordBatch.from_arrays(
                    [
                        windows.cast(pa.binary()),
                        pa.array(ids[of]), pa.array(nameless[of]), pa.array(tags[of]),
                        pa.array(np.repeat(place[run], n) + step),
                    ],
                    schema=schema,
                )

    return each


_SPANS = "row long, nameless boolean, tag long, start long, end long"


def _groups(values: np.ndarray, within: np.ndarray | None = None) -> np.ndarray:
    """Numbers of the runs of equal values, each within its group."""
    new = np.zeros(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    if within is not None:
        new[1:] |= within[1:] != within[:-1]
    return np.cumsum(new)


def _sorted_by_bytes(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that have equals in the order of their bytes, eight at a time, and their groups."""
    words = np.lib.stride_tricks.sliding_window_view(data, 8)

    def word(at: int) -> np.ndarray:
        """Eight bytes of each window, as a number in their order."""
        found = np.ascontiguousarray(words[place[order] + at]).view(">u8").ravel()
        return found.astype(np.uint64)

    order = np.arange(len(place))
    order = order[np.argsort(word(0))]
    group = _groups(word(0))
    for at in [*range(8, LENGTH - 7, 8), LENGTH - 8]:
        alike = np.bincount(group, minlength=1)[group] > 1  # what is alone has no equal
        order, group = order[alike], group[alike]
        if not len(order):
            break
        now = word(at)
        # Most groups stay whole; the others are sorted by these bytes.
        first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(first, len(group)))
        split = np.logical_or.reduceat(now != np.repeat(now[first], sizes), first)
        mixed = np.flatnonzero(np.repeat(split, sizes))
        by = mixed[np.lexsort((now[mixed], group[mixed]))]
        order[mixed], now[mixed] = order[by], now[by]
        group = _groups(now, group)
    return order, group


def _window_hashes(data: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hashes of windows at ascending places."""
    out = np.empty(len(place), np.uint64)
    for start in range(0, len(data) - LENGTH + 1, _PIECE):
        low, high = np.searchsorted(place, [start, start + _PIECE]).tolist()
        if low < high:
            out[low:high] = prefix_hashes(data[start : start + _PIECE + LENGTH - 1], LENGTH)[place[low:high] - start]
    return out


def _alike(data: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows that have equals, and the numbers of their groups, which ascend.

    ``place`` ascends. Windows are sorted by a hash and each is compared with the first of its
    group: by its last byte if the window before it has the same neighbour before it, else by
    all bytes. Where bytes differ all windows are sorted by them.
    """
    hashes = _window_hashes(data, place)
    order = np.argsort(hashes)
    hashes = hashes[order]
    same = hashes[1:] == hashes[:-1]
    alone = np.append(True, ~same) & np.append(~same, True)
    order = order[~alone]
    if not len(order):
        return order, order
    group = _groups(hashes[~alone])
    first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
    least = np.minimum.reduceat(order, first)
    like = np.full(len(place), -1, order.dtype)
    like[order] = place[least][group]
    mine = np.flatnonzero(like >= 0)
    a, b = place[mine].astype(np.int64), like[mine].astype(np.int64)
    on = np.zeros(len(mine), bool)
    on[1:] = (np.diff(a) == 1) & (np.diff(b) == 1)
    equal = (data[a + LENGTH - 1] == data[b + LENGTH - 1]).all()
    a, b = a[~on], b[~on]
    a, b = a[a != b], b[a != b]
    for at in range(0, LENGTH - 1):
        equal = equal and (data[a + at] == data[b + at]).all()
    return (order, group) if equal else _sorted_by_bytes(data, place)


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order, to the spans whose windows an earlier document has."""

    def spans(rows: list[dict]) -> pa.RecordBatch:
        plain = zstandard.ZstdDecompressor().decompress
        noted = {c: [] for c in _NOTES.names}
        for r in rows:
            notes, at = plain(r["notes"]), 0
            for c in _NOTES.names:
                noted[c].append(np.frombuffer(notes, _NOTES[c], r["n"], at))
                at += r["n"] * _NOTES[c].itemsize
        noted = {c: np.concatenate(v) for c, v in noted.items()}
        lengths, starts = noted["length"].astype(np.int64), noted["start"].astype(np.int64)
        row, tag, nameless = noted["row"], noted["tag"], noted["nameless"] != 0
        data = np.frombuffer(b"".join([*(plain(r["strings"]) for r in rows), bytes(8)]), np.uint8)
        n = lengths - LENGTH + 1
        kind = np.int32 if len(data) < 1 << 31 else np.int64
        string = np.repeat(np.arange(len(n), dtype=kind), n)
        # Windows lie one after the other in a string, and LENGTH - 1 bytes further in the next.
        place = np.arange(len(string), dtype=kind) + string * kind(LENGTH - 1)
        order, group = _alike(data, place)
        # Documents by id, those without one behind all others and not before each other.
        ids = np.unique(row[~nameless])
        rank = np.where(nameless, len(ids), np.searchsorted(ids, row))
        hit = np.zeros(len(place), bool)
        if len(order):
            mine = rank[string[order]]
            first = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
            least = np.minimum.reduceat(mine, first)
            hit[order] = mine > np.repeat(least, np.diff(np.append(first, len(order))))
        at = np.flatnonzero(hit)
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (string[at[1:]] != string[at[:-1]])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        of = string[at[first]]
        before = starts - (np.cumsum(lengths) - lengths)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(row[of]), pa.array(nameless[of]), pa.array(tag[of]),
                pa.array(before[of] + place[at[first]]),
                pa.array(before[of] + place[at[last]] + LENGTH),
            ],
            ["row", "nameless", "tag", "start", "end"],
        )

    waiting: list[dict] = []
    for batch in batches:
        for this in batch.to_pylist():
            if waiting and this["part"] != waiting[0]["part"]:
                yield spans(waiting)
                waiting = []
            waiting.append(this)
    if waiting:
        yield spans(waiting)


def _hot_spans(windows: DataFrame) -> DataFrame:
    """The same for windows that stand alone, by plain grouping; equal ones may be many."""
    nth = F.struct("is_nameless", F.when(F.col("is_nameless"), 0).otherwise(F.col("row")).alias("id"))
    first = windows.groupBy("window").agg(F.min(nth).alias("first"))
    return windows.join(first, "window").where(nth > F.col("first")).select(
        "row", F.col("is_nameless").alias("nameless"), "tag", "start",
        (F.col("start") + LENGTH).alias("end"),
    )


_CLEANED = (
    "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, "
    "spans array<struct<start: long, end: long>>"
)


def _without(schema: pa.Schema):
    """Texts without their spans."""

    def cleaned(batch: pa.RecordBatch, plain) -> pa.RecordBatch:
        texts = [plain(t.as_py()) for t in batch.column("packed")]
        sizes = np.array([len(t) for t in texts], np.int64)
        lists = batch.column("found")
        of = np.repeat(np.arange(len(texts)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
        told = lists.flatten()
        start, end, tag = (told.field(c).to_numpy(zero_copy_only=False) for c in ("start", "end", "tag"))
        # A copy of an earlier text goes as a whole.
        whole = batch.column("copy").to_numpy(zero_copy_only=False) & (sizes >= LENGTH)
        mine = (tag == batch.column("tag").to_numpy(zero_copy_only=False)[of]) & ~whole[of]
        of = np.concatenate([of[mine], np.flatnonzero(whole)])
        start = np.concatenate([start[mine], np.zeros(whole.sum(), np.int64)])
        end = np.concatenate([end[mine], sizes[whole]])
        # Texts one after the other with a byte between them, so that their spans do not touch.
        base = np.cumsum(sizes + 1) - (sizes + 1)
        order = np.argsort(base[of] + start, kind="stable")
        of, start, end = of[order], start[order], end[order]
        reach = np.maximum.accumulate(base[of] + end)
        new = np.ones(len(of), bool)
        new[1:] = (base[of] + start)[1:] > reach[:-1]
        first = np.flatnonzero(new)
        of, start = of[first], start[first]
        end = reach[np.append(first[1:], len(reach)) - 1 if len(first) else first] - base[of]
        n_spans = np.bincount(of, minlength=len(texts))
        removed = np.bincount(of, end - start, minlength=len(texts)).astype(np.int64)
        ends = np.cumsum(n_spans)
        a, b, kept = start.tolist(), end.tolist(), []
        for text, s, e in zip(texts, (ends - n_spans).tolist(), ends.tolist()):
            if s == e:
                kept.append(text)
            else:
                kept.append(b"".join([text[x:y] for x, y in zip([0, *b[s:e]], [*a[s:e], len(text)])]))
        spans = pa.StructArray.from_arrays([pa.array(start), pa.array(end)], ["start", "end"])
        offsets = pa.array(np.append(0, ends), pa.int32())
        columns = [
            batch.column("doc_id"), pa.array(sizes), pa.array(removed), pa.array(n_spans, pa.int64()),
            pa.array(kept, pa.binary()), pa.ListArray.from_arrays(offsets, spans),
        ]
        return pa.RecordBatch.from_arrays([c.cast(t) for c, t in zip(columns, schema.types)], schema=schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plain = zstandard.ZstdDecompressor().decompress
        for batch in small_batches(batches, 1 << 20):
            yield cleaned(batch, plain)

    return each


def _squeezed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    compress = zstandard.ZstdCompressor().compress
    for batch in small_batches(batches):
        packed = pa.array([compress(t.as_py()) for t in batch.column("text")], pa.binary())
        names = ["row", "nameless", "tag", "doc_id"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(n) for n in names), packed], [*names, "packed"]
        )


def drop_repeated_passages(docs: DataFrame, batches: int = BATCHES, hot: int = HOT) -> DataFrame:
    """Every document without the bytes of strings that an earlier document has too.

    A string of ``LENGTH`` bytes of the UTF-8 text goes if it also starts in a document with a
    smaller ``doc_id``; strings overlap, and all are judged on the input. Gives a row per row
    of ``docs``: ``doc_id, n_bytes, n_removed, n_spans, kept`` (binary) and ``spans``.

    A null text is empty and shorter texts than a string are kept. Rows without an id come
    after all others and do not count as earlier than each other, nor do rows that repeat an
    id, whatever their texts. Texts of any length are taken whole, in pieces. An empty
    table gives no rows; other columns are left aside. ``batches`` and ``hot`` change how
    the work is dealt out, never the result.
    """
    rows = _rows(docs)
    shares = [k / batches for k in range(1, batches)] or [1.0]
    total, cuts = rows.agg(
        F.sum(F.octet_length("text")), F.percentile_approx("doc_id", shares)
    ).first()
    total, cuts = total or 0, (cuts or [])[: batches - 1]
    suffixes = 2 * total // (LENGTH - PREFIX + 2)
    family = Family(min(24, max(3, (suffixes // BUCKET_SUFFIXES).bit_length())))
    candidates = None
    for k, (low, high) in enumerate(zip([None, *cuts], [*cuts, None])):
        batch = _between(rows, low, high).select("row", "nameless", "text")
        found = family.add(batch, k == len(cuts), max(1, hot // batches))
        candidates = found if candidates is None else candidates.union(found)
    many = staged(family.hot_keys().select("key", F.col("key").alias("many")), "hot")
    has_hot = not many.isEmpty()
    if has_hot:
        candidates = candidates.join(many, "key", "left")
    else:
        candidates = candidates.withColumn("many", F.lit(None).cast("long"))
    known = candidates.groupBy("row", "nameless").agg(
        F.collect_set("key").alias("keys"), F.collect_set("many").alias("hot")
    )
    # Written, being small; the candidates are dealt out by row once, as the texts are.
    noted = _copies(rows).join(_several(rows), ["row", "nameless"], "full")
    noted = staged(noted, "copies")
    family.forget(docs.sparkSession)
    # One exchange of the texts serves the search of windows and the removal.
    texts = rows.mapInArrow(
        _squeezed, "row long, nameless boolean, tag long, doc_id long, packed binary"
    ).repartition("row", "nameless")
    copy = F.coalesce(F.array_contains("copies", F.col("tag")), F.lit(False))
    told = texts.join(known, ["row", "nameless"]).join(noted, ["row", "nameless"], "left")
    # A part has at most four times the strings aimed at, if all suffixes are candidates.
    parts = max(1, min(1 << 24, suffixes // (4 * PART_STRINGS)))
    one_of = F.when(F.col("several"), F.col("tag")).otherwise(0)
    # With all columns of the texts, or their exchange could not be used again.
    searched = told.where(~copy).select(
        "row", "nameless", "doc_id", one_of.alias("tag"), "packed", "keys", "hot"
    )
    spans = (
        searched.mapInArrow(_strings(family.bits, parts), _PARTS)
        .repartition("part")
        .sortWithinPartitions("part")
        .mapInArrow(_repeated, _SPANS)
    )
    if has_hot:
        alone = searched.where(F.size("hot") > 0).mapInArrow(_windows(family.bits), _WINDOWS)
        spans = spans.unionByName(_hot_spans(alone))
    found = spans.groupBy("row", "nameless").agg(
        F.collect_list(F.struct("tag", "start", "end")).alias("found")
    )
    return (
        texts.join(found, ["row", "nameless"], "left")
        .join(noted, ["row", "nameless"], "left")
        .select("doc_id", "packed", one_of.alias("tag"), "found", copy.alias("copy"))
        .mapInArrow(_without(arrow_schema(_CLEANED)), _CLEANED)
    )


def _between(rows: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """The rows of a batch, by id; the last takes those without an id."""
    inside: Column = F.lit(True)
    if low is not None:
        inside = inside & (F.col("doc_id") > low)
    if high is not None:
        inside = inside & (F.col("doc_id") <= high)
    elif low is not None:
        inside = inside | F.col("doc_id").isNull()
    return rows.where(inside)
