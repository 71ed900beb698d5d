"""BPE by a tokenization automaton.

The automaton reads tokens: a sequence of tokens is a path through it exactly if applying
the merges in order yields that sequence. It starts as one state with a loop for every
base symbol, and each merge (u, v) puts a gadget into it, in order of priority:

- every arc labelled u now ends in a new state, a copy of the old one without its arc v;
- every state with an arc u gets an arc uv, which ends where the arc v ended.

So all arcs of one label end in one state, and a state is told from the one it was copied
from by the one label it lacks. The gadgets are kept in that form (a few numbers each)
instead of as a table of all arcs, which would have 49,000 x 49,000 entries. Arcs that
texts use are looked up through the gadgets once and then stand in a table.

Every prefix of a word has one path, so reading a word from the left keeps one state per
position, and the word's tokens are the labels of the arcs back from its end.
"""

from __future__ import annotations

import json
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .common import raw_texts, small_batches

WORD_CACHE = 220_000  # pieces of a generation; a Python worker remembers two
ARC_TABLE = 300_000  # arcs that it remembers
_DEAD = -2


class Automaton:
    """States, arcs and labels made from base symbols and merges, both in order.

    Symbols and labels are numbers; label i is base symbol i, or comes from merge
    i - len(base).
    """

    def __init__(self, base: int, merges: list[tuple[int, int]]):
        # A label as a text with one character per base symbol.
        self.spelled = [chr(0x100 + i) for i in range(base)]
        self._target = [0] * base  # where the arcs of a label end
        self._first, self._born = [-1] * base, [-1] * base
        self._origin = [0]  # the state which a state was copied from
        self._owner = [-1]  # the label whose arcs end in it
        self._owned: dict[int, list[int]] = {}
        self._gadgets: dict[int, int] = {}  # (owner, label it lacks): state
        self._arcs: dict[int, bool] = {}
        for u, v in merges:
            self._add_gadget(u, v)
            self.spelled.append(self.spelled[u] + self.spelled[v])
        self._label = {s: i for i, s in enumerate(self.spelled)}
        if len(self._label) < len(self.spelled):
            raise ValueError("two merges make one token")
        # The length of the longest label with these last three symbols.
        self._reach: dict[str, int] = {}
        for s in self.spelled:
            if len(s) > self._reach.get(s[-3:], 2):
                self._reach[s[-3:]] = len(s)
        self._read, self._states, self._path = "", [0], [0]  # of the last word

    def _add_gadget(self, u: int, v: int) -> None:
        old, end = self._target[u], self._target[v]
        copy = len(self._origin)
        self._born.append(copy)
        if not self.has_arc(old, v):  # v never follows u, so the merge never applies
            self._first.append(_DEAD)
            self._target.append(0)
            return
        self._first.append(u)
        self._target.append(end)
        self._origin.append(old)
        self._owner.append(u)
        self._owned.setdefault(u, []).append(copy)
        self._gadgets[u << 24 | v] = copy
        self._target[u] = copy

    def has_arc(self, state: int, label: int) -> bool:
        """Whether an arc of that label leaves the state."""
        key = state << 24 | label
        found = self._arcs.get(key)
        if found is None:
            if len(self._arcs) >= ARC_TABLE:
                self._arcs.clear()
            found = self._arcs[key] = self._resolve(state, label)
        return found

    def _resolve(self, state: int, label: int) -> bool:
        while True:
            first, born = self._first[label], self._born[label]
            if first == _DEAD:
                return False
            if state <= born:
                label = first  # states of that time have an arc uv if they have u
                continue
            if state == 0:
                return True
            # The label was there when the state was copied: is it the one that this
            # copy, or one before it of the same owner, lacks?
            owner = self._owner[state]
            if self._gadgets.get(owner << 24 | label, state + 1) <= state:
                return False
            chain = self._owned[owner]
            older = bisect_right(chain, born)
            state = chain[older - 1] if older else self._origin[chain[0]]

    def encode(self, symbols: str) -> list[int]:
        """Labels of the path over a word, given as one character per base symbol.

        The state after a prefix does not depend on what follows, so the states of the
        prefix shared with the word before are used again.
        """
        shared = 0
        for a, b in zip(symbols, self._read):
            if a != b:
                break
            shared += 1
        states, arcs = self._states, self._path
        del states[shared + 1 :], arcs[shared + 1 :]
        label_of, known, reach = self._label.get, self._arcs.get, self._reach.get
        for i in range(shared + 1, len(symbols) + 1):
            longest = reach(symbols[i - 3 : i], 2) if i > 2 else i
            for j in range(i - longest if longest < i else 0, i):
                label = label_of(symbols[j:i])
                if label is not None:
                    state = states[j]
                    arc = known(state << 24 | label)
                    if arc or arc is None and self.has_arc(state, label):
                        states.append(self._target[label])
                        arcs.append(label)
                        break
        self._read = symbols
        path, i = [], len(symbols)
        while i:
            path.append(arcs[i])
            i -= len(self.spelled[arcs[i]])
        return path[::-1]


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary: itself if
    it is printable in Latin-1, else the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(0x100, 0x200))
    return [chr(b if b in plain else next(others)) for b in range(256)]


class Tokenizer:
    """Encoding and decoding by the description of a word BPE (a JSON text).

    Words are split by the description's pattern after NFC, white space as one blank and
    lower case; the last symbol of a word carries the word end. Special tokens in the
    text are told before all that.
    """

    def __init__(self, description: str):
        spec = json.loads(description)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        made = {left + right for left, right in merges}
        base = [s for s in sorted(vocab, key=vocab.get) if s not in made]
        names = base + [left + right for left, right in merges]
        number = {s: i for i, s in enumerate(names)}
        self.automaton = Automaton(len(base), [(number[a], number[b]) for a, b in merges])
        self._ids = [vocab[s].to_bytes(4, "little") for s in names]
        end = spec["model"]["end_of_word_suffix"]
        symbols = byte_symbols()
        self._inner = {b: 0x100 + number[s] for b, s in enumerate(symbols)}
        self._last = {b: 0x100 + number[s + end] for b, s in enumerate(symbols)}
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self._split = regex.compile(pattern)
        self._special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        # The label of the arc that each id stands for; a special token stands for itself.
        labels = {vocab[s]: s.encode() for s in names}
        labels |= {i: s.encode() for s, i in self._special.items()}
        self._emitted = [labels.get(i) for i in range(max(labels, default=-1) + 1)]
        self._whole = None not in self._emitted
        names = sorted(map(regex.escape, self._special), key=len, reverse=True)
        self._told = regex.compile("(" + "|".join(names) + ")") if names else None
        # Ids (little-endian) of pieces. What is used moves on to the young generation;
        # the old one is forgotten as a whole.
        self._pieces: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> None:
        words = {}
        for piece in pieces:
            raw = piece.encode().decode("latin-1")  # a character per byte
            words[raw[:-1].translate(self._inner) + raw[-1].translate(self._last)] = piece
        ids, encode = self._ids, self.automaton.encode
        for word in sorted(words):
            self._pieces[words[word]] = b"".join([ids[x] for x in encode(word)])

    def _split_plain(self, text: str) -> list[str]:
        # Lower case of each character by itself: a final sigma is no exception.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        if not _newer(text):
            return self._split.findall(text)
        # Characters newer than the tokenizer are neither letters nor numbers to it.
        plain = "".join("\ue000" if unicodedata.category(c) == "Cn" else c for c in text)
        return [text[m.start() : m.end()] for m in self._split.finditer(plain)]

    def split(self, text: bytes) -> list[tuple[list[str], str | None]]:
        """Pieces of a text up to each special token, and that token."""
        parts = text.decode("utf-8", "replace")
        parts = self._told.split(parts) if self._told else [parts]
        pieces = [self._split_plain(p) for p in parts[::2]]
        return list(zip(pieces, [*parts[1::2], None]))

    def encode(self, texts: list[bytes]) -> list[bytes]:
        """The ids of each whole text (little-endian, four bytes each)."""
        split = [self.split(text) for text in texts]
        pieces = {p for text in split for found, _ in text for p in found}
        missing = pieces - self._pieces.keys()
        if len(self._pieces) + len(missing) > WORD_CACHE:
            self._old, self._pieces = self._pieces, {}
            missing = pieces
        known, old = self._pieces, self._old
        for piece in missing & old.keys():
            known[piece] = old[piece]
        self._learn(missing - known.keys())
        out = []
        for text in split:
            ids = []
            for found, special in text:
                ids += [known[p] for p in found]
                if special is not None:
                    ids.append(self._special[special].to_bytes(4, "little"))
            out.append(b"".join(ids))
        return out

    def decode(self, ids: bytes) -> bytes:
        """The labels of the arcs that the ids stand for, with blanks between, as a
        tokenizer without a decoder gives them. Numbers that are no id give nothing."""
        if len(ids) % 4:
            raise ValueError("ids take four bytes each")
        emitted, numbers = self._emitted, np.frombuffer(ids, "<u4")
        if not self._whole or len(numbers) and numbers.max() >= len(emitted):
            numbers = [i for i in numbers.tolist() if i < len(emitted) and emitted[i] is not None]
            return b" ".join([emitted[i] for i in numbers])
        return b" ".join([emitted[i] for i in numbers.tolist()])


def _newer(text: str) -> bool:
    """Whether a text has characters that no older Unicode version knows."""
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return any(c > "\u0557" and unicodedata.category(c) == "Cn" for c in text)
    return False


@lru_cache(maxsize=2)
def tokenizer(description: str) -> Tokenizer:
    """Compiled once in each Python worker."""
    return Tokenizer(description)


def encode_documents(docs: DataFrame, description: str) -> DataFrame:
    """``doc_id, n_tokens, ids`` for each row.

    ``ids`` are little-endian unsigned 32-bit numbers. A null or empty text has no tokens.
    Whole texts of any length are encoded, each in one task. Equal rows are returned each; an
    empty table gives none; other columns are ignored.

    ``description`` is the text of the tokenizer's file (below 2 MB); tasks get it with
    their code and compile it once per worker.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(description).encode
        for batch in small_batches(batches, 1 << 20):
            ids = encode([text or b"" for text in raw_texts(batch.column(1))])
            counts = pa.array([len(x) // 4 for x in ids], pa.int64())
            yield pa.record_batch(
                [batch.column(0), counts, pa.array(ids, pa.binary())], names=["doc_id", "n_tokens", "ids"]
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInArrow(each, "doc_id long, n_tokens long, ids binary")


def decode_documents(encoded: DataFrame, description: str) -> DataFrame:
    """The rows of ``encoded`` with ``decoded``, the text which ``ids`` stand for.

    Reads nothing but ``ids`` (little-endian unsigned 32-bit numbers), so it decodes what was
    stored as well; null ids give null, none an empty text, and a column named ``decoded`` is
    replaced. All other columns stay, equal rows are returned each, an empty table gives none.
    """
    kept = [c for c in encoded.columns if c != "decoded"]
    schema = StructType([*(encoded.schema[c] for c in kept), StructField("decoded", StringType())])
    at = kept.index("ids")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = tokenizer(description).decode
        for batch in small_batches(batches, 1 << 20):
            texts = [None if x is None else decode(x) for x in batch.column(at).to_pylist()]
            column = pa.array(texts, pa.binary()).cast(pa.string())
            yield pa.record_batch([*batch.columns, column], names=[*kept, "decoded"])

    return encoded.select(*kept).mapInArrow(each, schema)
