"""Repair of damaged conversations by divide and conquer over a four-state automaton.

The roles of a repaired conversation read ``(s?(ua)+)?``. Its automaton has four states:
nothing yet, after the system turn, after a user, after an assistant. Edits of a row move
between states at a cost, so the cheapest repair is a shortest path.

A conversation is cut into chunks of ``CHUNK`` rows, so that no task ever holds all rows of
a long one. A chunk is summed up by its 4 x 4 costs between states; a sweep over the chunks
gives each the costs of what follows, a second one the state which it starts in. Within a
chunk Hirschberg's halving rebuilds the edits: forward costs of the left half and backward
costs of the right one meet in the middle, the audit-least of the cheapest crossings is
taken, and both halves are solved alike, with nothing kept but two vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, staged

#: Rows of a chunk.
CHUNK = 4096

#: Fixed values of the contract: costs of edits, and what a kept truncated row adds.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3

#: States: nothing yet, after system, after user, after assistant.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: Next state by role initial; a role outside these fits nowhere.
_KEEP = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
#: The state after the only user or assistant turn which fits, and that turn's role.
_NEXT = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_ROLE = ("user", "user", "assistant", "user")
#: Costs at the end of a conversation: what is missing is inserted.
END = (0, 2 * INSERT, INSERT, 0)
_LEGAL = ("su", "ua", "au")
INF = 1 << 60

#: Kinds of rows: whole, truncated, duplicate, blank.
FINE, CUT, SAME, BLANK = range(4)

Vector = tuple[int, int, int, int]


@lru_cache(1 << 16)
def _back(initial: str, kind: int, after: Vector) -> tuple[Vector, tuple[str, ...], Vector]:
    """Costs before a row from the costs after it, and the least edits of each state.

    Edits are the row's own, with the inserts before it; the last part tells the states
    which they lead to.
    """
    options = []
    for state in range(4):
        found = [(DELETE + after[state], "D", state)]
        if kind in (FINE, CUT):
            extra = TRUNCATED if kind == CUT else 0
            if initial in _KEEP[state]:
                kept = _KEEP[state][initial]
                found.append((extra + after[kept], "K", kept))
            found.append((REROLE + extra + after[_NEXT[state]], "R", _NEXT[state]))
        options.append(found)
    cost = [min(o[0] for o in found) for found in options]
    for _ in range(3):
        cost = [min(c, INSERT + cost[_NEXT[s]]) for s, c in enumerate(cost)]
    edits, leads = [""] * 4, [0] * 4
    for state in range(4):
        at, done = state, ""
        while True:
            # Letters in ASCII order: D before I before K before R.
            best = {letter: to for c, letter, to in options[at] if c == cost[at]}
            if "D" not in best and cost[at] == INSERT + cost[_NEXT[at]]:
                at, done = _NEXT[at], done + "I"
                continue
            letter = min(best)
            edits[state], leads[state] = done + letter, best[letter]
            break
    return tuple(min(c, INF) for c in cost), tuple(edits), tuple(leads)


@lru_cache(1 << 10)
def _steps(initial: str, kind: int) -> tuple[tuple[int, ...], ...]:
    """Costs of a row from state to state."""
    columns = [
        _back(initial, kind, tuple(0 if t == end else INF for t in range(4)))[0]
        for end in range(4)
    ]
    return tuple(zip(*columns))


def _shifted(vector: Vector, by: int) -> Vector:
    return tuple(min(INF, v + by) if v < INF else INF for v in vector)


def _backward(rows: list[tuple[str, int, int]], after: Vector) -> tuple[Vector, list[int]]:
    """Costs before the rows, and the state each state leads to by the least edits."""
    leads = [0, 1, 2, 3]
    for initial, kind, copies in reversed(rows):
        least = min(after)
        if least >= INF:
            return after, leads
        vector, _, step = _back(initial, kind, _shifted(after, -least))
        after = _shifted(vector, least + DELETE * (copies - 1))
        leads = [leads[s] for s in step]
    return after, leads


def _forward(rows: list[tuple[str, int, int]], before: Vector) -> Vector:
    for initial, kind, copies in rows:
        steps = _steps(initial, kind)
        before = tuple(
            min(INF, min(before[s] + steps[s][t] for s in range(4)) + DELETE * (copies - 1))
            for t in range(4)
        )
    return before


def costs_between(rows: list[tuple[str, int, int]]) -> list[int]:
    """The cheapest cost from each state to each state, row by row of the 4 x 4 table."""
    return [
        c
        for s in range(4)
        for c in _forward(rows, tuple(0 if t == s else INF for t in range(4)))
    ]


def repair(rows: list[tuple[str, int, int]], state: int, after: Vector) -> Iterator[str]:
    """The least cheapest edits of each row (initial, kind, copies), by Hirschberg's halving."""
    if len(rows) == 1:
        least = min(after)
        yield _back(*rows[0][:2], _shifted(after, -least))[1][state]
        return
    left, right = rows[: len(rows) // 2], rows[len(rows) // 2 :]
    backward, _ = _backward(right, after)
    forward = _forward(left, tuple(0 if s == state else INF for s in range(4)))
    total = min(f + b for f, b in zip(forward, backward))
    crossings = [s for s in range(4) if forward[s] + backward[s] == total]
    # Several cheapest crossings: the one that the least edits of the left half lead to.
    middle = crossings[0] if len(crossings) == 1 else _backward(left, backward)[1][state]
    yield from repair(left, state, tuple(b if s == middle else INF for s, b in enumerate(backward)))
    yield from repair(right, middle, after)


def _text(column: str) -> Column:
    """A column as text; a null is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows as the fault model of the contract leaves them.

    ``n`` is how often a row stands there: 0 for a dropped one, 2 for a repeated one.
    """
    fault = F.crc32(F.concat_ws(":", _text("conv_id"), _text("turn"))) % 20
    role, text = _text("role"), _text("text")
    return conversations.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "")
        .when(fault == 2, F.regexp_replace(text, "[.!?]", ""))
        .otherwise(text)
        .alias("text"),
        F.when(fault == 0, 0).when(fault == 3, 2).otherwise(1).cast("long").alias("n"),
    )


def as_they_are(conversations: DataFrame) -> DataFrame:
    """The rows without any damage."""
    return conversations.select(
        "conv_id", "turn", _text("role").alias("role"), _text("text").alias("text"),
        F.lit(1).cast("long").alias("n"),
    )


_ORDER = ("conv_id", "turn", "role", "digest")


def _ordered(rows: DataFrame) -> DataFrame:
    """Equal rows folded into one, in order, each with its place and kind.

    Texts are told apart by their MD5, so that the sort moves no text. Equal rows stand
    side by side, so a range of rows can be cut anywhere, also within one conversation.
    """
    shown = F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r"))
    told = (
        rows.where("n > 0")
        .select(
            "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"),
            (shown == "").alias("blank"),
            (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("cut"),
            "n",
        )
        .groupBy(*_ORDER, "blank", "cut")
        .agg(F.sum("n").alias("n"))
    )
    placed = staged(
        told.repartitionByRange(*_ORDER)
        .sortWithinPartitions(*_ORDER)
        .withColumn("place", F.monotonically_increasing_id()),
        "turns",
    )
    first = placed.where("NOT blank").groupBy("conv_id", "role", "digest")
    first = first.agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    kind = (
        F.when(F.col("blank"), BLANK)
        .when(F.col("first").isNull(), SAME)
        .when(F.col("cut"), CUT)
        .otherwise(FINE)
    )
    return placed.join(first, "place", "left").select(
        *_ORDER, "place", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), "n"
    )


_CHUNK = (
    "conv_id {id}, chunk long, turn {turn}, role string, digest string, "
    "rows array<struct<place: long, initial: string, kind: int, n: long>>"
)


def _rows(row: dict) -> list[tuple[str, int, int]]:
    return [(r["initial"], r["kind"], r["n"]) for r in row["rows"]]


def _mapped(df: DataFrame, function, schema: str) -> DataFrame:
    """``function`` takes an iterator of rows as dicts and gives such rows."""
    arrow = arrow_schema(schema)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for row in function(r for b in batches for r in b.to_pylist()):
            waiting.append({n: row[n] for n in arrow.names})
            size += 1 + len(row.get("rows") or ()) + len(row.get("audit") or ())
            if size >= 1 << 17:
                yield pa.RecordBatch.from_pylist(waiting, arrow)
                waiting, size = [], 0
        if waiting:
            yield pa.RecordBatch.from_pylist(waiting, arrow)

    return df.mapInArrow(each, schema)


def _by_conversation(df: DataFrame, *order: Column | str) -> DataFrame:
    """Conversations whole and in order; rows pass by one at a time, none is gathered."""
    return df.repartition("conv_id").sortWithinPartitions("conv_id", *order)


def _chunked(ordered: DataFrame) -> DataFrame:
    """Chunks of each conversation, with the order of their first row."""
    first = F.min_by(F.struct("turn", "role", "digest"), "place")
    each = ordered.groupBy("conv_id", F.expr(f"place div {CHUNK}").alias("chunk")).agg(
        first.alias("first"),
        F.array_sort(F.collect_list(F.struct("place", "initial", "kind", "n"))).alias("rows"),
    )
    return each.select("conv_id", "chunk", "first.*", "rows")


def _add_costs(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        yield row | {"costs": costs_between(_rows(row))}


def _sweep_back(rows: Iterator[dict]) -> Iterator[dict]:
    """Chunks from last to first: the costs of what follows each."""
    conversation, after = object(), END
    for row in rows:
        if row["conv_id"] != conversation:
            conversation, after = row["conv_id"], END
        yield row | {"after": list(after)}
        costs = row["costs"]
        after = tuple(min(costs[4 * s + t] + after[t] for t in range(4)) for s in range(4))


def _add_leads(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        before, leads = _backward(_rows(row), tuple(row["after"]))
        yield row | {"leads": leads, "total": before[START]}


def _sweep_on(rows: Iterator[dict]) -> Iterator[dict]:
    """Chunks from first to last: the state in which each starts."""
    conversation, state, last, total = object(), START, None, 0
    for row in rows:
        if row["conv_id"] != conversation:
            conversation, state, last, total = row["conv_id"], START, None, row["total"]
        yield row | {"state": state, "before": last, "total": total}
        state, last = row["leads"][state], row["rows"][-1]["initial"]


def _add_audit(rows: Iterator[dict]) -> Iterator[dict]:
    for row in rows:
        found = _rows(row)
        edits = list(repair(found, row["state"], tuple(row["after"])))
        seen = [0, 0, 0, 0]
        illegal, last, first = 0, row["before"], row["before"] is None
        for initial, kind, copies in found:
            if kind in (FINE, CUT):
                seen[kind] += 1
                seen[SAME] += copies - 1
            else:
                seen[kind] += copies
            illegal += (not first and last + initial not in _LEGAL) + copies - 1
            last, first = initial, False
        yield row | {
            "audit": [e + "D" * (r[2] - 1) for e, r in zip(edits, found)],
            "kinds": [r[1] for r in found],
            "truncated": seen[CUT], "duplicate": seen[SAME], "blank": seen[BLANK],
            "illegal": illegal,
        }


def _written(rows: Iterator[dict]) -> Iterator[dict]:
    """Conversations rebuilt as their texts pass by, a chunk's edits before its texts."""
    done = None
    for row in rows:
        if row["kind"] == -1:
            if done is not None:
                yield done.row()
            done = _Rebuilt(row)
        elif row["kind"] == 0:
            done.chunk(row)
        else:
            done.text(row)
    if done is not None:
        yield done.row()


class _Rebuilt:
    """One conversation as it is written: digest, audit and sums, but no texts."""

    def __init__(self, marker: dict):
        self.sums = {k: marker[k] for k in ("conv_id", "gaps")}
        self.sums |= {k: 0 for k in ("blank", "duplicate", "truncated", "illegal", "cost")}
        self.digest, self.audit, self.edits = hashlib.sha256(), [], iter(())
        self.state, self.begun, self.last = START, False, None

    def _turn(self, role: str, text: str) -> None:
        self.digest.update(("\n" if self.begun else "").encode() + f"{role}:{text}".encode())
        self.begun = True

    def _insert(self) -> None:
        self._turn(_ROLE[self.state], "")
        self.state = _NEXT[self.state]

    def _without_text(self) -> None:
        """Edits of the blank rows up to the next row with a text."""
        for kind, edits in self.edits:
            if kind != BLANK:
                self.waiting = edits
                return
            for _ in range(edits.count("I")):
                self._insert()
        self.waiting = None

    def chunk(self, row: dict) -> None:
        for name in ("blank", "duplicate", "truncated", "illegal"):
            self.sums[name] += row[name]
        self.sums["cost"] = row["total"]
        self.audit += row["audit"]
        self.edits = zip(row["kinds"], row["audit"])
        self._without_text()

    def text(self, row: dict) -> None:
        this = (row["turn"], row["role"], row["digest"])
        if this == self.last:
            return  # a copy, whose deletion stands in the edits of the first
        self.last = this
        for letter in self.waiting:
            if letter == "I":
                self._insert()
            elif letter == "K":
                self._turn(row["role"], row["text"])
                self.state = _KEEP[self.state][row["role"][:1]]
            elif letter == "R":
                self._turn(_ROLE[self.state], row["text"])
                self.state = _NEXT[self.state]
        self._without_text()

    def row(self) -> dict:
        while END[self.state]:
            self.audit.append("I")
            self._insert()
        return self.sums | {
            "audit": "".join(self.audit),
            "repaired_sha256": self.digest.hexdigest(),
        }


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Audit and digest of the cheapest repair of each conversation.

    ``rows`` has ``conv_id, turn, role, text, n``, as :func:`damaged` and
    :func:`as_they_are` give them; a row with ``n`` 0 is gone but its conversation counts.
    Gives a row per ``conv_id``: ``gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired_sha256``.

    Rows go by ``turn``, those without a turn first; equal turns by role, then by the MD5
    of the text. Rows without ``conv_id`` are one conversation. Repeated rows are
    duplicates of the first. An empty table gives no rows, a conversation whose rows are
    all gone zeros and the digest of nothing. Texts and roles of any length are taken
    whole, other columns are left aside. The texts of a conversation pass through one
    task, one at a time, since a SHA-256 can only be made in order; all else of a long
    conversation is spread over its chunks.
    """
    kind = {f.name: f.dataType.simpleString() for f in rows.schema}
    chunk = _CHUNK.format(id=kind["conv_id"], turn=kind["turn"])
    chunks = _mapped(_chunked(_ordered(rows)), _add_costs, f"{chunk}, costs array<long>")
    swept = _mapped(
        _by_conversation(chunks, F.desc("chunk")), _sweep_back, f"{chunk}, after array<long>"
    )
    led = _mapped(
        staged(swept, "chunks").repartition("conv_id", "chunk"), _add_leads,
        f"{chunk}, after array<long>, leads array<int>, total long",
    )
    entered = _mapped(
        _by_conversation(led, "chunk"), _sweep_on,
        f"{chunk}, after array<long>, state int, before string, total long",
    )
    numbers = "blank long, duplicate long, truncated long, illegal long, total long"
    edited = _mapped(
        entered.repartition("conv_id", "chunk"), _add_audit,
        f"{chunk.partition(', rows')[0]}, audit array<string>, kinds array<int>, {numbers}",
    )
    there = F.when(F.col("n") > 0, F.col("turn"))
    markers = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(there) - F.min(there) + 1 - F.count_distinct(there), F.lit(0))
        .cast("long")
        .alias("gaps")
    )
    # A text row stands under every key of its order, so repeated ones meet it in the stream.
    texts = rows.where("n > 0").select(
        "conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"), "text"
    ).where(F.rtrim(F.col("text"), F.lit(" \t\n\x0b\x0c\r")) != "")
    stream = (
        markers.withColumn("kind", F.lit(-1))
        .unionByName(edited.drop("chunk").withColumn("kind", F.lit(0)), allowMissingColumns=True)
        .unionByName(texts.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    )
    # The marker comes before rows without a turn, a chunk before its first text.
    order = ((F.col("kind") >= 0).cast("int"), "turn", "role", "digest", "kind")
    return _mapped(
        _by_conversation(stream, *order), _written,
        f"conv_id {kind['conv_id']}, gaps long, blank long, duplicate long, truncated long, "
        "illegal long, cost long, audit string, repaired_sha256 string",
    )
