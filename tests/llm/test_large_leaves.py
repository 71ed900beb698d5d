"""Leaves with more templates than are compared in one go."""

import collections
import random
import time

import numpy as np
import pytest

from voltfleet.llm import templates


def word(rng):
    return "".join(rng.choice("abcdefghijklmnop") for _ in range(8))


def pairs_of(rng, tails):
    """Each line, and the same with one other word of the tail."""
    out = []
    for tail in tails:
        at = rng.randrange(len(tail))
        out.append((tail, [*tail[:at], word(rng), *tail[at + 1 :]]))
    return [tuple("one two three four " + " ".join(t) for t in p) for p in out]


@pytest.mark.parametrize("shared", [0, 5])
def test_planted_pairs_of_a_large_leaf_are_all_merged(spark, monkeypatch, shared):
    """Tails without a word in common, and such that share a block of each third word."""
    monkeypatch.setattr(templates, "LEAF_ROWS", 12)
    rng = random.Random(shared)
    tails = [[word(rng) for _ in range(6)] for _ in range(60)]
    if shared:
        tails = [["same", *t[1:3], "same", *t[4:]] for t in tails]
    pairs = pairs_of(rng, tails)
    rows = [(i, a) for i, (a, _) in enumerate(pairs)] + [(i + 1000, b) for i, (_, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = templates.drop_recurring_lines(df).where("text <> ''").collect()
    assert sorted(r["doc_id"] for r in left) == list(range(60))


def cleaned_by_hand(rows):
    """Recurring templates by comparing all lines: ``rows`` of id and text, in any order."""

    def masked(line):
        return tuple("<*>" if any(c.isdigit() for c in w) else w for w in line.split())

    def document(row):
        return (1, xxhash64(row[1])) if row[0] is None else (0, row[0])

    lines = sorted({masked(x) for _, t in rows for x in (t or "").split("\n") if len(x.split()) > 2})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(lines):
        for y in lines[:k]:
            if len(x) == len(y) and x[:4] == y[:4]:
                if 5 * sum(a == b for a, b in zip(x, y)) >= 4 * len(x):
                    root[find(x)] = find(y)
    first, seen = {}, collections.defaultdict(set)
    for row in rows:
        for line in (row[1] or "").split("\n"):
            if masked(line) in root:
                template = find(masked(line))
                seen[template].add(document(row))
    first = {t: min(docs) for t, docs in seen.items()}
    out = []
    for row in rows:
        if row[1] is None:
            out.append((row[0], None, 0))
            continue
        kept = [
            x for x in row[1].split("\n")
            if masked(x) not in root or first[find(masked(x))] == document(row)
        ]
        out.append((row[0], "\n".join(kept), len(row[1].split("\n")) - len(kept)))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def chained(spark):
    """Lines of few words, so that many are alike in chains, with odd rows; and what is left."""
    rng = random.Random(8)
    few = ["red", "green", "blue", "7", "x1"]
    rows = []
    for i in range(300):
        size = rng.choice((4, 5, 9, 10, 14))
        lines = [" ".join(["on", "the", "way", "to", *rng.choices(few, k=size)][:size]) for _ in range(rng.randint(1, 3))]
        lines.append(" ".join(["on", "the", "way", "to", *(word(rng) for _ in range(6))]))
        rows.append((i if i % 9 else None, "\n".join(lines)))
    rows += [(None, None), (3, None), (4, ""), (None, ""), rows[9], rows[9], rows[5], (5, "on the way to red red 7")]
    hashes = spark.createDataFrame(rows, "i long, t string").selectExpr("t", "xxhash64(coalesce(t, '')) h").collect()
    HASHES.update({r["t"]: r["h"] for r in hashes})
    return rows, cleaned_by_hand(rows)


HASHES = {}


def xxhash64(text):
    return HASHES[text]


@pytest.mark.parametrize("leaf_rows", [8, 100, 4096])
def test_one_answer_at_any_size_of_leaves(spark, monkeypatch, chained, leaf_rows):
    monkeypatch.setattr(templates, "LEAF_ROWS", leaf_rows)
    rows, want = chained
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = templates.drop_recurring_lines(df).select("doc_id", "text", "n_dropped").collect()
    assert sorted(map(tuple, found), key=str) == want


def test_few_tokens_of_a_go_give_the_same(spark, monkeypatch, chained):
    monkeypatch.setattr(templates, "CELLS", 90)
    rows, want = chained
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = templates.drop_recurring_lines(df).select("doc_id", "text", "n_dropped").collect()
    assert sorted(map(tuple, found), key=str) == want


def test_a_column_of_the_same_name_as_the_count(spark):
    rows = [(1, "one two three four", "a"), (2, "one two three four", "b")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_dropped string")
    found = templates.drop_recurring_lines(df)
    assert found.columns == ["doc_id", "text", "n_dropped"]
    assert sorted(map(tuple, found.collect())) == [(1, "one two three four", 0), (2, "", 1)]
    kept = templates.drop_recurring_lines(df, count=None)
    assert sorted(map(tuple, kept.collect())) == [(1, "one two three four", "a"), (2, "", "b")]
    other = templates.drop_recurring_lines(df, count="lost").collect()
    assert sorted((r["doc_id"], r["n_dropped"], r["lost"]) for r in other) == [(1, "a", 0), (2, "b", 1)]


def test_unlike_lines_take_little_time():
    rng = np.random.default_rng(1)
    begin = time.time()
    a, b = templates.spanning_links(rng.integers(0, 10**6, (4096, 16)).astype(np.int32), 4)
    assert not len(a) and not len(b) and time.time() - begin < 30
