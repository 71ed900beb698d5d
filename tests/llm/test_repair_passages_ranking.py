"""Conversation repair, repeated passages and ranked search against brute force."""

import collections
import hashlib
import math
import random
import re
import zlib

import pytest

from voltfleet.llm import conversations, passages, ranking

A_TO_Z = {i: i + 32 for i in range(65, 91)}


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# Conversation repair


def damage(rows):
    """The contract's faults, row by row: conversation to its rows in order."""
    out = {}
    for conv, turn, role, text in rows:
        named = [" " if v is None else str(v) for v in (conv, turn)]
        fault = zlib.crc32(":".join(named).encode()) % 20
        mine = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        if fault == 0:
            continue
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        mine += [(turn, role, text)] * (2 if fault == 3 else 1)
    for mine in out.values():
        mine.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
    return out


FOLLOWS = {"": "su", "s": "u", "u": "a", "a": "u"}
WANTED = {"": "u", "s": "u", "u": "a", "a": "u"}
NAMES = {"u": "user", "a": "assistant"}


def repaired(rows):
    """All cheapest repairs by plain dynamic programming over whole audits and texts."""
    faults, seen = [], set()
    for _, role, text in rows:
        shown = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append(
            "blank" if not shown
            else "duplicate" if (role, text) in seen
            else "truncated" if shown[-1] not in ".!?"
            else ""
        )
        seen.add((role, text))
    best = {
        "": (0, "", []), "a": (0, "", []), "u": (3, "I", ["assistant:"]),
        "s": (6, "II", ["user:", "assistant:"]),
    }
    for (_, role, text), fault in reversed(list(zip(rows, faults))):
        now = {}
        for state, after in best.items():
            found = [(after[0] + 4, "D" + after[1], after[2])]
            if fault in ("", "truncated"):
                extra = 3 if fault else 0
                if role[:1] and role[:1] in FOLLOWS[state]:
                    cost, audit, lines = best[role[:1]]
                    found.append((cost + extra, "K" + audit, [f"{role}:{text}", *lines]))
                cost, audit, lines = best[WANTED[state]]
                found.append((cost + extra + 3, "R" + audit, [f"{NAMES[WANTED[state]]}:{text}", *lines]))
            now[state] = min(found)
        for _ in range(3):
            for state, to in WANTED.items():
                cost, audit, lines = now[to]
                now[state] = min(now[state], (cost + 3, "I" + audit, [NAMES[to] + ":", *lines]))
        best = now
    cost, audit, lines = best[""]
    turns = [r[0] for r in rows if r[0] is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    return (
        max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
        sum(p not in ("su", "ua", "au") for p in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(lines).encode()).hexdigest(),
    )


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant"]
    texts = ["a.", "b!", "c", "", "  ", None, "d?", "e\x85", "f. \n", "g" * 70_000, "h.", "i."]
    rows = []
    for conv in [None, *range(120)]:
        for _ in range(rng.choice([1, 2, 5, 9, 40])):
            rows.append((conv, rng.choice([None, *range(12)]), rng.choice(roles), rng.choice(texts)))
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t}" + ".!?,"[t % 4]) for t in range(900)]
    rows += [(501, None, "user", "again.")] * 40
    return rows


@pytest.mark.parametrize("chunk", [1, 7, 4096])
def test_repair(spark, talks, chunk, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK", chunk)
    rows = [(*r, 1.5, "x") for r in talks]
    # Columns whose names the operator uses itself.
    schema = "conv_id long, turn long, role string, text string, cost double, rows string"
    df = spark.createDataFrame(rows, schema).repartition(3)
    found = got(conversations.repair_conversations(conversations.damaged(df)))
    want = [(conv, *repaired(mine)) for conv, mine in damage(talks).items()]
    assert found == sorted(want, key=str)


def test_repair_without_damage_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "s."), (1, 1, "user", "u?"), (1, 2, "assistant", "a!")]
    df = conversations.as_they_are(spark.createDataFrame(rows, schema))
    found = conversations.repair_conversations(df).first()
    assert (found.cost, found.audit) == (0, "KKK")
    none = conversations.damaged(spark.createDataFrame([], schema))
    assert conversations.repair_conversations(none).collect() == []


def test_halving_keeps_to_the_least_of_the_cheapest():
    rng = random.Random(2)
    for _ in range(300):
        rows = [(rng.choice("suax"), rng.randrange(4), 1) for _ in range(rng.randint(1, 9))]
        plain, after = [], conversations.END
        for initial, kind, _ in reversed(rows):
            plain.append(conversations._back(initial, kind, after))
            after = plain[-1][0]
        state, want = conversations.START, []
        for _, edits, leads in reversed(plain):
            want.append(edits[state])
            state = leads[state]
        assert list(conversations.repair(rows, conversations.START, conversations.END)) == want


# Repeated passages


def without_repeats(rows, length=50):
    none = math.inf
    first = {}
    for doc_id, text in rows:
        data = (text or "").encode()
        mine = none if doc_id is None else doc_id
        for k in range(len(data) - length + 1):
            window = data[k : k + length]
            first[window] = min(mine, first.get(window, none))
    out = []
    for doc_id, text in rows:
        data = (text or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - length + 1):
            if first[data[k : k + length]] < (none if doc_id is None else doc_id):
                gone[k : k + length] = b"\1" * length
        kept = bytes(b for b, g in zip(data, gone) if not g)
        spans = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out.append((doc_id, len(data), sum(gone), spans, kept))
    return out


@pytest.fixture(scope="module")
def repeats(rows):
    rng = random.Random(1)
    shared = "".join(rng.choice("abc é") for _ in range(3000))
    found = [(r[0], r[1]) for r in rows]
    for k in range(100, 220):
        text = "".join(rng.choice("abcdefgh ") for _ in range(rng.randint(0, 300)))
        for _ in range(rng.randint(0, 3)):
            at = rng.randint(0, 2900)
            text += shared[at : at + rng.randint(20, 120)] + rng.choice("xyz")
        found.append((rng.choice([None, k, k, k, k // 2]), text))
    found += [
        (500, "x" * 5000), (501, "x" * 700 + "y" + "x" * 60), (503, "a" * 49), (504, "a" * 49),
        (505, "a" * 50), (506, "b" + "a" * 50), (506, "a" * 51),
    ]
    return found + found[100:104]


@pytest.mark.parametrize("batches, hot, piece", [(1, 20_000, 1 << 18), (5, 20_000, 64), (3, 2, 1 << 18)])
def test_passages(spark, repeats, batches, hot, piece, monkeypatch):
    monkeypatch.setattr(passages, "_PIECE", piece)
    schema = "doc_id long, text string, row string, packed int, keys double"
    df = spark.createDataFrame([(*r, "r", 1, 2.0) for r in repeats], schema).repartition(3)
    found = passages.drop_repeated_passages(df, batches, hot)
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]
    assert got(found.select(*names)) == sorted(without_repeats(repeats), key=str)
    for row in found.where("n_removed > 0").limit(5).collect():
        assert sum(s.end - s.start for s in row.spans) == row.n_removed


def test_passages_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert passages.drop_repeated_passages(none).collect() == []


def test_levels_merge_geometrically(spark, repeats):
    family = passages.Family(bits=3)
    rows = passages._rows(spark.createDataFrame(repeats, "doc_id long, text string"))
    sizes = []
    for k in range(5):
        family.add(rows.where(f"pmod(row, 5) = {k}").select("row", "nameless", "text"))
        sizes.append(sorted(family.levels))
    assert sizes == [[1], [2], [1, 2], [4], [1, 4]]
    # Levels join bucket by bucket, without an exchange.
    one, four = family.levels[1], family.levels[4]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = family._joined(one, four, "inner")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    family.forget(spark)


# Ranked search

TERM = re.compile(ranking.TERM)


def ranked(rows, items, top=10):
    docs = [(i, collections.Counter(TERM.findall((t or "").translate(A_TO_Z)))) for i, t in rows]
    n_docs, n_terms = sum(1 for _, c in docs if c), sum(c.total() for _, c in docs)
    df = collections.Counter(t for _, c in docs for t in c)
    out = []
    for item_id, text in items:
        scores = []
        for doc_id, counts in docs:
            score = 0
            for term in set(TERM.findall((text or "").translate(A_TO_Z))):
                if counts[term]:
                    m = 10 + (90 * counts.total() * n_docs) // n_terms
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * ((1_000_000_000 * counts[term]) // (1000 * counts[term] + 8 * m))
            if score > 0:
                scores.append((-score, doc_id is None, doc_id or 0, doc_id))
        best = sorted(scores)[:top]
        out += [(item_id, k + 1, b[3], -b[0]) for k, b in enumerate(best)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block, top", [(4096, 10), (5, 10), (1, 3)])
def test_ranking(spark, docs, rows, block, top, monkeypatch):
    monkeypatch.setattr(ranking, "BLOCK_DOCS", block)
    monkeypatch.setattr(ranking, "ITEMS_AT_ONCE", 3)
    found = [r[1] for r in rows if r[1]]
    items = [(k, " ".join(found[k].split()[: 5 + 9 * k])) for k in range(8)]
    items += [(3, found[1][:90]), (None, "É é one TWO words"), (20, None), (21, " .,"), (22, "nowhere")]
    items += items[:1]
    asked = spark.createDataFrame([(*i, 1, "x") for i in items], "item_id long, text string, item int, rank string")
    hits = ranking.search(ranking.build_index(docs), asked, top)
    assert got(hits) == ranked([(r[0], r[1]) for r in rows], items, top)


def test_ranking_of_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "one")], "item_id long, text string")
    assert ranking.search(ranking.build_index(docs), none).collect() == []
    assert ranking.search(ranking.build_index(empty), one).collect() == []


def test_pairs_bound_less_than_their_terms(spark):
    """Two terms which never meet bound a score by the larger one."""
    header = {"term": None, "ids": [1, 2], "counts": [3, 3], "items": 0, "block": 0}
    rows = [
        header,
        {"term": "a", "places": [0], "counts": [1], "weight": 900, "askers": [7], "items": 0, "block": 0},
        {"term": "b", "places": [1], "counts": [2], "weight": 500, "askers": [7], "items": 0, "block": 0},
    ]
    lists = ranking._Lists(rows, 2, 6)
    both, joint = lists.pairs[(0, 1)]
    assert not len(both) and joint == 0 and len(lists.largest) == 2
