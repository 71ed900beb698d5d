"""Every operator against a brute-force version, over rows with all the odd cases."""

import base64
import collections
import hashlib
import math
import re
import struct

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voltfleet.llm import components, exact, languages, licences, lines, mixing, pii, simhash, templates, tokens, warc
from voltfleet.llm.queries import word_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
A_TO_Z = {i: i + 32 for i in range(65, 91)}
DIGITS = str.maketrans("0123456789", "ghijklmnop")


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def sha(data):
    return hashlib.sha256(data).hexdigest()


# Exact deduplication


def test_perfect_hash_gives_each_key_its_own_slot():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 5000):
        digests = rng.integers(0, 256, (n, 32), np.uint8)
        sizes, bits = exact.perfect_hash(digests)
        assert sorted(exact.slots(digests, sizes, bits)) == list(range(n))


@pytest.mark.parametrize("history", [None, "doc_id < 0", "doc_id >= 0", "doc_id % 2 = 0"])
def test_exact_dedup(docs, rows, history):
    condition = None if history is None else F.expr(history)
    found = exact.exact_dedup(docs, condition, keys_per_shard=7)
    groups = collections.defaultdict(list)
    for r in rows:
        groups[(r[1] or "").translate(A_TO_Z)].append(r[0])
    want = []
    for text, ids in groups.items():
        known = sorted(i for i in ids if i is not None)
        keep = known[-1] if known else None
        for copy, i in enumerate(sorted(ids, key=lambda i: (i is not None, i), reverse=True)):
            want.append((i, keep, len(ids), copy == 0, sha(text.encode())))
    assert got(found) == sorted(want, key=str)


# SimHash


def fingerprint(text, width):
    words = WORD.findall((text or "").translate(A_TO_Z))
    if not words:
        return 0
    parts = [" ".join(words[k : k + width]) for k in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def least_of_each(n, linked):
    parent = list(range(n))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return [root(x) for x in range(n)]


@pytest.fixture(scope="module")
def near_groups(rows):
    fps = [fingerprint(r[1], 4) for r in rows]
    return fps, least_of_each(len(rows), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)


def test_simhash_components(docs, rows, near_groups):
    fps, roots = near_groups
    ids = collections.defaultdict(list)
    for r, root in zip(rows, roots):
        ids[root] += [] if r[0] is None else [r[0]]
    want = [(r[0], "%016x" % fp, min(ids[root], default=None)) for r, fp, root in zip(rows, fps, roots)]
    found = simhash.simhash_components(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")), "component_id"
    )
    assert got(found) == sorted(want, key=str)


def test_one_of_each_keeps_all_columns(docs, rows, near_groups):
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len(set(near_groups[1]))
    assert {tuple(r) for r in kept.collect()} <= set(rows)


def test_dense_and_large_meetings(spark, monkeypatch):
    """Tiles of a few rows: links within and between them still connect all."""
    monkeypatch.setattr(simhash, "TILE", 16)
    rng = np.random.default_rng(4)
    centres = rng.integers(0, 2**64, 3, np.uint64)
    fps = {int(c) for c in rng.integers(0, 2**64, 50, np.uint64)}
    for c in centres.tolist():
        for _ in range(120):
            x = c
            for b in rng.integers(0, 64, 3).tolist():
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    want = least_of_each(len(fps), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 4)
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    links = simhash.close_links(df)
    assert all((a ^ b & (1 << 64) - 1).bit_count() <= 4 or ((a ^ b) & (1 << 64) - 1).bit_count() <= 4 for a, b in got(links))
    roots = dict(got(components.connected_components(links)))
    groups = collections.defaultdict(set)
    for x, r in zip(signed, want):
        groups[r].add(x)
    found = collections.defaultdict(set)
    for x in signed:
        found[roots.get(x, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, found.values()))


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(500, 501), (7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    assert got(components.connected_components(df)) == sorted(
        [(i, 0) for i in range(201)] + [(500, 500), (501, 500)], key=str
    )


# Line rules


def test_line_quality_base(docs, rows):
    want = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
        often = collections.Counter(windows)
        repeated = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(8)}
        seen = [x for x in text.split("\n") if WORD.search(x)]
        n = len(words)
        want.append(
            (r[0], n, sum(map(len, words)), sum(map(text.count, "#*$%&|<>")), len(seen) - len(set(seen)),
             len(repeated), n < 20 or 100 * len(repeated) > 30 * n)
        )
    found = lines.line_quality(docs)
    assert got(found.drop("kept", "cleaned")) == sorted(want, key=str)
    assert found.where("kept and base_failed").count() == 0


@pytest.mark.parametrize(
    "line,rule",
    [
        ("Home | About | Contact", "navigation"),
        ("News » Sport » Results", "navigation"),
        ("This site uses cookies to serve you better.", "boilerplate"),
        ("© 2024 All rights reserved.", "boilerplate"),
        ("the### best$$$ words*** here", "symbols"),
        ("Latest headlines", "punctuation"),
        ("A short line.", None),
        ("“Quoted!”", None),
        ("a line of ten or more words without a mark at its end", None),
        ("这是一个句子。", None),
    ],
)
def test_line_rules(line, rule):
    assert lines.line_failure(line.encode()) == rule


def test_clean_lines(docs, rows):
    kept = got(lines.clean_lines(docs).select("doc_id", "text", "n_chars", "row", "kept", "fp"))
    judged = {(r[0], r[1]): lines.assess(None if r[1] is None else r[1].encode()) for r in rows}
    want = []
    for r in rows:
        *_, stays, cleaned = judged[r[0], r[1]]
        if stays:
            text = cleaned.decode()
            want.append((r[0], text, len(text), "r", True, 7))
    assert kept == sorted(want, key=str)
    assert any("home | about" in (r[1] or "") for r in rows) and not any("home | about" in k[1] for k in kept)


# BPE


def test_tokens_equal_the_library(docs, rows):
    library = pytest.importorskip("tokenizers").Tokenizer.from_str(word_bpe())
    want = []
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0], len(ids), struct.pack(f"<{len(ids)}I", *ids), library.decode(ids, skip_special_tokens=False)))
    found = tokens.decode_documents(tokens.encode_documents(docs, word_bpe()), word_bpe())
    assert got(found.select("doc_id", "n_tokens", F.sha2("ids", 256), F.sha2(F.col("decoded").cast("binary"), 256))) == sorted(
        [(i, n, sha(ids), sha(text.encode())) for i, n, ids, text in want], key=str
    )


def test_decoding_reads_the_ids_alone(spark):
    library = pytest.importorskip("tokenizers").Tokenizer.from_str(word_bpe())
    rng = np.random.default_rng(4)
    many = [rng.integers(0, library.get_vocab_size(), n).tolist() for n in (0, 1, 5, 400)]
    rows = [(k, struct.pack(f"<{len(ids)}I", *ids), "old") for k, ids in enumerate(many)]
    rows += [(9, struct.pack("<3I", many[1][0], 2**32 - 1, many[1][0]), "old"), (10, None, None)]
    df = spark.createDataFrame(rows, "k long, ids binary, decoded string")
    found = tokens.decode_documents(df, word_bpe())
    assert found.columns == ["k", "ids", "decoded"]
    want = {k: library.decode(ids, skip_special_tokens=False) for k, ids in enumerate(many)}
    want |= {9: library.decode(many[1] * 2, skip_special_tokens=False), 10: None}
    assert {r["k"]: r["decoded"] for r in found.collect()} == want


def merge_by_hand(symbols, merges):
    word = list(symbols)
    for u, v in merges:
        i = 0
        while i < len(word) - 1:
            if (word[i], word[i + 1]) == (u, v):
                word[i : i + 2] = [u + v]
            i += 1
    return word


def test_automaton_equals_merges_in_order():
    rng = np.random.default_rng(9)
    for _ in range(60):
        names = list("abc")
        merges = []
        for _ in range(int(rng.integers(1, 9))):
            u, v = (names[i] for i in rng.integers(0, len(names), 2))
            if u + v not in names:
                merges.append((u, v))
                names.append(u + v)
        number = {s: i for i, s in enumerate(names)}
        machine = tokens.Automaton(3, [(number[u], number[v]) for u, v in merges])
        for _ in range(60):
            word = "".join(rng.choice(list("abc"), rng.integers(1, 9)))
            path = machine.encode("".join(chr(0x100 + number[c]) for c in word))
            assert [names[i] for i in path] == merge_by_hand(word, merges), (word, merges)


# Mixing


def test_mixing(docs, rows):
    mixed = mixing.mix(docs, shards=5, block_words=64)
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    weights = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    goal, free, left = {}, set(names), sum(sizes.values())
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            break
        for s in over:
            goal[s] = 3 * sizes[s]
            left -= goal[s]
            free.discard(s)
    goal |= share
    found = mixed.collect()
    taken, of_source = collections.Counter(), {}
    for r in found:
        assert r["target"] == pytest.approx(goal[r["source"]]) and 0 <= r["words"] <= r["size"]
        assert (r["pass"] is None) == (r["shard"] is None) == (r["words"] == 0)
        assert r["shard"] is None or 0 <= r["shard"] < 5
        taken[r["source"]] += r["words"]
    assert {s: taken[s] for s in names} == {s: round(goal[s]) for s in names}
    once = [r for r in found if not r["pass"]]
    assert sorted((r["doc_id"], r["size"]) for r in once if r["doc_id"] is not None) == sorted(
        (r[0], len(WORD.findall(r[1] or ""))) for r in rows if r[0] is not None
    )
    assert len(once) == len(rows)
    assert got(mixed) == got(mixing.mix(docs.repartition(7), shards=5, block_words=64))


def test_mixed_documents(docs, rows):
    mixed = mixing.mixed_documents(docs, shards=3)
    assert mixed.columns == docs.columns
    words = mixed.select(F.sum(F.regexp_count("text", F.lit(WORD.pattern)))).first()[0]
    assert words == mixing.mix(docs).agg(F.sum("words")).first()[0]
    whole = {(r[0], r[1]) for r in rows}
    cut = [r for r in mixed.collect() if (r["doc_id"], r["text"]) not in whole]
    assert len(cut) <= 4 and all(len(r["text"]) == r["n_chars"] for r in cut)
    assert all(any(i == r["doc_id"] and t.startswith(r["text"]) for i, t in whole if t) for r in cut)


def test_split_tree_deals_out_all_blocks():
    quotas = np.array([1000, 0, 7, 333])
    nodes = mixing.split_tree(quotas, 13, seed=2)
    assert [(first, shards) for first, shards, *_ in nodes] == [(k, 1) for k in range(13)]
    dealt = np.array([blocks for _, _, blocks, _ in nodes])
    assert dealt.shape == (13, 4) and (dealt.sum(axis=0) == quotas).all()
    assert dealt.sum(axis=1).max() - dealt.sum(axis=1).min() <= math.ceil(math.log2(13))
    before = np.array([before for *_, before in nodes])
    assert (before == dealt.cumsum(axis=0) - dealt).all()
    # Grown two levels at a time, the tree is the same.
    grown = []
    for first, shards, blocks, start in mixing.split_tree(quotas, 13, 2, levels=2):
        grown += [(f, n, *b, *(start + a)) for f, n, b, a in mixing.split_tree(blocks, shards, 2, first)]
    assert grown == [(f, n, *b, *a) for f, n, b, a in nodes]


@pytest.mark.parametrize("shards", [1, 5, 4_000_000])
def test_each_block_is_drawn_once(spark, shards):
    quotas = {0: 700, 1: 1, 2: 0, 3: 41}
    df = spark.createDataFrame(list(quotas.items()), "rank int, blocks long")
    found = mixing.deal_blocks(df, shards).collect()
    assert sorted((r["rank"], r["block"]) for r in found) == [(s, b) for s, n in quotas.items() for b in range(n)]
    assert all(0 <= r["shard"] < shards for r in found)
    held = collections.Counter(r["shard"] for r in found)
    assert max(held.values()) <= sum(quotas.values()) // shards + math.ceil(math.log2(shards)) + 1


def test_words_follow_from_the_blocks_of_the_shards(docs, monkeypatch):
    """Blocks that no shard draws are not in the mix."""
    whole = mixing.mix(docs, shards=5, block_words=64).where("words > 0").collect()
    deal = mixing.deal_blocks
    monkeypatch.setattr(mixing, "deal_blocks", lambda *a: deal(*a).where("shard <> 2"))
    rest = mixing.mix(docs, shards=5, block_words=64).where("words > 0").collect()
    key = lambda r: (r["row_key"], r["start"], r["pass"], r["words"], r["shard"])
    assert any(r["shard"] == 2 for r in whole)
    assert sorted(map(key, rest)) == sorted(key(r) for r in whole if r["shard"] != 2)


# Personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def valid(kind, text):
    digits = re.sub("[^0-9]", "", text)
    return {
        "email": lambda: True,
        "ip": lambda: all(int(p) <= 255 for p in text.split(".")),
        "card": lambda: 16 <= len(digits) <= 19 and passes_luhn(digits),
        "phone": lambda: 8 <= len(digits) <= 15,
    }[kind]()


def spans_by_hand(text, kind):
    return [m.span() for m in re.finditer(PATTERNS[kind], text) if valid(kind, m.group())]


MORE = (
    "a.b_c@d.e_f@g.h x@y a@b.c.d@e.f ..@-.- é@x.y 𝕏 z@𝕏.q.r",
    "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3 9.9.9.9999 1..2.3.4",
    "4111-1111-1111-1111 4111111111111111 5 4111 1111 1111 1111 0 4111  1111",
    "+12 345 678 +1(2)3.4-5 678 90 +49 30 123456-78) +1 +((((1 ++123456789+12345678 𝕏+1 555 010 9999",
)


def test_strict_spans(spark, rows):
    texts = [r[1] for r in rows if r[1] is not None and len(r[1]) < 10_000] + list(MORE)
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    found = df.select("i", *(pii.strict_spans(F.col("text"), k).alias(k) for k in pii.KINDS))
    for r in found.collect():
        for kind in pii.KINDS:
            assert [(s["start"], s["end"]) for s in r[kind]] == spans_by_hand(texts[r["i"]], kind), (kind, texts[r["i"]])


def test_personal_data(docs, rows):
    found = pii.find_personal_data(docs)
    assert found.count() == len(rows)
    by_text = {r[0]: r[1] for r in rows if r[0] is not None and r[0] != 5}
    for r in found.where("doc_id <> 5").collect():
        text = by_text[r["doc_id"]] or ""
        if len(text) < 10_000:
            for kind in pii.KINDS:
                assert [(s["start"], s["end"]) for s in r[kind]] == spans_by_hand(text, kind)
        taken = [(s["start"], s["end"]) for k in pii.KINDS for s in r[k]]
        for s in r["added"]:
            assert all(s["end"] <= a or b <= s["start"] for a, b in taken)
        if not re.search(r"[0-9]|@| at |\(at\)", text):
            assert not r["added"]


def test_reliabilities_tell_good_labelers_from_bad(spark):
    """A labeler that votes at random ends up less reliable than one that is right."""
    rng = np.random.default_rng(5)
    counts = collections.Counter()
    for _ in range(4000):
        truth = 1 if rng.random() < 0.5 else -1
        votes = [truth if rng.random() < p else -truth for p in (0.95, 0.9, 0.85, 0.55, 0.9, 0.9)]
        counts[tuple(votes)] += 1
    patterns = [("email", *v, 1, 1, n) for v, n in counts.items()]
    schema = "kind string, " + ", ".join(f"{v} int" for v in pii.VOTES) + ", left_edge int, right_edge int, n long"
    prior, right = pii.reliabilities(spark.createDataFrame(patterns, schema))
    assert 0.4 < prior["email"] < 0.6
    assert abs(right["email", "v1"] - 0.95) < 0.04 and abs(right["email", "v4"] - 0.55) < 0.06


# Languages


def test_languages(spark):
    rng = np.random.default_rng(6)
    words = {"en": ["the", "thing", "with", "and", "which"], "de": ["und", "schön", "nicht", "ich", "über"]}
    rows = [(i, " ".join(rng.choice(words[x], 30)).title(), x) for i in range(40) for x in [("en", "de")[i % 2]]]
    odd = [(100, None, "en"), (101, "", "en"), (102, "12 .. 3", "de"), (103, "Über", None), (None, "the thing", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    learned = languages.prototypes(df.where(~languages.held_out(F.col("doc_id"))))
    assert sorted(learned) == ["de", "en"]
    found = {r["doc_id"]: r for r in languages.identify(df, learned).collect()}
    assert all(found[i]["lang_pred"] == x for i, _, x in rows)
    assert [found[i]["lang_pred"] for i in (100, 101, 102, 103, None)] == ["und", "und", "und", "de", "en"]
    assert all(0 <= r["score"] <= 1 for r in found.values())
    nothing = languages.identify(df, {}).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]


def test_bundle_is_the_sum_of_bound_letters():
    profiler = languages.Profiler()
    plain = " ab é "
    want = np.zeros(languages.DIMENSIONS, int)
    for i in range(len(plain) - 2):
        vectors = [np.roll(languages.letter_vector(ord(c)), k) for k, c in enumerate(plain[i : i + 3])]
        want += np.prod(vectors, axis=0)
    assert (profiler.bundle("Ab, é!") == want).all()


# Licences


def test_licences(docs, rows):
    found = licences.scan(docs, licences.train(docs)).collect()
    assert len(found) == len(rows)
    text_of = {r[0]: r[1] or "" for r in rows}
    for r in found:
        text = text_of.get(r["doc_id"], "")
        want = [f for f, mark in (("gpl", "GNU General"), ("mit", "MIT License")) if mark in text]
        if r["doc_id"] is not None:
            assert r["families"] == want
            assert r["n_unknown"] == ("All rights reserved." in text)


# Line templates


def test_line_templates(docs, rows):
    cleaned = templates.drop_recurring_lines(docs)
    assert cleaned.columns == [*docs.columns, "n_dropped"]
    found = cleaned.collect()
    assert len(found) == len(rows)
    first = {}
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for line in (r[1] or "").split("\n"):
            first.setdefault(line, r[0])
    by_id = collections.defaultdict(list)
    for r in rows:
        by_id[r[0]].append(r[1])
    for r in found:
        if r["text"] is None:
            continue
        left = r["text"].split("\n")
        for line in left:  # no line of three words that an earlier document has
            assert len(line.split()) < 3 or first.get(line, r["doc_id"]) == r["doc_id"]
        assert any(set(left) <= set((t or "").split("\n")) | {""} for t in by_id[r["doc_id"]])
        assert r["n_chars"] == len(r["text"])
    orders = [r["text"] for r in found if "was shipped to" in (r["text"] or "")]
    assert len(orders) == 1 and "ann" in orders[0]


def test_a_large_leaf_is_dealt_to_blocks_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(templates, "LEAF_ROWS", 5)
    rows = [(i, f"please write to user {'abcdefghij'[i % 10]}{'klmnop'[i // 10]} now or never again") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    left = templates.drop_recurring_lines(df).where("text <> ''").collect()
    assert [r["doc_id"] for r in left] == [0]


# WARC


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>é" * 30_000
    rows = [
        (4, "http://x/é?a b\r\nX: y", "<html>one"), (2, None, "<html>one"), (9, "u", "<html>one"),
        (1, "u", None), (3, "u", ""), (7, "u", long), (8, "u", long), (6, "u", "0\r\n\r\nWARC/1.1\r\n\r\n"),
        (5, "u", "<b>same row"), (5, "u", "<b>same row"), (None, "u", "<html>one"), (None, "v", "only here"),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("copies", F.lit("x"))


def test_archive_round_trip(pages):
    found = warc.archive_round_trip(pages, segment_bytes=1000)
    groups = collections.defaultdict(list)
    for r in pages.collect():
        groups[r["html"] or ""].append(r["page_id"])
    want = []
    for html, ids in groups.items():
        ids = sorted(ids, key=lambda i: (i is None, i))
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        for k, i in enumerate(ids):
            kind = "revisit" if k else "response"
            want.append((i, len(html.encode()), digest, kind, ids[0] if k else None, "complete"))
    assert got(found) == sorted(want, key=str)


def test_small_payloads_are_all_responses(pages):
    found = warc.archive_round_trip(pages, min_payload=10_000).collect()
    assert sorted(r["page_id"] for r in found if r["record_type"] == "revisit") == [8]


def segments(spark, texts, drop=(), total=None):
    block = b"".join(texts)
    rows = [
        ("o" if k == 1 else f"o:{k}", "response" if k == 1 else "continuation", "u" if k == 1 else None, None, None,
         1, "o", k, (len(block) if total is None else total) if k == len(texts) else None, bytearray(t))
        for k, t in enumerate(texts, 1) if k not in drop
    ]
    return spark.createDataFrame(rows, warc._RECORD_DDL)


HEAD = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n"


@pytest.mark.parametrize(
    "texts,drop,total,state",
    [
        ([HEAD + b"5\r\nhel", b"lo\r\n0\r\n", b"\r\n"], (), None, "complete"),
        ([HEAD + b"5;x=1\r\nhello\r\n0\r\nTrailer: 1\r\n\r\n", b""], (), None, "complete"),
        ([HEAD + b"5\r\nhel", b"lo\r\n0\r\n", b"\r\n"], (2,), None, "missing segment"),
        ([HEAD + b"5\r\nhel", b"lo\r\n0\r\n", b"\r\n"], (3,), None, "missing segment"),
        ([HEAD + b"5\r\nhel", b"lo\r\n0\r\n\r\n"], (), 9, "wrong length"),
        ([HEAD + b"5\r\nhel", b"l\r\n0\r\n\r\n"], (), None, "broken framing"),
        ([HEAD + b"zz\r\n", b"hello"], (), None, "broken framing"),
    ],
)
def test_reassembly(spark, texts, drop, total, state):
    row = warc.reassemble(segments(spark, texts, drop, total).orderBy(F.desc("segment"))).first()
    assert row["state"] == state
    if state == "complete":
        assert bytes(row["payload"]) == b"hello" and row["payload_bytes"] == 5


# Empty tables


def test_empty_tables(spark, empty):
    for df in (
        exact.exact_dedup(empty), simhash.simhash_components(empty), simhash.one_of_each(empty),
        lines.line_quality(empty), lines.clean_lines(empty), tokens.encode_documents(empty, word_bpe()),
        mixing.mix(empty), mixing.mixed_documents(empty), pii.find_personal_data(empty),
        languages.identify(empty, languages.prototypes(empty)), licences.scan(empty, licences.train(empty)),
        templates.drop_recurring_lines(empty),
        warc.archive_round_trip(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0
