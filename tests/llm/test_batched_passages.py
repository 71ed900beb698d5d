"""Texts and windows of passages are handled many at a time, and bytes decide."""

import numpy as np
import pyarrow as pa
import zstandard

from voltfleet.llm import passages
from voltfleet.llm.common import arrow_schema

_NEEDED = (
    "doc_id long, packed binary, tag long, found array<struct<tag: long, start: long, end: long>>, "
    "copy boolean"
)


def test_texts_lose_their_spans_many_at_a_time(spark):
    text = bytes(range(97, 117)) * 10
    found = [
        None, [], [(0, 5, 60), (0, 60, 110), (0, 20, 70)], [(0, 150, 200), (0, 0, 50)], [(7, 0, 50)],
    ]
    gone = [0, 0, 105, 100, 0]
    rows = [
        {
            "doc_id": k, "packed": zstandard.compress(text), "tag": 0, "copy": k % 7 == 6,
            "found": None if spans is None else [dict(zip(("tag", "start", "end"), s)) for s in spans],
        }
        for k, spans in enumerate(found * 20)
    ]
    rows.append(rows[6] | {"doc_id": None, "packed": zstandard.compress(b"short"), "copy": True, "found": None})
    batch = pa.RecordBatch.from_pylist(rows, arrow_schema(_NEEDED))
    out = list(passages._without(arrow_schema(passages._CLEANED))(iter([batch])))
    assert len(out) == 1
    told = out[0].to_pylist()
    assert [r["n_removed"] for r in told] == [200 if k % 7 == 6 else gone[k % 5] for k in range(100)] + [0]
    assert told[2]["spans"] == [{"start": 5, "end": 110}]
    assert told[2]["kept"] == text[:5] + text[110:]
    assert told[3]["spans"] == [{"start": 0, "end": 50}, {"start": 150, "end": 200}]
    assert [r["n_spans"] for r in told[:7]] == [0, 0, 1, 2, 0, 0, 1]
    assert told[-1]["kept"] == b"short"


def test_strings_of_many_texts_share_rows(spark):
    rng = np.random.default_rng(5)
    text = rng.integers(97, 123, 300).astype(np.uint8).tobytes()
    runs = passages._Runs([text])
    key = passages._key(3, runs.key >> np.uint64(61), runs.key & passages._LOW)
    rows = [
        {"row": k, "nameless": False, "tag": 0, "doc_id": k, "packed": zstandard.compress(text), "keys": key.tolist(), "hot": []}
        for k in range(50)
    ]
    schema = arrow_schema(
        "row long, nameless boolean, tag long, doc_id long, packed binary, keys array<long>, hot array<long>"
    )
    batch = pa.RecordBatch.from_pylist(rows, schema)
    out = [r for b in passages._strings(3, 4)(iter([batch])) for r in b.to_pylist()]
    assert len(out) <= 4 and sum(r["n"] for r in out) == 50 * len(key)
    found = pa.RecordBatch.from_pylist(sorted(out, key=lambda r: r["part"]), arrow_schema(passages._PARTS))
    covered = np.zeros((50, len(text)), bool)
    for b in passages._repeated(iter([found])):
        for r in b.to_pylist():
            covered[r["row"], r["start"] : r["end"]] = True
    assert not covered[0].any() and covered[1:].all()


def test_windows_with_one_hash_are_told_apart_by_bytes(monkeypatch):
    rng = np.random.default_rng(6)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    data = np.concatenate([data, data[100:300], np.zeros(8, np.uint8)])
    place = np.append(np.arange(0, 351), np.arange(400, 551)).astype(np.int32)

    def groups():
        order, group = passages._alike(data, place)
        return sorted(sorted(order[group == g].tolist()) for g in np.unique(group))

    expected = sorted([100 + k, 351 + k] for k in range(151))
    assert groups() == expected
    monkeypatch.setattr(passages, "prefix_hashes", lambda d, n: np.zeros(len(d) - n + 1, np.uint64))
    assert groups() == expected
