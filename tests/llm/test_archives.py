"""How often archives are read, and what is found in them on the way."""

import base64
import gzip
import hashlib

import pytest

from voltfleet.llm import warc


def _scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("binaryFile")


def test_archives_are_read_once(spark, monkeypatch):
    scans, staged = [], warc.__dict__.get("staged")

    def counted(df, label):
        scans.append(_scans(df))
        return staged(df, label)

    monkeypatch.setattr(warc, "staged", counted, raising=False)
    rows = [(1, "u", "one"), (2, "u", "one"), (3, "u", "long " * 2_000), (4, None, None)]
    found = warc.archive_round_trip(spark.createDataFrame(rows, "page_id long, url string, html string"), 1_000)
    assert sum(scans) + _scans(found) == 1
    assert sorted((r["page_id"], r["payload_bytes"], r["refers_to"], r["state"]) for r in found.collect()) == [
        (1, 3, None, "complete"), (2, 3, 1, "complete"), (3, 10_000, None, "complete"), (4, 0, None, "complete"),
    ]


def _payload_digest(payload):
    return f"sha1:{base64.b32encode(hashlib.sha1(payload).digest()).decode()}"


@pytest.fixture(scope="module")
def archives(tmp_path_factory):
    """Two archives with records of many kinds; one record's segments stand in both."""
    block = warc._HTTP + warc.chunked(b"hello " * 100, 50)
    told = {"WARC-Payload-Digest": _payload_digest(b"hello " * 100)}

    def segment(name, number, at, end, **fields):
        kind, own = ("response", name) if number == 1 else ("continuation", f"{name}:{number}")
        extra = {"WARC-Segment-Number": str(number)} | ({} if number == 1 else {"WARC-Segment-Origin-ID": f"<{name}>"})
        return warc._record(kind, own, block[at:end], extra | fields)

    size = str(len(block))
    last = {"WARC-Segment-Total-Length": size}
    one = [
        warc._record("warcinfo", "info", b"software: x", {}),
        warc._record("request", "request", b"GET / HTTP/1.1\r\n\r\n", {}),
        warc._record("response", "whole", block, told | {"WARC-Copies": "2", "WARC-Target-URI": "u"}),
        warc._record("response", "cut off", block[:-9], told),
        warc._record("response", "other digest", block, {"WARC-Payload-Digest": _payload_digest(b"x")}),
        warc._record("response", "no digest", b"HTTP/1.1 200 OK\r\n\r\nplain", {}),
        segment("parts", 3, 400, None, **last), segment("parts", 1, 0, 200, **told),
        segment("no end", 1, 0, 200), segment("no end", 2, 200, 400),
        segment("wrong total", 1, 0, 200), segment("wrong total", 2, 200, None, **{"WARC-Segment-Total-Length": "9"}),
    ]
    two = [
        warc._record("revisit", "again", b"HTTP/1.1 200 OK\r\n\r\n", {"WARC-Refers-To": "<whole>", "WARC-Copies": "3"}),
        warc._record("revisit", "of nothing", b"", {}),
        segment("parts", 2, 200, 400), segment("parts", 2, 200, 400), segment("no start", 2, 200, None, **last),
    ]
    path = tmp_path_factory.mktemp("archives")
    for name, records in (("a", one), ("b", two)):
        (path / f"{name}.gz").write_bytes(gzip.compress(b"".join(r + b"\r\n\r\n" for r in records)))
    return str(path)


def test_opened_records_tell_the_same(spark, archives):
    columns = ("record_id", "target_uri", "copies", "state", "payload_bytes", "payload_digest")

    def rows(df):
        return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)

    plain = warc.reassemble(warc.read_archives(spark, archives))
    opened = warc.reassemble(warc.read_archives(spark, archives, opened=True), carry=False)
    want = rows(plain)
    assert {r[0]: r[3] for r in want} == {
        "whole": "complete", "cut off": "broken framing", "other digest": "wrong digest", "no digest": "complete",
        "parts": "complete", "no end": "missing segment", "no start": "missing segment", "wrong total": "wrong length",
    }
    assert rows(opened.where("record_type is distinct from 'revisit'")) == want
    revisits = opened.where("record_type = 'revisit'").select("record_id", "refers_to", "copies", "state").collect()
    assert sorted(map(tuple, revisits)) == [("again", "whole", 3, None), ("of nothing", None, 1, None)]
    assert opened.where("payload is not null").count() == 0
