"""The stages of the pipeline, and the queries' SQL."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline  # noqa: E402
from voltfleet.llm import lines, tokens  # noqa: E402
from voltfleet.llm.queries import QUERIES, word_bpe  # noqa: E402
from voltfleet.llm.sql import SQL  # noqa: E402

DATA = "/root/testdata/sf0.001"


def test_pipeline(spark, docs, rows, tmp_path):
    current, sizes = docs, []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / name)
        stage(spark, current, DATA).write.parquet(path)
        after = spark.read.parquet(path)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == docs.columns
        sizes.append((name, after.count()))
        current, before = after, current
    kept = sum(lines.assess(None if r[1] is None else r[1].encode())[6] for r in rows)
    assert sizes[0] == ("quality_rules", kept) and sizes[1][1] == kept
    assert 0 < sizes[2][1] <= kept and sizes[3][1] == sizes[4][1]
    machine = tokens.tokenizer(word_bpe())
    texts = {r["doc_id"]: r["text"] for r in before.collect()}
    for r in current.collect():
        assert r["n_tokens"] == len(machine.encode([texts[r["doc_id"]].encode()])[0]) // 4 or list(
            x["doc_id"] for x in before.collect()
        ).count(r["doc_id"]) > 1


def test_near_copies_leave_one(spark, docs):
    """Of the near copies without a line in common, one document stays."""
    near = docs.where("doc_id in (40, 41, 45)")
    stage = dict(corpus_pipeline.STAGES)["near_dedup"]
    assert [r["doc_id"] for r in stage(spark, near, DATA).collect()] == [40]


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, name):
    if not os.path.isdir(DATA):
        pytest.skip("no tables")
    for table in ("documents", "conversations", "benchmark"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    result = duckdb.sql(SQL[name])
    found = QUERIES[name](spark, DATA)
    order = [result.columns.index(c) for c in found.columns]
    want = sorted((tuple(r[i] for i in order) for r in result.fetchall()), key=str)
    assert sorted((tuple(r) for r in found.collect()), key=str) == want
