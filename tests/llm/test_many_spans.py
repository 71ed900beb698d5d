"""Texts with very many spans of personal data."""

import re
import time

from pyspark.sql import functions as F

from voltfleet.llm import pii


def test_running_folds_equal_a_loop(spark):
    values = [[], [5], [3, 1, 2], list(range(40, 0, -3)), [7] * 33]
    df = spark.createDataFrame([(v,) for v in values], "v array<long>")
    plus, most = pii.running(F.col("v"), lambda a, b: a + b), pii.running(F.col("v"), F.greatest)
    for r in df.select("v", plus.alias("plus"), most.alias("most")).collect():
        assert r["plus"] == [sum(r["v"][: i + 1]) for i in range(len(r["v"]))]
        assert r["most"] == [max(r["v"][: i + 1]) for i in range(len(r["v"]))]


def test_sixteen_thousand_phones_in_one_text(spark):
    """Places and contexts are right to the end, strict spans keep loose ones away, and it
    takes seconds: the time must not grow with the square of the spans."""
    parts = [f"𝕏 call +1 555 {i % 900 + 100} {i % 9000 + 1000}, or (212) 555-{i % 9000 + 1000}" for i in range(16_000)]
    text = "; ".join(parts)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    pii.candidates(df.limit(0)).collect()
    begin = time.time()
    found = pii.candidates(df).first()
    assert time.time() - begin < 60
    strict = [m.span() for m in re.finditer(r"\+1 555 [0-9]{3} [0-9]{4}", text)]
    loose = [m.span() for m in re.finditer(r"\(212\) 555-[0-9]{4}", text)]
    assert [(s["start"], s["end"]) for s in found["phone"]] == strict
    assert [(s["start"], s["end"]) for s in found["loose_phone"]] == loose
    # Each has the cue word in the characters before it, and clean edges.
    assert all(s["v4"] == 1 and s["left_edge"] and s["right_edge"] for s in found["phone"])
