"""What the stages hold of the texts at a time."""

import subprocess
import sys

import pyarrow as pa

from voltfleet.llm import lines, queries, templates


def _python_input(df):
    """The columns that go to Python, as the plan has them."""
    plan = df._jdf.queryExecution().optimizedPlan()
    while plan.nodeName() != "MapInArrow":
        plan = plan.children().head()
    return plan.children().head().schema().catalogString()


def test_texts_go_to_python_once(docs):
    for df in (lines.clean_lines(docs), templates.drop_recurring_lines(docs, count=None)):
        assert _python_input(df).replace("struct<", ",").split(",").count("text:string") == 1


def test_lines_are_cleaned_a_few_texts_at_a_time():
    text = "All of these words make up a line that is long enough to stay here.\n" * 400
    texts = [text] * 1000
    batch = pa.record_batch([pa.array(texts), pa.array([{"doc_id": k} for k in range(1000)])], names=["text", "row"])
    sizes = [b.nbytes for b in lines._cleaned(iter([batch]))]
    assert max(sizes) < 8 << 20 < batch.nbytes


def test_a_table_of_texts_alone(spark):
    text = " ".join(f"word{k}" for k in range(60)) + "."
    docs = spark.createDataFrame([(text,), ("x",)], "text string")
    assert [r[0] for r in lines.clean_lines(docs).collect()] == [text]


def test_a_task_holds_one_tokenizer(docs):
    plan = queries.digested(docs, queries.word_bpe())._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("MapInArrow") == 1


_WORKER = """
import re
import pyarrow as pa
from voltfleet.llm.common import raw_texts, small_batches

def held():
    with open("/proc/self/smaps_rollup") as file:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", file.read())[1]) / 1024

def batches():
    for k in range(2):
        texts = pa.array([b"%d" % k * 2000] * 40_000, pa.binary())
        yield pa.record_batch([texts], names=["text"])

start, remembered = held(), []
for batch in small_batches(batches(), 256 << 20):
    texts = raw_texts(batch.column(0))
    remembered += [bytes(bytearray(x)) for x in texts[::200]]
    del batch, texts
print(held() - start)
"""


def test_memory_of_a_batch_is_handed_back():
    run = subprocess.run([sys.executable, "-c", _WORKER], capture_output=True, text=True, check=True)
    assert float(run.stdout) < 60  # MB; a batch has 80, and as much in Python's objects
