"""Which spans are candidates of personal data."""

from pyspark.sql import functions as F

from voltfleet.llm import pii


def loose(spark, kind, texts):
    """The loose spans of each text, as they stand in it."""
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.candidates(df).select("doc_id", F.col(f"loose_{kind}").alias("spans")).collect()}
    return [[t[s["start"] : s["end"]] for s in found[i]] for i, t in enumerate(texts)]


def test_loose_phones_before_any_edge(spark):
    numbers = ("(212) 555-1234", "212-555-1234", "(030) 12.34.567", "020 7946 0018")
    edges = ("", " now", ". Then", ", then", "- then", ") then", "\nthen", "! then")
    texts = [f"call {n}{e}" for n in numbers for e in edges]
    assert loose(spark, "phone", texts) == [[n] for n in numbers for _ in edges]


def test_a_number_after_a_phone_is_not_part_of_it(spark):
    texts = ["call (212) 555-1234 100 times", "212-555-1234 2024 was", "(212) 555-1234-5678"]
    assert loose(spark, "phone", texts) == [["(212) 555-1234"], ["212-555-1234"], ["(212) 555-1234-5678"]]


def test_every_phone_of_the_fixture_is_a_candidate(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("text is not null")
    form = r"(?<![0-9A-Za-z+.-])\([0-9]{3}\) [0-9]{3}-[0-9]{4}(?![0-9A-Za-z])"
    numbers = F.size(F.regexp_extract_all("text", F.lit(form), 0))
    rows = given.where(numbers > 0).select("doc_id", "text", numbers.alias("n"))
    taken = pii.candidates(rows).select("doc_id", (F.size("phone") + F.size("loose_phone")).alias("found"))
    both = rows.join(taken, "doc_id").select("n", "found").collect()
    assert both and all(r["found"] >= r["n"] for r in both)


def test_loose_addresses(spark):
    forms = (
        "fe80::1", "fe80::1ff:fe23:4567:890a", "::1", "2001:db8::1", "fe80::", "::ffff:a00:1",
        "2001:db8:0:1:1:1:1:1", "2001:DB8:1::7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8",
    )
    edges = ("", " x", ".", ". Then", ", then", ")", ": up", "/64", "%eth0")
    texts = [f"host {f}{e}" for f in forms for e in edges]
    assert loose(spark, "ip", texts) == [[f] for f in forms for _ in edges]
    assert loose(spark, "ip", ["at 12:34", "std::vector", "a :: b", "x.fe80::1z", "note: add"]) == [[]] * 5


def test_loose_phones_in_pairs_and_without_a_break(spark):
    forms = ("01 23 45 67 89", "01-23-45-67-89", "30-12-34-56", "5551234567", "07911123456", "61234567")
    edges = ("", " now", ". Then", ", then")
    texts = [f"call {f}{e}" for f in forms for e in edges]
    assert loose(spark, "phone", texts) == [[f] for f in forms for _ in edges]
    others = ["0.5551234567", "5551234567.25", "a5551234567", "1234567", "2024-01-12", "12 34 56"]
    assert loose(spark, "phone", others) == [[]] * 6


def test_a_date_without_a_break_speaks_against_a_phone(spark):
    df = spark.createDataFrame([(1, "on 20240112 and 20249912")], "doc_id long, text string")
    assert [v["v6"] for v in pii.candidates(df).first()["loose_phone"]] == [-1, 0]
