import random

import pytest

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Columns whose names the operators use themselves.
    "row string, kept boolean, seals string, size double, digest string, fp int, copies int"
)


def prose(rng, words):
    vocabulary = [a + b for a in ("ba", "ke", "lo", "mi", "nu", "ter") for b in ("an", "est", "ing", "or", "us", "")]
    out = []
    while len(out) < words:
        out += [*(rng.choice(vocabulary) for _ in range(rng.randint(6, 14)))]
        out[-1] += "."
        if rng.random() < 0.4:
            out[-1] += "\n"
    return " ".join(out).replace("\n ", "\n")


@pytest.fixture(scope="session")
def texts():
    rng = random.Random(3)
    found = [prose(rng, rng.randint(25, 120)) for _ in range(40)]
    base = prose(rng, 150)
    words = base.split(" ")
    near = [" ".join([*words[:i], "other", *words[i + 1 :]]) for i in (20, 60, 100)]
    found += [base, base.upper(), *near, base]
    found += [
        None, "", " \t\n ", "one", "two words", "É é ß ﬁ Σας İ", "a\x0bb\x0cc\r\nd",
        prose(rng, 30_000),
        "x" * 100_000 + "@" + "1" * 50_000 + " " + "1 " * 3_000,
        "Mail ann@example.com or bob.lee%x@mail.example.org. Host 10.0.0.256 and 192.168.1.20.",
        "Card 4111 1111 1111 1111 and 4111111111111112, call +1 (555) 010-9999 or (555) 010-4477.",
        "write to ann (at) example (dot) com, or ann at home.",
        "a | b | c | d\nhome | about | contact\n" + prose(rng, 30),
        "Released under the MIT License.\n" + prose(rng, 40),
        prose(rng, 40) + "\nAll rights reserved.\nThis work is licensed under the GNU General Public License, version 2.",
        *(f"Order {k} was shipped to {name} on 2024-01-{k + 10}.\n" + prose(rng, 30) for k, name in enumerate(("ann", "bob", "eve"))),
        "a<|endoftext|>b it's I'LL 123 </w> 你好",
    ]
    return found


@pytest.fixture(scope="session")
def rows(texts):
    langs, sources = ("en", "de", None), ("a", "b", None, "c")
    out = [
        (i, t, langs[i % 3], sources[i % 4], None if t is None else len(t), "r", True, "s", 1.5, "d", 7, 2)
        for i, t in enumerate(texts)
    ]
    # The same row again, the same id with another text, rows without an id.
    out += [out[3], out[3], (5, texts[6], *out[6][2:]), (None, texts[7], *out[7][2:]), (None, None, *out[8][2:])]
    return out


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
