"""Small documents with everything that can go wrong in a table."""

import random

import pytest

from tests.conftest import rows, spark  # noqa: F401  the session of all tests

WORDS = "the of and tax bank firm market price paper value trade growth risk model test data form state Über naïve 12 a, b. c!".split()


def sentence(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def make_documents():
    """(doc_id, text, source, k1, b): copies, near copies, a shared passage, long, short, empty and null texts."""
    rng = random.Random(4)
    passage = sentence(rng, 60)
    base = [sentence(rng, n) for n in (3, 5, 40, 80, 200, 900)]
    texts = [*base, base[3], base[3].upper(), base[4] + " tail", " ".join(base[4].split()[:-4]), f"{sentence(rng, 30)} {passage}", f"{sentence(rng, 50)} {passage} {sentence(rng, 20)}", passage, passage + " " + passage, "", None, "   \t\n", "x", "x", "é" * 300, "aaaa" * 200, sentence(rng, 30) + "\x0b" + "\x85 \xa0   İ ς 中文 <|endoftext|> \x00"]
    texts += [passage.replace("tax", w) for w in ("firm", "bank", "risk")]
    rows = [(i * 3, t, "src", 7, "x") for i, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, base[3], None, None, None), (None, None, None, None, None), (12, "another text of the same id", None, 1, None)]
    return rows


SCHEMA = "doc_id long, text string, source string, k1 int, b string"


@pytest.fixture(scope="session")
def documents(spark):  # noqa: F811
    return make_documents()


@pytest.fixture
def docs(spark, documents):  # noqa: F811
    return spark.createDataFrame(documents, SCHEMA).repartition(3)


@pytest.fixture
def no_docs(spark):  # noqa: F811
    return spark.createDataFrame([], SCHEMA)
