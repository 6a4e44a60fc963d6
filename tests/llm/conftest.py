from __future__ import annotations

import random

import pyarrow.parquet as pq
import pytest

SF = "/root/testdata/sf0.01"
DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="session")
def corpus():
    return {r["doc_id"]: r["text"] for r in table("documents")}


def words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + rng.choice(["", "", "", ".", "\n"]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, very long, repeated and tied texts, a null id and a null source."""
    rng = random.Random(3)
    base = words(rng, 300)
    near = base.split(" ")
    near[150] = "changed"
    rows = [
        (1, base), (2, base), (3, " ".join(near)), (4, None), (5, ""), (6, " \n\t"), (7, "one"), (8, "Ünïcödé ÀB 1234  x"), (9, words(rng, 60_000)), (10, "x" * 200_000),
        (11, "The The The " * 400), (12, "mail me.you@host.org or 4111 1111 1111 1111, call +1 (555) 123-4567"), (12, "mail me.you@host.org or 4111 1111 1111 1111, call +1 (555) 123-4567"), (None, base), (14, words(rng, 80)), (15, "ab\0cd\0" * 30),
    ]
    return [(i, t, "en", None if k % 5 == 0 else f"src{k % 3}", None) for k, (i, t) in enumerate(rows)]


@pytest.fixture
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
