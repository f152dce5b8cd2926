"""Small document tables with the awkward cases in them."""

import random

import pytest
from pyspark.sql import types as T

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def awkward(spark):
    """Nulls in any column, empty, blank and long texts, copies, near copies, repeated rows, and columns whose names clash with results."""
    shared = prose(1, 70)
    near = prose(2, 60).split()
    rows = [
        (1, shared, "en"), (2, f"{prose(3, 20)} {shared} {prose(4, 5)}", "en"), (3, prose(5, 120), "de"), (4, prose(5, 120), "de"), (4, prose(5, 120), "de"),
        (5, " ".join(near), None), (6, " ".join([*near[:30], "changed", *near[31:]]), "fr"), (7, None, "en"), (8, "", "en"), (9, " \n\t ", "en"), (None, prose(6, 10), "en"),
        (None, None, None), (10, prose(7, 30_000), "en"), (11, "word " * 400, "en"), (12, "été über naïve ÀÉ ﬁ 漢字 kana", "fr"), (13, "12 34 !!", "en"), (14, shared.upper(), "en"),
    ]
    schema = T.StructType.fromDDL("doc_id long, text string, lang string, fp long, ids string, keep string, size int, n_words string, `odd name` int")
    return spark.createDataFrame([(i, t, g, 7, "x", "y", 3, "z", 1) for i, t, g in rows], schema)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.filter("false")
