import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))

LONG = " ".join(f"w{i % 977} x{i % 13}" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "one", "One two\nOne two\n\nthree", "a b c d e f g h i a b c d e f g h i x", LONG, LONG,
    "mail bob.smith+x@mail.example.com, or a@b@c.org now; @x.y z@q 10.0.0.1 and 1.2.3.4.5.6.7.8 or 256.1.1.1 and 0001.2.3.4",
    "card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (555) 123-4567 and +12 3 and +1234567890123456 end",
    "CC-BY, cc by cc BY\ngeneral public license; All Rights Reserved. Licensed under CC BY-NC 4.0.",
    "Released under the\nMIT License. Übergrößen ## ** $$ <b> & | %", "x" * 5000, "# * $ % & | < >\n" * 30, "tie tie tie tie", "tie tie tie tie",
    "caf\u00e9 \u00a0 \u2003 na\u00efve \x1c sep \x85 end @home", "the quick brown fox jumps over the lazy dog " * 12,
]


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, ties, repeated rows, long texts and columns with clashing names."""
    rows = [(i, t, "en", "s", "k", 1, "r") for i, t in enumerate(TEXTS)] + [(3, "one", "en", "s", "k", 1, "r"), (None, "no id here", "en", "s", "k", 1, "r"), (None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept string, score int, row string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("false")


@pytest.fixture(scope="session")
def labels(spark, sf):
    return spark.read.parquet(f"{sf}/labels.parquet")
