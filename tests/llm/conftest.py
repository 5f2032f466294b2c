import pytest

from swipelake.columns import CARD_COLUMNS

ODD_TEXTS = [
    ("T1", None, "grocery", 0),
    ("T2", "", "grocery", 0),
    ("T3", " \n\t", None, None),
    ("T4", "corner shop on the main street near the station", "travel", 0),
    ("T5", "Corner shop on the main street near the station", "travel", 0),
    ("T5", "Corner shop on the main street near the station", "travel", 0),
    (None, "corner shop on the main street near the station", None, 1),
    ("T6", "x" * 30_000 + " " + "word " * 9_000, "travel", None),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Transactions with nulls, ties, repeated rows, a very long text and columns with clashing names."""
    made = spark.createDataFrame(ODD_TEXTS, "trans_num string, merchant string, category string, is_fraud int")
    names = (
        "row", "text", "shard", "slot", "bytes", "spans", "score", "words", "_key", "_name", "transaction_id",
        "set_key", "n", "label", "language", "draw", "id", "key", "kept", "category_words", "_time", "has_weak",
    )
    return made.selectExpr("*", *[f"{i} as {n}" for i, n in enumerate(names)])


@pytest.fixture(scope="session")
def cols():
    return CARD_COLUMNS
