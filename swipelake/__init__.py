"""Payment-transaction analytics as lazy Spark DataFrame functions."""

from swipelake.columns import CARD_COLUMNS, DEFAULT_COLUMNS, TxnColumns, guess_columns

__all__ = ["CARD_COLUMNS", "DEFAULT_COLUMNS", "TxnColumns", "guess_columns"]
