"""Column vocabulary: operators never hard-code a name, they take a TxnColumns."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import types as T


@dataclass(frozen=True)
class TxnColumns:
    """Where each transaction field lives in the caller's frame."""

    transaction_id: str = "transaction_id"
    customer: str = "customer_id"
    merchant: str = "merchant_id"
    category: str = "merchant_category"
    amount: str = "amount"
    timestamp: str = "transaction_time"
    fraud: str = "is_fraud"
    lat: str = "lat"
    lon: str = "long"
    merch_lat: str = "merch_lat"
    merch_lon: str = "merch_long"
    state: str = "state"


DEFAULT_COLUMNS = TxnColumns()

CARD_COLUMNS = TxnColumns(
    transaction_id="trans_num",
    customer="cc_num",
    merchant="merchant",
    category="category",
    amount="amt",
    timestamp="trans_date_trans_time",
)


def guess_columns(df: DataFrame) -> TxnColumns:
    """Card vocabulary when its customer column is there, else the default one."""
    return CARD_COLUMNS if CARD_COLUMNS.customer in df.columns else DEFAULT_COLUMNS


class MissingColumnError(ValueError):
    """A required column is not in the frame."""


def present(df: DataFrame, names: Iterable[str], missing: str = "raise") -> list[str]:
    """The given names that exist; an absent one raises unless ``missing='skip'``."""
    if missing not in ("raise", "skip"):
        raise ValueError(f"missing must be 'raise' or 'skip', not {missing!r}")
    names = list(names)
    absent = [n for n in names if n not in df.columns]
    if absent and missing == "raise":
        raise MissingColumnError(f"columns {absent} not in {df.columns}")
    return [n for n in names if n not in absent]


def numeric_columns(df: DataFrame, subset: Iterable[str] | None = None) -> list[str]:
    """Columns of any numeric type, decimals and small integers included."""
    wanted = list(df.columns if subset is None else subset)
    types = {f.name: f.dataType for f in df.schema.fields}
    return [n for n in wanted if n in types and isinstance(types[n], T.NumericType)]


# Declared schema of the synthetic transaction vocabulary (fixed values).
TRANSACTION_SCHEMA = (
    T.StructType()
    .add("transaction_id", T.StringType(), nullable=False)
    .add("customer_id", T.StringType(), nullable=False)
    .add("merchant_id", T.StringType())
    .add("merchant_category", T.StringType())
    .add("transaction_type", T.StringType())
    .add("amount", T.DoubleType(), nullable=False)
    .add("currency", T.StringType())
    .add("city", T.StringType())
    .add("transaction_time", T.StringType())
    .add("is_fraud", T.IntegerType())
    .add("card_type", T.StringType())
    .add("device_type", T.StringType())
)
