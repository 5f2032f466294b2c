"""Amount and distance bands, and category groups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from swipelake.fixed_values import (
    BAND_BASIC,
    BAND_DISTANCE_KM,
    BAND_ETL,
    BAND_FEATURE,
    BAND_SCORED,
    CATEGORY_GROUPS,
)


def banded(value: Column, scale: tuple, null_as: str | None = None) -> Column:
    """Name of the first band whose upper limit lies above ``value``.

    NULL falls in the last band, as no comparison holds, unless ``null_as`` names it.
    """
    limits, above = scale
    name = F
    if null_as is not None:
        name = name.when(value.isNull(), null_as)
    for limit, word in limits:
        name = name.when(value < limit, word)
    return name.otherwise(above)


def band_basic(amount: Column) -> Column:
    return banded(amount, BAND_BASIC)


def band_etl(amount: Column) -> Column:
    return banded(amount, BAND_ETL)


def band_feature(amount: Column) -> Column:
    return banded(amount, BAND_FEATURE)


def amount_category(amount: Column) -> Column:
    return banded(amount, BAND_SCORED, null_as="unknown")


def band_distance(km: Column, null_as: str | None = None) -> Column:
    return banded(km, BAND_DISTANCE_KM, null_as)


def mapped(key: Column, table: Mapping, default) -> Column:
    """Lookup in a small literal map; a NULL or absent key gives ``default``."""
    pairs = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    return F.coalesce(F.try_element_at(pairs, key), F.lit(default))


def category_group(category: Column) -> Column:
    return mapped(category, CATEGORY_GROUPS, "other")
