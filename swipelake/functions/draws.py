"""Reproducible pseudo-random draws: pure functions of an id, equal on any cluster and retry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digits(key: Column, seed: int, salt: str) -> Column:
    """First 8 hex digits of MD5 over seed, purpose and key, as a number."""
    text = F.concat(F.lit(f"{seed}:{salt}:"), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(key: Column, seed: int, salt: str) -> Column:
    """A double in [0, 1)."""
    return _digits(key, seed, salt) / F.lit(float(2**32))


def whole(key: Column, seed: int, salt: str, n: int) -> Column:
    """A long in [0, n)."""
    return _digits(key, seed, salt) % n


def choice(key: Column, seed: int, salt: str, words: Sequence[str]) -> Column:
    listed = F.array(*[F.lit(w) for w in words])
    return F.element_at(listed, (whole(key, seed, salt, len(words)) + 1).cast("int"))
