"""The scalar functions by SQL name: temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from swipelake.fixed_values import (
    BAND_SCORED,
    DAY_PARTS,
    RISK_AMOUNT_POINTS,
    RISK_DEVICE_OTHER,
    RISK_DEVICE_POINTS,
    RISK_KNOWN_FRAUD,
    RISK_TYPE_OTHER,
    RISK_TYPE_POINTS,
)


def _case(*branches: str, default: str) -> str:
    return f"CASE {' '.join(branches)} ELSE {default} END"


def _points(column: str, table: dict, default: int) -> str:
    return _case(*[f"WHEN {column} = '{k}' THEN {v}" for k, v in table.items()], default=str(default))


def _definitions() -> dict[str, tuple[str, str, str]]:
    """name -> (parameters, return type, body)."""
    limits, above = BAND_SCORED
    category = _case(
        "WHEN amount IS NULL THEN 'unknown'",
        *[f"WHEN amount < {limit} THEN '{word}'" for limit, word in limits],
        default=f"'{above}'",
    )
    hour = "try_cast(substr(ts, 12, 2) AS INT)"
    day_part = _case(
        f"WHEN {hour} IS NULL THEN 'unknown'",
        *[f"WHEN {hour} >= {a} AND {hour} < {b} THEN '{word}'" for a, b, word in DAY_PARTS],
        default="'night'",
    )
    score = " + ".join(
        [
            _case(*[f"WHEN amount > {a} THEN {p}" for a, p in RISK_AMOUNT_POINTS], default="0"),
            _points("device", RISK_DEVICE_POINTS, RISK_DEVICE_OTHER),
            _points("kind", RISK_TYPE_POINTS, RISK_TYPE_OTHER),
            _case(f"WHEN fraud <> 0 THEN {RISK_KNOWN_FRAUD}", default="0"),
        ]
    )
    return {
        "categorize_amount": ("amount DOUBLE", "STRING", category),
        "mask_sensitive": (
            "v STRING",
            "STRING",
            "CASE WHEN char_length(v) > 4"
            " THEN concat(repeat('*', char_length(v) - 4), right(v, 4)) ELSE v END",
        ),
        "extract_hour_bucket": ("ts STRING", "STRING", day_part),
        "is_weekend": ("day INT", "BOOLEAN", "coalesce(day IN (1, 7), false)"),
        "hash_customer": ("id STRING", "STRING", "substr(sha2(id, 256), 1, 16)"),
        "parse_currency": (
            "v STRING",
            "DOUBLE",
            "coalesce(try_cast(trim(regexp_replace(v, '[$,]', '')) AS DOUBLE), 0D)",
        ),
        "calculate_risk_score": (
            "amount DOUBLE, fraud INT, device STRING, kind STRING",
            "DOUBLE",
            f"CAST(least(100, greatest(0, {score})) AS DOUBLE)",
        ),
    }


def register(spark: SparkSession) -> list[str]:
    """Create (or replace) the SQL functions in this session; returns their names."""
    made = _definitions()
    for name, (parameters, returns, body) in made.items():
        spark.sql(
            f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {returns} RETURN {body}"
        )
    return list(made)
