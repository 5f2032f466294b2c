"""Fraud reports: each question is one aggregate pass and gives a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import cached_property, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from swipelake.columns import DEFAULT_COLUMNS, TxnColumns, present
from swipelake.fixed_values import PATTERN_NAMES, SECTION_NAMES
from swipelake.operators.clean import Step
from swipelake.plans.cube import MEASURES, cube, facts
from swipelake.scratch import written


def _percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 when there is nothing to share."""
    return F.coalesce(F.try_divide(part * 100.0, whole), F.lit(0.0))


def _count() -> Column:
    return F.count(F.lit(1))


def customer_profile(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    present(df, [cols.customer, cols.amount, cols.merchant])
    return df.groupBy(cols.customer).agg(
        _count().alias("transaction_count"),
        F.sum(cols.amount).alias("total_amount"),
        F.avg(cols.amount).alias("avg_amount"),
        F.min(cols.amount).alias("min_amount"),
        F.max(cols.amount).alias("max_amount"),
        F.stddev(cols.amount).alias("stddev_amount"),
        F.count_distinct(cols.merchant).alias("unique_merchants"),
    )


def overall_stats(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.agg(
        _count().alias("total_transactions"),
        F.sum(cols.amount).alias("total_amount"),
        F.avg(cols.amount).alias("avg_amount"),
        F.max(cols.amount).alias("max_amount"),
        F.min(cols.amount).alias("min_amount"),
    )


def label_counts(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    return df.groupBy(cols.fraud).agg(_count().alias("transactions"))


def _of(df: DataFrame, cols: TxnColumns) -> DataFrame:
    """Facts of a transaction frame; a frame of facts (or a cube) is taken as it is."""
    if "_rows" in df.columns and "_frauds" in df.columns:
        return df
    present(df, [cols.fraud, cols.amount])
    return facts(df, cols)


def _sum(measure: str) -> Column:
    return F.coalesce(F.sum(f"_{measure}"), F.lit(0))


def _mean(total: Column, count: Column) -> Column:
    return F.coalesce(F.try_divide(total, count), F.lit(0.0))


def fraud_summary(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """One row of totals; an empty input gives zeros."""
    one = _of(df, cols).agg(*[_sum(m).alias(m) for m in MEASURES])
    rows, frauds, amount, lost = (F.col(c) for c in ("rows", "frauds", "amount", "fraud_amount"))
    at_risk = F.when(amount > 0, _percent(lost, amount)).otherwise(0.0)
    legit = _mean(F.col("legit_amount"), F.col("legit_paid"))
    return one.select(
        rows.alias("total_transactions"),
        frauds.alias("fraud_transactions"),
        (rows - frauds).alias("legitimate_transactions"),
        F.round(_percent(frauds, rows), 4).alias("fraud_rate_percent"),
        F.round(amount, 2).alias("total_amount"),
        F.round(lost, 2).alias("fraud_amount"),
        F.round(at_risk, 2).alias("amount_at_risk_percent"),
        F.round(_mean(lost, F.col("fraud_paid")), 2).alias("avg_fraud_transaction"),
        F.round(legit, 2).alias("avg_legitimate_transaction"),
    )


def _rates(df: DataFrame, key: str, cols: TxnColumns, decimals: int = 4) -> DataFrame:
    """Per key: rows, frauds, amounts and rate; pre-aggregated in the map tasks."""
    rows = _of(df, cols)
    present(rows, [key])
    counted = rows.groupBy(key).agg(
        _sum("rows").alias("total_transactions"),
        _sum("frauds").alias("fraud_count"),
        F.round(F.sum("_amount"), 2).alias("total_amount"),
        F.round(_sum("fraud_amount"), 2).alias("fraud_amount"),
    )
    rate = _percent(F.col("fraud_count"), F.col("total_transactions"))
    return counted.withColumn("fraud_rate_percent", F.round(rate, decimals))


def fraud_by_category(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, min_transactions: int = 0
) -> DataFrame:
    rates = _rates(df, cols.category, cols)
    if min_transactions:
        rates = rates.filter(F.col("total_transactions") >= min_transactions)
    return rates.orderBy(F.desc("fraud_rate_percent"), cols.category)


def high_risk_categories(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, top: int = 3
) -> DataFrame:
    """Categories above the plain mean of all category rates, highest first."""
    rates = _rates(df, cols.category, cols)
    mean = rates.agg(F.avg("fraud_rate_percent")).scalar()
    above = rates.filter(F.col("fraud_rate_percent") > mean)
    return above.orderBy(F.desc("fraud_rate_percent"), cols.category).limit(top)


def risky_merchants(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, min_transactions: int = 10, top: int = 20
) -> DataFrame:
    rates = _rates(df, cols.merchant, cols).drop("fraud_amount")
    enough = rates.filter(F.col("total_transactions") >= min_transactions)
    return enough.orderBy(F.desc("fraud_rate_percent"), cols.merchant).limit(top)


@dataclass(frozen=True)
class AmountFacts:
    """What the pattern and anomaly sections need: two tables, each from one pass over the transactions.

    ``stats`` is one row: mean and deviation of the amount and the counts that need neither. ``outliers`` are
    the rows beyond a limit, narrow and with their ``z_score``: at most a quarter of all rows can lie
    more than two deviations from the mean.
    """

    stats: DataFrame
    outliers: DataFrame
    limit: float

    def pair(self) -> Column:
        """Mean and deviation as one scalar subquery."""
        return self.stats.select(F.struct("mean", "sd")).scalar()


def amount_facts(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, limit: float = 3) -> AmountFacts:
    present(df, [cols.fraud, cols.amount])
    amount, fraud = F.col(cols.amount), F.col(cols.fraud) == 1
    low, whole = amount < 5, amount % 100 == 0
    stats = df.agg(
        F.avg(amount).alias("mean"),
        F.stddev(amount).alias("sd"),
        F.count_if(low).alias("low"),
        F.count_if(low & fraud).alias("low_frauds"),
        F.count_if(whole).alias("round"),
        F.count_if(whole & fraud).alias("round_frauds"),
    )
    stats = written(stats, "amount_stats")
    pair = stats.select(F.struct("mean", "sd")).scalar()
    mean, sd = _mean_sd(pair)
    named = [c for c in (cols.transaction_id, cols.category) if c in df.columns]
    narrow = df.select(*named, cols.amount, cols.fraud).withColumn("z_score", F.abs((amount - mean) / sd))
    far = narrow.filter((F.col("z_score") > limit) | (amount > _high_limit(pair)))
    return AmountFacts(stats, written(far, "amount_outliers"), limit)


def _mean_sd(stats: Column) -> tuple[Column, Column]:
    """Mean (0 if none) and deviation (1 if none or 0)."""
    sd = F.coalesce(F.nullif(stats["sd"], F.lit(0.0)), F.lit(1.0))
    return F.coalesce(stats["mean"], F.lit(0.0)), sd


def _high_limit(stats: Column) -> Column:
    return F.coalesce(stats["mean"], F.lit(0.0)) + 2 * F.coalesce(stats["sd"], F.lit(0.0))


def _risk_level(rate: Column) -> Column:
    return F.when(rate > 5, "HIGH").when(rate > 1, "MEDIUM").otherwise("LOW")


def risk_patterns(
    df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, amounts: AmountFacts | None = None
) -> DataFrame:
    """High, very low and round amounts, three rows. ``amounts`` are facts made earlier."""
    amounts = amounts or amount_facts(df, cols)
    limit = _high_limit(amounts.pair())
    high = amounts.outliers.filter(F.col(cols.amount) > limit)
    high = high.agg(F.count(F.lit(1)).alias("high"), F.count_if(F.col(cols.fraud) == 1).alias("high_frauds"))
    one = amounts.stats.crossJoin(F.broadcast(high))  # one row each
    names = PATTERN_NAMES
    patterns = (
        (names["high"], F.format_string(">$%.2f", limit), "high"),
        (names["low"], F.lit("<$5.00"), "low"),
        (names["round"], F.lit("Divisible by $100"), "round"),
    )
    listed = [
        F.struct(
            F.lit(name).alias("pattern"),
            threshold.alias("threshold"),
            F.col(count).alias("occurrences"),
            F.col(f"{count}_frauds").alias("fraud_count"),
        )
        for name, threshold, count in patterns
    ]
    rate = _percent(F.col("fraud_count"), F.col("occurrences"))
    return one.select(F.inline(F.array(*listed))).withColumns(
        {"fraud_rate_percent": F.round(rate, 2), "risk_level": _risk_level(rate)}
    )


def anomaly_summary(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    limit: float = 3,
    amounts: AmountFacts | None = None,
) -> DataFrame:
    """Rows more than ``limit`` deviations from the mean, on either side.

    The reported threshold is the upper one.
    """
    amounts = amounts or amount_facts(df, cols, limit)
    mean, sd = _mean_sd(amounts.pair())
    one = amounts.outliers.filter(F.col("z_score") > limit).agg(
        F.count(F.lit(1)).alias("total_anomalies"),
        F.count_if(F.col(cols.fraud) == 1).alias("fraudulent_anomalies"),
    )
    return one.select(
        F.lit(f"Z-Score > {limit:g}").alias("detection_method"),
        F.round(mean, 2).alias("mean_amount"),
        F.round(sd, 2).alias("std_amount"),
        F.round(mean + limit * sd, 2).alias("threshold_amount"),
        "total_anomalies",
        "fraudulent_anomalies",
        F.round(_percent(F.col("fraudulent_anomalies"), F.col("total_anomalies")), 2).alias(
            "anomaly_fraud_rate_percent"
        ),
    )


def top_anomalies(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    limit: float = 3,
    top: int = 10,
    amounts: AmountFacts | None = None,
) -> DataFrame:
    """The ``top`` rows farthest out, ties by id."""
    present(df, [cols.transaction_id])
    amounts = amounts or amount_facts(df, cols, limit)
    odd = amounts.outliers.filter(F.col("z_score") > limit)
    named = [c for c in (cols.category,) if c in df.columns]
    return (
        odd.select(cols.transaction_id, cols.amount, "z_score", cols.fraud, *named)
        .orderBy(F.desc("z_score"), cols.transaction_id)
        .limit(top)
    )


def anomaly_split(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, limit: float = 3) -> DataFrame:
    """Anomalies by kind, two rows."""
    one = anomaly_summary(df, cols, limit)
    legit = F.col("total_anomalies") - F.col("fraudulent_anomalies")
    return one.select(
        F.inline(
            F.array(
                F.struct(F.lit("Fraudulent").alias("kind"), F.col("fraudulent_anomalies").alias("n")),
                F.struct(F.lit("Legitimate").alias("kind"), legit.alias("n")),
            )
        )
    )


def _by_time(df: DataFrame, key: str, cols: TxnColumns) -> DataFrame:
    rows = _of(df, cols)
    present(rows, [key])
    counted = rows.groupBy(key).agg(_sum("rows").alias("total"), _sum("frauds").alias("fraud_count"))
    rate = _percent(F.col("fraud_count"), F.col("total"))
    return counted.withColumn("fraud_rate", F.round(rate, 2))


def fraud_by_hour(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    return _by_time(df, "hour", cols).orderBy("hour")


# Names of the day numbers (fixed values).
DAY_NAMES = {
    1: "Sunday",
    2: "Monday",
    3: "Tuesday",
    4: "Wednesday",
    5: "Thursday",
    6: "Friday",
    7: "Saturday",
}


def fraud_by_weekday(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """Per weekday, Sunday first; a NULL timestamp is its own group without a name."""
    names = F.create_map(*[F.lit(x) for pair in DAY_NAMES.items() for x in pair])
    made = _by_time(df, "day_of_week", cols)
    return made.withColumn("day", F.try_element_at(names, "day_of_week")).orderBy("day_of_week")


def peak_hours(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, top: int = 3) -> DataFrame:
    return fraud_by_hour(df, cols).orderBy(F.desc("fraud_rate"), "hour").limit(top)


def peak_days(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS, top: int = 2) -> DataFrame:
    return fraud_by_weekday(df, cols).orderBy(F.desc("fraud_rate"), "day_of_week").limit(top)


class _Facts:
    """Everything the sections are made from, each part made when first needed: three passes over ``df`` in all."""

    def __init__(self, df: DataFrame, cols: TxnColumns):
        self.df, self.cols = df, cols

    @cached_property
    def counts(self) -> DataFrame:
        return cube(self.df, self.cols)

    @cached_property
    def amounts(self) -> AmountFacts:
        return amount_facts(self.df, self.cols)


_SECTIONS: dict[str, Callable[[_Facts], DataFrame]] = {
    "executive_summary": lambda f: fraud_summary(f.counts, f.cols),
    "fraud_by_category": lambda f: fraud_by_category(f.counts, f.cols),
    "fraud_by_merchant": lambda f: risky_merchants(f.counts, f.cols),
    "high_risk_patterns": lambda f: risk_patterns(f.df, f.cols, f.amounts),
    "anomalies": lambda f: anomaly_summary(f.df, f.cols, amounts=f.amounts),
    "anomaly_examples": lambda f: top_anomalies(f.df, f.cols, amounts=f.amounts),
    "fraud_by_hour": lambda f: fraud_by_hour(f.counts, f.cols),
    "fraud_by_weekday": lambda f: fraud_by_weekday(f.counts, f.cols),
    "findings": lambda f: findings(f.df, f.cols, f.counts, f.amounts),
}


def report(df: DataFrame, cols: TxnColumns = DEFAULT_COLUMNS) -> dict[str, DataFrame]:
    """All analyses by section, with a ``summaries`` section of names and sentences.

    ``df`` is read three times, here: for the cube behind the counting sections, for mean and deviation, and for
    the rows far from the mean. All sections, findings and sentences come from these written tables.
    """
    facts = _Facts(df, cols)
    sections = {name: make(facts) for name, make in _SECTIONS.items()}
    return {**sections, "summaries": section_summaries(sections, cols)}


def _lines(df: DataFrame, section: str, rank: Column | int, text: Column) -> DataFrame:
    rank = rank if isinstance(rank, Column) else F.lit(rank)
    return df.select(
        F.lit(section).alias("section"), rank.cast("int").alias("rank"), text.alias("message")
    )


def _ranked(df: DataFrame, top: int, *order: Column | str) -> DataFrame:
    """A top-k frame (k rows at most) with its rank."""
    ordered = df.orderBy(*order).limit(top)
    packed = ordered.agg(F.collect_list(F.struct(*df.columns)).alias("rows"))
    return packed.select(F.posexplode("rows").alias("_at", "_row")).select("_at", "_row.*")


def findings(
    df: DataFrame,
    cols: TxnColumns = DEFAULT_COLUMNS,
    counts: DataFrame | None = None,
    amounts: AmountFacts | None = None,
) -> DataFrame:
    """What to act on, as rows (section, rank, message). ``counts`` and ``amounts`` are facts made earlier."""
    made: list[DataFrame] = []
    counts = cube(df, cols) if counts is None else counts
    amounts = amounts or amount_facts(df, cols)
    total = fraud_summary(counts, cols)
    rate, paid, legit = (
        F.col("fraud_rate_percent"),
        F.col("avg_fraud_transaction"),
        F.col("avg_legitimate_transaction"),
    )
    made.append(
        _lines(
            total.filter(rate > 1),
            "executive_summary",
            1,
            F.format_string("Fraud rate %.2f%% is above the 1%% threshold", rate),
        )
    )
    factor = F.format_string(", %.1fx the legitimate average", F.try_divide(paid, legit))
    times = F.when(legit > 0, factor).otherwise("")
    made.append(
        _lines(
            total.filter(paid > legit * 2),
            "executive_summary",
            2,
            F.concat(F.format_string("Average fraud is $%.2f", paid), times),
        )
    )
    rates = _rates(counts, cols.category, cols)
    mean = rates.agg(F.avg("fraud_rate_percent")).scalar()
    risky = rates.filter(F.col("fraud_rate_percent") > mean)
    made.append(
        _lines(
            _ranked(risky, 3, F.desc("fraud_rate_percent"), cols.category),
            "fraud_by_category",
            F.col("_at") + 1,
            F.format_string(
                "Category %s: %.2f%% fraud, $%.2f at risk",
                F.col(cols.category).cast("string"),
                "fraud_rate_percent",
                "fraud_amount",
            ),
        )
    )
    merchants = _ranked(
        risky_merchants(counts, cols), 5, F.desc("fraud_rate_percent"), cols.merchant
    ).filter(F.col("fraud_count") > 0)
    made.append(
        _lines(
            merchants,
            "fraud_by_merchant",
            F.col("_at") + 1,
            F.format_string(
                "Merchant %s: %d frauds (%.2f%%)",
                F.col(cols.merchant).cast("string"),
                "fraud_count",
                "fraud_rate_percent",
            ),
        )
    )
    patterns = risk_patterns(df, cols, amounts).filter(F.col("risk_level") != "LOW")
    order = F.when(F.col("pattern") == PATTERN_NAMES["high"], 1).when(
        F.col("pattern") == PATTERN_NAMES["low"], 2
    )
    made.append(
        _lines(
            patterns,
            "high_risk_patterns",
            order.otherwise(3),
            F.format_string(
                "%s: %.2f%% fraud, %s risk", "pattern", "fraud_rate_percent", "risk_level"
            ),
        )
    )
    odd_rate = F.col("anomaly_fraud_rate_percent")
    odd = anomaly_summary(df, cols, amounts=amounts).select(
        F.inline(
            F.array(
                F.struct(
                    F.lit(1).alias("rank"),
                    F.when(
                        odd_rate > 10,
                        F.format_string(
                            "%d anomalies are fraud (%.1f%%)", "fraudulent_anomalies", odd_rate
                        ),
                    ).alias("message"),
                ),
                F.struct(
                    F.lit(2).alias("rank"),
                    F.when(
                        F.col("total_anomalies") > 0,
                        F.format_string("Alert above $%.2f", "threshold_amount"),
                    ).alias("message"),
                ),
            )
        )
    )
    odd = odd.filter(F.col("message").isNotNull())
    made.append(_lines(odd, "anomalies", F.col("rank"), F.col("message")))
    hours = _ranked(fraud_by_hour(counts, cols), 3, F.desc("fraud_rate"), "hour").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "hour"))), lambda r: r["hour"]),
            ", ",
        ).alias("hours"),
        F.max("fraud_rate").alias("top"),
    )
    made.append(
        _lines(
            hours,
            "time_trends",
            1,
            F.format_string("Peak hours: %s (%.2f%% fraud)", "hours", F.coalesce("top", F.lit(0.0))),
        )
    )
    days = _ranked(fraud_by_weekday(counts, cols), 2, F.desc("fraud_rate"), "day_of_week").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "day"))), lambda r: r["day"]),
            ", ",
        ).alias("days")
    )
    made.append(_lines(days, "time_trends", 2, F.format_string("High-risk days: %s", "days")))
    return reduce(DataFrame.unionByName, made)


def section_summaries(sections: Mapping[str, DataFrame], cols: TxnColumns = DEFAULT_COLUMNS) -> DataFrame:
    """``section, name, summary``: one sentence for each section of a report, from the section itself."""

    def leading(key: str, rate: str) -> Column:
        first = F.min_by(F.col(key), F.struct(-F.col(rate), F.col(key))).cast("string")
        return F.coalesce(first, F.lit("N/A"))

    rows = F.count(F.lit(1))
    odd_rate = F.coalesce("anomaly_fraud_rate_percent", F.lit(0.0))
    asked = {
        "executive_summary": F.format_string(
            "Detected %,d fraudulent transactions (%.2f%%) totaling $%,.2f",
            "fraud_transactions",
            F.coalesce("fraud_rate_percent", F.lit(0.0)),
            F.coalesce("fraud_amount", F.lit(0.0)),
        ),
        "fraud_by_category": F.format_string(
            "Analyzed %d categories. Highest risk: %s", rows, leading(cols.category, "fraud_rate_percent")
        ),
        "fraud_by_merchant": F.format_string(
            "Identified %d merchants with fraud activity", F.count_if(F.col("fraud_count") > 0)
        ),
        "high_risk_patterns": F.format_string("Analyzed %d transaction patterns", rows),
        "anomalies": F.format_string(
            "Detected %,d statistical anomalies, %d are fraud (%.1f%%)",
            "total_anomalies",
            "fraudulent_anomalies",
            odd_rate,
        ),
        "fraud_by_hour": F.format_string("Peak fraud hour: %s:00", leading("hour", "fraud_rate")),
    }
    whole = ("executive_summary", "anomalies")  # already one row
    made = []
    for section, text in asked.items():
        frame = sections[section]
        one = frame.select(text.alias("summary")) if section in whole else frame.agg(text.alias("summary"))
        name = F.lit(SECTION_NAMES[section]).alias("name")
        made.append(one.select(F.lit(section).alias("section"), name, "summary"))
    return reduce(DataFrame.unionByName, made)


def write_report(sections: Mapping[str, DataFrame], path: str, mode: str = "overwrite") -> None:
    """Each section as its own JSON dataset under ``path``."""
    for name, frame in sections.items():
        frame.write.mode(mode).json(f"{path}/{name}")


def analysis(question: str, cols: TxnColumns = DEFAULT_COLUMNS) -> Step:
    """One section as a step for ``chain``: only what it needs is read."""
    if question == "summaries":
        return lambda df: report(df, cols)[question]
    return lambda df: _SECTIONS[question](_Facts(df, cols))
