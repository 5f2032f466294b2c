"""Checks, rules and profiles."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from catalog.base import big, holes, query, table, txn
from swipelake.operators import quality as dq
from swipelake.scratch import written


def _check(name, column, bad, limit, source):
    return f"""SELECT '{name}' AS "check", '{column}' AS column_name, {bad}::BIGINT AS failed_rows, count(*) AS total_rows,
 round({bad}::DOUBLE / count(*), 4) AS ratio, {limit}::DOUBLE AS threshold, {bad}::DOUBLE / count(*) <= {limit} AS passed FROM {source}"""


_NULLS = " UNION ALL ".join(
    _check("nulls", c, f"count(*) FILTER ({c} IS NULL)", 0.1, "holes")
    for c in ("amount", "category", "merchant_id")
)
_RANGE = " UNION ALL ".join(
    [
        _check("range", "amount", "count(*) FILTER (amount < 1 OR amount > 200)", 0, "holes"),
        _check("range", "merchant_id", "count(*) FILTER (merchant_id < 0 OR merchant_id > 1000)", 0, "holes"),
    ]
)


def _duplicates(source):
    return f"""SELECT 'duplicates' AS "check", 'l_orderkey,l_linenumber' AS column_name, (sum(n) - count(*))::BIGINT AS failed_rows,
 sum(n)::BIGINT AS total_rows, round((sum(n) - count(*))::DOUBLE / sum(n), 4) AS ratio, 0.01::DOUBLE AS threshold,
 (sum(n) - count(*))::DOUBLE / sum(n) <= 0.01 AS passed
FROM (SELECT count(*) AS n FROM {source} GROUP BY l_orderkey, l_linenumber)"""


_NULL_CHECK = dq.NullCheck(("amount", "category", "merchant_id"), 0.1)
_RANGE_CHECK = dq.RangeCheck({"amount": (1, 200), "merchant_id": (0, 1000)})


@query("dq_nulls", _NULLS)
def dq_nulls(spark, folder):
    return dq.run_checks(holes(spark, folder), _NULL_CHECK)


@query("dq_range", _RANGE)
def dq_range(spark, folder):
    return dq.run_checks(holes(spark, folder), _RANGE_CHECK)


@query("dq_duplicates", _duplicates("lineitem"))
def dq_duplicates(spark, folder):
    df = table(spark, folder, "lineitem")
    return dq.run_checks(df, dq.DuplicateCheck(("l_orderkey", "l_linenumber")))


@query(
    "dq_suite",
    " UNION ALL ".join(
        [
            _check("nulls", "l_quantity", "count(*) FILTER (l_quantity IS NULL)", 0.05, "lineitem"),
            _check("range", "l_discount", "count(*) FILTER (l_discount < 0 OR l_discount > 0.05)", 0, "lineitem"),
            _duplicates("lineitem"),
        ]
    ),
)
def dq_suite(spark, folder):
    return dq.run_checks(
        table(spark, folder, "lineitem"),
        dq.NullCheck(("l_quantity",)),
        dq.RangeCheck({"l_discount": (0, 0.05)}),
        dq.DuplicateCheck(("l_orderkey", "l_linenumber")),
    )


@query("dq_all_passed", f"SELECT bool_and(passed) AS all_passed FROM ({_NULLS} UNION ALL {_RANGE})")
def dq_all_passed(spark, folder):
    return dq.all_passed(dq.run_checks(holes(spark, folder), _NULL_CHECK, _RANGE_CHECK))


@query(
    "dq_schema",
    """
SELECT * FROM (VALUES ('missing', 'o_email', false), ('extra', 'o_orderstatus', true), ('extra', 'o_totalprice', true),
  ('extra', 'o_orderdate', true), ('extra', 'o_orderpriority', true), ('type', 'o_custkey', false))
  AS v(problem, column_name, passed), (SELECT count(*) AS table_rows FROM orders)
""",
)
def dq_schema(spark, folder):
    """The schema problems of a table, each with the table's row count."""
    df = table(spark, folder, "orders")
    expected = T.StructType.fromDDL("o_orderkey BIGINT, o_custkey STRING, o_email STRING")
    rows = df.agg(F.count(F.lit(1))).scalar()
    return dq.check_schema(df, expected, types=True).withColumn("table_rows", rows)


def _rule(name, failed, severity="error", source="holes"):
    return f"""SELECT '{name}' AS rule, '{severity}' AS severity, {failed}::BIGINT AS failed_count, count(*) AS total_count,
 (count(*) - {failed})::DOUBLE / count(*) AS pass_rate, {failed} = 0 AS passed FROM {source}"""


_RULES = {
    "rule_not_null": (
        dq.not_null("amount"),
        _rule("not_null_amount", "count(*) FILTER (amount IS NULL)"),
    ),
    "rule_positive": (
        dq.positive("amount"),
        _rule("positive_amount", "count(*) FILTER (amount <= 0)"),
    ),
    "rule_range": (
        dq.in_range("amount", 1, 200),
        _rule("range_amount", "count(*) FILTER (amount < 1 OR amount > 200)"),
    ),
    "rule_unique": (
        dq.unique("customer_id", "category"),
        _rule(
            "unique_customer_id_category",
            "(SELECT count(*) FROM (SELECT 1 FROM holes GROUP BY customer_id, category HAVING count(*) > 1))",
        ),
    ),
    "rule_custom": (
        dq.Rule("cheap_errors", lambda df: df.filter("category = 'error' AND amount < 2"), "warning"),
        _rule(
            "cheap_errors",
            "count(*) FILTER (category = 'error' AND amount < 2)",
            "warning",
        ),
    ),
}


def _register_rule(name, rule, sql):
    @query(name, sql)
    def run(spark, folder):
        return dq.run_rules(holes(spark, folder), rule)


for _name, (_made, _sql) in _RULES.items():
    _register_rule(_name, _made, _sql)


@query("rules_run", " UNION ALL ".join(sql for _, sql in _RULES.values()))
def rules_run(spark, folder):
    return dq.run_rules(holes(spark, folder), *[rule for rule, _ in _RULES.values()])


@query(
    "rules_summary",
    f"""SELECT count(*) AS total_rules, count(*) FILTER (passed) AS passed_rules, count(*) FILTER (NOT passed) AS failed_rules
FROM ({' UNION ALL '.join(sql for _, sql in _RULES.values())})""",
)
def rules_summary(spark, folder):
    results = dq.run_rules(holes(spark, folder), *[rule for rule, _ in _RULES.values()])
    return dq.rules_summary(results)


@query(
    "profile_summary",
    "SELECT count(*) AS row_count, 6::BIGINT AS column_count,"
    " 'transaction_id,customer_id,no_ts,amount,category,merchant_id' AS columns FROM holes",
)
def profile_summary(spark, folder):
    return big(dq.profile_summary(holes(spark, folder)))


def _number(name, kind):
    return f"""SELECT '{name}' AS column_name, '{kind}' AS dtype, min({name})::DOUBLE AS min, max({name})::DOUBLE AS max,
 round(avg({name}), 2) AS avg, round(stddev({name}), 2) AS stddev, NULL::BIGINT AS distinct_count FROM lineitem"""


def _words(name):
    return f"""SELECT '{name}', 'string', NULL, NULL, NULL, NULL,
 (SELECT count(*) FROM (SELECT DISTINCT {name} FROM lineitem)) FROM lineitem LIMIT 1"""


@query(
    "profile_columns",
    " UNION ALL ".join(
        [
            _number("l_orderkey", "bigint"),
            _number("l_partkey", "bigint"),
            _number("l_suppkey", "bigint"),
            _number("l_linenumber", "int"),
            _number("l_quantity", "double"),
            _number("l_extendedprice", "double"),
            _number("l_discount", "double"),
            _number("l_tax", "double"),
            f"({_words('l_returnflag')})",
            f"({_words('l_linestatus')})",
        ]
    ),
)
def profile_columns(spark, folder):
    return dq.profile_columns(table(spark, folder, "lineitem"))


@query(
    "profile_nulls",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER ({c} IS NULL) AS null_count,"
        f" round(count(*) FILTER ({c} IS NULL)::DOUBLE / count(*), 4) AS null_ratio FROM holes"
        for c in ("transaction_id", "customer_id", "no_ts", "amount", "category", "merchant_id")
    ),
)
def profile_nulls(spark, folder):
    return dq.profile_nulls(holes(spark, folder))


@query("require", "SELECT customer_id, count(*) AS n FROM txn GROUP BY customer_id")
def require(spark, folder):
    df = dq.require(txn(spark, folder), 1, ["amount"], ["transaction_id", "customer_id"])
    return df.groupBy("customer_id").agg(F.count(F.lit(1)).alias("n"))


_MOMENTS = """SELECT '{c}' AS column_name, min({c})::DOUBLE AS min, max({c})::DOUBLE AS max, round(avg({c}), 2) AS avg,
  round(stddev({c}), 2) AS stddev, NULL::BIGINT AS exact, NULL::BOOLEAN AS near FROM holes"""


@query(
    "profile_incremental",
    " UNION ALL ".join(_MOMENTS.format(c=c) for c in ("transaction_id", "customer_id", "amount", "merchant_id"))
    + """
UNION ALL SELECT 'category', NULL, NULL, NULL, NULL, count(DISTINCT category) + max(CASE WHEN category IS NULL THEN 1 ELSE 0 END), true FROM holes
UNION ALL SELECT 'customer', NULL, NULL, NULL, NULL, count(DISTINCT customer_id), true FROM txn""",
)
def profile_incremental(spark, folder):
    """States of each month stored apart and joined: the profile of all rows without reading these again.

    ``near`` tells whether the joined sketches are within three standard errors of the exact distinct count.
    """
    rows = holes(spark, folder).withColumn("customer", F.col("customer_id").cast("string"))
    month = txn(spark, folder).select("transaction_id", F.date_format("txn_ts", "yyyy-MM").alias("month"))
    states = written(dq.profile_states(rows.drop("no_ts").join(month, "transaction_id"), "month"), "states")
    made = dq.merged_profile(states)
    exact = dq.profile_columns(rows.select("category", "customer")).select(
        F.col("column_name").alias("of"), F.col("distinct_count").alias("exact")
    )
    near = F.abs(F.col("distinct_count") - F.col("exact")) <= 3 * 1.04 / 64 * F.col("exact") + 0.5
    joined = made.join(F.broadcast(exact), F.col("column_name") == F.col("of"), "left")
    return joined.select("column_name", "min", "max", "avg", "stddev", "exact", near.alias("near"))
