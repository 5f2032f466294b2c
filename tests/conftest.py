import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[8]")
        .appName("swipelake-tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "6g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sample(spark):
    """Five transactions with hand-known answers."""
    rows = [
        ("TXN_001", "CUST_001", "MERCH_001", "grocery", 45.50, "2023-06-15 14:30:00", 0),
        ("TXN_002", "CUST_001", "MERCH_002", "restaurant", 125.00, "2023-06-16 19:45:00", 0),
        ("TXN_003", "CUST_002", "MERCH_001", "electronics", 599.99, "2023-06-15 10:00:00", 0),
        ("TXN_004", "CUST_002", "MERCH_003", "gas_station", 35.00, "2023-06-17 08:00:00", 0),
        ("TXN_005", "CUST_003", "MERCH_002", "online_shopping", 1500.00, "2023-06-15 23:30:00", 1),
    ]
    return spark.createDataFrame(
        rows,
        "transaction_id string, customer_id string, merchant_id string, "
        "merchant_category string, amount double, transaction_time string, is_fraud bigint",
    )
