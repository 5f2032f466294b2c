"""Limits, words and points that results depend on. Data only, no logic."""

# Amount scales: (exclusive upper limit, name) pairs, then the name above the last limit.
BAND_BASIC = (((50, "small"), (200, "medium"), (1000, "large")), "high_value")
BAND_ETL = (((50, "micro"), (100, "small"), (500, "medium"), (1000, "large")), "premium")
BAND_FEATURE = (((10, "micro"), (50, "small"), (200, "medium"), (500, "large")), "very_large")
BAND_SCORED = (
    ((50, "micro"), (100, "small"), (500, "medium"), (1000, "large"), (5000, "very_large")),
    "premium",
)
BAND_DISTANCE_KM = (
    ((5, "local"), (25, "nearby"), (100, "regional"), (500, "distant")),
    "very_distant",
)

# Merchant category to spending group; anything else is "other".
CATEGORY_GROUPS = {
    "grocery": "essentials",
    "gas_station": "essentials",
    "utilities": "essentials",
    "healthcare": "essentials",
    "restaurant": "dining",
    "entertainment": "leisure",
    "travel": "leisure",
    "online_shopping": "shopping",
    "electronics": "shopping",
    "clothing": "shopping",
    "subscription": "recurring",
    "cash_withdrawal": "cash",
}

# Risk score points.
RISK_AMOUNT_POINTS = ((5000, 30), (1000, 15), (500, 5))
RISK_DEVICE_POINTS = {"mobile": 5, "desktop": 3, "pos_terminal": 1}
RISK_DEVICE_OTHER = 10
RISK_TYPE_POINTS = {"purchase": 1, "transfer": 10, "payment": 3, "refund": 5}
RISK_TYPE_OTHER = 5
RISK_KNOWN_FRAUD = 50

# Hour-of-day words: (first hour, hour after the last, name); other hours are "night".
DAY_PARTS = ((6, 12, "morning"), (12, 17, "afternoon"), (17, 21, "evening"))

EARTH_RADIUS_KM = 6371

# Synthetic transactions: amount range per category, and the other value domains.
CATEGORY_AMOUNTS = {
    "grocery": (10, 200),
    "gas_station": (20, 80),
    "restaurant": (15, 150),
    "online_shopping": (20, 500),
    "electronics": (50, 2000),
    "travel": (100, 5000),
    "entertainment": (10, 200),
    "healthcare": (20, 500),
    "utilities": (50, 300),
    "clothing": (30, 400),
    "subscription": (5, 50),
    "cash_withdrawal": (20, 500),
}
TRANSACTION_TYPES = ("purchase", "refund", "transfer", "payment")
CITIES = (
    "New York",
    "Los Angeles",
    "Chicago",
    "Houston",
    "Phoenix",
    "Philadelphia",
    "San Antonio",
    "San Diego",
    "Dallas",
    "San Jose",
)
CARD_TYPES = ("credit", "debit")
DEVICE_TYPES = ("mobile", "desktop", "pos_terminal")

# Feature names, by family.
FEATURE_FAMILIES = {
    "time_features": (
        "hour",
        "day_of_week",
        "day_of_month",
        "month",
        "is_weekend",
        "is_night",
        "is_business_hours",
    ),
    "amount_features": (
        "amount_zscore",
        "amount_bucket",
        "log_amount",
        "is_round_amount",
        "customer_avg_amount",
        "customer_std_amount",
        "amount_vs_customer_avg",
    ),
    "velocity_features": (
        "customer_txn_count",
        "customer_total_amount",
        "txn_number",
        "seconds_since_last_txn",
        "is_rapid_txn",
    ),
    "merchant_features": (
        "merchant_txn_count",
        "merchant_fraud_rate",
        "merchant_avg_amount",
        "merchant_risk_tier",
        "amount_vs_merchant_avg",
    ),
}

# Classifier inputs (the amount column is named by the caller's TxnColumns).
MODEL_NUMERIC = (
    "log_amount",
    "amount_zscore",
    "hour",
    "day_of_week",
    "is_weekend",
    "is_night",
    "customer_avg_amount",
    "customer_txn_count",
    "merchant_fraud_rate",
    "transaction_distance_km",
)
SEGMENT_INPUTS = ("txn_count", "avg_amount", "max_amount", "unique_merchants")

# Names of the report's sections (fixed values).
SECTION_NAMES = {
    "executive_summary": "Executive Summary",
    "fraud_by_category": "Fraud by Category",
    "fraud_by_merchant": "Top 20 High-Risk Merchants",
    "high_risk_patterns": "High-Risk Transaction Patterns",
    "anomalies": "Anomaly Detection",
    "fraud_by_hour": "Time-Based Fraud Trends",
}

# Titles of the amount patterns (fixed values).
PATTERN_NAMES = {
    "high": "High-Value Transactions",
    "low": "Low-Value Transactions (Card Testing)",
    "round": "Round Amount Transactions",
}
