"""Table schemas and the values that results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

RAW_INVOICE = T.StructType([
    T.StructField("business_code", T.StringType()),
    T.StructField("cust_number", T.StringType()),
    T.StructField("name_customer", T.StringType()),
    T.StructField("clear_date", T.StringType()),
    T.StructField("buisness_year", T.DoubleType()),
    T.StructField("doc_id", T.DoubleType()),
    T.StructField("posting_date", T.StringType()),
    T.StructField("document_create_date", T.StringType()),
    T.StructField("document_create_date.1", T.StringType()),
    T.StructField("due_in_date", T.DoubleType()),
    T.StructField("invoice_currency", T.StringType()),
    T.StructField("document type", T.StringType()),
    T.StructField("posting_id", T.DoubleType()),
    T.StructField("area_business", T.StringType()),
    T.StructField("total_open_amount", T.DoubleType()),
    T.StructField("baseline_create_date", T.DoubleType()),
    T.StructField("cust_payment_terms", T.StringType()),
    T.StructField("invoice_id", T.DoubleType()),
    T.StructField("isOpen", T.IntegerType()),
])

CLEAN_INVOICE = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("cust_number", T.StringType()),
    T.StructField("business_year", T.LongType()),
    T.StructField("due_in_date", T.DateType()),
    T.StructField("invoice_currency", T.StringType()),
    T.StructField("document_type", T.StringType()),
    T.StructField("total_open_amount", T.DoubleType()),
    T.StructField("invoice_sent", T.DateType()),
    T.StructField("cust_payment_terms", T.StringType()),
    T.StructField("invoice_paid", T.DateType()),
])

SCRIPT_OUTPUT = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("stage", T.StringType()),
    T.StructField("tone", T.StringType()),
    T.StructField("priority", T.StringType()),
    T.StructField("subject", T.StringType()),
    T.StructField("email_body", T.StringType()),
    T.StructField("reasoning", T.StringType()),
    T.StructField("playbook_reference", T.StringType()),
])

# ---------------------------------------------------------------------------
# Results depend on them, so they are stated as they are.
# ---------------------------------------------------------------------------

# Columns kept by cleaning, with their new names.
CLEAN_COLUMNS = {
    "doc_id": "doc_id",
    "cust_number": "cust_number",
    "buisness_year": "business_year",
    "due_in_date": "due_in_date",
    "invoice_currency": "invoice_currency",
    "document type": "document_type",
    "total_open_amount": "total_open_amount",
    "baseline_create_date": "invoice_sent",
    "cust_payment_terms": "cust_payment_terms",
    "clear_date": "invoice_paid",
}

# CAD to USD by business year: cleaning rates (other years 0.75) and lookup-table rates.
CAD_TO_USD = {2018: 0.771, 2019: 0.754, 2020: 0.745}
CAD_TO_USD_DEFAULT = 0.75
CAD_USD_LOOKUP = {2018: 0.772, 2019: 0.754, 2020: 0.746, 2021: 0.798}

# Model features, and the columns that never reach the model.
MODEL_FEATURES = [
    "invoice_age_days", "days_until_due", "pay_terms_days", "customer_avg_delay",
    "days_since_last_invoice", "invoice_amount_log", "invoice_month_sin",
]
NON_FEATURES = [
    "doc_id", "cust_number", "due_in_date", "invoice_sent", "total_open_amount", "open_amount",
    "reference_date", "week_bucket", "days_to_payment", "invoice_paid", "cust_payment_terms",
]

# Amount sizes, forecast weeks, sharpening temperature.
SIZE_EDGES = (10000.0, 100000.0)
SIZE_LABELS = ("small", "medium", "large")
SIZE_QUANTILES = (0.33, 0.66)
N_CLASSES = 7
FORECAST_WEEKS = (1, 2, 3, 4, 5, 6)
TEMPERATURE = 0.8
BACKTEST_PERCENTILES = (0.4, 0.5, 0.6, 0.7, 0.8)

# Risk labels and scores of the collections queue.
RISK_SCORE = {"Critical": 6, "Very High": 5, "High": 4, "Medium": 3, "Low": 2, "Very Low": 1}
BUCKET_LABEL = {6: "Critical", 5: "Very High", 4: "High", 3: "Medium", 2: "Low", 1: "Very Low"}

# Business segments by customer number; all others are 'Other'.
BUSINESS_SEGMENTS = {
    "200769623": "Mass Retail",
    "200980828": "Foodservice Distribution",
    "200792734": "Healthcare Distribution",
    "140106181": "Retail (Canada)",
    "200762301": "Wholesale Grocery",
    "200743129": "Retail Grocery",
    "200186937": "Foodservice Distribution",
    "200721222": "Technology",
    "200794332": "Warehouse Retail",
    "200881076": "Retail Grocery",
    "100053554": "IT Services",
    "200783734": "Retail Grocery",
}

# Probability tilts compared on the validation part, in class order 1..7.
BIAS_GRID = {
    "neutral": [1.00, 1.00, 1.00, 1.00, 1.00, 1.00, 1.00],
    "early_small": [1.05, 1.03, 1.02, 1.00, 0.98, 0.96, 1.00],
    "early_medium": [1.10, 1.06, 1.03, 1.00, 0.96, 0.92, 1.00],
    "late_small": [0.96, 0.98, 1.00, 1.02, 1.04, 1.06, 1.00],
    "deemphasize_outside": [1.02, 1.02, 1.01, 1.00, 0.99, 0.98, 0.95],
    "slight_early_and_less_outside": [1.05, 1.03, 1.01, 1.00, 0.98, 0.97, 0.95],
}

# Weights of the three ensemble members.
WEIGHT_GRID = [
    (1, 1, 1), (2, 1, 1), (3, 1, 1), (4, 1, 1), (5, 1, 1),
    (3, 2, 1), (3, 1, 2), (2, 1, 0), (2, 0, 1),
]

# Allowed values and required keys of a collections script, in the order of the checks.
SCRIPT_ACTIONS = ["send_email", "no_action", "manual_review"]
SCRIPT_STAGES = [
    "stage_1_friendly", "stage_2_final_reminder", "stage_3_due_today", "stage_4_first_overdue",
    "stage_5_second_overdue", "stage_6_escalation", "stage_7_final_notice", "none",
]
SCRIPT_TONES = ["friendly", "neutral", "firm"]
SCRIPT_PRIORITIES = ["low", "medium", "high"]
SCRIPT_KEYS = [
    "action", "stage", "tone", "priority", "subject", "email_body", "reasoning", "playbook_reference",
]

# Fields a script request must have; the mask that stands for the customer's name.
REQUEST_FIELDS = [
    "doc_id", "name_customer", "cust_number", "total_open_amount", "due_in_date", "days_past_due",
]
NAME_MASK = "CUSTOMER_NAME"
