"""Fixed vocabularies and thresholds.

These are fixed values: results only match when the lists are exactly these.
Each stage has its own list on purpose (see README, "Semantics kept apart").
"""

# Text that stands for "missing", per stage.
SCHEMA_NULLS = ("", "na", "n/a", "nan", "none", "null", "nil", "missing", "unknown", "-", "--")
CLEANING_NULLS = ("", "na", "n/a", "nan", "none", "null", "nil", "missing", "unknown", "?", "-", "--")
REPORT_NULLS = ("", "na", "n/a", "nan", "none", "null", "nil", "missing", "unknown", "?", "-")

# Boolean words, per stage.
SCHEMA_TRUE = ("true", "yes", "y", "1", "on", "active", "enabled")
SCHEMA_FALSE = ("false", "no", "n", "0", "off", "inactive", "disabled")
CLEANING_TRUE = ("true", "yes", "y", "1", "t")
CLEANING_FALSE = ("false", "no", "n", "0", "f")
VALID_BOOLEANS = ("true", "false", "yes", "no", "y", "n", "1", "0", "t", "f")

# Words in column names.
IDENTIFIER_NUMBER_NAMES = (
    "customer_number", "account_number", "invoice_number",
    "order_number", "transaction_number", "employee_number",
)
SERIAL_WORDS = ("number", "code", "key", "serial")
DATE_WORDS = (
    "date", "time", "timestamp", "datetime", "created", "updated", "modified", "joined",
    "registered", "birth", "dob", "order_date", "transaction_date",
)
DATE_SUBSTRINGS = ("date", "timestamp", "datetime", "created_at", "updated_at", "birth")
TEXT_WORDS = (
    "description", "comment", "comments", "review", "message", "notes", "note",
    "address", "summary", "feedback", "text",
)
NON_NEGATIVE_WORDS = (
    "age", "quantity", "qty", "price", "cost", "salary", "revenue", "sales", "income", "units",
    "count", "distance", "duration", "height", "weight", "rating", "radius", "speed",
)
SIGNED_WORDS = (
    "profit", "loss", "balance", "change", "difference", "delta", "return", "adjustment",
    "variance", "growth", "margin", "cashflow", "cash_flow",
)

# Semantic type names and the aliases callers may use for them.
TYPE_ALIASES = {
    "Numerical": ("numerical", "numeric", "number", "integer", "float", "continuous", "discrete"),
    "Categorical": ("categorical", "category"),
    "Boolean": ("boolean", "bool"),
    "Identifier": ("identifier", "id"),
    "Datetime": ("datetime", "date", "timestamp"),
    "Text": ("text", "string"),
    "Empty": ("empty",),
}
SEMANTIC_TYPES = ("Identifier", "Boolean", "Datetime", "Numerical", "Categorical", "Text", "Empty")

# Weights of the five quality components.
QUALITY_WEIGHTS = {
    "completeness": 0.30,
    "uniqueness": 0.15,
    "validity": 0.20,
    "consistency": 0.15,
    "anomaly_quality": 0.20,
}

# Characters a trim removes, and the words a read-only query may not contain.
WHITESPACE = " \t\n\r\f\v"
FORBIDDEN_SQL_WORDS = (
    "insert", "update", "delete", "drop", "alter", "create", "replace", "truncate", "attach",
    "detach", "copy", "export", "import", "install", "load", "call", "pragma",
)
