"""The three input tables: column name to kind (see ``functions.coerce``)."""

from __future__ import annotations

# The declared columns and their order.
CUSTOMERS = {
    "customer_id": "string",
    "signup_date": "datetime",
    "country": "string",
    "plan": "string",
    "monthly_price": "money",
    "segment": "string",
    "first_source": "string",
}

SUBSCRIPTIONS = {
    "subscription_id": "string",
    "customer_id": "string",
    "period_start": "datetime",
    "period_end": "datetime",
    "revenue": "money",
    "is_renewal": "bool",
    "churn_flag": "int",
    "active": "bool",
    "num_logins": "int",
    "feature_x_usage": "float",
}

TRANSACTIONS = {
    "transaction_id": "string",
    "customer_id": "string",
    "amount": "money",
    "transaction_date": "datetime",
    "payment_method": "string",
}

SCHEMAS = {"customers": CUSTOMERS, "subscriptions": SUBSCRIPTIONS, "transactions": TRANSACTIONS}
