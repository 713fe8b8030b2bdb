"""Explicit schemas of the tables and records."""

from __future__ import annotations

from pyspark.sql import types as T

MONEY = T.DecimalType(12, 2)


def _struct(spec: dict[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in spec.items()])


_S, _I, _L, _D, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampNTZType()

CUSTOMER_PROFILE = _struct(
    dict.fromkeys(
        [
            "customer_id", "first_name", "last_name", "email", "phone_number", "national_id",
            "date_of_birth", "shipping_address", "billing_address",
        ],
        _S,
    )
)

ORDER_LEDGER = _struct(
    {
        "order_id": _S, "transaction_id": _S, "customer_id": _S, "order_date": _S,
        "product_sku": _S, "product_name": _S, "category": _S, "quantity": _I,
        "price_per_unit": MONEY, "total_amount": MONEY, "payment_method": _S,
        "credit_card_number": _S, "device_ip_address": _S, "order_status": _S,
    }
)

PROMPT_LOG = _struct({"conv_id": _L, "turn": _L, "role": _S, "text": _S})

DOCUMENTS = _struct({"doc_id": _L, "text": _S, "lang": _S, "source": _S, "n_chars": _L})

GATE_RESULT = _struct(
    {
        "gate": _S, "passed": T.BooleanType(), "blocked": T.BooleanType(), "error": _S,
        "details": T.MapType(_S, _S),
    }
)

ENGINE_RESULT = _struct(
    {
        "path": _S, "response_text": _S, "is_blocked": T.BooleanType(),
        "annotations": T.ArrayType(_S), "guardrail_action": _S,
        "sensitive_detected": T.BooleanType(), "error": _S,
    }
)

PRESET = _struct(
    {
        "id": _S, "label": _S, "emoji": _S, "category": _S, "prompt_text": _S,
        "is_analytics": T.BooleanType(),
    }
)

RETRIEVAL_CONTENT = _struct(
    {
        "row": T.ArrayType(_struct({"columnName": _S, "columnValue": _S})),
        "text": _S,
    }
)
