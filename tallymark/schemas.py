"""Table schemas. A null means "not printed"; a null ``lineItems`` means "not annotated", unlike an empty array."""

from __future__ import annotations

from pyspark.sql import types as T

AMOUNT = T.DecimalType(28, 6)


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields.items()])


_S, _D, _L, _B = T.StringType(), T.DoubleType(), T.LongType(), T.BooleanType()

ADDRESS = _struct(street=_S, city=_S, region=_S, postalCode=_S, country=_S)
PARTY = _struct(name=_S, address=ADDRESS)
LINE_ITEM = _struct(description=_S, quantity=AMOUNT, unitPrice=AMOUNT, amount=AMOUNT)
INVOICE = _struct(
    vendor=PARTY, customer=PARTY, invoiceNumber=_S, invoiceDate=T.DateType(), dueDate=T.DateType(), currency=_S,
    subtotal=AMOUNT, discount=AMOUNT, tax=AMOUNT, total=AMOUNT, lineItems=T.ArrayType(LINE_ITEM),
)
GOLDEN = _struct(
    id=_S, source=_S, layout=_S, documentPath=_S, textPath=_S, ocrTextPath=_S, expected=INVOICE,
)
SPAN = _struct(text=_S, bbox=T.ArrayType(T.ArrayType(_D)))
RUN_CONFIG = _struct(
    name=_S, model=_S, prompt=_S, inputMode=_S, temperature=_D, disableThinking=_B, extractor=_S,
)
PAIR = _struct(
    id=_S, field=_S, doc_id=_S, golden=_S, predicted=_S, excerpt=_S, origin=_S, human_label=_B,
)
CELL = _struct(config=_S, subset=_S, metric=_S, value=_D)

# One stored result per (execution, config, document), as the run wrote it.
STORED_RESULT = T.StructType([
    T.StructField("execution", _S), T.StructField("config", _S), T.StructField("scenario", _S),
    T.StructField("tags", T.ArrayType(_S)),
    T.StructField("metrics", T.ArrayType(T.StructType([
        T.StructField("name", _S), T.StructField("numeric", _B), T.StructField("value", _D),
        T.StructField("outcome", _S),
        T.StructField("diagnostics", T.ArrayType(T.StructType([
            T.StructField("severity", _S), T.StructField("message", _S)]))),
    ]))),
    T.StructField("stamped_latency_ms", _D), T.StructField("turn_latency_ms", _D), T.StructField("cache_hit", _B),
    T.StructField("input_tokens", _L), T.StructField("output_tokens", _L), T.StructField("thinking_tokens", _L),
    T.StructField("response_text", _S),
])

# The ten scored fields and where each sits in an invoice.
FIELD_PATHS = {
    "invoice_number": ("invoiceNumber",),
    "invoice_date": ("invoiceDate",),
    "due_date": ("dueDate",),
    "currency": ("currency",),
    "subtotal": ("subtotal",),
    "discount": ("discount",),
    "tax": ("tax",),
    "total": ("total",),
    "vendor_name": ("vendor", "name"),
    "customer_name": ("customer", "name"),
}
FIELDS = tuple(FIELD_PATHS)
JUDGED_FIELDS = ("vendor_name", "customer_name")
AMOUNT_FIELDS = ("subtotal", "discount", "tax", "total")
DATE_FIELDS = ("invoice_date", "due_date")
NAME_FIELDS = JUDGED_FIELDS

# Summary column name -> per-document agent metric.
AGENT_METRICS = {
    "tool_call_count_mean": "tool_call_count",
    "validate_totals_called_rate": "validate_totals_called",
    "normalize_currency_called_rate_symbol": "normalize_currency_called_symbol",
    "normalize_currency_called_rate_code": "normalize_currency_called_code",
    "tool_override_rate": "tool_override",
    "warning_precision": "totals_warning_correct",
    "tool_call_accuracy": "tool_call_accuracy",
    "task_adherence": "task_adherence",
}
