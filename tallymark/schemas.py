"""Record shapes, enumerations and defaults.

Every reader uses one of these schemas; nothing is inferred from data.
"""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values (must be equal to the contract the messages follow) -------

SOURCES = ("LEDGER", "RAILS", "EXCHANGES", "ONCHAIN", "CUSTODY")
BREAK_TYPES = ("AMOUNT_MISMATCH", "TIMING_GAP", "MISSING_ENTRY", "DUPLICATE")
CLASSIFICATIONS = ("TIMING", "REAL")
BREAK_STATUSES = ("OPEN", "RESOLVED", "ESCALATED", "CLOSED")
RESOLUTION_TYPES = ("MANUAL", "AUTO")
STRATEGIES = ("EXACT", "FUZZY", "BALANCE_ROLLFORWARD")
RUN_STATUSES = ("RUNNING", "COMPLETED", "FAILED")

SOURCE_TOPICS = {
    "LEDGER": "ledger.events.v1",
    "RAILS": "rail.events.v1",
    "EXCHANGES": "exchange.events.v1",
    "ONCHAIN": "blockchain.events.v1",
    "CUSTODY": "custody.events.v1",
    "LIQUIDITY": "liquidity.fills",
    "FRAUD": "fraud.scored",
    "PAYMENT": "payment.events.v1",
}
ALERT_TOPIC = "break-alert"
AUDIT_TOPIC = "audit.v1"
DEAD_LETTER_TOPIC = "recon-dlq"

DEFAULT_STRATEGY = "EXACT"
DEFAULT_TOLERANCE_SECONDS = 300
DEFAULT_ESCALATION_MINUTES = 60
DEFAULT_AUTO_RESOLVE = True
DEFAULT_LIST_LIMIT = 1000

# --- Types -------------------------------------------------------------------

# Amounts keep 18 decimals while they are compared (on-chain units) and are
# rounded to 8 only when a break is stored.
MATCH_MONEY = T.DecimalType(38, 18)
STORED_MONEY = T.DecimalType(28, 8)
REPORT_MONEY = T.DecimalType(38, 8)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, dtype, True) for name, dtype in fields])


_text, _long, _time = T.StringType(), T.LongType(), T.TimestampType()

# `ord` is the arrival position: a BIGINT, unique on its side. Pairing rules
# ("the earliest unused one wins") are defined on it.
LEDGER = _struct(
    ("ord", _long),
    ("reference", _text),
    ("asset", _text),
    ("amount", MATCH_MONEY),
    ("counterparty", _text),
    ("ts", _time),
)

EXTERNAL = _struct(
    ("ord", _long),
    ("external_event_id", _text),
    ("source", _text),
    ("asset", _text),
    ("reference", _text),
    ("amount", MATCH_MONEY),
    ("counterparty", _text),
    ("ts", _time),
)

POSTING_ENTRY = _struct(
    ("entry_id", _text),
    ("account_id", _text),
    ("direction", _text),
    ("amount", _text),
    ("asset", _text),
    ("created_at", _text),
)

POSTING = _struct(
    ("posting_id", _text),
    ("ref_tx_id", _text),
    ("created_at", _text),
    ("entries", T.ArrayType(POSTING_ENTRY)),
)

ACCOUNT_ITEM = _struct(
    ("entry_id", _text),
    ("posting_id", _text),
    ("account_id", _text),
    ("direction", _text),
    ("amount", _text),
    ("asset", _text),
    ("created_at", _text),
)

ACCOUNT_PAGE = _struct(
    ("account_id", _text),
    ("entries", T.ArrayType(ACCOUNT_ITEM)),
    ("next_cursor", _text),
    ("final_balance", _text),
)

# Row shape of a Kafka source after casting key and value to text.
MESSAGE = _struct(
    ("topic", _text),
    ("partition", T.IntegerType()),
    ("offset", _long),
    ("key", _text),
    ("value", _text),
)

# Fields read from a payload; other fields stay in the stored text. All are
# taken as text, so a value of another type never spoils the rest.
PAYLOAD = _struct(
    ("external_event_id", _text),
    ("posting_id", _text),
    ("entry_id", _text),
    ("asset", _text),
    ("reference", _text),
    ("amount", _text),
    ("counterparty", _text),
    ("account_id", _text),
    ("direction", _text),
    ("timestamp", _text),
    ("created_at", _text),
)

EXTERNAL_EVENT = _struct(
    ("source", _text),
    ("external_event_id", _text),
    ("payload", _text),
    ("ord", _long),
)

RUN = _struct(
    ("run_id", _text),
    ("source", _text),
    ("scope", _text),
    ("status", _text),
    ("matched_count", _long),
    ("unmatched_count", _long),
    ("breaks_count", _long),
    ("started_at", _time),
    ("completed_at", _time),
)

BREAK = _struct(
    ("break_id", _text),
    ("run_id", _text),
    ("type", _text),
    ("classification", _text),
    ("source", _text),
    ("asset", _text),
    ("reference", _text),
    ("internal_amount", STORED_MONEY),
    ("external_amount", STORED_MONEY),
    ("status", _text),
    ("detected_at", _time),
    ("resolved_at", _time),
    ("age_seconds", _long),
)

RESOLUTION = _struct(
    ("break_id", _text),
    ("type", _text),
    ("actor", _text),
    ("note", _text),
    ("created_at", _time),
)

RULE = _struct(
    ("source", _text),
    ("asset", _text),
    ("match_strategy", _text),
    ("tolerance_seconds", _long),
    ("escalation_age_minutes", _long),
    ("auto_resolve_timing", T.BooleanType()),
    ("config", _text),
)

COMMAND = _struct(("break_id", _text), ("actor", _text), ("note", _text))

BALANCE_SNAPSHOT = _struct(
    ("source", _text),
    ("asset", _text),
    ("balance", MATCH_MONEY),
    ("ts", _time),
)


def columns(schema: T.StructType) -> list[str]:
    return [field.name for field in schema.fields]
