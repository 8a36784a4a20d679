"""Alert and audit messages derived from break rows and transitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.scalars import iso_z, json_with_nulls, money_text, stable_id

# --- Fixed values of the audit envelope ---
ENVELOPE_VERSION = "1"
ACTION_PREFIX = "recon."
TARGET_TYPE = "break"
HASH_PREFIX = "sha256:"

# Our own name in messages, unless another one is given.
SERVICE = "tallymark"

# Fields in alphabetical order: that is the canonical form that is hashed.
_STATE = "struct<age_seconds:bigint,classification:string,run_id:string,status:string>"


def state(**values: Column | str) -> Column:
    """The part of a break shown in an audit; fields not given stay out of its JSON."""
    names = ("age_seconds", "classification", "run_id", "status")
    parts = []
    for name in names:
        value = values.get(name)
        if isinstance(value, str):
            value = F.lit(value)
        parts.append((F.lit(None) if value is None else value).alias(name))
    return F.struct(*parts).cast(_STATE)


def alerts(breaks: DataFrame, action: Column | str, actor: Column | str, at: Column) -> DataFrame:
    """One alert per break row, with the age the row has."""
    as_col = lambda v: F.lit(v) if isinstance(v, str) else v
    return breaks.select(
        "break_id", "type", "classification", "source", "asset", "reference",
        "internal_amount", "external_amount", "detected_at", "age_seconds",
        as_col(action).alias("action"), as_col(actor).alias("actor"), at.alias("timestamp"),
    )


def as_messages(alert_rows: DataFrame) -> DataFrame:
    """Key = break id, value = JSON with every field present."""
    body = F.struct(
        "break_id", "type", "classification", "source", "asset", "reference",
        money_text("internal_amount").alias("internal_amount"),
        money_text("external_amount").alias("external_amount"),
        iso_z("detected_at").alias("detected_at"),
        "age_seconds", "action", "actor",
        iso_z("timestamp").alias("timestamp"),
    )
    return alert_rows.select(
        F.lit(schemas.ALERT_TOPIC).alias("topic"),
        F.col("break_id").alias("key"),
        json_with_nulls(body).alias("value"),
    )


def detected_audits(breaks: DataFrame, at: Column) -> DataFrame:
    return breaks.select(
        "break_id",
        F.lit("detected").alias("action"),
        F.lit("system").alias("actor"),
        state().alias("before"),
        state(run_id=F.col("run_id"), classification=F.col("classification")).alias("after"),
        at.alias("timestamp"),
    )


def envelope(audits: DataFrame, service: str = SERVICE) -> DataFrame:
    """Audit rows wrapped and hashed.

    The hash is over compact JSON with keys in alphabetical order. The id is
    derived from the content, so a message sent twice can be recognised.
    """
    payload = F.to_json(
        F.struct(
            "action", "actor", "after", "before", "break_id", iso_z("timestamp").alias("timestamp")
        )
    )
    with_payload = audits.withColumn("payload", payload)
    digest = F.concat(F.lit(HASH_PREFIX), F.sha2("payload", 256))
    return with_payload.select(
        F.lit(ENVELOPE_VERSION).alias("schema_version"),
        stable_id(F.col("payload")).alias("id"),
        iso_z("timestamp").alias("ts"),
        F.lit(service).alias("source_service"),
        F.col("actor").alias("actor_id"),
        F.concat(F.lit(ACTION_PREFIX), F.col("action")).alias("action"),
        F.lit(TARGET_TYPE).alias("target_type"),
        F.col("break_id").alias("target_id"),
        digest.alias("payload_hash"),
        "payload",
    )


def as_audit_messages(audits: DataFrame, service: str = SERVICE) -> DataFrame:
    """The payload goes into the message as an object, by the very text that is hashed."""
    wrapped = envelope(audits, service)
    head = json_with_nulls(F.struct(*[F.col(c) for c in wrapped.columns if c != "payload"]))
    value = F.concat(head.substr(F.lit(1), F.length(head) - 1), F.lit(',"payload":'), F.col("payload"), F.lit("}"))
    return wrapped.select(
        F.lit(schemas.AUDIT_TOPIC).alias("topic"), F.col("target_id").alias("key"), value.alias("value")
    )


def dead_letter_messages(letters: DataFrame) -> DataFrame:
    """Dead letters as messages: where each came from, its text and what is wrong with it."""
    body = F.struct("topic", "partition", "offset", "key", F.col("value").alias("payload"), "error")
    return letters.select(F.lit(schemas.DEAD_LETTER_TOPIC).alias("topic"), "key", json_with_nulls(body).alias("value"))


def replay(audits: DataFrame) -> DataFrame:
    """Every state change of every break with its position, and where it ends.

    Rows stay flat: a break with very many changes never becomes one value.
    """
    from tallymark.functions.ranking import number_rows

    steps = number_rows(
        audits.withColumn("ord", F.unix_micros("timestamp") * 8 + _stage(F.col("action"))),
        ["break_id"],
        "step",
    )
    last = audits.where("after.status IS NOT NULL").groupBy("break_id").agg(
        F.max_by("after.status", F.unix_micros("timestamp") * 8 + _stage(F.col("action"))).alias(
            "final_status"
        )
    )
    return steps.join(last, "break_id", "left").select(
        "break_id",
        "step",
        "action",
        "actor",
        F.col("before.status").alias("status_before"),
        F.col("after.status").alias("status_after"),
        "timestamp",
        F.coalesce("final_status", F.lit("OPEN")).alias("final_status"),
    )


def _stage(action: Column) -> Column:
    """Order of changes that carry the same time."""
    return (
        F.when(action == "detected", 0)
        .when(action == "escalated", 1)
        .when(action == "auto-resolved", 2)
        .otherwise(3)
    )
