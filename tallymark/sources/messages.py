"""From Kafka-shaped messages to stored external events.

Every step works the same on a batch and on a stream: topic, partition,
offset, key, value in, columns added, nothing collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallymark import schemas
from tallymark.functions.scalars import (
    first_present,
    parse_instant,
    signed_amount,
    text_or_empty,
)

# --- Fixed texts ---
NOT_AN_OBJECT = "payload is not a JSON object"
BAD_AMOUNT = "amount is not a number"
AMOUNT_RANGE = "amount has more than 20 whole digits or 18 decimals"

# Room for topics and partitions in an arrival position; 2^39 offsets are left.
_TOPIC_BITS, _PARTITION_BITS = 8, 16

_ORIGIN = ["topic", "partition", "offset", "key", "value"]


def route(messages: DataFrame, topics: dict[str, str] | None = None) -> DataFrame:
    """Add `source` by topic; messages of unknown topics drop out.

    `topics` maps sources to topics and overrides single defaults.
    """
    by_topic = {topic: source for source, topic in {**schemas.SOURCE_TOPICS, **(topics or {})}.items()}
    pairs = [F.lit(x) for item in by_topic.items() for x in item]
    known = F.create_map(*pairs)
    return messages.where(F.col("topic").isin(list(by_topic))).withColumn("source", known[F.col("topic")])


def field(name: str) -> str:
    """Column that holds a decoded payload field."""
    return f"p_{name}"


def decode(rows: DataFrame, text: str = "value") -> DataFrame:
    """Add the payload fields as columns and `is_object`.

    The text is parsed once per row: generating the columns keeps the
    optimizer from repeating the parser for every field.
    """
    corrupt = "_unreadable"
    shape = T.StructType([*schemas.PAYLOAD.fields, T.StructField(corrupt, T.StringType())])
    payload = F.col(text).cast("string")
    parsed = F.from_json(payload, shape, {"columnNameOfCorruptRecord": corrupt})
    names = [field(f.name) for f in shape.fields]
    opened = rows.select("*", F.inline(F.array(parsed)).alias(*names))
    readable = F.col(field(corrupt)).isNull() & payload.rlike(r"^\s*\{")
    return opened.withColumn("is_object", F.coalesce(readable, F.lit(False))).drop(field(corrupt))


def _no_amount_type(text: str) -> Column:
    """Whether the amount is a JSON object or array rather than text that looks like one."""
    kind = F.schema_of_variant(
        F.try_variant_get(F.try_parse_json(F.col(text).cast("string")), "$.amount", "variant")
    )
    looks_nested = F.col(field("amount")).rlike(r"^\s*[\[{]")
    return F.when(looks_nested, ~F.coalesce(kind == "STRING", F.lit(False))).otherwise(F.lit(False))


def parse_amount() -> Column:
    """Numbers and numeric text; anything else is null."""
    return F.col(field("amount")).try_cast(schemas.MATCH_MONEY)


def _is_number() -> Column:
    return F.col(field("amount")).rlike(r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$")


def _decimals() -> Column:
    """Decimals that count of a numeric text, its exponent included."""
    text = F.trim(F.col(field("amount")))
    fraction = F.regexp_extract(text, r"\.([0-9]*?)0*([eE].*)?$", 1)
    exponent = F.regexp_extract(text, r"[eE]([+-]?[0-9]+)$", 1).try_cast("int")
    mantissa = F.regexp_extract(text, r"^[+-]?([0-9.]*)", 1)
    return F.when(mantissa.rlike("[1-9]"), F.length(fraction) - F.coalesce(exponent, F.lit(0))).otherwise(0)


def error_of(text: str = "value") -> Column:
    """Why a message cannot be taken. An amount that is an object or a list
    counts as no amount; other values must be numbers, and such that they can
    be kept exactly: none is ever rounded."""
    given = F.col(field("amount")).isNotNull() & ~_no_amount_type(text)
    range_error = parse_amount().isNull() | (_decimals() > schemas.MATCH_MONEY.scale)
    return (
        F.when(~F.col("is_object"), F.lit(NOT_AN_OBJECT))
        .when(given & ~_is_number(), F.lit(BAD_AMOUNT))
        .when(given & range_error, F.lit(AMOUNT_RANGE))
    )


def event_id() -> Column:
    """The first id present, else the position of the message."""
    place = F.concat_ws(":", "topic", F.col("partition").cast("string"), F.col("offset").cast("string"))
    given = first_present(field("external_event_id"), field("posting_id"), field("entry_id"))
    return F.coalesce(given, place)


def arrival_position(topics: dict[str, str] | None = None) -> Column:
    """A BIGINT per message: by offset, then topic, then partition.

    Needs no shuffle and is the same on every reading. Every configured source
    has a slot. A message for which there is no room (256 sources, 65,536
    partitions, 2^39 offsets) fails the job rather than share a position.
    """
    sources = {**schemas.SOURCE_TOPICS, **(topics or {})}
    slots = [F.lit(x) for n, source in enumerate(sources) for x in (source, n)]
    slot = F.create_map(*slots)[F.col("source")].cast("bigint")
    partition, offset = F.col("partition").cast("bigint"), F.col("offset")
    room = (
        slot.between(0, (1 << _TOPIC_BITS) - 1)
        & partition.between(0, (1 << _PARTITION_BITS) - 1)
        & offset.between(0, (1 << 63 - _TOPIC_BITS - _PARTITION_BITS) - 1)
    )
    position = (offset * (1 << _TOPIC_BITS) + slot) * (1 << _PARTITION_BITS) + partition
    return F.when(room, position).otherwise(F.raise_error(F.lit("no arrival position for a message")))


def prepare(
    messages: DataFrame, topics: dict[str, str] | None = None, undecodable: str = "dead-letter"
) -> DataFrame:
    """Routed and decoded messages with `ord`, `external_event_id` and `error` (null = fine).

    `undecodable="empty"` takes a payload that is no JSON object for an empty
    one instead of an error.
    """
    rows = decode(route(messages, topics))
    if undecodable == "empty":
        rows = rows.withColumn("is_object", F.lit(True))
    return (
        rows.withColumn("external_event_id", event_id())
        .withColumn("error", error_of())
        .withColumn("ord", arrival_position(topics))
    )


def dead_letters(prepared: DataFrame) -> DataFrame:
    return prepared.where("error IS NOT NULL").select(*_ORIGIN, "error")


def events_of(prepared: DataFrame) -> DataFrame:
    """Good messages as events; the payload text is kept as it came."""
    return prepared.where("error IS NULL").select(
        "source", "external_event_id", F.col("value").alias("payload"), "ord"
    )


def first_of_each(events: DataFrame) -> DataFrame:
    """The first arrival per (source, id).

    One row per key and task is kept before the shuffle, so an id delivered
    any number of times costs one row per task.
    """
    arrival = Window.partitionBy("source", "external_event_id").orderBy("ord")
    return events.withColumn("_n", F.row_number().over(arrival)).where("_n = 1").drop("_n")


def not_stored(events: DataFrame, stored: DataFrame) -> DataFrame:
    """Events whose (source, id) is not stored yet: the first payload stays.

    The store is reduced to the arriving ids first. A small arrival is then
    broadcast to it by the session, and the store is read but not shuffled.
    """
    key = ["source", "external_event_id"]
    known = stored.select(*key).join(events.select(*key), key, "left_semi")
    return events.join(known, key, "left_anti")


def ingest(events: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """The rows to add to the store. Running it again adds nothing."""
    fresh = first_of_each(events)
    return fresh if stored is None else not_stored(fresh, stored)


def external_entries(events: DataFrame) -> DataFrame:
    """Stored events as rows for matching."""
    return decode(events, "payload").select(
        "ord",
        "external_event_id",
        "source",
        text_or_empty(field("asset")).alias("asset"),
        F.col(field("reference")).alias("reference"),
        parse_amount().alias("amount"),
        F.col(field("counterparty")).alias("counterparty"),
        parse_instant(field("timestamp")).alias("ts"),
    )


def ledger_entries(events: DataFrame) -> DataFrame:
    """Stored LEDGER events as the ledger side of a match."""
    rows = decode(events.where("source = 'LEDGER'"), "payload")
    reference = first_present(field("reference"), field("posting_id"), field("entry_id"))
    return rows.select(
        "ord",
        F.coalesce(reference, F.lit("")).alias("reference"),
        text_or_empty(field("asset")).alias("asset"),
        signed_amount(field("direction"), parse_amount()).alias("amount"),
        first_present(field("counterparty"), field("account_id")).alias("counterparty"),
        parse_instant(F.coalesce(field("timestamp"), field("created_at"))).alias("ts"),
    )


def list_events(
    events: DataFrame, source: str | None = None, limit: int | None = None
) -> DataFrame:
    """Events of a source by arrival; no limit unless asked for one."""
    if source is not None:
        events = events.where(F.col("source") == source).orderBy("ord")
    return events if limit is None else events.limit(limit)
