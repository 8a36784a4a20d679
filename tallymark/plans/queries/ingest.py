"""Reading postings and messages."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.scalars import parse_instant, signed_amount
from tallymark.plans.fixtures import spread, table, view, with_inputs
from tallymark.plans.registry import money, query, us
from tallymark.sources import ledger as lg
from tallymark.sources import messages as ms

# Two legs per line item. By order: 7 no posting id, 11 no id at all, 17 no
# entries; by line: 5 empty account; flag R is a credit, N has no direction.
_LEG_SQL = """, legs AS (
  SELECT *, CASE WHEN l_orderkey % 11 = 0 THEN '' WHEN l_orderkey % 7 = 0 THEN concat('T', l_orderkey) ELSE concat('P', l_orderkey) END AS reference,
    concat('AS', l_partkey % 3) AS asset, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DECIMAL(38,8)) AS amt FROM lineitem)
"""


def _created(leg: int):
    """Text of a leg's own time: leg 0 has one, leg 1 has garbage or none."""
    if leg == 0:
        return F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.when(F.col("l_partkey") % 2 == 0, F.lit("yesterday"))


def _direction(leg: int):
    first = F.when(F.col("l_returnflag") == "R", F.lit("credit")).when(F.col("l_returnflag") == "A", F.lit("DEBIT"))
    return first if leg == 0 else F.when(F.col("l_returnflag") != "R", F.lit("CREDIT"))


def _entry(leg: int, posting_id=None, account=None):
    account = account if account is not None else F.when(
        F.col("l_linenumber") == 5, F.lit("")
    ).otherwise(F.concat(F.lit("S" if leg == 0 else "C"), F.col("l_suppkey")))
    fields = [F.lit(f"e{leg}").alias("entry_id")]
    if posting_id is not None:
        fields.append(posting_id.alias("posting_id"))
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return F.struct(
        *fields,
        account.alias("account_id"),
        _direction(leg).alias("direction"),
        # Amounts come as numbers or as text.
        (price if leg == 0 else price.cast("string")).cast("string").alias("amount"),
        F.concat(F.lit("AS"), F.col("l_partkey") % 3).alias("asset"),
        _created(leg).alias("created_at"),
    )


def _posting_id():
    key = F.col("l_orderkey")
    return F.when(key % 11 == 0, F.lit("")).when(key % 7 != 0, F.concat(F.lit("P"), key))


def posting_json(spark, d) -> DataFrame:
    """One posting document per line item, as landed text."""
    key = F.col("l_orderkey")
    doc = F.struct(
        _posting_id().alias("posting_id"),
        F.when(key % 11 != 0, F.concat(F.lit("T"), key)).alias("ref_tx_id"),
        F.lit("2024-03-01T00:00:00+00:00").alias("created_at"),
        F.when(key % 17 != 0, F.array(_entry(0), _entry(1))).alias("entries"),
    )
    return spread(table(spark, d, "lineitem")).select(F.to_json(doc).alias("value"))


def opened(text: DataFrame, schema) -> DataFrame:
    """JSON documents as rows; each is parsed once."""
    return text.select(F.inline(F.array(F.from_json("value", schema))))


def _ledger_out(frame: DataFrame) -> DataFrame:
    return frame.select("reference", "asset", money("amount"), "counterparty", us("ts"))


_SIGN0 = "CASE WHEN l_returnflag = 'R' THEN -amt ELSE amt END"
_SIGN1 = "CASE WHEN l_returnflag <> 'R' THEN -amt ELSE amt END"
_PARTY = "CASE WHEN l_linenumber = 5 THEN NULL ELSE concat('{p}', l_suppkey) END"


@query(
    "ledger_from_postings",
    f"WITH x AS (SELECT 1){_LEG_SQL}"
    f"""SELECT reference, asset, {_SIGN0} AS amount, {_PARTY.format(p='S')} AS counterparty, epoch_us(l_shipdate) AS ts_us
FROM legs WHERE l_orderkey % 17 <> 0
UNION ALL SELECT reference, asset, {_SIGN1}, {_PARTY.format(p='C')}, epoch_us(TIMESTAMP '2024-03-01 00:00:00')
FROM legs WHERE l_orderkey % 17 <> 0""",
)
def ledger_from_postings(spark, d):
    docs = opened(posting_json(spark, d), schemas.POSTING)
    return _ledger_out(lg.from_postings(docs))


@query(
    "ledger_from_items",
    f"WITH x AS (SELECT 1){_LEG_SQL}"
    f"""SELECT CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 7 = 0 THEN 'e0' ELSE reference END AS reference, asset, {_SIGN0} AS amount,
  concat('S', l_suppkey) AS counterparty, epoch_us(l_shipdate) AS ts_us FROM legs
UNION ALL SELECT CASE WHEN l_orderkey % 11 = 0 OR l_orderkey % 7 = 0 THEN 'e1' ELSE reference END, asset, {_SIGN1},
  concat('S', l_suppkey), NULL FROM legs""",
)
def ledger_from_items(spark, d):
    account = F.concat(F.lit("S"), F.col("l_suppkey"))
    page = F.struct(
        account.alias("account_id"),
        F.array(_entry(0, _posting_id(), account), _entry(1, _posting_id(), account)).alias("entries"),
    )
    text = spread(table(spark, d, "lineitem")).select(F.to_json(page).alias("value"))
    return _ledger_out(lg.from_account_pages(opened(text, schemas.ACCOUNT_PAGE)))


@query(
    "signed_amount",
    """SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_returnflag = 'R' THEN -q ELSE q END AS DECIMAL(38,8)) AS amount
FROM (SELECT *, CASE WHEN l_linestatus = 'F' THEN 0 ELSE CAST(l_quantity AS DECIMAL(18,2)) END AS q FROM lineitem) t""",
)
def signed_amount_query(spark, d):
    given = F.when(F.col("l_linestatus") != "F", F.col("l_quantity").cast("decimal(18,2)"))
    return table(spark, d, "lineitem").withColumn("given", given).withColumn(
        "direction", _direction(0)
    ).select(
        "l_orderkey", "l_linenumber", "l_partkey",
        signed_amount("direction", "given").cast("decimal(38,8)").alias("amount"),
    )


_STAMPS = {
    0: ("yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'", "epoch_us(ts)"),
    1: ("yyyy-MM-dd HH:mm:ss", "epoch_us(date_trunc('second', ts))"),
    2: ("yyyy-MM-dd'T'HH:mm:ss'+02:00'", "epoch_us(date_trunc('second', ts)) - 7200000000"),
    3: ("yyyy-MM-dd", "epoch_us(date_trunc('day', ts))"),
    4: ("dd/MM/yyyy", "NULL"),
}


@query(
    "parse_timestamps",
    "SELECT event_id, CAST(CASE "
    + " ".join(f"WHEN event_id % 7 = {k} THEN {sql}" for k, (_, sql) in _STAMPS.items())
    + " END AS BIGINT) AS ts_us FROM events",
)
def parse_timestamps(spark, d):
    key = F.col("event_id") % 7
    text = F.when(key == 5, F.lit(""))
    for k, (pattern, _) in _STAMPS.items():
        text = text.when(key == k, F.date_format("ts", pattern))
    return table(spark, d, "events").select("event_id", us_of(parse_instant(text)))


def us_of(instant):
    return F.unix_micros(instant).alias("ts_us")


SCOPE_SINCE = datetime(1996, 1, 1, tzinfo=timezone.utc)


@query(
    "ledger_scope",
    """WITH s AS (SELECT o_orderkey AS ord, concat('C', o_custkey % 10) AS counterparty, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,8)) AS amount,
  CASE o_custkey % 10 WHEN 3 THEN 1 WHEN 1 THEN 2 WHEN 7 THEN 3 END AS place FROM orders
  WHERE o_custkey % 10 IN (1, 3, 7) AND o_orderdate >= TIMESTAMP '1996-01-01 00:00:00')
SELECT ord, counterparty, amount FROM (SELECT *, row_number() OVER (PARTITION BY counterparty ORDER BY ord) AS n FROM s) t
WHERE n <= 33 ORDER BY place, ord LIMIT 100""",
)
def ledger_scope(spark, d):
    orders = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"),
        F.concat(F.lit("C"), F.col("o_custkey") % 10).alias("counterparty"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("amount"),
        F.col("o_orderdate").cast("timestamp").alias("ts"),
    )
    found = lg.scope(orders, " C3, C1 ,C7,", SCOPE_SINCE, 100)
    return found.select("ord", "counterparty", money("amount"))


# --- Messages ---

_TOPIC_CASE = "CASE topic " + " ".join(
    f"WHEN '{topic}' THEN '{source}'" for source, topic in schemas.SOURCE_TOPICS.items()
) + " END"

MESSAGES = f""",
decoded AS (SELECT *, {_TOPIC_CASE} AS source, TRY_CAST(body AS JSON) AS j FROM fx_messages),
parsed AS (SELECT *, coalesce(json_type(j) = 'OBJECT', false) AS is_object, json_type(j, '$.amount') AS kind, j->>'$.amount' AS amount_text,
  coalesce(nullif(j->>'$.external_event_id', ''), nullif(j->>'$.posting_id', ''), nullif(j->>'$.entry_id', ''),
    concat(topic, ':', part, ':', pos)) AS external_event_id FROM decoded WHERE source IS NOT NULL),
checked AS (SELECT *, TRY_CAST(amount_text AS DECIMAL(38,8)) AS amount,
  CASE WHEN NOT is_object THEN 'payload is not a JSON object'
    WHEN kind IN ('VARCHAR', 'BOOLEAN', 'BIGINT', 'UBIGINT', 'DOUBLE') AND TRY_CAST(amount_text AS DECIMAL(38,18)) IS NULL THEN 'amount is not a number' END AS error
  FROM parsed),
good AS (SELECT * FROM checked WHERE error IS NULL)
"""


def message_rows(spark, d) -> DataFrame:
    return as_messages(view(spark, d, "fx_messages", busy=True))


def as_messages(rows: DataFrame) -> DataFrame:
    return rows.select(
        "topic", F.col("part").alias("partition"), F.col("pos").alias("offset"),
        F.col("msg_key").alias("key"), F.col("body").alias("value"),
    )


def prepared(spark, d) -> DataFrame:
    return ms.prepare(message_rows(spark, d))


@query(
    "parse_external_payload",
    with_inputs(["fx_messages"], MESSAGES + """SELECT source, external_event_id, coalesce(j->>'$.asset', '') AS asset, j->>'$.reference' AS reference,
  amount, j->>'$.counterparty' AS counterparty, epoch_us(CAST(replace(j->>'$.timestamp', 'Z', '') AS TIMESTAMP)) AS ts_us FROM good"""),
)
def parse_external_payload(spark, d):
    entries = ms.external_entries(ms.events_of(prepared(spark, d)))
    return entries.select(
        "source", "external_event_id", "asset", "reference", money("amount"), "counterparty", us("ts")
    )


@query(
    "decode_json_safe",
    with_inputs(["fx_messages"], """SELECT pos, coalesce(json_type(TRY_CAST(body AS JSON)) = 'OBJECT', false) AS is_object,
  TRY_CAST(body AS JSON)->>'$.asset' AS asset FROM fx_messages"""),
)
def decode_json_safe(spark, d):
    rows = ms.decode(message_rows(spark, d))
    return rows.select(
        F.col("offset").alias("pos"), "is_object", F.col(ms.field("asset")).alias("asset")
    )


@query(
    "route_topics",
    with_inputs(["fx_messages"], f"SELECT pos, topic, {_TOPIC_CASE} AS source FROM fx_messages WHERE {_TOPIC_CASE} IS NOT NULL"),
)
def route_topics(spark, d):
    return ms.route(message_rows(spark, d)).select(F.col("offset").alias("pos"), "topic", "source")


@query(
    "ledger_event_ids",
    with_inputs(["fx_messages"], MESSAGES + "SELECT pos, external_event_id FROM checked WHERE source = 'LEDGER'"),
)
def ledger_event_ids(spark, d):
    return prepared(spark, d).where("source = 'LEDGER'").select(
        F.col("offset").alias("pos"), "external_event_id"
    )


@query(
    "ledger_from_events",
    with_inputs(["fx_messages"], MESSAGES + """SELECT coalesce(nullif(j->>'$.reference', ''), nullif(j->>'$.posting_id', ''), '') AS reference,
  coalesce(j->>'$.asset', '') AS asset, coalesce(amount, 0) AS amount, coalesce(nullif(j->>'$.counterparty', ''), nullif(j->>'$.account_id', '')) AS counterparty,
  epoch_us(CAST(replace(coalesce(j->>'$.timestamp', j->>'$.created_at'), 'Z', '') AS TIMESTAMP)) AS ts_us FROM good WHERE source = 'LEDGER'"""),
)
def ledger_from_events(spark, d):
    rows = ms.ledger_entries(ms.events_of(prepared(spark, d)))
    return rows.select("reference", "asset", money("amount"), "counterparty", us("ts"))


FIRST = """, firsts AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source, external_event_id ORDER BY pos) AS rn FROM {rows}) t WHERE rn = 1)
"""


@query(
    "ingest_dedupe",
    with_inputs(["fx_messages"], MESSAGES + FIRST.format(rows="good WHERE part >= 2").replace("firsts", "incoming") + """
SELECT i.source, i.external_event_id, i.body AS payload FROM incoming i
WHERE NOT EXISTS (SELECT 1 FROM good s WHERE s.part < 2 AND s.source = i.source AND s.external_event_id = i.external_event_id)"""),
)
def ingest_dedupe(spark, d):
    """Two message partitions are stored already; the others arrive."""
    stored = ms.ingest(ms.events_of(prepared(spark, d).where("partition < 2")))
    arriving = ms.events_of(prepared(spark, d).where("partition >= 2"))
    return ms.ingest(arriving, stored).select("source", "external_event_id", "payload")


@query(
    "dead_letters",
    with_inputs(["fx_messages"], MESSAGES + """SELECT topic, part, pos, msg_key, body, error FROM checked WHERE error IS NOT NULL"""),
)
def dead_letters(spark, d):
    return ms.dead_letters(prepared(spark, d)).select(
        "topic", F.col("partition").alias("part"), F.col("offset").alias("pos"),
        F.col("key").alias("msg_key"), F.col("value").alias("body"), "error",
    )


@query(
    "list_external_events",
    with_inputs(["fx_messages"], MESSAGES + FIRST.format(rows="good") + """SELECT external_event_id, body AS payload FROM firsts
WHERE source = 'RAILS' ORDER BY pos"""),
)
def list_external_events(spark, d):
    events = ms.ingest(ms.events_of(prepared(spark, d)))
    return ms.list_events(events, "RAILS").select("external_event_id", "payload")
