import json
from decimal import Decimal

import pytest
from helpers import at

from tallymark import schemas
from tallymark.functions.scalars import parse_instant, signed_amount
from tallymark.sources import ledger as lg
from tallymark.sources import messages as ms


def landed(tmp_path, name, *docs):
    folder = tmp_path / name
    folder.mkdir(exist_ok=True)
    (folder / "part.json").write_text("".join(json.dumps(d) + "\n" for d in docs))
    return str(folder)


def test_account_items(spark, tmp_path):
    page = {
        "account_id": "vault-7", "next_cursor": None, "final_balance": 5,
        "entries": [
            {"entry_id": "leg-31", "posting_id": "book-4", "account_id": "vault-7", "direction": "CREDIT", "amount": 640, "asset": "USD", "created_at": "2024-07-09T08:15:00Z"},
            {"entry_id": "leg-32", "direction": "DEBIT", "amount": "8.5", "asset": "CHF"},
        ],
    }
    rows = lg.from_account_pages(lg.read_account_pages(spark, landed(tmp_path, "pages", page, {"account_id": "x", "entries": []}))).collect()
    got = sorted((r.reference, r.asset, r.amount, r.counterparty, r.ts is None) for r in rows)
    assert got == [("book-4", "USD", -640, "vault-7", False), ("leg-32", "CHF", Decimal("8.5"), None, True)]


def test_postings(spark, tmp_path):
    legs = [{"account_id": "till", "direction": "DEBIT", "amount": 37, "asset": "GBP"}, {"account_id": "", "direction": "credit", "amount": 37, "created_at": "soon"}]
    docs = [
        {"posting_id": "book-1", "ref_tx_id": "wire-5", "created_at": "2023-11-30T17:45:00Z", "entries": legs},
        {"posting_id": "", "ref_tx_id": "wire-6", "entries": legs[:1]},
        {"posting_id": "book-2", "entries": []},
        {"posting_id": "book-3"},
    ]
    rows = lg.from_postings(lg.read_postings(spark, landed(tmp_path, "postings", *docs))).collect()
    got = sorted((r.reference, r.asset, r.amount, r.counterparty or "", r.ts is None) for r in rows)
    assert got == [("book-1", "", -37, "", False), ("book-1", "GBP", 37, "till", False), ("wire-6", "GBP", 37, "till", True)]


@pytest.mark.parametrize("direction, amount, want", [("CREDIT", "100", -100), ("credit", "1", -1), ("DEBIT", "50", 50), (None, "2", 2), ("x", None, 0)])
def test_signed_amount(spark, direction, amount, want):
    frame = spark.createDataFrame([(direction, amount)], "d string, a string")
    assert frame.select(signed_amount("d", "a")).first()[0] == want


def test_unreadable_ledger_amount_fails(spark):
    frame = spark.createDataFrame([("DEBIT", "abc")], "d string, a string")
    with pytest.raises(Exception):
        frame.select(signed_amount("d", "a")).collect()


@pytest.mark.parametrize(
    "text, want",
    [
        ("2024-01-01T00:00:00Z", 0), ("2024-01-01T02:00:00+02:00", 0), ("2024-01-01T02:00:00+0200", 0),
        ("2024-01-01", 0), ("2024-01-01 00:00:01.5", 1.5), ("2024-01-01T00:00:01,5Z", 1.5), ("2024-01-01T00:01", 60),
        ("", None), (None, None), ("garbage", None), ("2024-13-01T00:00:00Z", None), ("2024", None), ("12:00", None),
    ],
)
def test_parse_instant(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string").select(parse_instant("t").alias("t"))
    got = frame.selectExpr("unix_micros(t) - unix_micros(timestamp'2024-01-01')").first()[0]
    assert got == (None if want is None else want * 1_000_000)


def test_scope(spark):
    rows = [(i, f"c{i % 3}", at(i)) for i in range(30)]
    ledger = spark.createDataFrame(rows, "ord bigint, counterparty string, ts timestamp")
    assert lg.scope(ledger).count() == 30
    assert lg.scope(ledger, since=at(20)).count() == 10
    assert lg.scope(ledger, "c1, c2,").count() == 20
    picked = [(r.counterparty, r.ord) for r in lg.scope(ledger, "c2,c0,gone", limit=7).collect()]
    assert picked == [("c2", 2), ("c2", 5), ("c0", 0), ("c0", 3)]
    assert [r.ord for r in lg.scope(ledger, "c2,c0", limit=1).collect()] == [2]


def messages(spark, *rows):
    return spark.createDataFrame([(t, p, o, k, v if v is None or isinstance(v, str) else json.dumps(v)) for t, p, o, k, v in rows], schemas.MESSAGE)


EVENT = {"external_event_id": "e1", "source": "RAILS", "asset": "USD", "amount": "100", "reference": "ref1", "extra": [1]}


def test_routing(spark):
    rows = messages(spark, ("rail.events.v1", 0, 1, None, EVENT), ("nope", 0, 2, None, EVENT), ("mine", 0, 3, None, EVENT))
    assert [(r.topic, r.source) for r in ms.route(rows).collect()] == [("rail.events.v1", "RAILS")]
    assert [r.source for r in ms.route(rows, {"FRAUD": "mine", "RAILS": "other"}).collect()] == ["FRAUD"]


@pytest.mark.parametrize(
    "value, error",
    [
        (EVENT, None), ({**EVENT, "amount": 5}, None), ({**EVENT, "amount": None}, None), ({**EVENT, "amount": {"v": 1}}, None),
        ({**EVENT, "amount": [1]}, None), ({**EVENT, "amount": "abc"}, ms.BAD_AMOUNT), ({**EVENT, "amount": True}, ms.BAD_AMOUNT),
        ({**EVENT, "amount": ""}, ms.BAD_AMOUNT), ({**EVENT, "amount": "[1]"}, ms.BAD_AMOUNT), ({}, None),
        ("not json", ms.NOT_AN_OBJECT), ("[1]", ms.NOT_AN_OBJECT), ('[{"amount":1}]', ms.NOT_AN_OBJECT), ("5", ms.NOT_AN_OBJECT),
        ('{"amount":', ms.NOT_AN_OBJECT), (None, ms.NOT_AN_OBJECT), (" {}", None),
    ],
)
def test_errors(spark, value, error):
    row = ms.prepare(messages(spark, ("rail.events.v1", 0, 1, "k", value))).first()
    assert row.error == error


def test_dead_letters_keep_the_message(spark):
    rows = messages(spark, ("rail.events.v1", 2, 7, "k", "poison"), ("rail.events.v1", 2, 8, "k", EVENT))
    letters = ms.dead_letters(ms.prepare(rows)).collect()
    assert [tuple(r) for r in letters] == [("rail.events.v1", 2, 7, "k", "poison", ms.NOT_AN_OBJECT)]
    lenient = ms.prepare(rows, undecodable="empty")
    assert ms.dead_letters(lenient).isEmpty() and ms.events_of(lenient).count() == 2


def test_ids(spark):
    topic = "ledger.events.v1"
    rows = messages(
        spark, (topic, 0, 0, None, {"asset": "USD"}), (topic, 0, 1, None, {"entry_id": "n"}),
        (topic, 0, 2, None, {"posting_id": "p", "entry_id": "n"}), (topic, 0, 3, None, {"external_event_id": "", "posting_id": "p"}),
        (topic, 0, 4, None, EVENT))
    got = [r.external_event_id for r in ms.prepare(rows).orderBy("offset").collect()]
    assert got == ["ledger.events.v1:0:0", "n", "p", "p", "e1"]


def test_same_event_twice_is_stored_once_and_first_wins(spark):
    rows = ms.prepare(messages(spark, ("rail.events.v1", 0, 5, None, {**EVENT, "amount": "2"}), ("rail.events.v1", 0, 4, None, EVENT)))
    first = ms.ingest(ms.events_of(rows))
    assert [json.loads(r.payload)["amount"] for r in first.collect()] == ["100"]
    assert ms.ingest(ms.events_of(rows), first).isEmpty()


def test_same_id_of_two_sources_is_two_events(spark):
    rows = ms.prepare(messages(spark, ("rail.events.v1", 0, 5, None, EVENT), ("custody.events.v1", 0, 5, None, EVENT)))
    assert ms.ingest(ms.events_of(rows)).count() == 2


def test_entries_from_stored_events(spark):
    docs = [EVENT, {**EVENT, "external_event_id": "e2", "asset": None, "amount": {"x": 1}, "timestamp": "2024-01-01T00:00:00Z"}]
    rows = ms.prepare(messages(spark, *[("rail.events.v1", 0, i, None, d) for i, d in enumerate(docs)]))
    got = ms.external_entries(ms.ingest(ms.events_of(rows))).orderBy("ord").collect()
    assert [(r.asset, r.amount, r.reference, r.ts is None) for r in got] == [("USD", 100, "ref1", True), ("", None, "ref1", False)]


def test_ledger_side_from_ledger_events(spark):
    docs = [{"posting_id": "p1", "asset": "USD", "amount": "100", "direction": "CREDIT", "account_id": "a"}]
    rows = ms.prepare(messages(spark, *[("ledger.events.v1", 0, i, None, d) for i, d in enumerate(docs)]))
    row = ms.ledger_entries(ms.events_of(rows)).first()
    assert (row.reference, row.amount, row.counterparty) == ("p1", -100, "a")


def test_arrival_positions_are_unique(spark):
    rows = messages(spark, *[(t, p, o, None, EVENT) for t in schemas.SOURCE_TOPICS.values() for p in (0, 4095) for o in (0, 1)])
    ords = [r.ord for r in ms.prepare(rows).orderBy("ord").collect()]
    assert len(set(ords)) == 32


def test_arrival_positions_of_many_partitions_and_new_sources(spark):
    topics = {"SWAPS": "swaps.v1"}
    names = [*schemas.SOURCE_TOPICS.values(), "swaps.v1"]
    rows = messages(spark, *[(t, p, o, None, EVENT) for t in names for p in (0, 4095, 4096, 65_535) for o in (0, 1, 1 << 38)])
    ords = [r.ord for r in ms.prepare(rows, topics).collect()]
    assert None not in ords and len(set(ords)) == len(ords) == len(names) * 12
    with pytest.raises(Exception, match="no arrival position"):
        ms.prepare(messages(spark, ("rail.events.v1", 65_536, 0, None, EVENT))).select("ord").collect()


@pytest.mark.parametrize("amount, error", [
    ("1" * 20, None), ("1" * 21, ms.AMOUNT_RANGE), ("0." + "1" * 18, None), ("0." + "1" * 19, ms.AMOUNT_RANGE), ("1.10" + "0" * 30, None),
    ("1e-18", None), ("1e-19", ms.AMOUNT_RANGE), ("0e-30", None), ("1e30", ms.AMOUNT_RANGE), ("-1.5e3", None), ("abc", ms.BAD_AMOUNT), ("NaN", ms.BAD_AMOUNT),
    ("", ms.BAD_AMOUNT), (12, None), (1.5, None)])
def test_amounts_are_exact_or_dead_letters(spark, amount, error):
    assert ms.prepare(messages(spark, ("rail.events.v1", 0, 0, None, {**EVENT, "amount": amount}))).first().error == error


def test_listing(spark):
    rows = ms.prepare(messages(spark, *[("rail.events.v1", 0, i, None, {**EVENT, "external_event_id": f"e{9 - i}"}) for i in range(5)]))
    events = ms.ingest(ms.events_of(rows))
    assert [r.external_event_id for r in ms.list_events(events, "RAILS", 2).collect()] == ["e9", "e8"]
    assert ms.list_events(events, "CUSTODY").isEmpty()
