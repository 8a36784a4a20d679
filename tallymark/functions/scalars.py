"""Column expressions shared by the operators. All of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallymark.schemas import MATCH_MONEY, REPORT_MONEY, STORED_MONEY

# Extended ISO-8601: date, optional time, optional fraction, optional offset.
_ISO_INSTANT = (
    r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}([.,]\d+)?)?([Zz]|[+-]\d{2}(:?\d{2})?)?)?$"
)


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def blank_to_null(value: Column | str) -> Column:
    """Empty text counts as absent."""
    return F.nullif(_col(value), F.lit(""))


def first_present(*values: Column | str) -> Column:
    """The first argument that is neither null nor empty."""
    return F.coalesce(*[blank_to_null(v) for v in values])


def text_or_empty(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(""))


def match_money(value: Column | str) -> Column:
    return _col(value).cast(MATCH_MONEY)


def stored_money(value: Column | str) -> Column:
    return _col(value).cast(STORED_MONEY)


def report_money(value: Column | str) -> Column:
    return _col(value).cast(REPORT_MONEY)


def amount_or_zero(value: Column | str) -> Column:
    return F.coalesce(_col(value), F.lit(0).cast(MATCH_MONEY))


def signed_amount(direction: Column | str, amount: Column | str) -> Column:
    """Credits are negative; a missing direction is a debit, a missing amount 0.

    Text that is not a number fails the job: a ledger that cannot be read
    must not pass for an empty one.
    """
    value = amount_or_zero(match_money(amount))
    is_credit = F.upper(text_or_empty(direction)) == F.lit("CREDIT")
    return F.when(is_credit, -value).otherwise(value).cast(MATCH_MONEY)


def parse_instant(value: Column | str) -> Column:
    """ISO-8601 text to a timestamp; anything else becomes null. No offset = UTC.

    The usual spellings are read directly; a comma before the fraction or an
    offset without a colon is rewritten first.
    """
    text = _col(value)
    plain = F.replace(F.upper(text), F.lit(","), F.lit("."))
    plain = F.regexp_replace(plain, r"(:\d{2}(?:\.\d+)?[+-]\d{2})(\d{2})$", "$1:$2")
    parsed = F.coalesce(text.try_cast("timestamp"), plain.try_cast("timestamp"))
    return F.when(text.rlike(_ISO_INSTANT), parsed)


def _iso(value: Column | str, suffix: str) -> Column:
    instant = _col(value)
    whole = F.unix_micros(instant) % F.lit(1_000_000) == 0
    return F.when(whole, F.date_format(instant, f"yyyy-MM-dd'T'HH:mm:ss'{suffix}'")).otherwise(
        F.date_format(instant, f"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'{suffix}'")
    )


def iso_z(value: Column | str) -> Column:
    """UTC instant as messages carry it; the fraction only when there is one."""
    return _iso(value, "Z")


def iso_offset(value: Column | str) -> Column:
    """UTC instant as reports and exports print it."""
    return _iso(value, "+00:00")


def micros(value: Column | str) -> Column:
    return F.unix_micros(_col(value))


def micros_apart(left: Column | str, right: Column | str) -> Column:
    return F.abs(micros(left) - micros(right))


def within_seconds(left: Column | str, right: Column | str, seconds: Column | int) -> Column:
    """At most `seconds` apart, the limit included. Null if a side is unknown."""
    limit = F.lit(seconds) if isinstance(seconds, int) else seconds
    return micros_apart(left, right) <= limit.cast("bigint") * F.lit(1_000_000).cast("bigint")


def age_seconds(detected_at: Column | str, now: Column) -> Column:
    """Whole seconds since detection, never negative."""
    elapsed = micros(now) - micros(detected_at)
    return F.greatest(F.lit(0).cast("bigint"), F.floor(elapsed / F.lit(1_000_000)).cast("bigint"))


def classify_timing(
    ledger_ts: Column | str, external_ts: Column | str, tolerance_seconds: Column | int
) -> Column:
    """TIMING when a side is unknown or both are within the tolerance, else REAL."""
    close = within_seconds(ledger_ts, external_ts, tolerance_seconds)
    return F.when(F.coalesce(close, F.lit(True)), F.lit("TIMING")).otherwise(F.lit("REAL"))


def classify_amount(delta: Column | str, tolerance_seconds: Column | int) -> Column:
    """TIMING for no delta or one of at most the tolerance, else REAL."""
    limit = F.lit(tolerance_seconds) if isinstance(tolerance_seconds, int) else tolerance_seconds
    small = F.abs(_col(delta)) <= limit
    return F.when(F.coalesce(small, F.lit(True)), F.lit("TIMING")).otherwise(F.lit("REAL"))


def stable_id(*parts: Column | str) -> Column:
    """The same inputs always give the same id, so a repeated job adds nothing new."""
    return F.sha2(F.concat_ws("|", *[_col(p).cast("string") for p in parts]), 256)


def json_with_nulls(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def money_text(value: Column | str) -> Column:
    """Stored amount as plain text with eight decimals; null stays null."""
    return stored_money(value).cast("string")
