"""Turning what a strategy could not settle into break rows."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallymark import schemas
from tallymark.functions.scalars import classify_timing, first_present, stable_id
from tallymark.operators.matching import MatchOutcome


def _new_break(
    run_id: Column,
    now: Column,
    branch: Column | str,
    row_key: Column | str,
    **values: Column,
) -> list[Column]:
    """All columns of a fresh OPEN break; amounts are rounded here, not earlier."""
    kind = F.lit(branch) if isinstance(branch, str) else branch
    filled = {
        "break_id": stable_id(run_id, kind, row_key),
        "run_id": run_id,
        "reference": F.lit(None),
        "internal_amount": F.lit(None),
        "external_amount": F.lit(None),
        "status": F.lit("OPEN"),
        "detected_at": now,
        "resolved_at": F.lit(None),
        "age_seconds": F.lit(0),
        **values,
    }
    return [filled[f.name].cast(f.dataType).alias(f.name) for f in schemas.BREAK.fields]


def _leftover_columns(
    has_ledger: Column, ledger: str, external: str, run_id: Column, source: Column, now: Column,
    tolerance_seconds: int,
) -> list[Column]:
    """A ledger row without an event may only be late; an event without a ledger
    row is a real gap. The classifier sees no event time for the former."""
    timing = classify_timing(F.col(f"{ledger}.ts"), F.lit(None).cast("timestamp"), tolerance_seconds)
    classification = F.when(has_ledger, timing).otherwise(F.lit("REAL"))
    late = has_ledger & (classification == "TIMING")
    return _new_break(
        run_id,
        now,
        F.when(has_ledger, F.lit("ledger")).otherwise(F.lit("external")),
        F.when(has_ledger, F.col(f"{ledger}.ord")).otherwise(F.col(f"{external}.ord")),
        type=F.when(late, F.lit("TIMING_GAP")).otherwise(F.lit("MISSING_ENTRY")),
        classification=classification,
        source=source,
        asset=F.when(has_ledger, F.col(f"{ledger}.asset")).otherwise(F.col(f"{external}.asset")),
        reference=F.when(has_ledger, F.col(f"{ledger}.reference")).otherwise(
            F.col(f"{external}.reference")
        ),
        internal_amount=F.when(has_ledger, F.col(f"{ledger}.amount")),
        external_amount=F.when(~has_ledger, F.col(f"{external}.amount")),
    )


def leftover_breaks(
    pairing: DataFrame, run_id: Column, source: Column, now: Column, tolerance_seconds: int
) -> DataFrame:
    """Both one-sided kinds in one pass over the pairing."""
    one_sided = pairing.where("(l IS NULL) <> (e IS NULL)")
    return one_sided.select(
        *_leftover_columns(F.col("l").isNotNull(), "l", "e", run_id, source, now, tolerance_seconds)
    )


def timing_gap_breaks(outcome: MatchOutcome, run_id, source, now, tolerance_seconds) -> DataFrame:
    rows = outcome.pairing.where("l IS NOT NULL AND e IS NULL")
    return leftover_breaks(rows, run_id, source, now, tolerance_seconds)


def missing_entry_breaks(outcome: MatchOutcome, run_id, source, now, tolerance_seconds) -> DataFrame:
    rows = outcome.pairing.where("e IS NOT NULL AND l IS NULL")
    return leftover_breaks(rows, run_id, source, now, tolerance_seconds)


def balance_breaks(balances: DataFrame, run_id: Column, source: Column, now: Column) -> DataFrame:
    return balances.where("NOT matched").select(
        *_new_break(
            run_id,
            now,
            "balance",
            "asset",
            type=F.lit("AMOUNT_MISMATCH"),
            classification=F.lit("REAL"),
            source=first_present(F.col("source"), source),
            asset=F.col("asset"),
            internal_amount=F.col("expected_closing"),
            external_amount=F.col("actual_closing"),
        )
    )


def _duplicate_columns(prefix: str, run_id: Column, now: Column) -> list[Column]:
    return _new_break(
        run_id,
        now,
        "duplicate",
        f"{prefix}ord",
        type=F.lit("DUPLICATE"),
        classification=F.lit("REAL"),
        source=F.col(f"{prefix}source"),
        asset=F.col(f"{prefix}asset"),
        reference=F.col(f"{prefix}reference"),
        external_amount=F.col(f"{prefix}amount"),
    )


def duplicate_breaks(duplicates: DataFrame, run_id: Column, now: Column) -> DataFrame:
    return duplicates.select(*_duplicate_columns("", run_id, now))


def _exact_breaks(
    pairing: DataFrame, run_id: Column, source: Column, now: Column, tolerance_seconds: int
) -> DataFrame:
    """Leftovers and second copies in one pass; a row can be both."""
    has_ledger = F.col("l").isNotNull()
    leftover = F.struct(
        *_leftover_columns(has_ledger, "l", "e", run_id, source, now, tolerance_seconds)
    )
    copy = F.struct(*_duplicate_columns("e.", run_id, now))
    found = F.array_compact(
        F.array(
            F.when(has_ledger != F.col("e").isNotNull(), leftover),
            F.when(F.col("e.copy") == 2, copy),
        )
    )
    return pairing.select(F.inline(found))


def as_column(value: Column | str | datetime) -> Column:
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime):
        return F.lit(value).cast("timestamp")
    return F.lit(value)


def detect_breaks(
    outcome: MatchOutcome,
    run_id: Column | str,
    source: Column | str,
    now: Column | datetime,
    tolerance_seconds: int = schemas.DEFAULT_TOLERANCE_SECONDS,
) -> DataFrame:
    """Every unmatched row, unbalanced asset and duplicate becomes one break.

    A duplicate that is also unmatched gives two.
    """
    run, src, at = as_column(run_id), as_column(source), as_column(now)
    if outcome.strategy == "EXACT":
        return _exact_breaks(outcome.pairing, run, src, at, tolerance_seconds)
    found = leftover_breaks(outcome.pairing, run, src, at, tolerance_seconds)
    if outcome.strategy == "BALANCE_ROLLFORWARD":
        found = found.unionByName(balance_breaks(outcome.balances, run, src, at))
    return found
