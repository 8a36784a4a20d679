"""Every registered query against its SQL on another engine, and the known sizes."""

import sys
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))

import __spark_entry__ as contract  # noqa: E402
from tallymark.plans import registry  # noqa: E402
from tallymark.plans.fixtures import VIEWS, view, with_inputs  # noqa: E402

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    return con


def plain(rows):
    return sorted((tuple(format(v, "f") if isinstance(v, Decimal) else v for v in r) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_equals_sql(spark, sql, name):
    frame = contract.queries()[name](spark, DATA)
    columns = sorted(frame.columns)
    result = sql.sql(contract.oracle_sql()[name])
    assert sorted(result.columns) == columns
    want = result.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    assert plain(frame.select(*columns).collect()) == plain(want)


def test_entry(spark):
    row = contract.entry(spark).first()
    assert (row.matched_count, row.unmatched_count, row.breaks_count) == (1050, 825, 900)


SIZES = {"match_exact": 1050, "unmatched_ledger": 375, "unmatched_external": 450, "duplicates": 75,
         "detect_breaks": 900, "match_fuzzy": 758, "auto_resolve": 172, "escalate_stale": 616, "run_report_counts": 45}


@pytest.mark.parametrize("name", sorted(SIZES))
def test_known_sizes(spark, name):
    assert contract.queries()[name](spark, DATA).count() == SIZES[name]


@pytest.mark.parametrize("name", sorted(VIEWS))
def test_inputs_are_the_same_on_both_engines(spark, sql, name):
    assert view(spark, DATA, name).count() == len(sql.sql(with_inputs([name], f"SELECT * FROM {name}")).fetchall())
