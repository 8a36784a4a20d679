import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from tallymark.session import build_session, clean_up  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    shared = str(tmp_path_factory.mktemp("shared"))
    session = build_session(
        "local[4]",
        shuffle_partitions=4,
        app="tests",
        settings={"spark.checkpoint.dir": shared, "spark.sql.warehouse.dir": shared},
    )
    yield session
    clean_up(session)
    session.stop()
