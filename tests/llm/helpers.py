import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pytest
from tallymark.llm import queries
from tallymark.llm.common import documents, ship, table

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not Path(DATA).exists(), reason="test tables not present")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def run(spark, name):
    return queries.QUERIES[name](spark, DATA)


def same_as_sql(frame, sql, views):
    con = duckdb.connect()
    for name, source in views.items():
        if isinstance(source, str):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{source}'")
        else:
            con.register(f"t_{name}", source.toArrow())
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM t_{name}")
    result = con.sql(sql)
    columns = sorted(frame.columns)
    assert sorted(result.columns) == columns
    want = result.project(", ".join(f'"{c}"' for c in columns)).fetchall()
    got = [tuple(r) for r in frame.select(*columns).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    return got


def whole(spark):
    """(doc_id, text) of the test table, in order."""
    ship(spark)
    return [tuple(r) for r in documents(table(spark, DATA, "documents")).orderBy("doc_id").collect()]


def docs(spark, *texts, first=1):
    """A table of documents with these texts."""
    ship(spark)
    rows = [(first + k, t, "en", "web", len(t or "")) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
