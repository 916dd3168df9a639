import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"
TABLES = ("documents", "benchmark", "conversations", "labels")


@pytest.fixture(scope="session")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{SMALL}/{name}.parquet'")
    return con


@pytest.fixture(scope="session")
def documents(con):
    return con.execute("select doc_id, coalesce(text, '') from documents order by 1").fetchall()


@pytest.fixture
def hard(spark):
    """Null and empty texts, null, repeated and tied ids, odd white space, and columns with clashing names."""
    base = "Grey herons stand in the shallow water and wait for small fish to pass them by at dawn"
    rows = [
        (1, base, "x", 1), (2, base, "y", 2), (2, base, "y", 2), (2, "other text\nwith two lines\nother text", "z", 3),
        (None, base, None, None), (3, None, "q", None), (4, "", "q", 5), (5, " \n\t\n ", "q", 5), (-6, "word", "w", 0),
        (7, "é ñ ÀB  \x0b x\r\n" + base.upper(), "w", 0), (8, "long " * 30_000, "w", 0),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, row string, t int")


@pytest.fixture
def none(hard):
    return hard.filter("doc_id > 100")


os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
