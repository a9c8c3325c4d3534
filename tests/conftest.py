import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from tributary.session import build_session

    folder = tmp_path_factory.mktemp("shared")
    s = build_session(master="local[4]", spark_sql_shuffle_partitions="4", spark_ui_enabled="false", spark_checkpoint_dir=f"file://{folder}", spark_sql_warehouse_dir=str(folder / "warehouse"))
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


REVIEW = "review_id string, user_id string, business_id string, stars double, text string, event_time timestamp, ingest_time timestamp, id string, k string, n long"


@pytest.fixture(scope="session")
def make_reviews(spark):
    """Rows of reviews from dictionaries, with columns whose names clash with inner ones."""
    from datetime import datetime

    def make(rows):
        base = {"review_id": None, "user_id": "u", "business_id": "b", "stars": 3.0, "text": "t", "event_time": datetime(2020, 1, 1, 10), "ingest_time": datetime(2020, 1, 1, 10, 5), "id": "x", "k": "y", "n": 7}
        return spark.createDataFrame([tuple((base | r).values()) for r in rows], REVIEW)

    return make


@pytest.fixture(scope="session")
def oracle():
    """Rows of a query by DuckDB over the smallest tables."""
    import duckdb

    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for p in Path(SMALL).glob("*.parquet"):
        c.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return c


def plain(value):
    import datetime
    import decimal

    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 5) + 0.0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def compare(spark, oracle, query, sql, folder=SMALL):
    df = query(spark, folder)
    names = sorted(df.columns)
    mine = [[plain(r[c]) for c in names] for r in df.collect()]
    told = oracle.execute(sql)
    at = {d[0]: i for i, d in enumerate(told.description)}
    assert sorted(at) == names
    theirs = [[plain(r[at[c]]) for c in names] for r in told.fetchall()]
    key = lambda r: [(v is None, str(v)) for v in r]
    assert sorted(mine, key=key) == sorted(theirs, key=key)
