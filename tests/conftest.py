import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    shared = tmp_path_factory.mktemp("shared")
    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{shared}").config("spark.sql.warehouse.dir", f"{shared}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(DATA):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck):
    """Holds a query against its SQL: names, row count, and values without order."""

    def compare(query, sql):
        df = query(spark, DATA)
        got = df.select(*sorted(df.columns)).toPandas()
        want = duck.execute(sql).df()
        assert sorted(df.columns) == sorted(want.columns)
        text = lambda x: sorted(map(str, x.astype(object).where(x.notna(), None).itertuples(index=False, name=None)))
        norm = lambda x: text(x[sorted(x.columns)].apply(lambda c: c.astype(float) if c.dtype.kind in "iuf" else c))
        assert norm(got) == norm(want)

    return compare
