"""One local session for all tests."""

import duckdb
import pytest
from pyspark.sql import SparkSession

DATA = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[4]")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    """A function that runs SQL over the tables of a folder."""

    def run(sf_dir: str, sql: str):
        con = duckdb.connect()
        for t in TABLES:
            con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        return con.execute(sql)

    return run


def as_rows(columns, rows):
    """Comparable rows: columns by name, -0.0 as 0.0."""
    columns = list(columns)
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    clean = lambda v: 0.0 if isinstance(v, float) and v == 0 else v
    return sorted(repr([clean(r[i]) for i in order]) for r in rows), sorted(columns)
