import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    return s


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


def normal(rows):
    """Rows as sorted tuples by column name; floats rounded, nulls as None."""

    def one(v):
        if v is None or str(v) in ("nan", "NaN", "<NA>", "NaT"):
            return None
        if isinstance(v, str):
            return v
        if isinstance(v, float) or hasattr(v, "as_tuple"):
            return round(float(v), 6)
        return int(v) if hasattr(v, "__int__") else v

    return sorted((tuple(one(r[k]) for k in sorted(r)) for r in rows), key=str)


@pytest.fixture(scope="session")
def same_as_oracle(spark, sf):
    """Whether a query gives its oracle's rows."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.sql(f"create view {f[:-8]} as select * from read_parquet('{sf}/{f}')")

    def check(df, sql):
        got = df.toPandas()
        want = con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert normal(got.astype(object).to_dict("records")) == normal(want.astype(object).to_dict("records"))

    return check
