import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parents[1])
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g").getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    connection = duckdb.connect()
    connection.execute("set timezone = 'UTC'")
    for path in Path(SF).iterdir():
        connection.execute(f"create view {path.name.split('.')[0]} as select * from '{path}'")
    return connection


@pytest.fixture(scope="session")
def same_as_sql(spark, duck):
    """Whether a query's rows are those of its SQL, whatever their order."""
    import decimal
    import math

    def plain(v):
        if isinstance(v, decimal.Decimal):
            return float(v)
        if isinstance(v, float):
            return None if math.isnan(v) else round(v, 8) + 0.0
        return v

    def check(query, sql):
        df = query(spark, SF)
        result = duck.execute(sql)
        names = [x[0] for x in result.description]
        assert sorted(names) == sorted(df.columns)
        want = [tuple(map(plain, r)) for r in result.fetchall()]
        got = [tuple(plain(r[n]) for n in names) for r in df.collect()]
        assert sorted(got, key=repr) == sorted(want, key=repr)

    return check
