import os
import sys
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import SparkSession

REPO = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(REPO))
os.environ["PYTHONPATH"] = f"{REPO}:{os.environ.get('PYTHONPATH', '')}"
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    where = tmp_path_factory.mktemp("spark")
    session = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.driver.memory", "6g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", str(where / "warehouse"))
        .config("spark.checkpoint.dir", f"file://{where}/shared").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(names, values):
    """Rows with columns by name, comparable across engines: doubles to 5 places, whole numbers as int."""

    def plain(v):
        if v is None or v != v:
            return None
        if isinstance(v, bool):
            return v
        if isinstance(v, (list, tuple)):
            return tuple(map(plain, v))
        return round(float(v), 5) + 0.0 if isinstance(v, float) or type(v).__name__ == "Decimal" else v

    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=str)


def same(spark_df, relation):
    assert sorted(spark_df.columns) == sorted(relation.columns)
    assert rows(spark_df.columns, spark_df.collect()) == rows(relation.columns, relation.fetchall())
