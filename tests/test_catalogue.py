"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pandas as pd
import pytest

from sceneqa.queries import catalogue
from sceneqa.sources.tables import TABLES


def rows(df: pd.DataFrame) -> list[tuple]:
    def plain(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
            return None
        return v.item() if hasattr(v, "item") else v

    return sorted((tuple(plain(v) for v in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_against_sql(spark, sf, con, name):
    df = catalogue.queries()[name](spark, sf)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    cursor = con.execute(catalogue.oracle_sql()[name])
    want = pd.DataFrame(cursor.fetchall(), columns=[d[0] for d in cursor.description], dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__ as entry

    assert sum(r.n for r in entry.entry(spark).collect()) > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_bin_pack_holds_capacity(spark, sf):
    got = catalogue.queries()["bin_pack"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "n_chars").toPandas()
    assert sorted(got["key"]) == sorted(docs["doc_id"])
    for _, bin_ in got.groupby(["batch", "bin"]):
        assert bin_["size"].sum() <= 4096 or len(bin_) == 1


def test_two_stage_draw(spark, sf):
    from pyspark.sql import functions as F

    from sceneqa.operators import sampling as S

    drawn = catalogue.queries()["two_stage_draw"](spark, sf)
    observed = drawn.groupBy("category").agg((F.count("*") / F.lit(20_000.0)).alias("observed"))
    expected = drawn.select("category").distinct().withColumn("expected", F.lit(0.25))
    assert all(r.ok for r in S.assert_shares(observed, expected, "category").collect())
