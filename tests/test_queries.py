import os

import duckdb
import pandas as pd
import pytest

from tidemark import plans

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def table(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].astype(object).where(df.notna(), None)
    text = lambda v: str(v)[:10] if hasattr(v, "year") and not getattr(v, "hour", 0) and str(v)[10:].strip(" 0:") == "" else repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    return sorted(tuple(map(text, r)) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_agrees_with_sql(spark, con, name):
    got, want = plans.QUERIES[name](spark, SF).toPandas(), con.sql(plans.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert table(got) == table(want)


def test_features_do_not_look_past_the_cutoff(spark, tmp_path):
    """Features at the first cutoff are the same if nothing after it was ever recorded."""
    whole = plans.QUERIES["features_wide"](spark, SF).where("cutoff = '2024-01-10'").toPandas()
    spark.read.parquet(f"{SF}/events.parquet").where("ts < timestamp_ntz'2024-01-11 00:00:00'").write.parquet(str(tmp_path / "events.parquet"))
    cut = plans.QUERIES["features_wide"](spark, str(tmp_path)).where("cutoff = '2024-01-10'").toPandas()
    assert len(whole) and table(whole) == table(cut)
