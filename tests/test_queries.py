"""Every query with SQL gives the same rows as DuckDB, at the smallest scale."""

import duckdb
import pandas as pd
import pytest

from fixturelake.plans import attached, catalogue, feeds, lists, stored, streams  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events pages".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def rows_of(df: pd.DataFrame) -> list:
    df = df[sorted(df.columns)].convert_dtypes()
    for c in df.columns:
        if str(df[c].dtype).startswith("Float"):
            df[c] = df[c].round(5) + 0.0
    return sorted(tuple("-" if str(v) in ("None", "<NA>", "NaT", "nan") else str(v).removesuffix(" 00:00:00") for v in row) for row in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows_as_sql(spark, duck, name):
    ours = catalogue.QUERIES[name](spark, SF).toPandas()
    theirs = duck.execute(catalogue.ORACLES[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows_of(ours) == rows_of(theirs)


def test_model_scores_are_probabilities(spark):
    with pytest.raises(ValueError, match="training rows"):
        catalogue.model_scores(spark, SF)
    out = catalogue.model_scores(spark, SF.replace("0.001", "0.01")).toPandas()
    assert set(out.model) == {"gbt", "mlp", "forest", "ensemble"}
    assert (abs(out.home_p + out.draw_p + out.away_p - 1) < 1e-5).all()


@pytest.mark.parametrize("name", ["all_results_newest_first", "predictions_of_day", "matches_of_day_by_league"])
def test_lists_are_in_order(spark, name):
    rows = [tuple(r) for r in catalogue.QUERIES[name](spark, SF).collect()]
    key = {"all_results_newest_first": lambda r: (-r[4].timestamp(), -r[0]), "predictions_of_day": lambda r: -r[3], "matches_of_day_by_league": lambda r: (r[1], r[2])}[name]
    assert rows == sorted(rows, key=key)


def test_entry_runs_on_its_own(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
