"""Every registered query that has SQL gives what DuckDB gives on the small tables."""

import duckdb
import pandas as pd
import pytest

from barloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()


def rows(df: pd.DataFrame) -> list[tuple]:
    plain = lambda x: None if x is None or x is pd.NaT or (isinstance(x, float) and x != x) else round(float(x), 6) + 0.0 if isinstance(x, (int, float)) and not isinstance(x, bool) else x
    return sorted((tuple(plain(x.item() if hasattr(x, "item") else x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


PICKED = ["src_walk_bars", "clean_standardise", "clean_problems", "ind_macd", "ind_adx", "ind_rsi", "ind_cci", "ind_realized_volatility", "agg_composites", "fund_trailing_pe", "fund_fair_value", "fund_market_context", "stat_jarque_bera", "stat_ks_uniform", "stat_diebold_mariano", "model_garch_path", "model_reaction_days", "model_ornstein_uhlenbeck", "eval_score_forecasts", "eval_segments", "eval_long_only_rule", "bt_chosen_models", "stream_intraday_bars", "stat_unit_root", "bt_resume_work"]


@pytest.mark.parametrize("name", PICKED)
def test_equals_sql(spark, con, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    want = con.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
