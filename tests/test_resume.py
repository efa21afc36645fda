"""A kept walk-forward test, carried on, against a full run."""

import pandas as pd
import pytest
from conftest import walk
from pyspark.sql import functions as F

from barloom.plans import resume, walkforward
from barloom.settings import load_settings
from barloom.sources import files

S = load_settings(forecast={"monte_carlo_paths": 120}, walk_forward={"min_training_days": 300, "forecast_every_days": 5, "refit_every_days": 10, "min_scored_forecasts_for_model_selection": 3}, models={"hmm": {"max_iterations": 20, "random_restarts": 1}, "garch": {"max_iterations": 60}, "merton": {"max_iterations": 60}})


@pytest.fixture(scope="module")
def prepared(spark):
    bars = spark.createDataFrame(pd.concat([walk(382, 1, "A"), walk(377, 2, "B"), walk(332, 3, "C")]))
    return walkforward.prepare(bars, spark.createDataFrame([], files.EARNINGS), S).checkpoint()


def table(df) -> pd.DataFrame:
    return df.toPandas().sort_values(["ticker", "position", "model"]).reset_index(drop=True)


def same(got: resume.Resumed, prepared) -> None:
    records, log = walkforward.walk_forward(prepared, S)
    want = table(records)
    pd.testing.assert_frame_equal(table(got.records)[want.columns], want, check_dtype=False, check_exact=True)
    logged = lambda df: sorted((r["ticker"], r["refit"], tuple(r["kept"]), r["garch_persistence"]) for r in df.collect())
    assert logged(got.refits) == logged(log)


def origins(prepared) -> int:
    return walkforward.test_origins(prepared, S).agg(F.sum(F.size("positions"))).first()[0]


def test_carried_on_equals_a_full_run(spark, prepared, tmp_path):
    folder = str(tmp_path / "kept")
    # Five days less of two tickers, a good many less of A: a refit half done, and one whole range.
    last = F.when(F.col("ticker") == "A", 366).when(F.col("ticker") == "B", 372).otherwise(332)
    before = prepared.where(F.col("position") < last)
    first = resume.resumed_walk_forward(before, S, folder)
    assert first.origins_run == origins(before)
    second = resume.resumed_walk_forward(prepared, S, folder)
    assert second.origins_run == origins(prepared) - origins(before) == 4
    same(second, prepared)
    assert resume.resumed_walk_forward(prepared, S, folder).origins_run == 0

    # A changed old bar counts from the first origin that sees it.
    changed = prepared.withColumn("x", F.when((F.col("ticker") == "B") & (F.col("position") == 352), F.col("x") + 0.01).otherwise(F.col("x"))).checkpoint()
    third = resume.resumed_walk_forward(changed, S, folder)
    touched = walkforward.test_origins(changed, S).where("ticker = 'B'").select(F.explode("positions").alias("p")).where("p + 5 >= 352").count()
    assert third.origins_run == touched
    same(third, changed)
    resume.compacted(changed, S, folder, str(tmp_path / "compact"))
    assert resume.resumed_walk_forward(changed, S, str(tmp_path / "compact")).origins_run == 0
    assert spark.read.parquet(str(tmp_path / "compact/engine")).count() == origins(changed)


def test_new_settings_count_as_new(prepared):
    other = load_settings(forecast={"monte_carlo_paths": 121})
    assert resume.settings_print(S) != resume.settings_print(other)
    assert resume.settings_print(S) == resume.settings_print(S | {"output": {"directory": "elsewhere"}})
