"""Shapes of physical plans, and the shared folder."""

import math
import os

import pytest
from pyspark.sql import functions as F

from panelcast.operators import arima, features, learn, mlp, smoothing
from panelcast.operators import panel as P
from panelcast.plans import backtest, catalog, report
from panelcast.session import shared_dir, shared_path
from panelcast.sources import store

FOLDER = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
needs_tables = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@needs_tables
@pytest.mark.parametrize(
    "name",
    ["panel_base", "panel_dense", "complete_series", "feature_frame", "leaderboard", "hw_lsq",
     "arima_forecast", "param_grid", "backtest_hw", "scored_wide"],
)
def test_no_plan_pairs_all_rows(spark, name):
    plan = _plan(catalog.queries()[name](spark, FOLDER))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan


@needs_tables
def test_period_and_columns_reach_the_scan(spark):
    plan = _plan(catalog.queries()["period_bounds"](spark, FOLDER))
    scan = next(line for line in plan.splitlines() if "lineitem.parquet" in line)
    assert "GreaterThanOrEqual(l_shipdate" in scan
    assert "ReadSchema: struct<l_orderkey:bigint,l_extendedprice:double,l_shipdate" in scan


@needs_tables
@pytest.mark.parametrize("name", ["rf_month_means", "gbm_month_means", "mlp_line", "lgbm_missing_side"])
def test_training_reads_saved_series_and_not_the_lines(spark, name):
    files = catalog.queries()[name](spark, FOLDER).inputFiles()
    assert files and not [f for f in files if "lineitem" in f or "orders" in f]


def test_searches_run_once_even_when_filtered(make_panel):
    panel = make_panel({("a", "x"): range(84), ("b", "x"): range(84)})
    series = P.split_series(panel, "2012-01-01", ["2018-01-01"]).where("status = 'ok'")
    for tuned in (smoothing.tune_holt_winters(series), arima.tune_arima(series)):
        assert _plan(tuned.where("status = 'ok'")).count("ArrowEvalPython") == 1


def test_regressors_read_the_panel_once(spark, make_panel):
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    panel = make_panel({("a", "x"): range(1, 85), ("b", "x"): range(2, 86)})
    panel = panel.mapInArrow(counted, panel.schema)
    scored = backtest.backtest_regressors(
        panel, "2012-01-01", ["2017-01-01", "2018-01-01"], ("gbm",), {"gbm": {"maxIter": 1, "maxDepth": 2}}
    )
    assert scored.count() == 48
    assert seen.value == 2 * 84


def test_models_share_one_grouping_of_the_panel(make_panel):
    panel = make_panel({("a", "x"): range(84), ("b", "x"): range(84)})
    scored = backtest.backtest_series(
        panel, "2012-01-01", ["2018-01-01"], hw_grid=smoothing.GRID[:2], arima_grid=arima.GRID[:2]
    )
    assert scored.count() == 48
    scored.collect()
    final = _plan(scored).split("Initial Plan")[0].splitlines()
    shuffles = [line for line in final if "Exchange hashpartitioning" in line]
    # A reused shuffle is printed with the one it stands for.
    assert ["ReusedExchange" in line for line in shuffles] == [False, True]


def test_features_keep_the_partitioning_for_later_series_work(make_panel):
    panel = P.complete_series(make_panel({("a", "x"): range(30)}), 2012, 2014)
    assert _plan(features.build_features(panel)).count("Exchange") == 1


class _Session:
    """Stands in for a session on a cluster, whose setting cannot change while it runs."""

    def __init__(self, master, folder):
        self.sparkContext, self.conf = self, {"spark.checkpoint.dir": folder}
        self.master, self.used = master, None

    def getCheckpointDir(self):
        return self.used

    def setCheckpointDir(self, folder):
        self.used = folder


def test_shared_folder_follows_the_session(spark):
    assert shared_dir(spark) == shared_dir(spark) and shared_path(spark, "t") != shared_path(spark, "t")
    cluster = _Session("spark://host:7077", "hdfs:///shared")
    assert shared_dir(cluster) == cluster.used == "hdfs:///shared"
    assert shared_path(cluster, "t").startswith("hdfs:///shared/t-")
    with pytest.raises(ValueError):
        shared_dir(_Session("yarn", None))


def test_every_report_covers_both_test_years(make_panel):
    panel = make_panel({("a", "x"): range(96), ("b", "y"): range(96)})
    scored = backtest.backtest_series(
        panel, 2012, [2018, 2019], ("tes",), hw_grid=smoothing.GRID[:3]
    )
    ranked = report.rank_products(scored).collect()
    assert [(r.year, r.model, r.Product) for r in ranked] != []
    assert {(r.year, r.Product) for r in ranked} == {
        (2018, "x"), (2018, "y"), (2019, "x"), (2019, "y")
    }


def test_registered_pipeline_searches_all_candidates_of_the_full_grids(spark, make_panel, monkeypatch):
    panel = make_panel({("a", "x"): range(1, 73), ("b", "y"): range(2, 74)}, start="1995-01-01")
    monkeypatch.setattr(catalog, "_panel", lambda spark, folder: panel)
    asked, refits = [], []

    def search(vectors, model, grid, cutoff, parallelism):
        size = math.prod(len(values) for values in grid.values())
        asked.append((model, cutoff, size, grid))
        winner = {name: str(values[-1]) for name, values in grid.items()}
        schema = "model string, params map<string,string>, r2 double, best boolean"
        return store.best_regressor_params(spark.createDataFrame([(model, winner, 1.0, True)], schema), cutoff)

    def forecast(vectors, model, settings):
        refits.append((model, settings))
        return vectors.where("is_test").select(
            *P.KEYS, "Time", F.lit(model).alias("model"), F.col("real").alias("pred"), "real"
        )

    monkeypatch.setattr(backtest, "_search", search)
    monkeypatch.setattr(backtest, "_forecast", forecast)
    ranked = catalog.queries()["regressor_pipeline"](spark, FOLDER).collect()
    assert len(ranked) == 2 * 6 * 2
    full = {"lgbm": 54, "rf": 27, "mlp": 12, "gbm": 27, "xgb": 54, "catb": 18}
    assert {(model, cutoff): size for model, cutoff, size, _ in asked} == {
        (model, cutoff): size for model, size in full.items() for cutoff in catalog.CUTOFFS
    }
    assert all(grid == {**learn.FULL_GRIDS, "mlp": mlp.FULL_GRID}[model] for model, _, _, grid in asked)
    # the winners are read back as they were saved
    last = {model: {n: v[-1] for n, v in grid.items()} for model, _, _, grid in asked}
    assert sorted(m for m, _ in refits) == sorted(2 * list(full))
    assert all(settings == last[model] for model, settings in refits)
