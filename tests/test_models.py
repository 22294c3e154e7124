import numpy as np
import pytest
from pyspark.sql import functions as F

from panelcast.operators import arima, learn, mlp, naive, smoothing
from panelcast.operators import panel as P
from panelcast.plans import backtest, report
from panelcast.sources import store


def _loop(y, alpha, beta, gamma, level, trend, season, horizon=12):
    season, errors = list(season), []
    for v in y:
        old = season.pop(0)
        errors.append(v - level - trend - old)
        new = alpha * (v - old) + (1 - alpha) * (level + trend)
        season.append(gamma * (v - level - trend) + (1 - gamma) * old)
        level, trend = new, beta * (new - level) + (1 - beta) * trend
    return np.array([level + (h + 1) * trend + season[h % 12] for h in range(horizon)]), errors


def _first_year(y):
    level = y[:12].mean()
    return level, (y[12:24].mean() - level) / 12, y[:12] - level


def _seasonal(n, seed=0, noise=1.0):
    rng = np.random.default_rng(seed)
    t = np.arange(n)
    return 100 + 0.5 * t + 20 * np.sin(2 * np.pi * t / 12 + seed) + rng.normal(0, noise, n)


@pytest.fixture(scope="module")
def noisy(make_panel):
    values = {(f"c{i}", f"p{i % 3}"): _seasonal(84, seed=i) for i in range(9)}
    return make_panel(values).persist()


@pytest.fixture(scope="module")
def series(noisy):
    return P.split_series(noisy, "2012-01-01", ["2018-01-01"]).where("status = 'ok'").persist()


# --- Holt-Winters ------------------------------------------------------------------------------


def test_fold_and_weights_equal_a_plain_loop(series):
    params = (0.3, 0.1, 0.5)
    fixed = [F.lit(v) for v in params]
    rows = smoothing.forecast_holt_winters(series, *fixed, init="heuristic").collect()
    assert len(rows) == 9
    for row in rows:
        y = np.array(row.y)
        expected, _ = _loop(y, *params, *_first_year(y))
        np.testing.assert_allclose(row.pred, expected, rtol=1e-10)
        weights = smoothing.forecast_weights(len(y), (params,), "heuristic")[0]
        np.testing.assert_allclose(weights @ y, expected, rtol=1e-10)


def test_least_squares_states_equal_a_direct_solve():
    y, params = _seasonal(60), (0.5, 0.3, 0.1)
    _, free = _loop(y, *params, 0.0, 0.0, np.zeros(12))
    basis = np.column_stack(
        [_loop(np.zeros(60), *params, e[0], e[1], e[2:])[1] for e in np.eye(14)]
    )
    states = -np.linalg.lstsq(basis, np.array(free), rcond=1e-10)[0]
    expected, _ = _loop(y, *params, states[0], states[1], states[2:])
    weights = smoothing.forecast_weights(60, (params,), "lsq")[0]
    np.testing.assert_allclose(weights @ y, expected, rtol=1e-9)


def test_exact_and_constant_series_forecast_without_error(make_panel):
    exact = _seasonal(60, noise=0.0)
    panel = make_panel({("exact", "x"): exact, ("constant", "x"): [7.0] * 60})
    rows = P.split_series(panel, "2012-01-01", ["2016-01-01"])
    for grid in [smoothing.GRID[:1], smoothing.GRID[-1:], smoothing.GRID]:
        for row in smoothing.tune_holt_winters(rows, grid).collect():
            assert row.status == "ok" and row.mae < 1e-6


@pytest.mark.parametrize("select_on", ["holdout", "validation"])
def test_grid_search_equals_brute_force(series, select_on):
    tuned = smoothing.tune_holt_winters(series, init="heuristic", select_on=select_on).collect()
    for row in tuned:
        y, actual = np.array(row.y), np.array(row.actual)
        past, target = (y, actual) if select_on == "holdout" else (y[:-12], y[-12:])
        errors = [
            round(np.abs(target - _loop(past, *g, *_first_year(past))[0]).mean(), 6)
            for g in smoothing.GRID
        ]
        best = smoothing.GRID[int(np.argmin(errors))]
        assert (row.alpha, row.beta, row.gamma) == best
        assert row.mae == pytest.approx(min(errors), abs=2e-6)
        np.testing.assert_allclose(row.pred, _loop(y, *best, *_first_year(y))[0], rtol=1e-9)


def test_short_series_keep_their_row_with_a_status(make_panel):
    panel = make_panel({("a", "x"): range(30)})
    rows = P.split_series(panel, "2012-01-01", ["2013-07-01"])
    (row,) = smoothing.tune_holt_winters(rows).collect()
    assert (row.status, row.n_failed, row.alpha, row.pred) == ("too_short", 125, None, None)


def test_saved_parameters_refit_to_the_same_forecast(spark, series, tmp_path):
    path = str(tmp_path / "params")
    tuned = smoothing.tune_holt_winters(series)
    names = ("alpha", "beta", "gamma")
    store.write_params(store.best_params(tuned, names), path)
    saved = store.read_params(spark, path, "tes", 2018)
    assert saved.count() == 9
    refit = smoothing.forecast_holt_winters(store.with_params(series, saved, "tes", names))
    first = {r.Country: r.pred for r in tuned.collect()}
    for row in refit.collect():
        np.testing.assert_allclose(row.pred, first[row.Country], rtol=1e-9)


# --- seasonal ARIMA ----------------------------------------------------------------------------


def _simulate(n, seed, ar=0.0, ma=0.0, sar=0.0, sma=0.0):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(13, n + 200):
        w[t] = ar * w[t - 1] + sar * w[t - 12] - ar * sar * w[t - 13]
        w[t] += e[t] + ma * e[t - 1] + sma * e[t - 12] + ma * sma * e[t - 13]
    return w[200:]


def test_ar1_is_the_least_squares_slope():
    y = np.stack([_simulate(400, s, ar=0.7) for s in range(50)])
    _, coefs = arima.fit_orders(y, [(1, 0, 0, 0, 0, 0)])
    slopes = (y[:, 1:] * y[:, :-1]).sum(axis=1) / (y[:, :-1] ** 2).sum(axis=1)
    np.testing.assert_allclose(coefs[:, 0, 0], slopes, atol=1e-8)
    assert abs(coefs[:, 0, 0].mean() - 0.7) < 0.02


@pytest.mark.parametrize(
    "order, truth",
    [
        ((1, 0, 1, 0, 0, 0), {"ar": 0.7, "ma": 0.4}),
        ((0, 0, 1, 0, 0, 1), {"ma": -0.4, "sma": -0.5}),
        ((1, 0, 0, 1, 0, 0), {"ar": 0.6, "sar": 0.5}),
    ],
)
def test_coefficients_are_recovered_on_average(order, truth):
    y = np.stack([_simulate(400, s, **truth) for s in range(20)])
    _, coefs = arima.fit_orders(y, [order])
    means = dict(zip(("ar", "ma", "sar", "sma"), coefs[:, 0].mean(axis=0)))
    for name, mean in means.items():
        assert abs(mean - truth.get(name, 0.0)) < 0.05


def test_derivatives_equal_differences():
    rng = np.random.default_rng(2)
    w, coef = rng.normal(size=(50, 2)), rng.uniform(-0.6, 0.6, (4, 2))
    used = np.ones(w.shape, dtype=bool)
    errors, slope = arima._residuals(w, coef, used)
    for i in range(4):
        shifted = coef.copy()
        shifted[i] += 1e-6
        moved = arima._residuals(w, shifted, used, gradient=False)
        np.testing.assert_allclose((moved - errors) / 1e-6, slope[:, i], atol=1e-4)


def test_a_lane_does_not_depend_on_its_batch():
    y = np.stack([_seasonal(72, seed=s) for s in range(4)])
    together, _ = arima.fit_orders(y, arima.GRID)
    alone, _ = arima.fit_orders(y[2:3], arima.GRID[20:30])
    np.testing.assert_allclose(alone[0], together[2, 20:30], rtol=1e-6)


def test_forecast_follows_the_model_equation():
    """An ARMA forecast of differenced values, written out step by step."""
    y = np.cumsum(_simulate(120, 5, ar=0.5, ma=0.3))
    preds, coefs = arima.fit_orders(y[None], [(1, 1, 1, 0, 0, 0)], horizon=3)
    ar, ma = coefs[0, 0, :2]
    w, e = np.diff(y), np.zeros(119)
    for t in range(1, 119):
        e[t] = w[t] - ar * w[t - 1] - ma * e[t - 1]
    steps = [ar * w[-1] + ma * e[-1]]
    steps += [ar * steps[0], ar * ar * steps[0]]
    np.testing.assert_allclose(preds[0, 0], y[-1] + np.cumsum(steps), rtol=1e-9)


@pytest.mark.parametrize("select_on", ["holdout", "validation"])
def test_order_search_picks_the_smallest_error(series, select_on):
    orders = arima.GRID[::5]
    for row in arima.tune_arima(series, orders, select_on).collect():
        y, actual = np.array(row.y), np.array(row.actual)
        past, target = (y, actual) if select_on == "holdout" else (y[:-12], y[-12:])
        errors = np.abs(target - arima.fit_orders(past[None], orders)[0][0]).mean(axis=1)
        best = orders[int(np.argmin(errors.round(6)))]
        assert tuple(row[c] for c in arima.ORDER_COLUMNS) == best
        np.testing.assert_allclose(row.pred, arima.fit_orders(y[None], [best])[0][0, 0], rtol=1e-5)


def test_orders_beyond_a_short_history_are_counted(make_panel):
    rows = P.split_series(make_panel({("a", "x"): range(42)}), 2012, ["2014-07-01"])
    (row,) = arima.tune_arima(rows).collect()
    assert row.status == "ok" and 0 < row.n_failed < 64
    rows = P.split_series(make_panel({("a", "x"): range(17)}), 2012, ["2012-06-01"])
    # five months: an order fits when it leaves more residuals than it has coefficients
    (row,) = arima.tune_arima(rows).collect()
    left = [5 - d - 12 * sd - p - 12 * sp - (p + q + sp + sq) for p, d, q, sp, sd, sq in arima.GRID]
    assert row.status == "ok" and row.n_failed == sum(n <= 0 for n in left)
    (row,) = arima.tune_arima(rows, [o for o in arima.GRID if o[4]]).collect()
    assert row.status == "no_fit" and row.n_failed == 32 and row.pred is None


# --- regressors --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def vectors(noisy):
    panel = P.complete_series(noisy, "2012-01-01", "2019-01-01")
    return learn.assemble(learn.training_frame(panel, "2018-01-01")).persist()


def test_frame_has_all_inputs_and_series_sized_folds(vectors):
    row = vectors.first()
    assert row.features.size == 5 + 7 + 40 + 2 + 9 + 3
    train = vectors.where("NOT is_test")
    counts = {r.fold: r["count"] for r in train.groupBy("fold").count().collect()}
    assert sorted(counts) == list(range(5)) and max(counts.values()) - min(counts.values()) <= 1
    assert vectors.where("is_test AND fold IS NOT NULL").count() == 0


@pytest.mark.parametrize("model", ["rf", "gbm"])
def test_trees_beat_the_seasonal_naive_and_repeat(vectors, series, model):
    small = {"maxDepth": 5, **({"numTrees": 20} if model == "rf" else {"maxIter": 15})}
    once = report.score(learn.forecast_regressor(vectors, model, small)).persist()
    again = learn.forecast_regressor(vectors, model, small)
    assert once.select("Country", "Time", "pred").exceptAll(
        again.select("Country", "Time", "pred")
    ).isEmpty()
    base = report.score(P.forecast_rows(naive.seasonal_naive(series)))
    mean = F.avg("smape")
    assert once.count() == 108
    assert once.agg(mean).first()[0] < base.agg(mean).first()[0]


def test_search_returns_one_best_candidate(spark, vectors, tmp_path):
    tuned = learn.tune_regressor(vectors, "rf", {"maxDepth": [2, 6], "numTrees": [5]}, folds=5)
    assert tuned.count() == 2 and tuned.where("best").count() == 1
    assert learn.best_settings(tuned) == {"maxDepth": 6, "numTrees": 5}
    path = str(tmp_path / "params")
    store.write_params(store.best_regressor_params(tuned, "2018-01-01"), path)
    saved = store.read_params(spark, path, "rf", 2018)
    assert learn.best_settings(saved) == {"maxDepth": 6, "numTrees": 5}


def _r2_of(rows, model, params, folds=5):
    """Mean R2 of separate fits, one per fold."""
    out = []
    for fold in range(folds):
        held = rows.where(F.col("fold") == fold)
        fitted = learn.fit_ensemble(rows.where(F.col("fold") != fold), model, params)
        if model == "rf":
            found = fitted.lengths(held, [params["numTrees"]]).selectExpr(
                "label", f"_p{params['numTrees']} AS p"
            )
        else:
            found = fitted.parts[0][1].transform(held).selectExpr("label", "prediction AS p")
        error, spread = found.agg(F.avg((F.col("label") - F.col("p")) ** 2), F.var_pop("label")).first()
        out.append(1 - error / spread)
    return sum(out) / folds


def test_prefix_scores_of_boosting_equal_separate_short_fits(vectors):
    grid = {"stepSize": [0.1, 0.3], "maxDepth": [3], "maxIter": [2, 5, 9]}
    tuned = learn.tune_regressor(vectors, "gbm", grid).collect()
    assert [(r.params["stepSize"], r.params["maxIter"]) for r in tuned] == [
        (s, n) for s in ("0.1", "0.3") for n in ("2", "5", "9")
    ]
    rows = learn.sized(vectors.where("NOT is_test").select("features", "label", "fold"))
    for row in tuned[1:5:3]:
        params = {"stepSize": float(row.params["stepSize"]), "maxDepth": 3}
        params["maxIter"] = int(row.params["maxIter"])
        assert row.r2 == pytest.approx(_r2_of(rows, "gbm", params), rel=1e-9)


def test_prefixes_of_a_forest_equal_separate_forests(vectors, monkeypatch):
    monkeypatch.setattr(learn, "PART_TREES", 4)
    grid = {"maxDepth": [4], "numTrees": [4, 8, 12]}
    tuned = learn.tune_regressor(vectors, "rf", grid).collect()
    rows = learn.sized(vectors.where("NOT is_test").select("features", "label", "fold"))
    for row in tuned[:2]:
        params = {"maxDepth": 4, "numTrees": int(row.params["numTrees"])}
        assert row.r2 == pytest.approx(_r2_of(rows, "rf", params), rel=1e-9)
    with pytest.raises(ValueError, match="no beginning"):
        learn.fit_ensemble(rows, "rf", {"maxDepth": 2, "numTrees": 8}).lengths(rows, [6])


def test_search_shares_the_fits_of_the_longest(vectors, monkeypatch):
    fits = []
    fit = learn.fit_ensemble
    monkeypatch.setattr(learn, "fit_ensemble", lambda r, m, p: fits.append(p) or fit(r, m, p))
    grid = {"stepSize": [0.1, 0.2, 0.3], "maxDepth": [1, 2, 3], "maxIter": [1, 2, 3]}
    tuned = learn.tune_regressor(vectors, "gbm", grid, folds=2)
    assert tuned.count() == 27 and len(fits) == 9 * 2
    assert {p["maxIter"] for p in fits} == {3}


def test_missing_values_are_coded_on_both_sides(spark):
    rows = [(1.0, None), (2.0, 5), (None, 7)]
    frame = spark.createDataFrame(rows, "a double, b int")
    coded, names = learn.two_sided(frame, ["a", "b"])
    assert names == ["a_below", "a_above", "b_below", "b_above"]
    got = coded.select(*names).collect()
    assert (got[2].a_below, got[2].a_above) == (0.0, 3.0)
    assert (got[0].b_below, got[0].b_above) == (3.0, 9.0)
    assert learn.two_sided(frame.fillna(0), ["a", "b"])[1] == ["a", "b"]


def test_one_frame_serves_all_cutoffs(noisy):
    cutoffs = ["2017-01-01", "2018-01-01"]
    short = noisy.where("NOT (Country = 'a' AND Time >= '2018-06-01')")
    frame = backtest.regressor_frames(short, "2012-01-01", cutoffs)
    for cutoff, end in zip(cutoffs, ("2018-01-01", "2019-01-01")):
        alone = learn.training_frame(P.complete_series(short, "2012-01-01", end), cutoff)
        mine = frame.where(F.col("cutoff") == F.lit(cutoff).cast("date")).select(*alone.columns)
        assert mine.exceptAll(alone).isEmpty() and alone.exceptAll(mine).isEmpty()
    plan = frame._jdf.queryExecution().toString()
    assert plan.count("Import_ewm_alpha_09_lag_24") >= 1


def test_backtest_of_several_models_searches_and_keeps_all_rows(noisy, tmp_path):
    cutoffs = ["2017-01-01", "2018-01-01"]
    grids = {
        "gbm": {"maxIter": [2, 4], "maxDepth": [3]},
        "mlp": {"alpha": [0.1], "hidden": [(4,)]},
    }
    path = str(tmp_path / "params")
    scored = backtest.backtest_regressors(
        noisy, "2012-01-01", cutoffs, ("lgbm", "gbm", "mlp"), grids=grids, saved=path,
        params={"lgbm": {"maxIter": 2, "maxDepth": 3}},
    )
    assert {(r.model, str(r.cutoff), r["count"]) for r in scored.groupBy("model", "cutoff").count().collect()} == {
        (m, c, 108) for m in ("lgbm", "gbm", "mlp") for c in cutoffs
    }
    assert store.read_params(noisy.sparkSession, path).count() == 4


def test_waves_hold_a_bounded_number_of_weights(spark):
    assert mlp.waves({1: 5, 2: 5, 3: 9, 4: 30, 5: 1}, 10) == [[1, 2], [3], [4], [5]]
    rng = np.random.default_rng(6)
    rows = [(v.tolist(), float(v[0]), i % 5) for i, v in enumerate(rng.normal(size=(60, 3)))]
    data = spark.createDataFrame(rows, "x array<double>, label double, fold int").coalesce(2)
    settings = {i: {"alpha": 0.1, "hidden": (4, 3), "left_out": i - 1} for i in range(3)}
    together = mlp.train_networks(data, 3, settings, max_iter=6)
    before, mlp.WAVE_WEIGHTS, mlp.SLICE = (mlp.WAVE_WEIGHTS, mlp.SLICE), 1, 7
    try:
        apart = mlp.train_networks(data, 3, settings, max_iter=6)
    finally:
        mlp.WAVE_WEIGHTS, mlp.SLICE = before
    for key in settings:
        np.testing.assert_allclose(together[key][0], apart[key][0], rtol=1e-7)


def test_orders_are_dealt_by_cost():
    hands = arima.deal(arima.GRID, 8)
    assert sorted(i for hand in hands for i in hand) == list(range(64))
    costs = [sum(arima.cost_of(arima.GRID[i]) for i in hand) for hand in hands]
    assert max(costs) < 1.1 * min(costs)
    assert arima.deal(arima.GRID[:3], 3) and len(arima.deal(arima.GRID[:3], 3)) == 3


def test_certificates_hold_and_no_grid_point_is_better(noisy):
    rows = P.split_series(noisy, "2012-01-01", ["2018-01-01"]).where("Country = 'a'")
    found = arima.certify_arima(rows, points=(-0.9, -0.45, 0.0, 0.45, 0.9)).collect()
    assert len(found) == 64 * rows.count()
    assert all(r.sse <= r.least * (1 + 1e-9) for r in found)
    assert all(r.slope < 1e-4 for r in found)


def test_network_gradient_equals_differences():
    rng = np.random.default_rng(0)
    x, label = rng.normal(size=(20, 4)), rng.normal(size=20)
    shapes = mlp._shapes(4, (5, 3))
    flat = mlp.initial_weights(4, (5, 3), 1)
    loss, grad = mlp.batch_gradient(x, label, flat, shapes)
    for i in range(0, len(flat), 7):
        moved = flat.copy()
        moved[i] += 1e-6
        assert (mlp.batch_gradient(x, label, moved, shapes)[0] - loss) / 1e-6 == pytest.approx(
            grad[i], abs=1e-4
        )


def test_lbfgs_solves_a_quadratic():
    scale = np.array([1.0, 10.0, 100.0])
    run = mlp.lbfgs(np.ones(3), 100)
    x = next(run)
    with pytest.raises(StopIteration) as end:
        while True:
            x = run.send((0.5 * float(scale @ (x - 2) ** 2), scale * (x - 2)))
    np.testing.assert_allclose(end.value.value, 2.0, atol=1e-3)


def test_distributed_gradient_equals_one_batch(spark):
    rng = np.random.default_rng(3)
    x, label = rng.normal(size=(60, 3)), rng.normal(size=60)
    rows = [(v.tolist(), float(t), i % 5) for i, (v, t) in enumerate(zip(x, label))]
    data = spark.createDataFrame(rows, "x array<double>, label double, fold int").repartition(4)
    shapes, flat = mlp._shapes(3, (4,)), mlp.initial_weights(3, (4,), 1)
    sums = mlp.total_gradients(data, {0: (flat, shapes, -1), 1: (flat, shapes, 2)})
    keep = np.arange(60) % 5 != 2
    for key, chosen in ((0, keep | True), (1, keep)):
        loss, grad = mlp.batch_gradient(x[chosen], label[chosen], flat, shapes)
        assert sums[key][0] == chosen.sum() and sums[key][1] == pytest.approx(loss)
        np.testing.assert_allclose(sums[key][2], grad, rtol=1e-9)


def test_network_learns_and_search_ranks(vectors):
    scored = report.score(mlp.forecast_mlp(vectors, {"hidden": (8,)}, max_iter=30))
    assert scored.count() == 108 and scored.agg(F.avg("smape")).first()[0] < 20
    grid = {"alpha": [0.1, 100.0], "hidden": [(8,)]}
    rows = mlp.tune_mlp(vectors, grid, max_iter=15).collect()
    assert [r.params["alpha"] for r in rows] == ["0.1", "100.0"]
    assert [r.best for r in rows] == [r.r2 == max(r.r2 for r in rows) for r in rows]


def test_networks_trained_in_step_equal_single_ones(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(80, 3))
    rows = [(v.tolist(), float(v[0] + 2), i % 5) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "x array<double>, label double, fold int").coalesce(1)
    settings = {i: {"alpha": 0.1, "hidden": (4,), "left_out": i - 1} for i in range(3)}
    together = mlp.train_networks(data, 3, settings, max_iter=8)
    for key in settings:
        alone = mlp.train_networks(data, 3, {key: settings[key]}, max_iter=8)
        np.testing.assert_allclose(together[key][0], alone[key][0], rtol=1e-6)


# --- reports -----------------------------------------------------------------------------------


def test_backtest_and_reports_agree(noisy):
    scored = backtest.backtest_series(
        noisy, "2012-01-01", ["2017-01-01", "2018-01-01"], hw_grid=smoothing.GRID[::9],
        arima_grid=[(0, 1, 0, 0, 1, 0), (0, 1, 1, 0, 1, 1)],
    ).persist()
    assert scored.count() == 2 * 2 * 9 * 12
    board = report.leaderboard(scored).where("Product IS NULL").collect()
    direct = {r.model: r.m for r in scored.groupBy("model").agg(F.avg("smape").alias("m")).collect()}
    assert {r.model: r.mean_smape for r in board} == pytest.approx(direct)
    ranked = [r.mean_smape for r in report.rank_by(scored).collect()]
    assert ranked == sorted(ranked)
    wide = report.scored_wide(scored, ["tes", "sarima"])
    assert wide.columns[3:] == ["cutoff", "Import", "tes", "TES_smape", "sarima", "SARIMA_smape"]
    assert wide.count() == 2 * 9 * 12 and wide.where("tes IS NULL OR sarima IS NULL").isEmpty()
    assert {r.countries for r in report.coverage(scored).collect()} == {3}
    assert report.attach_actuals(
        scored.drop("real"), noisy
    ).exceptAll(scored.select(*report.FORECAST_KEYS, *[
        c for c in scored.columns if c not in (*report.FORECAST_KEYS, "real")], "real")).isEmpty()


def test_missing_errors_rank_last(spark):
    rows = [("a", 3.0), ("b", None), ("c", 1.0)]
    scored = spark.createDataFrame(rows, "Product string, smape double")
    assert [r.Product for r in report.rank_by(scored).collect()] == ["c", "a", "b"]
