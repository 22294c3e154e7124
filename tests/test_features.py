import numpy as np
import pandas as pd
import pytest

from panelcast.operators import features


def _frame(df):
    return df.orderBy("Country", "Product", "Time").toPandas()


def _random(make_panel, n=40, keys=(("a", "x"), ("a", "y"), ("b", "x"))):
    rng = np.random.default_rng(1)
    return make_panel({k: rng.uniform(1, 100, n) for k in keys})


def test_lags_stay_inside_a_series_unless_asked(make_panel):
    panel = make_panel({("a", "x"): [1, 2], ("a", "y"): [3, 4]})
    own = _frame(features.lag_features(panel, [1]))["Import_lag_1"]
    wide = _frame(features.lag_features(panel, [1], ("Country",), ("Product", "Time")))
    assert own.fillna(-1).tolist() == [-1, 1, -1, 3]
    assert wide["Import_lag_1"].fillna(-1).tolist() == [-1, 1, 2, 3]


@pytest.mark.parametrize("keys", [["Country", "Product"], ["Country"]])
def test_features_equal_their_definition(make_panel, monkeypatch, keys):
    # Small blocks, so that the country-wide variant crosses several of them.
    monkeypatch.setattr(features, "BLOCK", 16)
    panel = _random(make_panel)
    order = ("Time",) if len(keys) == 2 else ("Product", "Time")
    out = _frame(features.build_features(panel, tuple(keys), order))
    groups = [g.to_numpy() for _, g in _frame(panel).groupby(keys)["Import"]]

    def expected(of):
        return np.concatenate([[of(g, t) for t in range(len(g))] for g in groups])

    for lag in features.LAGS:
        want = expected(lambda g, t: g[t - lag] if t >= lag else np.nan)
        np.testing.assert_allclose(out[f"Import_lag_{lag}"], want)
    for n in features.WINDOWS:
        weights = np.array(features.triangular_weights(n))
        want = expected(lambda g, t: float(g[t - n : t] @ weights) if t >= n else np.nan)
        np.testing.assert_allclose(out[f"Import_roll_mean_{n}"], want)
    for alpha in features.ALPHAS:
        for lag in features.EWM_LAGS:

            def decayed(g, t):
                weights = (1 - alpha) ** np.arange(t - lag, -1, -1.0)
                return weights @ g[: t - lag + 1] / weights.sum() if t >= lag else np.nan

            name = f"Import_ewm_alpha_{features.alpha_tag(alpha)}_lag_{lag}"
            np.testing.assert_allclose(out[name], expected(decayed), rtol=1e-12)


@pytest.mark.parametrize("gap", [0, 3, 40, 700])
def test_country_wide_means_cross_gaps_of_any_length(make_panel, monkeypatch, gap):
    monkeypatch.setattr(features, "BLOCK", 16)
    monkeypatch.setattr(features, "EWM_REACH", 400)
    rng = np.random.default_rng(gap)
    values = {
        ("a", "x"): [*rng.uniform(1, 9, 21), *[None] * gap],
        ("a", "y"): [None, 5.0, None, *rng.uniform(1, 9, 30)],
        ("b", "x"): [None] * 5 + [2.0],
    }
    out = _frame(features.ewm(make_panel(values), [0.9, 0.1], ("Country",), ("Product", "Time")))
    for country in "ab":
        mine = [v for key, part in values.items() if key[0] == country for v in part]
        for alpha in (0.9, 0.1):
            n, d, age, want = 0.0, 0.0, 1, []
            for v in mine:
                if v is not None:  # a gap ages both sums alike and leaves their ratio
                    n, d = n * (1 - alpha) ** age + v, d * (1 - alpha) ** age + 1
                age = 1 if v is not None else age + 1
                want.append(n / d if d else np.nan)
            got = out.loc[out.Country == country, f"Import_ewm_alpha_{features.alpha_tag(alpha)}"]
            np.testing.assert_allclose(got, want, rtol=1e-9)


def test_window_of_two_is_the_plain_mean_and_constants_stay(make_panel):
    out = _frame(features.build_features(make_panel({("a", "x"): [7.0] * 30})))
    derived = [c for c in out.columns if c.startswith("Import_")]
    assert len(derived) == 5 + 7 + 40
    np.testing.assert_allclose(out[derived].iloc[-1], 7.0)
    pair = _frame(features.rolling_features(make_panel({("a", "x"): [1, 3, 9]}), [2]))
    assert pair["Import_roll_mean_2"].iloc[2] == 2.0


def test_ewm_carries_over_missing_values(make_panel):
    values = [None, 1.0, None, 4.0, 2.0]
    out = _frame(features.ewm(make_panel({("a", "x"): values}), [0.5]))
    expected = pd.Series(values, dtype=float).ewm(alpha=0.5).mean()
    np.testing.assert_allclose(out["Import_ewm_alpha_05"], expected)


def test_blocks_lose_and_repeat_no_row(make_panel, monkeypatch):
    monkeypatch.setattr(features, "BLOCK", 8)
    panel = _random(make_panel, n=50)
    out = features.ewm(panel, [0.5], ("Country",), ("Product", "Time"))
    assert out.count() == out.select("Country", "Product", "Time").distinct().count() == 150


def test_jitter_is_seeded(make_panel):
    panel = _random(make_panel)
    first = _frame(features.jitter(panel, "Import", 2.0, seed=3))
    again = _frame(features.jitter(panel, "Import", 2.0, seed=3))
    assert first.equals(again) and not first.equals(_frame(panel))


def test_features_need_one_shuffle(make_panel):
    plan = features.build_features(_random(make_panel))._jdf.queryExecution().executedPlan()
    assert plan.toString().count("Exchange") == 1


@pytest.mark.parametrize("keys", [["Country", "Product"], ["Country"]])
def test_means_of_long_series_equal_pandas(make_panel, keys):
    """Series longer than a block, with signs, gaps and very unequal sizes."""
    rng = np.random.default_rng(4)
    values = rng.normal(0, 1, 700) * 10.0 ** rng.integers(-3, 6, 700)
    values = [None if i % 97 == 5 else v for i, v in enumerate(values)]
    panel = make_panel({("a", "x"): values, ("a", "y"): values[:300], ("b", "x"): values[:40]})
    order = ("Time",) if len(keys) == 2 else ("Product", "Time")
    out = _frame(features.ewm_features(panel, [0.9, 0.5, 0.1], [1], tuple(keys), order))
    groups = _frame(panel).groupby(keys)["Import"]
    for alpha in (0.9, 0.5, 0.1):
        expected = groups.transform(lambda x: x.shift(1).ewm(alpha=alpha).mean())
        # Sums of mixed signs: compare on the scale of the values that enter.
        size = groups.transform(lambda x: x.abs().shift(1).ewm(alpha=alpha).mean())
        error = (out[f"Import_ewm_alpha_{features.alpha_tag(alpha)}_lag_1"] - expected).abs()
        assert (error / size).max() < 1e-12
        assert out[f"Import_ewm_alpha_{features.alpha_tag(alpha)}_lag_1"].isna().equals(
            expected.isna()
        )


def test_means_survive_gaps_of_any_length(spark):
    """A gap inside a block, one over several blocks, and one before the first value."""
    import numpy as np

    gaps = {"P": (191, 330), "Q": (301, 1100), "R": (0, 700)}
    rng = np.random.default_rng(1)
    rows, want = [], {}
    order = 0
    state = {k: (None, 0.0) for k in ("wide", *gaps)}
    for product, (low, high) in gaps.items():
        for i in range(1200):
            value = None if low <= i < high else float(rng.random())
            day = f"{1900 + i // 12}-{i % 12 + 1:02d}-01"
            rows.append(("A", product, day, value))
            for group in ("wide", product):
                mean, weight = state[group]
                weight *= 0.1
                if value is not None:
                    mean = value if mean is None else (mean * weight + value) / (weight + 1)
                    weight += 1
                state[group] = (mean, weight)
                want[(group == "wide", product, day)] = mean
            order += 1
    panel = spark.createDataFrame(rows, "Country string, Product string, Time string, Import double")
    panel = panel.selectExpr("Country", "Product", "CAST(Time AS DATE) AS Time", "Import")
    for across in (False, True):
        options = {"keys": ("Country",), "order": ("Product", "Time")} if across else {}
        found = features.ewm(panel, alphas=(0.9,), **options).collect()
        assert len(found) == 3600
        for r in found:
            mean = want[(across, r.Product, str(r.Time))]
            got = r["Import_ewm_alpha_09"]
            assert (got is None) == (mean is None), (across, r.Product, r.Time)
            assert mean is None or abs(got - mean) < 1e-12


def test_noise_is_normal_and_the_same_in_any_partitioning(spark):
    rows = [(f"c{i % 50}", f"p{i}", None) for i in range(20_000)]
    frame = spark.createDataFrame(rows, "Country string, Product string, Time date").withColumn(
        "z", features.normal_noise(("Country", "Product", "Time"), 7)
    )
    other = frame.drop("z").repartition(13).withColumn(
        "z", features.normal_noise(("Country", "Product", "Time"), 7)
    )
    assert frame.exceptAll(other).isEmpty()
    z = np.array([r.z for r in frame.select("z").collect()])
    assert abs(z.mean()) < 0.03 and abs(z.std() - 1) < 0.03
    assert abs((np.abs(z) < 1).mean() - 0.6827) < 0.01
    seeds = frame.withColumn("y", features.normal_noise(("Country", "Product", "Time"), 8))
    assert abs(seeds.corr("y", "z")) < 0.03
