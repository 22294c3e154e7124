import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelcast.functions.expressions import clean_name, parse_month, triangular_weights
from panelcast.functions.metrics import mae_arrays, smape, smape_mean
from panelcast.operators import encode, folds
from panelcast.operators import panel as P
from panelcast.operators.position import with_position


def _year(value=1.0):
    return [value] * 12


def test_complete_series_ignores_gaps_outside_the_period(make_panel):
    panel = make_panel(
        {
            ("a", "x"): [None] + _year() * 2,
            ("b", "x"): [1.0] * 15 + [None] + [1.0] * 9,
            ("c", "x"): [1.0] * 5 + [float("nan")] + [1.0] * 19,
            ("d", "x"): [1.0] * 10,
        },
        start="2011-12-01",
    )
    kept = P.complete_series(panel, "2012-01-01", "2013-01-01")
    assert {r.Country for r in kept.collect()} == {"a", "b"}
    assert kept.count() == 24
    missing = {r.Country: r.missing for r in P.incomplete_series(panel, 2012, 2014).collect()}
    assert missing == {"b": 1, "c": 1, "d": 15}


def test_densify_fills_every_month(make_panel):
    panel = make_panel({("a", "x"): [5.0, None, 7.0], ("b", "x"): [float("nan")]})
    dense = P.densify(panel, "2012-01-01", "2012-05-01").orderBy("Country", "Time").collect()
    assert [r.Import for r in dense] == [5, 0, 7, 0, 0, 0, 0, 0]


def test_split_series_reports_incomplete_ones(make_panel):
    panel = make_panel(
        {
            ("full", "x"): range(36),
            ("hole", "x"): [1.0, None] + [1.0] * 34,
            ("short", "x"): range(35),
        }
    )
    rows = P.split_series(panel, "2012-01-01", ["2013-01-01", "2014-01-01"]).collect()
    status = {(r.Country, r.cutoff.year): r.status for r in rows}
    assert status == {
        ("full", 2013): "ok",
        ("full", 2014): "ok",
        ("hole", 2013): "incomplete_train",
        ("hole", 2014): "incomplete_train",
        ("short", 2013): "ok",
        ("short", 2014): "incomplete_test",
    }
    full = next(r for r in rows if r.Country == "full" and r.cutoff.year == 2013)
    assert full.y == list(range(12)) and full.actual == list(range(12, 24))


def test_difference_matches_manual(make_panel):
    values = [float(i * i) for i in range(16)]
    out = P.difference(make_panel({("a", "x"): values}), d=1, seasonal=1).orderBy("Time").collect()
    assert [r.Import for r in out] == [None] * 13 + [24.0] * 3


def test_month_formats_are_explicit(spark):
    df = spark.createDataFrame([("2012-M03",), ("2012-03",), ("March",)], "label string")
    listed = [r[0] for r in df.select(parse_month("label", ("yyyy-'M'MM",))).collect()]
    assert [str(v) for v in listed] == ["2012-03-01", "None", "None"]


def test_smape_edges(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (2.0, 2.0)], "p double, t double")
    assert [r[0] for r in df.select(smape("p", "t")).collect()] == [None, 100.0, 0.0]
    assert df.agg(smape_mean("p", "t")).first()[0] == pytest.approx(100 / 3)
    arrays = spark.sql("SELECT array(1D, 2D) AS p, array(3D, 2D) AS t")
    assert arrays.select(mae_arrays("p", "t")).first()[0] == 1.0


@settings(max_examples=25, deadline=None)
@given(st.integers(1, 40))
def test_triangular_weights(window):
    weights = triangular_weights(window)
    assert sum(weights) == pytest.approx(1.0)
    assert weights == pytest.approx(weights[::-1])


@settings(max_examples=50, deadline=None)
@given(st.integers(5, 400), st.integers(2, 7))
def test_fold_sizes_differ_by_one(total, n):
    size, larger = divmod(total, n)
    expected = [size + 1] * larger + [size] * (n - larger)
    assert sum(expected) == total and max(expected) - min(expected) <= 1


def test_folds_are_contiguous(spark):
    df = spark.range(103).select(F.col("id").alias("k"), (F.col("id") * 7 % 103).alias("v"))
    rows = folds.with_folds(df.repartition(7), 5, ["k"]).orderBy("k").collect()
    found = [r.fold for r in rows]
    assert found == sorted(found)
    assert [found.count(i) for i in range(5)] == [21, 21, 21, 20, 20]


def test_positions_follow_the_order(spark):
    df = spark.range(1000).select((F.col("id") * 37 % 1000).alias("k")).repartition(6)
    rows = with_position(df, ["k"]).collect()
    assert all(r.k == r.position for r in rows) and len(rows) == 1000


def test_clean_names_rejects_collisions(spark):
    df = spark.createDataFrame([(1, 2)], ["Product_çilek", "Product_ilek"])
    with pytest.raises(ValueError):
        encode.clean_names(df)
    assert clean_name("Country_United Kingdom") == "Country_UnitedKingdom"


def test_one_hot_keeps_all_levels_and_checks_their_number(make_panel):
    panel = make_panel({("a", "x"): [1.0], ("b", "y"): [2.0]})
    out = encode.one_hot(panel, ["Country", "Product"]).orderBy("Import")
    assert out.columns == ["Time", "Import", "Country_a", "Country_b", "Product_x", "Product_y"]
    assert [tuple(r)[2:] for r in out.collect()] == [(1, 0, 1, 0), (0, 1, 0, 1)]
    with pytest.raises(ValueError):
        encode.category_levels(panel, ["Country"], max_levels=1)


def test_standardize_uses_training_rows(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0), (9.0, 5.0)], "a double, c double")
    out = folds.standardize(df, ["a", "c"], df.where("a < 5")).orderBy("a").collect()
    assert [tuple(r) for r in out] == [(-1.0, 0.0), (1.0, 0.0), (7.0, 0.0)]


def test_a_repeated_month_does_not_hide_a_missing_one(spark, make_panel):
    panel = make_panel({("A", "x"): [1.0] * 11, ("B", "x"): [1.0] * 12})
    twice = panel.unionByName(panel.where("Country = 'A' AND month(Time) = 1"))
    assert {r.Country for r in P.complete_series(twice, "2012-01-01", "2013-01-01").collect()} == {"B"}
    lacking = P.incomplete_series(twice, "2012-01-01", "2013-01-01").collect()
    assert [(r.Country, r.missing) for r in lacking] == [("A", 1)]
