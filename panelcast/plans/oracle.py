"""For each registered query that SQL can express, the same result in DuckDB SQL."""

from __future__ import annotations

from panelcast.functions.expressions import triangular_weights
from panelcast.operators.features import ALPHAS, EWM_LAGS, LAGS, WINDOWS

_PANEL_ALL = """panel_all AS (
  SELECT n_name AS "Country", c_mktsegment AS "Product",
         CAST(date_trunc('month', l_shipdate) AS DATE) AS "Time",
         CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS "Import"
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  GROUP BY 1, 2, 3)"""
_PANEL = f"""{_PANEL_ALL}, panel AS (
  SELECT * FROM panel_all WHERE "Time" >= DATE '1995-01-01' AND "Time" < DATE '2001-01-01')"""
_COMPLETE = f"""{_PANEL}, complete AS (
  SELECT "Country", "Product", "Time", "Import" + 1.0 AS "Import" FROM panel
  QUALIFY COUNT("Import") OVER (PARTITION BY "Country", "Product") = 72)"""
_SERIES_OK = f"""{_PANEL}, shifted AS (
  SELECT "Country", "Product", "Time", "Import" + 1.0 AS "Import" FROM panel),
cuts AS (SELECT unnest([DATE '1999-01-01', DATE '2000-01-01']) AS cutoff),
history AS (
  SELECT "Country", "Product", cutoff, "Time", "Import", "Time" < cutoff AS is_train
  FROM shifted, cuts WHERE "Time" < cutoff + INTERVAL 12 MONTH
  QUALIFY COUNT("Import") OVER (PARTITION BY "Country", "Product", cutoff)
          = date_diff('month', DATE '1995-01-01', cutoff) + 12)"""
_NAIVE = f"""{_SERIES_OK},
last_rows AS (
  SELECT "Country", "Product", cutoff,
         MAX("Import") FILTER (WHERE "Time" = cutoff - INTERVAL 1 MONTH) AS y1,
         MAX("Import") FILTER (WHERE "Time" = cutoff - INTERVAL 13 MONTH) AS y13
  FROM history WHERE is_train GROUP BY 1, 2, 3),
tests AS (
  SELECT t."Country", t."Product", t.cutoff, t."Time", t."Import" AS real,
         b."Import" AS year_ago, y1, y13
  FROM history t
  JOIN history b ON b."Country" = t."Country" AND b."Product" = t."Product"
   AND b.cutoff = t.cutoff AND b."Time" = t."Time" - INTERVAL 12 MONTH
  JOIN last_rows l ON l."Country" = t."Country" AND l."Product" = t."Product"
   AND l.cutoff = t.cutoff
  WHERE NOT t.is_train),
forecasts AS (
  SELECT "Country", "Product", cutoff, "Time", 'seasonal_naive' AS model, year_ago AS pred, real
  FROM tests
  UNION ALL SELECT "Country", "Product", cutoff, "Time", 'random_walk', y1, real FROM tests
  UNION ALL SELECT "Country", "Product", cutoff, "Time", 'seasonal_random_walk',
                   year_ago + (y1 - y13), real FROM tests),
scored AS (
  SELECT *, 200.0 * abs(pred - real) / nullif(abs(pred) + abs(real), 0) AS smape FROM forecasts)"""


def _tag(alpha: float) -> str:
    return str(alpha).replace(".", "")


def _lags(window: str) -> str:
    return ", ".join(f'lag("Import", {k}) OVER {window} AS "Import_lag_{k}"' for k in LAGS)


def _rolls(window: str) -> str:
    columns = []
    for n in WINDOWS:
        terms = [
            f'{weight!r} * lag("Import", {k}) OVER {window}'
            for k, weight in enumerate(triangular_weights(n), start=1)
        ]
        columns.append(f'round({" + ".join(terms)}, 5) AS "Import_roll_mean_{n}"')
    return ", ".join(columns)


# Every series with one row per month; every seventh month has no value.
_GAPPY = f"""{_PANEL}, gappy AS (
  SELECT k."Country", k."Product", m."Time",
         CASE WHEN (12 * year(m."Time") + month(m."Time")) % 7 <> 3 THEN p."Import" END AS "Import"
  FROM (SELECT DISTINCT "Country", "Product" FROM panel) k
  CROSS JOIN (SELECT CAST(m AS DATE) AS "Time" FROM
    generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) AS g(m)) m
  LEFT JOIN panel p ON p."Country" = k."Country" AND p."Product" = k."Product"
    AND p."Time" = m."Time")"""


def _ewm_sql(partition: str, order: str, base: str = _COMPLETE, rows: str = "complete") -> str:
    """CTE ``means``: unlagged means from the list of all earlier values, newest first."""
    columns = []
    for a in ALPHAS:
        weight = f"pow({1 - a!r}, i - 1)"
        columns.append(
            f"list_sum([{weight} * past[i] for i in range(1, len(past) + 1)])"
            f" / list_sum([CASE WHEN past[i] IS NOT NULL THEN {weight} END"
            f" for i in range(1, len(past) + 1)]) AS e{_tag(a)}"
        )
    return f"""{base}, pasts AS (
      SELECT "Country", "Product", "Time", "Import",
             list_reverse(list("Import") OVER (PARTITION BY {partition} ORDER BY {order}
                          ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS past
      FROM {rows}),
    means AS (SELECT "Country", "Product", "Time", "Import", {", ".join(columns)} FROM pasts)"""


_LEVELS = "[0.1, 0.3, 0.5, 0.7, 0.9]"
_HW_GRID = f"""SELECT a, b, g FROM (SELECT unnest({_LEVELS}) AS a), (SELECT unnest({_LEVELS}) AS b),
  (SELECT unnest({_LEVELS}) AS g)"""


def _hw(grid: str, cutoffs: str) -> str:
    """CTEs ``fits`` (forecast and error of every series and parameter set) and ``best``."""
    return f"""RECURSIVE {_SERIES_OK}, grid AS ({grid}),
ys AS (
  SELECT "Country", "Product", cutoff, list("Import" ORDER BY "Time") FILTER (WHERE is_train) AS y,
         list("Import" ORDER BY "Time") FILTER (WHERE NOT is_train) AS actual
  FROM history WHERE cutoff IN ({cutoffs}) GROUP BY 1, 2, 3),
begun AS (
  SELECT *, list_sum(y[1:12]) / 12 AS m1, list_sum(y[13:24]) / 12 AS m2 FROM ys),
hw AS (
  SELECT "Country", "Product", cutoff, y, actual, a, b, g, 0 AS t, m1 AS l, (m2 - m1) / 12 AS tr,
         [v - m1 for v in y[1:12]] AS s
  FROM begun, grid
  UNION ALL
  SELECT "Country", "Product", cutoff, y, actual, a, b, g, t + 1,
         a * (y[t + 1] - s[1]) + (1 - a) * (l + tr),
         b * (a * (y[t + 1] - s[1]) + (1 - a) * (l + tr) - l) + (1 - b) * tr,
         list_append(s[2:12], g * (y[t + 1] - l - tr) + (1 - g) * s[1])
  FROM hw WHERE t < len(y)),
fits AS (
  SELECT *, [l + i * tr + s[i] for i in range(1, 13)] AS pred FROM hw WHERE t = len(y)),
errors AS (
  SELECT *, round(list_sum([abs(actual[i] - pred[i]) for i in range(1, 13)]) / 12, 6) AS mae
  FROM fits),
best AS (
  SELECT * FROM errors QUALIFY row_number() OVER (
    PARTITION BY "Country", "Product", cutoff ORDER BY mae, a, b, g) = 1),
best_rows AS (
  SELECT "Country", "Product", cutoff, CAST(cutoff + to_months(CAST(i - 1 AS INTEGER)) AS DATE)
         AS "Time", 'tes' AS model, pred[i] AS pred, actual[i] AS real
  FROM best, (SELECT unnest(range(1, 13)) AS i))"""


# Orders whose fit is a quotient of two sums: an AR or a seasonal AR term at most.
_AR_ORDERS = """SELECT p, d, 0 AS q, sp, sd, 0 AS sq
  FROM (SELECT unnest([0, 1]) AS p), (SELECT unnest([0, 1]) AS d), (SELECT unnest([0, 1]) AS sp),
       (SELECT unnest([0, 1]) AS sd) WHERE p + sp <= 1"""


def _ar(orders: str, cutoffs: str = "DATE '2000-01-01'") -> str:
    """CTE ``ar_fits``: forecast and error of every series and order."""
    return f"""{_SERIES_OK}, orders_ AS ({orders}),
ys AS (
  SELECT "Country", "Product", cutoff, list("Import" ORDER BY "Time") FILTER (WHERE is_train) AS y,
         list("Import" ORDER BY "Time") FILTER (WHERE NOT is_train) AS actual
  FROM history WHERE cutoff IN ({cutoffs}) GROUP BY 1, 2, 3),
seasonal AS (
  SELECT *, CASE WHEN sd = 1 THEN [y[i] - y[i - 12] for i in range(13, len(y) + 1)] ELSE y END AS u
  FROM ys, orders_),
differenced AS (
  SELECT *, CASE WHEN d = 1 THEN [u[i] - u[i - 1] for i in range(2, len(u) + 1)] ELSE u END AS w,
         CASE WHEN sp = 1 THEN 12 ELSE 1 END AS k FROM seasonal),
slopes AS (
  SELECT *, CASE WHEN p + sp = 0 THEN 0.0 ELSE greatest(-0.99, least(0.99,
      list_sum([w[i] * w[i - k] for i in range(k + 1, len(w) + 1)])
      / list_sum([w[i - k] * w[i - k] for i in range(k + 1, len(w) + 1)]))) END AS c
  FROM differenced),
ahead AS (
  SELECT *, [CASE WHEN sp = 1 THEN c * w[len(w) - 12 + h] ELSE pow(c, h) * w[len(w)] END
             for h in range(1, 13)] AS wf FROM slopes),
summed AS (
  SELECT *, CASE WHEN d = 1 THEN [u[len(u)] + list_sum(wf[1:h]) for h in range(1, 13)]
            ELSE wf END AS uf FROM ahead),
ar_preds AS (
  SELECT *, CASE WHEN sd = 1 THEN [y[len(y) - 12 + h] + uf[h] for h in range(1, 13)]
            ELSE uf END AS pred FROM summed),
ar_fits AS (
  SELECT *, round(list_sum([abs(actual[i] - pred[i]) for i in range(1, 13)]) / 12, 6) AS mae
  FROM ar_preds)"""


def _ar_rows(p: int, d: int, sp: int, sd: int) -> str:
    order = f"SELECT {p} AS p, {d} AS d, 0 AS q, {sp} AS sp, {sd} AS sd, 0 AS sq"
    return f"""WITH {_ar(order)} SELECT "Country", "Product", cutoff,
        CAST(cutoff + to_months(CAST(i - 1 AS INTEGER)) AS DATE) AS "Time", 'sarima' AS model,
        round(pred[i], 2) AS pred, actual[i] AS real
        FROM ar_fits, (SELECT unnest(range(1, 13)) AS i)"""


def _arima_certificate() -> str:
    """Least sum of squares over coefficients of -0.5 and 0.5, all orders, errors by recursion."""
    bits = ", ".join(f"(SELECT unnest([0, 1]) AS {c})" for c in ("p", "d", "q", "sp", "sd", "sq"))
    tries = "".join(
        f", (SELECT unnest([0.0, -0.5, 0.5]::DOUBLE[]) AS {name})" for name in ("ar", "ma", "sar", "sma")
    )
    free = " AND ".join(
        f"({name} <> 0) = ({order} = 1)"
        for name, order in (("ar", "p"), ("ma", "q"), ("sar", "sp"), ("sma", "sq"))
    )
    before = "coalesce(CASE WHEN i > {0} THEN w[i - {0}] END, 0)"
    lagged = "coalesce(CASE WHEN t >= {0} THEN e[t - {0} + 1] END, 0)"
    return f"""WITH RECURSIVE {_SERIES_OK}, orders_ AS (SELECT * FROM {bits}),
ys AS (
  SELECT "Country", "Product", list("Import" ORDER BY "Time") FILTER (WHERE is_train) AS y
  FROM history WHERE cutoff = DATE '2000-01-01' GROUP BY 1, 2),
seasonal AS (
  SELECT *, CASE WHEN sd = 1 THEN [y[i] - y[i - 12] for i in range(13, len(y) + 1)] ELSE y END AS u
  FROM ys, orders_),
differenced AS (
  SELECT *, CASE WHEN d = 1 THEN [u[i] - u[i - 1] for i in range(2, len(u) + 1)] ELSE u END AS w
  FROM seasonal),
lanes AS (SELECT *, row_number() OVER () AS lane FROM differenced{tries} WHERE {free}),
inputs AS (
  SELECT lane, ma, sma, [w[i] - ar * {before.format(1)} - sar * {before.format(12)}
    + ar * sar * {before.format(13)} for i in range(1 + p + 12 * sp, len(w) + 1)] AS z FROM lanes),
steps AS (
  SELECT lane, ma, sma, z, 0 AS t, []::DOUBLE[] AS e FROM inputs
  UNION ALL
  SELECT lane, ma, sma, z, t + 1, list_append(e, z[t + 1] - ma * {lagged.format(1)}
    - sma * {lagged.format(12)} - ma * sma * {lagged.format(13)}) FROM steps WHERE t < len(z)),
sums AS (SELECT lane, list_sum([x * x for x in e]) AS sse FROM steps WHERE t = len(z))
SELECT "Country", "Product", p, d, q, sp, sd, sq, round(ln(min(sse)), 6) AS log_least,
  true AS not_worse, true AS at_minimum
FROM lanes JOIN sums USING (lane) GROUP BY ALL"""


_BY_SERIES = '(PARTITION BY "Country", "Product" ORDER BY "Time")'
_BY_COUNTRY = '(PARTITION BY "Country" ORDER BY "Product", "Time")'
_EWM = ", ".join(f'round(e{_tag(a)}, 2) AS "Import_ewm_alpha_{_tag(a)}"' for a in ALPHAS)


def _ewm_lags(window: str) -> str:
    return ", ".join(
        f'round(lag(e{_tag(a)}, {k}) OVER {window}, 2) AS "Import_ewm_alpha_{_tag(a)}_lag_{k}"'
        for a in ALPHAS
        for k in EWM_LAGS
    )


_EWM_LAGS = _ewm_lags(_BY_SERIES)
_NATIONS = [f"NATION_{i}" for i in range(25)]
_SEGMENTS = "AUTOMOBILE BUILDING FURNITURE HOUSEHOLD MACHINERY".split()


def oracle_sql() -> dict[str, str]:
    q: dict[str, str] = {}
    q["panel_base"] = f"WITH {_PANEL_ALL} SELECT * FROM panel_all"
    q["period_bounds"] = f"WITH {_PANEL} SELECT * FROM panel"
    q["panel_dense"] = f"""WITH {_PANEL}, months AS (
        SELECT CAST(m AS DATE) AS "Time" FROM
        generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) AS g(m))
        SELECT k."Country", k."Product", m."Time", coalesce(p."Import", 0.0) AS "Import"
        FROM (SELECT DISTINCT "Country", "Product" FROM panel) k CROSS JOIN months m
        LEFT JOIN panel p ON p."Country" = k."Country" AND p."Product" = k."Product"
        AND p."Time" = m."Time" """
    q["complete_series"] = f"""WITH {_PANEL} SELECT * FROM panel
        QUALIFY COUNT("Import") OVER (PARTITION BY "Country", "Product") = 72"""
    q["incomplete_series"] = f"""WITH {_PANEL_ALL}
        SELECT "Country", "Product", CAST(72 - COUNT("Import") FILTER (
          WHERE "Time" >= DATE '1995-01-01' AND "Time" < DATE '2001-01-01') AS INTEGER) AS missing
        FROM panel_all GROUP BY 1, 2 HAVING missing > 0"""
    q["offset_shift"] = f"""WITH {_PANEL_ALL}
        SELECT "Country", "Product", "Time", "Import" + 1.0 AS "Import" FROM panel_all"""
    q["select_countries"] = f"""WITH {_PANEL_ALL} SELECT * FROM panel_all
        WHERE "Country" IN ('NATION_2', 'NATION_3', 'NATION_11')"""
    q["date_parts"] = f"""WITH {_PANEL_ALL} SELECT *, CAST(month("Time") AS INTEGER) AS month,
        CAST(year("Time") AS INTEGER) AS year FROM panel_all"""
    q["split_counts"] = f"""WITH {_PANEL_ALL} SELECT "Product",
        CASE WHEN "Time" < DATE '2000-01-01' THEN 'train' ELSE 'test' END AS split, COUNT(*) AS n
        FROM panel_all GROUP BY 1, 2"""
    q["series_status"] = f"""WITH {_PANEL},
        cuts AS (SELECT unnest([DATE '1999-01-01', DATE '2000-01-01']) AS cutoff),
        counts AS (
          SELECT cutoff, COUNT(*) FILTER (WHERE "Time" < cutoff) AS before,
                 COUNT(*) FILTER (WHERE "Time" >= cutoff
                                  AND "Time" < cutoff + INTERVAL 12 MONTH) AS after
          FROM panel, cuts GROUP BY "Country", "Product", cutoff)
        SELECT cutoff, CASE
            WHEN before < date_diff('month', DATE '1995-01-01', cutoff) THEN 'incomplete_train'
            WHEN after < 12 THEN 'incomplete_test' ELSE 'ok' END AS status, COUNT(*) AS n
        FROM counts GROUP BY 1, 2"""
    q["difference"] = f"""WITH {_COMPLETE}, first_diff AS (
        SELECT * REPLACE ("Import" - lag("Import") OVER {_BY_SERIES} AS "Import") FROM complete)
        SELECT * REPLACE (round("Import" - lag("Import", 12) OVER {_BY_SERIES}, 2) AS "Import")
        FROM first_diff"""

    q["wide_unpivot"] = f"""WITH {_PANEL_ALL}, months AS (
        SELECT CAST(m AS DATE) AS "Time" FROM
        generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH) AS g(m))
        SELECT k."Country", k."Product", m."Time", p."Import"
        FROM (SELECT DISTINCT "Country", "Product" FROM panel_all) k CROSS JOIN months m
        LEFT JOIN panel_all p ON p."Country" = k."Country" AND p."Product" = k."Product"
        AND p."Time" = m."Time" """
    q["header_parse"] = f"""WITH {_PANEL_ALL} SELECT strftime("Time", '%Y-M%m') AS "Label",
        "Time" AS parsed, COUNT(*) AS n FROM panel_all GROUP BY 1, 2"""
    q["wide_join"] = f"""WITH {_PANEL_ALL} SELECT * FROM panel_all
        QUALIFY COUNT(DISTINCT year("Time")) OVER (PARTITION BY "Country", "Product") = 7"""
    q["wide_join_parquet"] = q["wide_join"]
    q["wide_join_quoted"] = f"""WITH {_PANEL_ALL} SELECT * REPLACE (
        'The "' || "Country" || '",' || chr(10) || chr(10) || 'Republic of ""' AS "Country")
        FROM (SELECT * FROM panel_all
        QUALIFY COUNT(DISTINCT year("Time")) OVER (PARTITION BY "Country", "Product") = 7)"""
    q["wide_conflicts"] = f"""WITH {_PANEL_ALL} SELECT "Product", "Country", "Time", "Import" AS low,
        "Import" + 1.0 AS high FROM panel_all WHERE month("Time") = 6"""

    q["lag_features"] = f"WITH {_COMPLETE} SELECT *, {_lags(_BY_SERIES)} FROM complete"
    q["lag_features_country_only"] = (
        f"WITH {_COMPLETE} SELECT *, {_lags(_BY_COUNTRY)} FROM complete"
    )
    q["tri_roll"] = f"WITH {_COMPLETE} SELECT *, {_rolls(_BY_SERIES)} FROM complete"
    q["tri_roll_country_only"] = f"WITH {_COMPLETE} SELECT *, {_rolls(_BY_COUNTRY)} FROM complete"
    keys = '"Country", "Product", "Time", "Import"'
    q["ewm"] = f"""WITH {_ewm_sql('"Country", "Product"', '"Time"')}
        SELECT {keys}, {_EWM} FROM means"""
    q["ewm_country_only"] = f"""WITH {_ewm_sql('"Country"', '"Product", "Time"')}
        SELECT {keys}, {_EWM} FROM means"""
    q["ewm_lags"] = f"""WITH {_ewm_sql('"Country", "Product"', '"Time"')}
        SELECT {keys}, {_EWM_LAGS} FROM means"""
    q["feature_frame"] = f"""WITH {_ewm_sql('"Country", "Product"', '"Time"')}
        SELECT {keys}, {_lags(_BY_SERIES)}, {_rolls(_BY_SERIES)}, {_EWM_LAGS},
        CAST(month("Time") AS INTEGER) AS month, CAST(year("Time") AS INTEGER) AS year FROM means"""
    gaps = _ewm_sql('"Country", "Product"', '"Time"', _GAPPY, "gappy")
    q["ewm_gaps"] = f"WITH {gaps} SELECT {keys}, {_EWM} FROM means"
    across = _ewm_sql('"Country"', '"Product", "Time"', _GAPPY, "gappy")
    q["ewm_gaps_country_only"] = f"WITH {across} SELECT {keys}, {_EWM} FROM means"
    parts = """CAST(month("Time") AS INTEGER) AS month, CAST(year("Time") AS INTEGER) AS year"""
    q["feature_frame_gaps"] = f"""WITH {gaps} SELECT {keys}, {_lags(_BY_SERIES)},
        {_rolls(_BY_SERIES)}, {_EWM_LAGS}, {parts} FROM means"""
    whole = _ewm_sql('"Country"', '"Product", "Time"')
    q["ewm_lags_country_only"] = f"""WITH {whole} SELECT {keys}, {_ewm_lags(_BY_COUNTRY)}
        FROM means"""
    q["feature_frame_country_only"] = f"""WITH {whole} SELECT {keys}, {_lags(_BY_COUNTRY)},
        {_rolls(_BY_COUNTRY)}, {_ewm_lags(_BY_COUNTRY)}, {parts} FROM means"""
    flags = [("Country", n) for n in _NATIONS] + [("Product", s) for s in _SEGMENTS]
    dummies = ", ".join(
        f"CASE WHEN \"{c}\" = '{v}' THEN 1 ELSE 0 END AS \"{c}_{v}\"" for c, v in flags
    )
    q["one_hot"] = f'WITH {_PANEL_ALL} SELECT "Time", "Import", {dummies} FROM panel_all'
    cleaned = ", ".join(
        f"COUNT(*) FILTER (WHERE \"{c}\" = '{v}') AS \"{c}_{v}\""
        for c, v in flags
    )
    q["clean_names"] = f"WITH {_PANEL_ALL} SELECT {cleaned} FROM panel_all"
    q["log_target"] = f"""WITH {_COMPLETE} SELECT "Country", "Product", "Time",
        round(ln(1 + "Import"), 6) AS logged, round(exp(ln(1 + "Import")) - 1, 2) AS back
        FROM complete"""
    filled = ", ".join(
        f'coalesce(lag("Import", {k}) OVER {_BY_SERIES}, 0.0) AS "Import_lag_{k}"' for k in LAGS
    )
    q["fill_zero"] = f"WITH {_COMPLETE} SELECT *, {filled} FROM complete"
    digits = """md5('4;' || strlen("Country") || ':' || "Country" || strlen("Product") || ':'
        || "Product" || '10:' || CAST("Time" AS VARCHAR))"""
    bits = [f"CAST(CAST('0x' || substr({digits}, {at}, 13) AS BIGINT) AS DOUBLE)" for at in (1, 14)]
    q["jitter_noise"] = f"""WITH {_PANEL_ALL}, noise AS (
        SELECT *, sqrt(-2 * ln(({bits[0]} + 1) / 4503599627370496))
          * cos({bits[1]} * (2 * pi() / 4503599627370496)) AS z FROM panel_all)
        SELECT "Country", "Product", "Time", "Import",
          round("Import" + z * (SELECT round(avg("Import") / 20) FROM panel_all), 2) AS noisy FROM noise"""
    q["jitter_scale"] = f'WITH {_PANEL_ALL} SELECT round(avg("Import") / 20) AS scale FROM panel_all'

    one = 'SELECT "Country", "Product", cutoff, "Time", model, {pred} AS pred, real FROM forecasts'
    for name, model, pred in (
        ("seasonal_naive", "seasonal_naive", "pred"),
        ("rw_forecast", "random_walk", "pred"),
        ("seasonal_rw", "seasonal_random_walk", "round(pred, 2)"),
    ):
        q[name] = f"""WITH {_NAIVE} {one.format(pred=pred)}
            WHERE model = '{model}' AND cutoff = DATE '2000-01-01'"""

    q["smape_rows"] = f"""WITH {_NAIVE} SELECT * REPLACE (round(pred, 2) AS pred,
        round(smape, 6) AS smape) FROM scored"""
    q["smape_group"] = f"""WITH {_NAIVE} SELECT cutoff, model,
        round(sum(smape) / count(*), 6) AS smape FROM scored GROUP BY 1, 2"""
    q["mae"] = f"""WITH {_NAIVE} SELECT cutoff, model, "Product",
        round(avg(abs(real - pred)), 2) AS mae FROM scored GROUP BY 1, 2, 3"""
    q["rank_product"] = f"""WITH {_NAIVE} SELECT "Product", round(avg(smape), 6) AS mean_smape
        FROM scored WHERE model = 'seasonal_naive' AND cutoff = DATE '2000-01-01'
        GROUP BY 1 ORDER BY 2, 1"""
    q["rank_products_all"] = f"""WITH {_NAIVE} SELECT CAST(year("Time") AS INTEGER) AS year, model,
        "Product", round(avg(smape), 6) AS mean_smape FROM scored GROUP BY 1, 2, 3"""
    q["rank_country_product"] = f"""WITH {_NAIVE} SELECT model, "Country", "Product",
        round(avg(smape), 6) AS mean_smape FROM scored GROUP BY 1, 2, 3"""
    q["coverage"] = f"""WITH {_NAIVE} SELECT "Product", COUNT(DISTINCT "Country") AS countries
        FROM scored GROUP BY 1"""
    q["leaderboard"] = f"""WITH {_NAIVE} SELECT model, "Country", "Product",
        round(avg(smape), 6) AS mean_smape, COUNT(smape) AS n, 12 AS horizon FROM scored
        GROUP BY GROUPING SETS ((model), (model, "Product"), (model, "Country", "Product"))"""
    models = ("seasonal_naive", "random_walk", "seasonal_random_walk")
    cells = ", ".join(
        f"round(max(pred) FILTER (WHERE model = '{m}'), 2) AS {m}, "
        f"round(max(smape) FILTER (WHERE model = '{m}'), 6) AS \"{m.upper()}_smape\""
        for m in models
    )
    q["scored_wide"] = f"""WITH {_NAIVE} SELECT "Country", "Product", "Time", cutoff,
        max(real) AS "Import", {cells} FROM scored GROUP BY 1, 2, 3, 4"""
    q["scored_wide_overlap"] = q["scored_wide"].replace("DATE '1999-01-01'", "DATE '1999-07-01'")
    counted = f"""WITH {_NAIVE} SELECT model, COUNT(*) FILTER (
        NOT (model = 'random_walk' AND month("Time") = 12)) AS n FROM scored GROUP BY model"""
    q["model_rows"] = f"SELECT *, max(n) OVER () - n AS missing FROM ({counted})"
    q["backtest_naive"] = f"""WITH {_NAIVE} SELECT CAST(year(cutoff) AS INTEGER) AS year, model,
        round(avg(smape), 6) AS mean_smape, COUNT(*) AS n FROM scored GROUP BY 1, 2"""

    both = "DATE '1999-01-01', DATE '2000-01-01'"
    last = "DATE '2000-01-01'"
    q["param_grid"] = f"""WITH {_SERIES_OK}, grid AS ({_HW_GRID}) SELECT "Product", CAST(a AS DOUBLE)
        AS alpha, CAST(b AS DOUBLE) AS beta, CAST(g AS DOUBLE) AS gamma, COUNT(*) AS series
        FROM (SELECT DISTINCT "Country", "Product" FROM history WHERE cutoff = {last}), grid
        GROUP BY 1, 2, 3, 4"""
    rounded = 'SELECT * REPLACE (round(pred, 2) AS pred) FROM best_rows'
    q["hw_fixed"] = f"WITH {_hw('SELECT 0.5 AS a, 0.1 AS b, 0.3 AS g', last)} {rounded}"
    named = 'CAST(a AS DOUBLE) AS alpha, CAST(b AS DOUBLE) AS beta, CAST(g AS DOUBLE) AS gamma'
    q["hw_grid_best"] = f"""WITH {_hw(_HW_GRID, last)} SELECT "Country", "Product", {named},
        round(mae, 2) AS mae, 'ok' AS status FROM best"""
    q["hw_forecast"] = f"""WITH {_hw(_HW_GRID, last)} SELECT * REPLACE (round(pred, 2) AS pred),
        round(200.0 * abs(pred - real) / (abs(pred) + abs(real)), 5) AS smape FROM best_rows"""
    by_month = 'PARTITION BY "Country", "Product", month("Time")'
    q["hw_lsq_exact"] = f"""WITH {_COMPLETE}, exact AS (SELECT "Country", "Product", "Time",
          round(avg("Import") OVER whole) + round(min("Import") OVER whole / 100)
          * date_diff('month', DATE '1995-01-01', "Time") + round(avg("Import") OVER ({by_month}) / 10)
          AS value FROM complete WINDOW whole AS (PARTITION BY "Country", "Product"))
        SELECT "Country", "Product", {last} AS cutoff, "Time", 'tes' AS model, value AS pred,
        value AS real FROM exact WHERE "Time" >= {last}"""
    q["model_rows_all"] = f"""WITH {_SERIES_OK}
        SELECT unnest(['lgbm', 'rf', 'mlp', 'gbm', 'xgb', 'catb', 'tes', 'sarima']) AS model,
        COUNT(*) AS n, CAST(0 AS BIGINT) AS missing FROM history WHERE NOT is_train"""
    q["mlp_line"] = f"""WITH {_COMPLETE}, line AS (
        SELECT regr_slope(ln(1 + "Import"), month("Time")) AS b,
               regr_intercept(ln(1 + "Import"), month("Time")) AS a
        FROM complete WHERE "Time" < {last})
        SELECT "Country", "Product", "Time", 'mlp' AS model,
        round(a + b * month("Time"), 3) AS pred, "Import" AS real
        FROM complete, line WHERE "Time" >= {last}"""
    for model in ("rf", "gbm", "xgb", "catb", "lgbm"):
        q[f"{model}_month_means"] = f"""WITH {_COMPLETE}, means AS (
            SELECT month("Time") AS m, exp(avg(ln(1 + "Import"))) - 1 AS pred FROM complete
            WHERE "Time" < {last} GROUP BY 1)
            SELECT "Country", "Product", "Time", '{model}' AS model, round(pred, 2) AS pred,
            "Import" AS real FROM complete JOIN means ON m = month("Time") WHERE "Time" >= {last}"""
    # Parameters chosen on 1999 forecast 2000, for series complete up to the end of 2000.
    q["hw_validation"] = f"""WITH {_hw(_HW_GRID, both)} SELECT f."Country", f."Product", f.cutoff,
        CAST(f.cutoff + to_months(CAST(i - 1 AS INTEGER)) AS DATE) AS "Time", 'tes' AS model,
        round(f.pred[i], 2) AS pred, f.actual[i] AS real
        FROM fits f JOIN best c ON c."Country" = f."Country" AND c."Product" = f."Product"
         AND c.a = f.a AND c.b = f.b AND c.g = f.g AND c.cutoff = DATE '1999-01-01',
        (SELECT unnest(range(1, 13)) AS i) WHERE f.cutoff = {last}"""
    q["param_freq"] = f"""WITH {_hw(_HW_GRID, last)} SELECT {named}, COUNT(*) AS wins,
        CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total FROM best GROUP BY 1, 2, 3"""
    q["params_roundtrip"] = f"WITH {_hw(_HW_GRID, both)} {rounded}"
    q["predictions_roundtrip"] = f"""WITH {_NAIVE} SELECT model, "Product",
        round(avg(smape), 6) AS mean_smape FROM scored WHERE year("Time") = 1999 GROUP BY 1, 2"""
    q["predictions_two_models"] = f"""WITH {_NAIVE} SELECT CAST(year("Time") AS INTEGER) AS year,
        model, round(avg(smape), 6) AS mean_smape, COUNT(*) AS n FROM scored GROUP BY 1, 2"""
    q["params_by_part"] = f"""WITH {_SERIES_OK} SELECT DISTINCT cutoff, "Product",
        COUNT(DISTINCT "Country") AS n FROM history GROUP BY 1, 2"""
    q["backtest_hw"] = f"""WITH {_hw(_HW_GRID, both)} SELECT CAST(year(cutoff) AS INTEGER) AS year,
        "Product", round(avg(200.0 * abs(pred - real) / (abs(pred) + abs(real))), 5) AS mean_smape,
        COUNT(*) AS n FROM best_rows GROUP BY 1, 2"""

    q["arima_random_walk"] = _ar_rows(0, 1, 0, 0)
    q["arima_seasonal_naive"] = _ar_rows(0, 0, 0, 1)
    q["arima_seasonal_walk"] = _ar_rows(0, 1, 0, 1)
    q["arima_ar"] = _ar_rows(1, 1, 0, 0)
    q["arima_seasonal_ar"] = _ar_rows(0, 1, 1, 1)
    q["arima_ar_grid_best"] = f"""WITH {_ar(_AR_ORDERS)} SELECT "Country", "Product",
        p, d, q, sp, sd, sq, round(mae, 2) AS mae, 'ok' AS status FROM ar_fits
        QUALIFY row_number() OVER (PARTITION BY "Country", "Product"
                                   ORDER BY mae, p, d, q, sp, sd, sq) = 1"""

    q["arima_certificate"] = _arima_certificate()
    winner = """QUALIFY row_number() OVER (PARTITION BY "Country", "Product", cutoff
        ORDER BY mae, p, d, q, sp, sd, sq) = 1"""
    q["arima_params_roundtrip"] = f"""WITH {_ar(_AR_ORDERS, both)},
        chosen AS (SELECT * FROM ar_fits {winner})
        SELECT "Country", "Product", cutoff, CAST(cutoff + to_months(CAST(i - 1 AS INTEGER)) AS DATE)
        AS "Time", 'sarima' AS model, round(pred[i], 2) AS pred, actual[i] AS real
        FROM chosen, (SELECT unnest(range(1, 13)) AS i)"""
    q["arima_param_freq"] = f"""WITH {_ar(_AR_ORDERS)}, chosen AS (SELECT * FROM ar_fits {winner})
        SELECT p, d, q, sp, sd, sq, COUNT(*) AS wins, CAST(SUM(COUNT(*)) OVER () AS BIGINT) AS total
        FROM chosen GROUP BY 1, 2, 3, 4, 5, 6"""
    q["lgbm_missing_side"] = f"""WITH {_COMPLETE}, raised AS (
        SELECT * REPLACE ("Import" * CASE WHEN month("Time") = 1 OR month("Time") >= 7 THEN 1000.0
          ELSE 1.0 END AS "Import"), month("Time") = 1 OR month("Time") >= 7 AS high FROM complete),
        means AS (SELECT high, avg(ln(1 + "Import")) AS m FROM raised WHERE "Time" < {last} GROUP BY 1)
        SELECT "Country", "Product", "Time", 'lgbm' AS model, round(exp(m) - 1, 2) AS pred,
          "Import" AS real FROM raised JOIN means USING (high) WHERE "Time" >= {last}"""
    q["regressor_r2"] = f"""WITH {_COMPLETE}, dealt AS (
        SELECT month("Time") AS m, ln(1 + "Import") AS y,
          ntile(5) OVER (ORDER BY "Product", "Country", "Time") AS fold
        FROM complete WHERE "Time" < {last}),
        sums AS (SELECT m, fold, sum(y) AS s, count(*) AS c FROM dealt GROUP BY 1, 2),
        means AS (SELECT a.m, a.fold, sum(b.s) / sum(b.c) AS p FROM sums a
          JOIN sums b ON b.m = a.m AND b.fold <> a.fold GROUP BY 1, 2),
        scores AS (SELECT fold, 1 - avg((y - p) ** 2) / var_pop(y) AS r2
          FROM dealt JOIN means USING (m, fold) GROUP BY 1)
        SELECT model, CAST(trees AS INTEGER) AS trees, round(avg(r2), 8) AS r2
        FROM scores, (VALUES ('rf', 1), ('gbm', 1), ('gbm', 2), ('gbm', 3)) AS v(model, trees)
        GROUP BY 1, 2"""
    names = [f"Import_lag_{k}" for k in LAGS] + [f"Import_roll_mean_{n}" for n in WINDOWS]
    names += [f"Import_ewm_alpha_{_tag(a)}_lag_{k}" for a in ALPHAS for k in EWM_LAGS]
    values = ", ".join(f"({i}, '{name}')" for i, name in enumerate([*names, "month", "year"]))
    q["input_names"] = f"""WITH {_COMPLETE}, levels AS (
        SELECT 1 AS part, "Country" AS level FROM complete
        UNION SELECT 2, "Product" FROM complete)
        SELECT CAST(i AS INTEGER) AS idx, name FROM (VALUES {values}) AS v(i, name)
        UNION ALL SELECT CAST({len(names) + 1} + row_number() OVER (ORDER BY part, level) AS INTEGER),
          CASE part WHEN 1 THEN '_Country_dummies_' ELSE '_Product_dummies_' END || level FROM levels"""
    q["fold_sizes"] = f"""WITH {_COMPLETE} SELECT CAST(fold AS INTEGER) AS fold, "Product",
        COUNT(*) AS n FROM (SELECT "Product", ntile(5) OVER (ORDER BY "Product", "Country", "Time")
        - 1 AS fold FROM complete WHERE "Time" < {last}) GROUP BY 1, 2"""
    scaled = ", ".join(
        f'round(("Import_lag_{k}" - avg("Import_lag_{k}") FILTER (WHERE "Time" < {last}) OVER ())'
        f' / stddev_pop("Import_lag_{k}") FILTER (WHERE "Time" < {last}) OVER (), 6)'
        f' AS "Import_lag_{k}"'
        for k in LAGS
    )
    q["standardize"] = f"""WITH {_COMPLETE}, lagged AS (SELECT *, {filled} FROM complete)
        SELECT "Country", "Product", "Time", "Import", {scaled} FROM lagged"""

    q["hardest_product"] = f"""WITH {_PANEL}, months AS (
        SELECT CAST(m AS DATE) AS "Time" FROM
        generate_series(DATE '1995-01-01', DATE '2000-12-01', INTERVAL 1 MONTH) AS g(m)),
        dense AS (
          SELECT k."Country", k."Product", m."Time", coalesce(p."Import", 0.0) + 1.0 AS v
          FROM (SELECT DISTINCT "Country", "Product" FROM panel) k CROSS JOIN months m
          LEFT JOIN panel p ON p."Country" = k."Country" AND p."Product" = k."Product"
          AND p."Time" = m."Time")
        SELECT t."Product",
          round(avg(200.0 * abs(b.v - t.v) / (abs(b.v) + abs(t.v))), 6) AS mean_smape
        FROM dense t JOIN dense b ON b."Country" = t."Country" AND b."Product" = t."Product"
         AND b."Time" = t."Time" - INTERVAL 12 MONTH
        WHERE t."Time" >= DATE '2000-01-01' GROUP BY 1 ORDER BY 2, 1"""
    return q
