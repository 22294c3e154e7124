"""Lag, triangular rolling-mean and exponentially weighted features of a panel.

By default every window stays inside one series. ``keys=("Country",), order=("Product", "Time")``
gives the country-wide variant, in which a window may begin in the previous product of the country.
Such a group has no size bound, so it is cut into blocks of consecutive rows; each block also
carries copies of the earlier rows that its windows can see.

An exponentially weighted mean changes at rows with a value only, and is carried on to the rows
after them over a gap of any length. At a row with a value it is a ratio of two running sums, with
weights that grow along the block. That row's own weight, 0.1 ** 255 or more, is inside the range of
a double, and rows more than ``EWM_REACH`` before it weigh less than its last bit: there a weight of
zero is exact. In country-wide groups no rows are copied for it: each block is summed to one state,
states are scanned over the blocks, and a row adds the state before its block to its running sums.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

from panelcast.functions.expressions import alpha_tag, triangular_weights
from panelcast.operators.panel import KEYS, date_parts
from panelcast.operators.position import with_position

# The feature set a regressor is trained on.
LAGS = (1, 3, 6, 12, 24)
WINDOWS = (2, 3, 4, 5, 6, 9, 12)
ALPHAS = (0.9, 0.7, 0.5, 0.2, 0.1)
EWM_LAGS = (1, 2, 3, 4, 5, 6, 12, 24)

# Rows per block, and the earlier rows that count in the mean of a row with a value: 0.9 ** 400 is
# below the resolution of a double.
BLOCK = 256
EWM_REACH = 400


def _bounded(keys: Sequence[str]) -> bool:
    """Is a group part of one series, and so no longer than the calendar?"""
    return set(KEYS) <= set(keys)


def _blocks(panel: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int) -> DataFrame:
    """Cut groups into blocks: _block, and _at, the place in it; negative for copied earlier rows.

    In country-wide groups copies reach back ``reach`` rows; inside a series, to its beginning."""
    if _bounded(keys):
        group = Window.partitionBy(*keys)
        placed = panel.withColumns(
            {
                "_pos": F.row_number().over(group.orderBy(*order)) - 1,
                "_end": F.count("*").over(group) - 1,
            }
        )
        last = F.col("_end")
    else:
        placed = with_position(panel, [*keys, *order], "_pos")
        last = F.col("_pos") + reach
    spread = F.sequence(F.floor(F.col("_pos") / BLOCK), F.floor(last / BLOCK))
    return (
        placed.withColumn("_block", F.explode(spread))
        .withColumn("_at", F.col("_pos") - F.col("_block") * BLOCK)
        .drop("_pos", "_end")
    )


def _grouped(
    panel: DataFrame, keys: Sequence[str], order: Sequence[str], reach: int
) -> tuple[DataFrame, list[str]]:
    if _bounded(keys):
        return panel, list(keys)
    return _blocks(panel, keys, order, reach), [*keys, "_block"]


def _released(df: DataFrame) -> DataFrame:
    return df.where("_at >= 0").drop("_block", "_at") if "_at" in df.columns else df


def _with_lags_and_means(
    df: DataFrame, window: WindowSpec, lags: Sequence[int], windows: Sequence[int]
) -> DataFrame:
    """Lag and rolling columns, from one shared lag column per distance.

    A rolling value is the weighted mean of the previous n values; NULL until n of them exist.
    """
    steps = sorted({*lags, *range(1, max(windows, default=0) + 1)})
    shared = {f"_lag_{k}": F.lag("Import", k).over(window) for k in steps}
    columns = {f"Import_lag_{k}": F.col(f"_lag_{k}") for k in lags}
    for n in windows:
        terms = [
            F.lit(weight) * F.col(f"_lag_{k}")
            for k, weight in enumerate(triangular_weights(n), start=1)
        ]
        columns[f"Import_roll_mean_{n}"] = sum(terms[1:], terms[0])
    return df.withColumns(shared).withColumns(columns).drop(*shared)


def _ewm_of(running: WindowSpec, alpha: float) -> Column:
    """Mean at each row with a value. A missing value adds nothing, but ages those before it."""
    weight = F.pow(F.lit(1.0 - alpha), F.lit(BLOCK - 1) - F.col("_at"))
    known = F.when(F.col("Import").isNotNull(), weight)
    total = F.sum(known * F.col("Import")).over(running)
    return F.when(
        F.col("Import").isNotNull(), F.try_divide(total, F.sum(known).over(running))
    )


def _sums(alpha: float) -> tuple[Column, Column]:
    """Weighted value and weight of a row in its block: the block's last row weighs 1."""
    weight = F.pow(F.lit(1.0 - alpha), F.lit(BLOCK - 1) - F.col("_at"))
    known = F.when(F.col("Import").isNotNull(), weight)
    return known * F.col("Import"), known


def _scanned(placed: DataFrame, keys: Sequence[str], alphas: Sequence[float]) -> DataFrame:
    """Per block, the state of each mean before it: (_carry: block, n<i>, d<i>).

    A block is one weighted sum and one weight per mean. The state at its end takes in the two
    blocks before it, which hold all rows that count beside its own; blocks without a value have no
    state, so the one before a block is that of the last block with a value, however far back.
    """
    sums = {}
    for i, alpha in enumerate(alphas):
        total, weight = _sums(alpha)
        sums |= {f"n{i}": F.sum(total), f"d{i}": F.sum(weight)}
    blocks = placed.groupBy(*keys, "_block").agg(*[c.alias(name) for name, c in sums.items()])
    order = Window.partitionBy(*keys).orderBy("_block")
    fields = [F.col("_block").alias("block")]
    for i, alpha in enumerate(alphas):
        for name in (f"n{i}", f"d{i}"):
            zero = F.lit(0.0)
            parts = [
                F.coalesce(F.lag(name, k).over(order) if k else F.col(name), zero)
                * (1.0 - alpha) ** (BLOCK * k)
                for k in range(1 + -(-EWM_REACH // BLOCK))
            ]
            fields.append(sum(parts[1:], parts[0]).alias(name))
    state = F.when(F.col("d0").isNotNull(), F.struct(*fields))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    found = blocks.select(*keys, "_block", state.alias("_state"))
    carry = F.last("_state", ignorenulls=True).over(before)
    return found.select(*keys, "_block", carry.alias("_carry"))


def _with_ewm(
    panel: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    alphas: Sequence[float],
    reach: int,
) -> tuple[DataFrame, WindowSpec]:
    """Rows with a column ``_ewm_<alpha>`` per alpha, and a window that sees ``reach`` rows back."""
    block = Window.partitionBy(*keys, "_block").orderBy(*order)
    running = block.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    names = [f"_ewm_{alpha_tag(a)}" for a in alphas]
    if _bounded(keys):
        means = {name: _ewm_of(running, a) for name, a in zip(names, alphas)}
        # Copies have served the sums; their own means, of weights far below the block's, are no use.
        known = _blocks(panel, keys, order, EWM_REACH).withColumns(means).where("_at >= 0")
        window = Window.partitionBy(*keys).orderBy(*order)
        running = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        filled = {n: F.last(n, ignorenulls=True).over(running) for n in names}
        return known.drop("_block", "_at").withColumns(filled), window
    placed = with_position(panel, [*keys, *order], "_pos")
    placed = placed.withColumns(
        {"_block": F.floor(F.col("_pos") / BLOCK), "_at": F.pmod("_pos", F.lit(BLOCK))}
    ).drop("_pos")
    sums = {}
    for i, alpha in enumerate(alphas):
        total, weight = _sums(alpha)
        sums |= {f"_n{i}": F.sum(total).over(running), f"_d{i}": F.sum(weight).over(running)}
    joined = placed.withColumns(sums).join(_scanned(placed, keys, alphas), [*keys, "_block"], "left")
    blocks_back = (F.col("_block") - F.col("_carry.block")) * BLOCK
    means = {}
    for i, (name, alpha) in enumerate(zip(names, alphas)):
        age = F.pow(F.lit(1.0 - alpha), blocks_back)
        n, d = (
            F.coalesce(f"_{x}{i}", F.lit(0.0)) + F.coalesce(F.col(f"_carry.{x}{i}") * age, F.lit(0.0))
            for x in "nd"
        )
        carried = F.try_divide(F.col(f"_carry.n{i}"), F.col(f"_carry.d{i}"))
        means[name] = F.when(F.col(f"_d{i}").isNotNull(), F.try_divide(n, d)).otherwise(carried)
    known = joined.withColumns(means).drop("_carry", *sums)
    if not reach:
        return known, block
    steps = F.sequence(F.lit(0), F.floor((F.col("_at") + reach) / BLOCK).cast("int"))
    copied = known.withColumn("_step", F.explode(steps)).withColumns(
        {
            "_block": F.col("_block") + F.col("_step"),
            "_at": F.col("_at") - BLOCK * F.col("_step"),
        }
    )
    return copied.drop("_step"), block


def ewm_columns(
    window: WindowSpec, alphas: Sequence[float] = ALPHAS, lags: Sequence[int] = EWM_LAGS
) -> dict[str, Column]:
    """Lags of the unlagged means: shifting first or averaging first gives the same values."""
    return {
        f"Import_ewm_alpha_{alpha_tag(a)}_lag_{k}": F.lag(f"_ewm_{alpha_tag(a)}", k).over(window)
        for a in alphas
        for k in lags
    }


def lag_features(
    panel: DataFrame,
    lags: Sequence[int] = LAGS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
) -> DataFrame:
    df, group = _grouped(panel, keys, order, max(lags))
    window = Window.partitionBy(*group).orderBy(*order)
    return _released(_with_lags_and_means(df, window, lags, ()))


def rolling_features(
    panel: DataFrame,
    windows: Sequence[int] = WINDOWS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
) -> DataFrame:
    df, group = _grouped(panel, keys, order, max(windows))
    window = Window.partitionBy(*group).orderBy(*order)
    return _released(_with_lags_and_means(df, window, (), windows))


def ewm(
    panel: DataFrame,
    alphas: Sequence[float] = ALPHAS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
) -> DataFrame:
    """Exponentially weighted means up to and including each row, one column per alpha."""
    df, _ = _with_ewm(panel, keys, order, alphas, 0)
    names = {f"_ewm_{alpha_tag(a)}": f"Import_ewm_alpha_{alpha_tag(a)}" for a in alphas}
    return _released(df).withColumnsRenamed(names)


def _without_means(df: DataFrame, alphas: Sequence[float]) -> DataFrame:
    return _released(df.drop(*[f"_ewm_{alpha_tag(a)}" for a in alphas]))


def ewm_features(
    panel: DataFrame,
    alphas: Sequence[float] = ALPHAS,
    lags: Sequence[int] = EWM_LAGS,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
) -> DataFrame:
    df, window = _with_ewm(panel, keys, order, alphas, max(lags))
    return _without_means(df.withColumns(ewm_columns(window, alphas, lags)), alphas)


def build_features(
    panel: DataFrame,
    keys: Sequence[str] = KEYS,
    order: Sequence[str] = ("Time",),
    lags: Sequence[int] = LAGS,
    windows: Sequence[int] = WINDOWS,
    alphas: Sequence[float] = ALPHAS,
    ewm_lags: Sequence[int] = EWM_LAGS,
) -> DataFrame:
    """All derived columns, with month and year. One shuffle by series serves every one of them."""
    reach = max(*lags, *windows, *ewm_lags)
    df, window = _with_ewm(panel, keys, order, alphas, reach)
    df = _with_lags_and_means(df, window, lags, windows)
    df = df.withColumns(ewm_columns(window, alphas, ewm_lags))
    return date_parts(_without_means(df, alphas))


def feature_names(df: DataFrame) -> list[str]:
    """Input columns of a regressor: everything except the time, the target and the text keys."""
    return [c for c in df.columns if c not in ("Time", "Import", *KEYS)]


def normal_noise(keys: Sequence[str], seed: int) -> Column:
    """Standard normal noise of a row, by Box and Muller from a hash of its keys and the seed.

    The row's keys are its counter, so the noise is the same whatever the order and partitioning of
    the rows, and rows of equal keys have equal noise. A null key is unlike any value.
    """
    parts = [F.col(k).cast("string") for k in keys]
    encoded = [
        F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts
    ]
    digits = F.md5(F.concat(F.lit(f"{seed};"), *encoded).cast("binary"))
    bits = [F.conv(F.substring(digits, at, 13), 16, 10).cast("double") for at in (1, 14)]
    radius = F.sqrt(-2.0 * F.log((bits[0] + 1.0) / float(1 << 52)))
    return radius * F.cos(bits[1] * (2.0 * math.pi / float(1 << 52)))


def jitter(
    df: DataFrame, column: str, scale: float, seed: int, keys: Sequence[str] = (*KEYS, "Time")
) -> DataFrame:
    """Add seeded Gaussian noise to a column. No pipeline here turns it on."""
    return df.withColumn(column, F.col(column) + normal_noise(keys, seed) * F.lit(scale))


def jitter_scale_of(column: str) -> Column:
    """Aggregate: the noise level used with :func:`jitter`, a twentieth of the mean, rounded."""
    return F.round(F.avg(column) / 20)
