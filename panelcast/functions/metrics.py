"""Error metrics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def smape(pred: Column | str, real: Column | str) -> Column:
    """Symmetric percentage error of one row, 0 to 200; NULL when both values are zero."""
    p, t = _col(pred), _col(real)
    return 200.0 * F.try_divide(F.abs(p - t), F.abs(p) + F.abs(t))


def smape_mean(pred: Column | str, real: Column | str) -> Column:
    """Aggregate sMAPE of a group. Rows where both values are zero add nothing but do count in n."""
    counted = F.count(_col(pred) + _col(real))
    return F.try_divide(F.sum(smape(pred, real)), counted)


def mae(pred: Column | str, real: Column | str) -> Column:
    """Aggregate mean absolute error of a group."""
    return F.avg(F.abs(_col(real) - _col(pred)))


def mae_arrays(pred: Column | str, real: Column | str) -> Column:
    """Mean absolute error of two aligned arrays held in one row."""
    errors = F.zip_with(_col(real), _col(pred), lambda t, p: F.abs(t - p))
    total = F.aggregate(errors, F.lit(0.0), lambda acc, e: acc + e)
    return F.try_divide(total, F.size(errors))
