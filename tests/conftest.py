import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path[:0] = [str(ROOT), str(ROOT / "tests")]

from panelcast.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("panelcast-tests", cpus=8)
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def make_panel(spark):
    """Panel from {(country, product): values}, monthly from a start date."""
    from panelcast.functions.expressions import add_months, as_date

    def build(series, start="2012-01-01"):
        rows = [
            (country, product, add_months(as_date(start), i), None if v is None else float(v))
            for (country, product), values in series.items()
            for i, v in enumerate(values)
        ]
        return spark.createDataFrame(
            rows, "Country string, Product string, Time date, Import double"
        )

    return build
