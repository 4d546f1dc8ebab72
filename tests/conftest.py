import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from yieldscope.session import local_session
from yieldscope.sources.observations import Observations


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", cores="8", **{"spark.sql.shuffle.partitions": "8"})


@pytest.fixture(scope="session")
def build(spark):
    """Observations from a matrix, a target and optional groups; row i has key i."""

    def make(x, y, groups=None, names=None):
        import pandas as pd
        n, p = np.shape(x)
        frame = pd.DataFrame({
            "row_id": range(n), "ts": pd.date_range("2024-01-01", periods=n, freq="5min"),
            "group_id": groups if groups is not None else ["A"] * n,
            "y": y, "features": [[None if v != v else float(v) for v in row] for row in x]})
        kind = "string" if isinstance(y[0], str) else "double"
        df = spark.createDataFrame(
            frame, f"row_id bigint, ts timestamp, group_id string, y {kind}, features array<double>")
        return Observations(df, tuple(names or [f"s.f{i}" for i in range(p)]))

    return make


@pytest.fixture(scope="session")
def planted(build):
    """Six features on 400 rows; the target is 3·f1 − 2·f3 plus little noise."""
    draw = np.random.default_rng(7)
    x = draw.normal(size=(400, 6))
    y = 3 * x[:, 1] - 2 * x[:, 3] + 0.1 * draw.normal(size=400)
    return build(x, y), x, y
