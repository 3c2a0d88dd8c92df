from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from quillpanel.session import local_session

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    s = local_session(4, 4)
    s.sparkContext.setLogLevel("ERROR")
    s.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))
    yield s
    s.stop()


def walk(ticker: str, n: int = 200, seed: int = 0, start: str = "2018-01-01") -> pd.DataFrame:
    """Random-walk bars on business days with valid price order."""
    rng = np.random.default_rng(seed)
    close = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, n)))
    open_ = close * np.exp(rng.normal(0, 0.005, n))
    high = np.maximum(open_, close) * (1 + rng.uniform(0, 0.01, n))
    low = np.minimum(open_, close) * (1 - rng.uniform(0, 0.01, n))
    return pd.DataFrame({"ticker": ticker, "date": pd.bdate_range(start, periods=n).date, "open": open_, "high": high,
                         "low": low, "close": close, "volume": rng.integers(0, 1000, n).astype(float)})


@pytest.fixture(scope="session")
def panel_pdf():
    """Six walks; the last one is listed late."""
    return pd.concat([walk(f"T{i}", 150 - (60 if i == 5 else 0), i, "2018-04-02" if i == 5 else "2018-01-01")
                      for i in range(6)], ignore_index=True)


@pytest.fixture(scope="session")
def panel(spark, panel_pdf):
    return spark.createDataFrame(panel_pdf).cache()


@pytest.fixture
def tiny_groups(spark):
    """Forces the sliced forms by allowing only a few rows per task."""
    from quillpanel.plans.skew import GROUP_ROWS_KEY

    spark.conf.set(GROUP_ROWS_KEY, "20")
    yield
    spark.conf.unset(GROUP_ROWS_KEY)
