import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from curvine.session import build_session

    session = build_session(
        "tests", "local[*]",
        **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.default.parallelism": "8"},
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def vectors(spark):
    """300 random vectors in 6 labels; label 0 holds a third of them."""
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.standard_normal((300, 8))
    x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
    label = np.where(np.arange(300) < 100, 0, rng.integers(1, 6, 300))
    rows = [(int(i), [float(v) for v in x[i]], int(label[i])) for i in range(300)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").cache()
    return df, x, label
