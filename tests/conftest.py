import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from sensorloom.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4, "4g")
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def stream(spark):
    """Build a streams table from (recording, rows) where a row is (ts, q_f, q_w)."""

    def make(recordings, dataset="A"):
        rows = [
            (dataset, name, f"g{i % 2}", k, float(t), float(f), float(w), k)
            for i, (name, data) in enumerate(recordings.items())
            for k, (t, f, w) in enumerate(data)
        ]
        return spark.createDataFrame(
            rows, "dataset string, recording_id string, dependency_group string, idx bigint, ts_s double, q_f double, q_w double, native_index bigint"
        )

    return make
