"""Rows of a live recording in any order, and replays in few slices."""

import numpy as np
import pandas as pd
import pytest

from sensorloom.plans import live_streams
from sensorloom.streaming import live


class Held:
    """One value of state."""

    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Told(live.InOrder):
    def take(self, key, rows):
        yield rows


@pytest.mark.parametrize("order", ["backwards", "shuffled", "with a hole"])
def test_no_row_of_a_micro_batch_is_late_however_many_wait(monkeypatch, order):
    """Before, rows beyond HOLD went on over the hole, and the earlier ones that came next were dropped as late."""
    monkeypatch.setattr(live, "HOLD", 20)
    idx = {"backwards": np.arange(300)[::-1], "shuffled": np.random.default_rng(3).permutation(300), "with a hole": np.delete(np.arange(300), 5)}[order]
    frames = [pd.DataFrame({"idx": part, "ts_s": part * 0.01}) for part in np.array_split(np.concatenate([idx, idx[:3]]), 11)]
    processor = Told()
    processor.place = Held()
    got = pd.concat(processor.handleInputRows(("A", "r"), iter(frames), None))
    assert got["idx"].tolist() == sorted(idx)
    last, late, last_ts = processor.place.get()
    assert (last, late) == (299, 3) and last_ts == pytest.approx(2.99)


def test_late_rows_are_replayed_in_few_slices(spark, monkeypatch):
    """Before, each slice had 256 rows of a recording, so that micro-batches grew with the recordings."""
    asked = []

    def slices(rows, path, width, along):
        asked.append((width, rows.agg({"arrival": "max"}).first()[0]))
        raise InterruptedError

    monkeypatch.setattr(live, "replay_slices", slices)
    with pytest.raises(InterruptedError):
        live_streams.x2_late(spark, "/root/testdata/sf0.1")
    ((width, last),) = asked
    assert width % live_streams.LATE_SLICE == 0 and last // width < 6


def test_slices_along_the_clock_do_not_grow_with_the_span(spark, monkeypatch):
    """Before, a slice had three days, so that a replay of some years took hundreds of appends."""
    asked = []

    def slices(rows, path, width, along):
        low, high = rows.agg({"ts_s": "min"}).first()[0], rows.agg({"ts_s": "max"}).first()[0]
        asked.append((along, high // width - low // width + 1))
        raise InterruptedError

    monkeypatch.setattr(live, "replay_slices", slices)
    for query in (live_streams.x3_ends, live_streams.x3_counts):
        with pytest.raises(InterruptedError):
            query(spark, "/root/testdata/sf0.001")
    assert [a for a, _ in asked] == ["ts_s", "ts_s"] and max(n for _, n in asked) <= 5
    for days in (30, 1800, 10_800):
        assert days * 86400 / live.slice_seconds(days * 86400, 100_000) <= 4
    assert live.slice_seconds(400.0, 40_000_000) == 40  # more rows, more slices


def test_live_ridge_orders_the_streams_once(spark, monkeypatch):
    """Before, the replay and the windows of the models each ordered the events."""
    made, order = [], live_streams.td.streams

    def counted(*a):
        made.append(order(*a))
        return made[-1]

    def stop(*a):
        raise InterruptedError

    monkeypatch.setattr(live_streams.td, "streams", counted)
    monkeypatch.setattr(live, "run_ridge", stop)
    with pytest.raises(InterruptedError):
        live_streams.x2_ridge(spark, "/root/testdata/sf0.001")
    assert len(made) == 1
