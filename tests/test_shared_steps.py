"""Steps that several parts of a query read are made once."""

import pytest

from sensorloom.plans import base, models, statistics

SF = "/root/testdata/sf0.001"


@pytest.fixture
def built(monkeypatch):
    """Number of window builds asked for."""
    calls, build = [], base.build_windows

    def counted(*args):
        calls.append(1)
        return build(*args)

    monkeypatch.setattr(base, "build_windows", counted)
    return calls


def test_predictions_build_their_windows_once(spark, built):
    """Before, moments and forecasts built them anew, and every reader of the result did so again."""
    plan = models.all_predictions(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(built) == 1 and "Window" not in plan


def test_local_results_are_read_not_rebuilt(spark, built):
    """Before, each statistic of the paired table ran the windows again."""
    rows = statistics.local_results(spark, SF)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert len(built) == 1 and "Window" not in plan and "Exchange" not in plan


def test_stream_audits_are_made_once(spark, stream):
    """Before, the rows and the spans of the overlap each ran the whole audit."""
    from sensorloom.operators import bundle

    s = stream({"r": [(i * 0.01, i, 1) for i in range(20)]})
    audits = bundle.stream_audits(bundle.both_kinds(s, s.filter("idx > 4")), True)
    assert audits.count() == 2
    assert "Window" not in audits._jdf.queryExecution().executedPlan().toString()
