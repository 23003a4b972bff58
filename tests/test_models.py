"""Ridge on moments against a direct fit, selection, folds and leakage."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorloom.config import BaselineSpec, WindowSpec
from sensorloom.operators import forecasts, linear, selection, splits
from sensorloom.operators.metrics import recording_results, with_skill
from sensorloom.operators.windows import build_windows

SPEC = WindowSpec(8, 3, 2)
BASE = BaselineSpec(linear_k=4, lags=(2, 8), alphas=(1e-4, 1.0), report_horizons=(1, 3))


@pytest.fixture(scope="module")
def setup(spark, stream):
    rng = np.random.default_rng(4)

    def make(n):
        q = 9.8 + np.convolve(rng.normal(size=n + 5), np.ones(5) / 5, "valid")[:n]
        return [(i * 0.01, q[i], abs(q[i] - 9) + rng.random()) for i in range(n)]

    s = stream({f"a{i}": make(80 + 20 * i) for i in range(4)}).unionByName(stream({f"b{i}": make(90 + 10 * i) for i in range(4)}, "B")).cache()
    recs = s.groupBy("dataset", "recording_id", "dependency_group").count().withColumn("ord", F.substring("recording_id", 2, 1).cast("bigint")).drop("count").cache()
    w = build_windows(s, SPEC, True).cache()
    m = linear.recording_moments(w, SPEC, (9.8, 1.0)).cache()
    return s, recs, w, m


def direct_fit(frames, lag, alpha, use_qw):
    """Weighted ridge on raw windows; every recording weighs the same."""
    x = [np.hstack([np.stack(f.hist_qf)[:, -lag:]] + ([np.stack(f.hist_qw)[:, -lag:]] if use_qw else [])) for f in frames]
    y = np.vstack([np.stack(f.future_qf) for f in frames])
    w = np.concatenate([np.full(len(v), 1 / len(v) / len(x)) for v in x])
    x = np.vstack(x)
    mean = w @ x
    std = np.sqrt(w @ (x - mean) ** 2)
    z, yc = (x - mean) / std, y - w @ y
    coef = np.linalg.solve((z * w[:, None]).T @ z + alpha * np.eye(z.shape[1]), (z * w[:, None]).T @ yc)
    return mean, std, coef.T, w @ y


def test_fits_predictions_and_selection(setup, spark):
    _, recs, w, m = setup
    pdf = w.toPandas()
    by_rec = {k: g for k, g in pdf.groupby("recording_id")}
    chosen = selection.select_ridge(m, recs, SPEC, BASE).cache()
    fits = selection.refit(m, recs, chosen, SPEC, (9.8, 1.0)).cache()
    assert fits.count() == 2 * (8 + 2)
    for r in fits.collect():
        names = [x for x in by_rec if x[0] == r.dataset.lower() and x != r.held_recording]
        mean, std, coef, intercept = direct_fit([by_rec[x] for x in names], r.lag, r.alpha, r.model == forecasts.RIDGE_QF_QW)
        assert r.scaler_mean == pytest.approx(mean, abs=1e-9) and r.scaler_std == pytest.approx(std, abs=1e-9)
        assert np.array(r.coef) == pytest.approx(coef, abs=1e-7) and r.intercept == pytest.approx(intercept, abs=1e-9)
        assert r.n_windows == sum(len(by_rec[x]) for x in names)

    # Nested validation scores, by fitting and scoring raw windows.
    scores = {(s.fold_id, s.recording_id, s.model, s.lag, s.alpha): s.rmse for s in selection.validation_scores(m, recs, SPEC, [("B3_RIDGE_QF_QW", 8, 1.0)]).collect()}
    group = {r.recording_id: r.dependency_group for r in recs.collect()}
    fold = "A_LORO_01_a0"
    for v in ("a1", "a2", "a3"):
        train = [x for x in ("a1", "a2", "a3") if group[x] != group[v]]
        mean, std, coef, b = direct_fit([by_rec[x] for x in train], 8, 1.0, True)
        f = by_rec[v]
        x = (np.hstack([np.stack(f.hist_qf), np.stack(f.hist_qw)]) - mean) / std
        rmse = np.sqrt(np.mean((x @ coef.T + b - np.stack(f.future_qf)) ** 2))
        assert scores[fold, v, "B3_RIDGE_QF_QW", 8, 1.0] == pytest.approx(rmse, abs=1e-9)

    models = selection.assign_models(fits, recs, (("A", "B"), ("B", "A")))
    keys = ["evaluation_context", "fold_id", "model", "dataset", "recording_id", "origin"]
    a = linear.ridge_predict(w, models, SPEC).orderBy(*keys).collect()
    slim = models.select("dataset", "recording_id", "evaluation_context", "fold_id", "model", "lag", "scaler_mean", "scaler_std", "coef", "intercept")
    b = linear._predict_joined(w, slim, SPEC, ["dataset", "recording_id"]).orderBy(*keys).collect()
    assert len(a) == len(b) == 4 * len(pdf)
    for x, y in zip(a, b):
        assert [x[k] for k in keys] == [y[k] for k in keys] and x.yhat == pytest.approx(y.yhat, abs=1e-9)


def test_shift_has_no_effect(setup):
    _, recs, w, m = setup
    plain = linear.recording_moments(w, SPEC)
    a, b = (selection.select_ridge(x, recs, SPEC, BASE).orderBy("fold_id", "model").collect() for x in (m, plain))
    assert [(r.lag, r.alpha, round(r.score, 7)) for r in a] == [(r.lag, r.alpha, round(r.score, 7)) for r in b]


def test_persistence_scores_no_skill(setup):
    _, _, w, _ = setup
    out = with_skill(recording_results(forecasts.predict(w, SPEC, BASE), SPEC, BASE))
    assert out.filter("model = 'B0_PERSISTENCE' and skill is not null").count() == 0
    forecasts.register_forecaster("COPY", lambda s, b: F.array_repeat(F.element_at("hist_qf", -1), s.horizon))
    both = with_skill(recording_results(forecasts.predict(w, SPEC, BASE, ("B0_PERSISTENCE", "COPY")), SPEC, BASE))
    assert {r.skill for r in both.filter("model = 'COPY'").collect()} == {0.0}
    with pytest.raises(ValueError):
        forecasts.predict(w, SPEC, BASE, ("NOPE",))


def test_future_does_not_reach_the_history(setup, spark):
    s, _, w, _ = setup
    changed = build_windows(s.withColumn("q_f", F.when(F.col("idx") > 50, F.lit(1e6)).otherwise(F.col("q_f"))), SPEC, True)
    early = lambda df: [tuple(r) for r in forecasts.predict(df, SPEC, BASE).filter("origin <= 50").select("recording_id", "origin", "model", "yhat").orderBy("recording_id", "origin", "model").collect()]
    assert early(w) == early(changed)


def test_folds_are_disjoint(setup):
    _, recs, _, m = setup
    recs = recs.filter("recording_id <> 'b3'")
    loro = splits.leave_one_recording_out(recs)
    assert loro.count() == 4 * 4 + 3 * 3
    assert loro.filter("split_role = 'test'").count() == 7
    every = loro.unionByName(splits.leave_group_out(recs)).unionByName(splits.transfer_manifests(recs, (("A", "B"), ("B", "A"))))
    assert splits.overlapping_roles(every).count() == 0
    single = splits.leave_group_out(recs).filter("fold_id = 'B_LGO_g1'").first()
    assert single.notes.endswith("SMALL_GROUP_SINGLE_RECORDING")
    # Holding b1 out leaves a single group: no inner split, so no selection for that fold.
    chosen = selection.select_ridge(m.filter("recording_id <> 'b3'"), recs, SPEC, BASE)
    assert chosen.select("fold_id").distinct().count() == 7 + 2 - 1


def test_tied_argmin_prefers_short_lag_then_strong_penalty(spark):
    rows = [("k", 10, 0.1, 1.0), ("k", 5, 0.1, 1.005), ("k", 5, 10.0, 1.009), ("k", 2, 1.0, 1.02), ("k", 1, 1.0, float("nan"))]
    r = selection.tied_argmin(spark.createDataFrame(rows, "k string, lag int, alpha double, score double"), ["k"]).first()
    assert (r.lag, r.alpha, r.n_tied, r.best_score) == (5, 10.0, 3, 1.0)


def test_magnitudes_do_not_turn(spark):
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 3))
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    from sensorloom.functions.scalar import magnitude

    norm = lambda a: [r[0] for r in spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(a)], "i int, x double, y double, z double").orderBy("i").select(magnitude(F.col("x"), F.col("y"), F.col("z"))).collect()]
    assert norm(v) == pytest.approx(norm(v @ q.T), abs=1e-12)
