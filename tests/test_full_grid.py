"""The ridge protocol with every lag and penalty against a direct solve on raw windows."""

import numpy as np
import pytest

from sensorloom.plans import base
from sensorloom.plans.catalog import QUERIES
from sensorloom.sources import testdata as td

D = "/root/testdata/sf0.001"
MODELS = {"B2_RIDGE_QF": False, "B3_RIDGE_QF_QW": True}
CONTEXTS = ("WITHIN_A", "WITHIN_B", "A_TO_B", "B_TO_A")


def inputs(frame, lag, use_qw):
    """Inputs and targets of one recording's windows."""
    x = np.stack(frame.hist_qf)[:, -lag:]
    return np.hstack([x, np.stack(frame.hist_qw)[:, -lag:]]) if use_qw else x, np.stack(frame.future_qf)


def solve(frames, lag, alpha, use_qw):
    """Ridge in which every recording weighs the same; returns a scorer."""
    parts = [inputs(f, lag, use_qw) for f in frames]
    w = np.concatenate([np.full(len(x), 1 / len(x) / len(parts)) for x, _ in parts])
    x, y = np.vstack([p[0] for p in parts]), np.vstack([p[1] for p in parts])
    mean, target = w @ x, w @ y
    std = np.sqrt(w @ (x - mean) ** 2)
    z = (x - mean) / std
    coef = np.linalg.solve((z.T * w) @ z + alpha * np.eye(z.shape[1]), (z.T * w) @ (y - target))
    return lambda v: (v - mean) / std @ coef + target


def rmse(scorer, frame, lag, use_qw):
    x, y = inputs(frame, lag, use_qw)
    e = scorer(x) - y
    return np.sqrt(np.mean(e**2)), np.sqrt(np.mean(e**2, axis=0))


def choose(frames, group, names, lags, use_qw):
    """Lag and penalty by leaving one group of the train recordings out at a time."""
    scores = {}
    for lag in lags:
        for alpha in base.BASE.alphas:
            errors = []
            for g in sorted({group[n] for n in names}):
                train = [frames[n] for n in names if group[n] != g]
                if train:
                    s = solve(train, lag, alpha, use_qw)
                    errors += [rmse(s, frames[n], lag, use_qw)[0] for n in names if group[n] == g]
            scores[lag, alpha] = np.mean(errors)
    least = min(scores.values())
    return min((k for k, v in scores.items() if v <= least * 1.01), key=lambda k: (k[0], -k[1]))


@pytest.fixture(scope="module")
def direct(spark):
    """{(setting, context, model, recording): (lag, alpha, error, errors by step)}"""
    pdf = base.windows(spark, D).toPandas()
    frames = {k: f for k, f in pdf.groupby("recording_id")}
    home = dict(zip(pdf.recording_id, pdf.dataset))
    group = dict(zip(pdf.recording_id, pdf.dependency_group))
    out = {}
    for setting, lags in (("primary", base.BASE.lags), ("fixed", (td.SPEC.lookback,))):
        for model, use_qw in MODELS.items():
            for d, other in (("A", "B"), ("B", "A")):
                own = [n for n in frames if home[n] == d]
                jobs = [(f"WITHIN_{d}", [n for n in own if n != held], [held]) for held in own]
                jobs.append((f"{d}_TO_{other}", own, [n for n in frames if home[n] == other]))
                for context, train, test in jobs:
                    lag, alpha = choose(frames, group, train, lags, use_qw)
                    scorer = solve([frames[n] for n in train], lag, alpha, use_qw)
                    for n in test:
                        out[setting, context, model, n] = (lag, alpha, *rmse(scorer, frames[n], lag, use_qw))
    return out


def of(direct, setting, context, model):
    return [v for k, v in direct.items() if k[:3] == (setting, context, model)]


def test_selected_models_and_errors(spark, direct):
    got = {(r.dataset, r.held_recording, r.model): r for r in QUERIES["a16_ridge_fit"](spark, D).collect()}
    assert len(got) == 2 * (14 + 2)
    for (setting, context, model, n), (lag, alpha, *_) in direct.items():
        if setting == "primary":
            r = got[("A" if n < "r06" else "B", n, model) if context.startswith("WITHIN") else (context[0], None, model)]
            assert (r.lag, r.alpha) == (lag, alpha)
    results = {(r.evaluation_context, r.model, r.recording_id): r for r in QUERIES["k8_all_results"](spark, D).collect()}
    for (setting, context, model, n), (_, _, error, steps) in direct.items():
        if setting == "primary":
            r = results[context, model, n]
            assert r.rmse_all_horizons == pytest.approx(error, abs=2e-6)
            assert [r.rmse_at_1, r.rmse_at_2, r.rmse_at_4] == pytest.approx(list(steps[[0, 1, 3]]), abs=2e-6)


def test_every_lag_and_penalty_competes(spark):
    """Validation errors of one fold for the whole grid (the given signals are noise, so that short lags win)."""
    scores = QUERIES["k7_validation_scores"](spark, D).filter("fold_id = 'A_LORO_01_r00'").collect()
    pdf = base.windows(spark, D).filter("dataset = 'A'").toPandas()
    frames = {k: f for k, f in pdf.groupby("recording_id") if k != "r00"}
    group = dict(zip(pdf.recording_id, pdf.dependency_group))
    assert len(scores) == len(MODELS) * len(base.BASE.lags) * len(base.BASE.alphas) * len(frames)
    for r in scores:
        use_qw = MODELS[r.model]
        scorer = solve([f for n, f in frames.items() if group[n] != group[r.recording_id]], r.lag, r.alpha, use_qw)
        assert r.rmse == pytest.approx(rmse(scorer, frames[r.recording_id], r.lag, use_qw)[0], abs=2e-6)


def test_tables_of_the_full_grid(spark, direct):
    mean = {(c, m): np.mean([v[2] for v in of(direct, "primary", c, m)]) for c in CONTEXTS for m in MODELS}
    table = {r.model: r for r in QUERIES["r1_model_by_context"](spark, D).collect()}
    gaps = {(r.direction, r.model): r for r in QUERIES["j8_transfer_gaps"](spark, D).collect()}
    roles = {(r.evaluation_context, r.model): r.mean_rmse for r in QUERIES["r4_baseline_roles"](spark, D).collect()}
    for (c, m), v in mean.items():
        assert table[m][c] == pytest.approx(v, abs=2e-6) and roles[c, m] == pytest.approx(v, abs=2e-6)
    for direction, within in (("A_TO_B", "WITHIN_B"), ("B_TO_A", "WITHIN_A")):
        for m in MODELS:
            assert gaps[direction, m].transfer_gap == pytest.approx(mean[direction, m] - mean[within, m], abs=2e-6)
    for r in QUERIES["t3_best_model"](spark, D).collect():
        assert r.best_value <= min(mean[r.evaluation_context, m] for m in MODELS) + 2e-6


def test_fixed_lag_sensitivity(spark, direct):
    rows = {r.evaluation_context: r for r in QUERIES["k9_fixed_lag_sensitivity"](spark, D).collect()}
    assert set(rows) == set(CONTEXTS)
    for c, r in rows.items():
        for s in ("primary", "fixed"):
            want = of(direct, s, c, "B3_RIDGE_QF_QW")
            errors = np.array([v[2] for v in want])
            assert r[f"{s}_n_recordings"] == len(want) and r[f"{s}_mean"] == pytest.approx(errors.mean(), abs=2e-6)
            steps = np.mean([v[3] for v in want], axis=0)
            assert [r[f"{s}_mean_rmse_at_{h}"] for h in (1, 2, 4)] == pytest.approx(list(steps[[0, 1, 3]]), abs=2e-6)
            # The interval of the hashed draws lies where NumPy's own draws put it.
            draws = np.random.default_rng(1).choice(errors, (10_000, len(errors))).mean(axis=1)
            spread = errors.std() / np.sqrt(len(errors))
            assert [r[f"{s}_ci_low"], r[f"{s}_ci_high"]] == pytest.approx(list(np.quantile(draws, [0.025, 0.975])), abs=0.15 * spread + 1e-6)
        assert r.delta == pytest.approx(r.fixed_mean - r.primary_mean, abs=2e-6)


@pytest.mark.parametrize("name", ["a28_c4_paired_vs_ridge", "c5_residual_gate", "c7_key_findings", "r2_skill_table"])
def test_full_grid_has_the_columns_of_the_one_lag_form(spark, name):
    got = QUERIES[name](spark, D)
    assert got.columns == QUERIES[f"{name}_lag1"](spark, D).columns and got.count() > 0
