"""Rule tables: ordered conditions over aggregated evidence."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorloom.config import RECORDING
from sensorloom.functions.scalar import yes_no
from sensorloom.operators.rows import side_by_side, union_all

# Reasons of the usability rules.
NO_IMU = "IMU acceleration/angular velocity not available"
NO_GT = "public ground-truth pose not available"
NO_UNITS = "acceleration units not verified"
NO_FRAME = "sensor frame not sufficiently understood"
SHORT_OVERLAP = "IMU-GT overlap < 20 s"
NOT_FINITE = "required IMU channels < 99% finite"
NO_CALIB = "calibration/frame relationship incompletely documented"


def classify_usability(evidence: DataFrame) -> DataFrame:
    """Usability status of each recording with its reasons.

    Flags downloaded, public_gt, withheld, imu_ok, gt_ok, units_ok, frame_ok,
    calib_ok, corrupt are boolean; overlap_s, min_overlap_s, finite_fraction are
    numbers.
    """
    gt = F.col("gt_ok") & F.col("public_gt")
    long_enough = F.coalesce("overlap_s", F.lit(0.0)) >= F.coalesce("min_overlap_s", F.lit(20.0))
    finite = F.coalesce("finite_fraction", F.lit(0.0)) >= 0.99
    checks = {
        NO_IMU: F.col("imu_ok"),
        NO_GT: gt,
        NO_UNITS: F.col("units_ok"),
        NO_FRAME: F.col("frame_ok"),
        SHORT_OVERLAP: long_enough,
        NOT_FINITE: finite,
        NO_CALIB: F.col("calib_ok"),
    }
    reasons = F.filter(F.array(*[F.when(~ok, text) for text, ok in checks.items()]), lambda r: r.isNotNull())
    missing = ~F.col("downloaded")
    status = (
        F.when(F.col("withheld") & missing, "GT_WITHHELD")
        .when(missing, "NOT_DOWNLOADED")
        .when(F.col("corrupt") | ~F.col("imu_ok") | ~gt | ~finite, "EXCLUDE")
        .when(~long_enough | ~F.col("units_ok"), "QUESTIONABLE")
        .when(F.size(reasons) > 0, "USABLE_SECONDARY")
        .otherwise("USABLE_PRIMARY")
    )
    why = (
        F.when(F.col("usable_status") == "GT_WITHHELD", "GROUND_TRUTH_WITHHELD")
        .when(F.col("usable_status") == "NOT_DOWNLOADED", "not downloaded")
        .when(F.col("corrupt"), "file corruption or unreadable official archive")
        .otherwise(F.array_join(reasons, "; "))
    )
    return evidence.withColumn("usable_status", status).select(*RECORDING, "usable_status", why.alias("exclusion_reason"))


# Check ids of the full audit with the severity a failure carries.
AUDIT_CHECKS = (
    ("CSV_READABLE", "imu", "CRITICAL"),
    ("YAML_READABLE", "calibration", "CRITICAL"),
    ("REQUIRED_COLUMNS", "imu", "CRITICAL"),
    ("NAN_INF", "imu", "CRITICAL"),
    ("MONOTONIC_TS", "timestamps", "MAJOR"),
    ("CONSTANT_CHANNELS", "imu", "MAJOR"),
    ("GT_READABLE", "ground_truth", "CRITICAL"),
    ("GT_OVERLAP", "ground_truth", "MAJOR"),
)


def audit_conditions() -> dict[str, Column]:
    """When each check passes, from the joined audit columns."""
    return {
        "CSV_READABLE": F.col("n_samples") > 0,
        "YAML_READABLE": F.col("has_calibration"),
        "REQUIRED_COLUMNS": F.col("layout") != "UNRESOLVED",
        "NAN_INF": F.col("finite_fraction_required") >= 0.99,
        "MONOTONIC_TS": F.col("backward_count") == 0,
        "CONSTANT_CHANNELS": ~F.col("accel_constant"),
        "GT_READABLE": F.coalesce(F.col("n_reference") > 0, F.lit(False)),
        "GT_OVERLAP": F.coalesce(F.col("overlap_s"), F.lit(0.0)) >= 20,
    }


def audit_findings(evidence: DataFrame) -> DataFrame:
    """One finding per check and recording; a passed check is informational except
    where the table always carries its severity."""
    passes = audit_conditions()
    always = {"CSV_READABLE", "REQUIRED_COLUMNS", "GT_READABLE"}
    rows = F.array(
        *[
            F.struct(
                F.lit(check).alias("check_id"),
                F.lit(category).alias("category"),
                F.when(passes[check] & F.lit(check not in always), "INFO").otherwise(severity).alias("severity"),
                F.when(passes[check], "PASS").otherwise("FAIL").alias("status"),
            )
            for check, category, severity in AUDIT_CHECKS
        ]
    )
    return evidence.select(*RECORDING, F.inline(rows))


# Rule and action of each check in the full audit.
AUDIT_RULES = {
    "CSV_READABLE": ("table with a header", "Signal table.", "EXCLUDE"),
    "YAML_READABLE": ("calibration file", "Calibration of the sensor.", "review"),
    "REQUIRED_COLUMNS": ("timestamp + 3 gyro + 3 accel", "Columns found in the header.", "EXCLUDE"),
    "NAN_INF": (">=99% finite required IMU samples", "Finite share of the required cells.", "EXCLUDE"),
    "MONOTONIC_TS": ("strictly increasing timestamps preferred", "Order of the native clock.", "review"),
    "CONSTANT_CHANNELS": ("non-constant IMU channels", "Stuck accelerometer.", "EXCLUDE"),
    "GT_READABLE": ("reference table readable", "Reference table.", "EXCLUDE"),
    "GT_OVERLAP": (">=20 s IMU-GT overlap", "Common time, without interpolation.", "downgrade usability"),
    "ZIP_VALID": ("no damaged member", "Archive of the recording.", "EXCLUDE"),
}


def detailed_findings(evidence: DataFrame) -> DataFrame:
    """`audit_findings` with the observed value, the rule, its meaning and the action; with a `damaged_member`
    column (blank: none) the archive is a ninth check."""
    observed = {
        "CSV_READABLE": F.format_string("n=%d", "n_samples"),
        "YAML_READABLE": F.when(F.col("has_calibration"), "present").otherwise("missing"),
        "REQUIRED_COLUMNS": F.col("layout"),
        "NAN_INF": F.format_string("finite_fraction=%.6f", "finite_fraction_required"),
        "MONOTONIC_TS": F.format_string("backward=%d", "backward_count"),
        "CONSTANT_CHANNELS": F.concat(F.lit("accel_constant="), F.col("accel_constant").cast("string")),
        "GT_READABLE": F.when(F.col("n_reference").isNull(), "missing").otherwise(F.format_string("n=%d", "n_reference")),
        "GT_OVERLAP": F.format_string("overlap_s=%.6f", F.coalesce("overlap_s", F.lit(0.0))),
    }
    passes, severities = audit_conditions(), {c: (g, s) for c, g, s in AUDIT_CHECKS}
    always = {"CSV_READABLE", "REQUIRED_COLUMNS", "GT_READABLE"}
    if "damaged_member" in evidence.columns:
        sound = F.coalesce("damaged_member", F.lit("")) == ""
        passes["ZIP_VALID"], severities["ZIP_VALID"] = sound, ("archive", "CRITICAL")
        observed["ZIP_VALID"] = F.when(sound, "archive_ok").otherwise(F.col("damaged_member"))
    rows = []
    for check, (category, severity) in severities.items():
        rule, meaning, action = AUDIT_RULES[check]
        ok = passes[check]
        rows.append(
            F.struct(
                F.lit(check).alias("check_id"), F.lit(category).alias("category"), F.when(ok & F.lit(check not in always), "INFO").otherwise(severity).alias("severity"),
                F.when(ok, "PASS").otherwise("FAIL").alias("status"), observed[check].alias("observed"), F.lit(rule).alias("expected_or_rule"),
                F.lit(meaning).alias("interpretation"), F.when(ok, "none").otherwise(action).alias("action_required"),
            )
        )
    return evidence.select(*RECORDING, F.inline(F.array(*rows)))


def archive_verdict(evidence: DataFrame) -> DataFrame:
    """`audit_verdict` with the archive's own status; a damaged archive excludes the recording."""
    status = F.when(F.coalesce("damaged_member", F.lit("")) == "", "OK").otherwise("DAMAGED")
    archives = evidence.select(*RECORDING, status.alias("archive_status"))
    damaged = F.col("archive_status") == "DAMAGED"
    return audit_verdict(evidence).join(archives, list(RECORDING)).select(
        *RECORDING, F.when(damaged, "EXCLUDE").otherwise(F.col("usable_status")).alias("usable_status"),
        F.when(damaged, "CRITICAL integrity failure").otherwise(F.col("exclusion_reason")).alias("exclusion_reason"), "archive_status",
    )


def audit_verdict(evidence: DataFrame) -> DataFrame:
    """EXCLUDE, QUESTIONABLE or USABLE_PRIMARY per recording."""
    passes = audit_conditions()
    critical = F.lit(False)
    for check, _, severity in AUDIT_CHECKS:
        if severity == "CRITICAL":
            critical = critical | ~passes[check]
    documented = F.col("units_ok") & F.col("has_calibration") & passes["REQUIRED_COLUMNS"] & passes["GT_READABLE"]
    long_enough = (F.col("duration_s") >= 20) & passes["GT_OVERLAP"]
    verdict = F.when(critical, "EXCLUDE").when(~documented | ~long_enough, "QUESTIONABLE").otherwise("USABLE_PRIMARY")
    reason = (
        F.when(critical, "CRITICAL integrity failure")
        .when(~documented, "incomplete IMU/units/frame/GT documentation")
        .when(~long_enough, "duration or IMU-GT overlap < 20 s")
        .otherwise("")
    )
    return evidence.select(*RECORDING, verdict.alias("usable_status"), reason.alias("exclusion_reason"))


def primary_set(tables: Sequence[DataFrame]) -> DataFrame:
    """Eligible recordings of all datasets."""
    return union_all(*tables).filter(F.col("usable_status") == "USABLE_PRIMARY")


def stage_verdict(integrity: DataFrame, findings: DataFrame, hashes: DataFrame, channels: DataFrame) -> DataFrame:
    """One-row decision of the processing stage.

    All q_f nearly flat asks for a review; any critical failure, short, off-rate or
    non-finite stream, or a bad hash fails; a near-constant q_f or a major failure
    leaves a conditional pass.
    """
    flat = channels.filter(F.col("channel") == "q_f").agg(
        F.coalesce(F.bool_and(F.col("std") < 0.05), F.lit(False)).alias("degenerate"),
        F.coalesce(F.bool_or("near_constant"), F.lit(False)).alias("near_constant"),
    )
    good = integrity.agg(
        F.bool_and((F.col("enough_rows") == "YES") & (F.col("near_nominal_rate") == "YES") & (F.col("all_finite") == "YES")).alias("streams_ok")
    )
    failed = lambda s: F.count_if((F.col("severity") == s) & (F.col("status") == "FAIL")) > 0
    found = findings.agg(failed("CRITICAL").alias("critical"), failed("MAJOR").alias("major"))
    locked = hashes.agg(F.coalesce(F.bool_and(F.col("status") == "PASS"), F.lit(True)).alias("hashes_ok"))
    decision = (
        F.when(F.col("degenerate"), "CONDITIONAL_PASS_REVIEW_REQUIRED")
        .when(F.col("critical") | ~F.col("streams_ok") | ~F.col("hashes_ok"), "FAIL")
        .when(F.col("near_constant") | F.col("major"), "CONDITIONAL_PASS")
        .otherwise("PASS")
    )
    return side_by_side(flat, good, found, locked).withColumn("decision", decision)


def acquisition_verdict(usable: DataFrame, checks: Mapping[str, Column | bool], downloaded: bool, needed: int = 6) -> DataFrame:
    """Overall audit verdict: enough usable recordings per dataset and every check true.

    `usable` has dataset and usable_status for all datasets involved.
    """
    per_dataset = usable.groupBy("dataset").agg(F.count_if(F.col("usable_status") == "USABLE_PRIMARY").alias("n_primary"))
    summary = per_dataset.agg(F.min("n_primary").alias("least_primary"), F.count(F.lit(1)).alias("n_datasets"))
    all_true = F.lit(True)
    for c in checks.values():
        all_true = all_true & (c if isinstance(c, Column) else F.lit(c))
    verdict = (
        F.when(F.lit(not downloaded), "ACQUISITION_BLOCKED")
        .when((F.col("least_primary") >= needed) & all_true, "CONDITIONAL_PASS")
        .otherwise("FAIL")
    )
    return summary.withColumn("verdict", verdict)


def evidence_class(paired: DataFrame) -> DataFrame:
    """Strength of a paired gain from its mean, interval, wins and relative size."""
    d, lo, hi = F.col("mean_delta"), F.col("ci_low"), F.col("ci_high")
    small = F.abs("relative_improvement_pct") < 1.0
    worse = (d > 0) & (F.col("losses") > F.col("wins"))
    grade = (
        F.when(worse & small & (lo <= 0) & (hi >= 0), "C. NO MATERIAL GAIN")
        .when(worse, "D. DEGRADATION")
        .when((d < 0) & (F.col("wins") >= F.ceil(F.col("n_recordings") / 2)) & (hi <= 0), "A. CLEAR PRACTICAL GAIN")
        .when(d < 0, "B. MODEST / UNCERTAIN GAIN")
        .otherwise("C. NO MATERIAL GAIN")
    )
    return paired.withColumn("evidence_class", grade)


def residual_gate(summary: DataFrame, predictability: DataFrame, within: Sequence[str], transfer: Sequence[str], learned: Sequence[str], persistence: str) -> DataFrame:
    """Is there residual structure that richer models could use? One row."""
    w, t = F.col("evaluation_context").isin(*within), F.col("evaluation_context").isin(*transfer)
    fitted = F.col("model").isin(*learned)
    best = summary.agg(
        F.max(F.when(w & fitted, F.col("mean_recording_skill"))).alias("best_within"),
        F.max(F.when(t & fitted, F.col("mean_recording_skill"))).alias("best_transfer"),
        F.min(F.when(w & fitted, F.col("mean_rmse"))).alias("ridge_within"),
        F.min(F.when(w & (F.col("model") == persistence), F.col("mean_rmse"))).alias("persistence_within"),
    )
    ratio = predictability.agg(F.median("persistence_rmse_over_sd").alias("median_ratio"))
    bw, bt = F.col("best_within"), F.col("best_transfer")
    label = (
        F.when((F.col("median_ratio") < 0.05) & (bw < 0.05), "RESEARCH_TARGET_REVIEW_REQUIRED")
        .when((bw > 0.8) & (bt > 0.6) & (F.col("ridge_within") < 0.25 * F.col("persistence_within")), "ADVANCED_MODELS_LOW_PRIORITY")
        .when((bw > 0.05) & ((bt < bw - 0.05) | (bt < 0.05)), "ADVANCED_MODELS_JUSTIFIED")
        .when(bw > 0.1, "ADVANCED_MODELS_JUSTIFIED")
        .when((bw <= 0.05) & (F.col("median_ratio") > 0.3), "ADVANCED_MODELS_JUSTIFIED")
        .otherwise("ADVANCED_MODELS_LOW_PRIORITY")
    )
    return side_by_side(best, ratio).withColumn("gate", label)


def gain_flags(deltas: DataFrame, seed_spread: DataFrame) -> DataFrame:
    """Per (context, model): majority gain, robustness to dropping the best recording,
    and size against the seed spread.

    `deltas` has evaluation_context, model, delta per recording; `seed_spread` has
    sd_across_seeds. Dropping the best recording only needs sum, count and minimum.
    """
    keys = ["evaluation_context", "model"]
    g = deltas.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("delta").alias("mean_delta"),
        F.sum("delta").alias("total"),
        F.min("delta").alias("best"),
        F.count_if(F.col("delta") < 0).alias("n_negative"),
        F.count_if(F.col("delta") < -1e-12).alias("wins"),
        F.count_if(F.col("delta") > 1e-12).alias("losses"),
    ).join(seed_spread.select(*keys, "sd_across_seeds"), keys, "left")
    majority = (F.col("wins") > F.col("losses")) & (F.col("wins") >= F.ceil(F.col("n") / 2))
    rest = F.col("n") - 1
    rest_negative = F.col("n_negative") - (F.col("best") < 0).cast("bigint")
    robust = (F.try_divide(F.col("total") - F.col("best"), rest) < 0) | (rest_negative >= F.ceil(rest / 2))
    gain = (F.col("mean_delta") < 0) & majority & F.when(F.col("n") >= 3, robust).otherwise(majority)
    over_seed = F.coalesce(F.abs("mean_delta") > F.col("sd_across_seeds"), F.lit(True))
    return g.withColumns({"practical_gain": gain, "gain_over_seeds": gain & over_seed}).drop("total", "best", "n_negative")


def gain_classification(flags: DataFrame, summary: DataFrame, within: tuple[str, str], transfer: tuple[str, str], persistence: str, ridge: str) -> DataFrame:
    """Do richer models gain over ridge? One-row label.

    A transfer collapse is an error above 1.5 times persistence and 1.25 times ridge.
    """
    of = lambda m: F.max(F.when(F.col("model") == m, F.col("mean_rmse")))
    bases = summary.groupBy("evaluation_context").agg(of(persistence).alias("p"), of(ridge).alias("r"))
    rows = flags.join(summary.select("evaluation_context", "model", "mean_rmse"), ["evaluation_context", "model"]).join(bases, "evaluation_context")
    in_ = lambda cs: F.col("evaluation_context").isin(*cs)
    collapse = (F.col("mean_rmse") > 1.5 * F.col("p")) & (F.col("mean_rmse") > 1.25 * F.col("r"))
    improved = (F.col("mean_delta") < 0) & (F.col("wins") > F.col("losses"))
    some = lambda cond: F.coalesce(F.bool_or(cond), F.lit(False))
    each = rows.groupBy("model").agg(
        (F.count_if(in_(within) & F.col("practical_gain")) == len(within)).alias("both"),
        some(in_(within) & F.col("practical_gain")).alias("one"),
        (F.count_if(in_(within) & F.col("gain_over_seeds")) == len(within)).alias("both_seed"),
        some(in_(within) & F.col("gain_over_seeds")).alias("one_seed"),
        some(in_(transfer) & improved).alias("transfers"),
        some(in_(transfer) & collapse).alias("collapses"),
    )
    verdict = each.agg(
        some(F.col("both") & F.col("transfers") & ~F.col("collapses") & F.col("both_seed")).alias("clear"),
        some(F.col("one") & ~F.col("transfers")).alias("domain"),
        some(F.col("one") & ~F.col("one_seed")).alias("unstable"),
        some(F.col("collapses")).alias("collapse"),
    )
    specific = F.lit("ADVANCED_MODEL_DOMAIN_SPECIFIC_GAIN")
    unstable = F.lit("ADVANCED_MODELS_UNSTABLE")
    stays = F.lit("RIDGE_REMAINS_COMPETITIVE")
    label = (
        F.when(F.col("collapse") & ~F.col("clear"), F.when(F.col("domain"), specific).when(F.col("unstable"), unstable).otherwise(stays))
        .when(F.col("clear"), "ADVANCED_MODEL_CLEAR_GAIN")
        .when(F.col("unstable") & F.col("domain"), unstable)
        .when(F.col("domain"), specific)
        .otherwise(stays)
    )
    decision = F.when(F.col("collapse") & (F.col("label") == unstable), "CONDITIONAL_PASS").otherwise("PASS")
    return verdict.withColumn("label", label).withColumn("decision", decision)


def key_findings(summary: DataFrame, paired: DataFrame, within_first: str, within_second: str, first_to_second: str, second_to_first: str,
                 ridge: str, advanced: Sequence[str], convolution: str, recurrent: str, attention: str) -> DataFrame:
    """Support of the five headline findings, one row each."""
    ctx = F.col("evaluation_context")
    m = lambda c, name: F.max(F.when((ctx == c) & (F.col("model") == name), F.col("mean_rmse")))
    p = lambda c, name, col: F.max(F.when((ctx == c) & (F.col("model") == name), F.col(col)))
    learned = [ridge, *advanced]
    best = summary.filter(F.col("model").isin(*learned)).groupBy(ctx).agg(F.min_by("model", "mean_rmse").alias("w"))
    s = summary.agg(
        *[m(within_first, x).alias(f"wf_{i}") for i, x in enumerate(learned)],
        *[m(first_to_second, x).alias(f"fs_{i}") for i, x in enumerate(learned)],
        *[m(second_to_first, x).alias(f"sf_{i}") for i, x in enumerate(learned)],
    )
    d = paired.agg(
        F.min(F.when((ctx == within_first) & F.col("model").isin(*advanced), F.col("mean_delta"))).alias("a_min"),
        *[p(within_second, attention, c).alias(f"b_{c}") for c in ("mean_delta", "wins", "ci_high")],
        *[p(first_to_second, attention, c).alias(f"c_{c}") for c in ("mean_delta", "wins", "losses")],
        p(second_to_first, recurrent, "ci_high").alias("d_high"),
    )
    winners = best.agg(F.count_distinct("w").alias("n_winners"))
    near = F.lit(True)
    for i in range(1, len(learned)):
        near = near & (F.abs(F.col(f"wf_{i}") - F.col("wf_0")) / F.col("wf_0") < 0.03)
    conv, rec = learned.index(convolution), learned.index(recurrent)
    a = near & (F.col("a_min") > -0.01)
    b = (F.col("b_mean_delta") < 0) & (F.col("b_wins") >= 6) & (F.col("b_ci_high") < 0)
    c = (F.abs(F.col(f"fs_{conv}") - F.col("fs_0")) / F.col("fs_0") < 0.02) & (F.col("c_mean_delta") > 0.05) & (F.col("c_losses") > F.col("c_wins"))
    e_best = F.col(f"sf_{rec}") <= F.least(*[F.col(f"sf_{i}") for i in range(len(learned))])
    dd = e_best & (F.col("d_high") > 0)
    e = F.col("n_winners") > 1
    support = lambda cond, weak="NOT_SUPPORTED": F.when(cond, "SUPPORTED").otherwise(weak)
    rows = F.array(*[
        F.struct(F.lit(k).alias("finding"), v.alias("status"))
        for k, v in (("A", support(a)), ("B", support(b)), ("C", support(c)), ("D", support(dd, "PARTIALLY_SUPPORTED")), ("E", support(e)))
    ])
    return side_by_side(s, d, winners).select(F.inline(rows))


def compatibility(meta: DataFrame, a: str, b: str, n_available: Column | int = 6) -> DataFrame:
    """Can two datasets be compared? From their quantity and units in `meta`
    (dataset, quantity, unit_acceleration, unit_gyro). One row."""
    of = lambda d, c: F.max(F.when(F.col("dataset") == d, F.col(c)))
    wide = meta.agg(*[of(d, c).alias(f"{side}_{c}") for side, d in (("a", a), ("b", b)) for c in ("quantity", "unit_acceleration", "unit_gyro")])
    resolved = lambda c: F.coalesce(F.col(c), F.lit("UNRESOLVED")) != "UNRESOLVED"
    same_quantity = (F.col("a_quantity") == F.col("b_quantity")) & resolved("a_quantity") & resolved("b_quantity")
    same_units = (F.col("a_unit_acceleration") == "m/s^2") & (F.col("b_unit_acceleration") == "m/s^2")
    available = n_available if isinstance(n_available, Column) else F.lit(n_available)
    verdict = (
        F.when(available < 6, "INSUFFICIENT_EVIDENCE")
        .when(~F.coalesce(same_quantity & same_units, F.lit(False)), "COMPARABLE_FOR_SELECTED_QUANTITIES_ONLY")
        .otherwise("COMPARABLE_AFTER_DOCUMENTED_FRAME_TRANSFORM")
    )
    return wide.withColumns({"same_quantity": yes_no(same_quantity), "units_ok": yes_no(same_units), "verdict": verdict})


def failing(findings: DataFrame, severity: str = "MAJOR") -> DataFrame:
    """Failed findings of one severity."""
    return findings.filter((F.col("severity") == severity) & (F.col("status") == "FAIL"))
