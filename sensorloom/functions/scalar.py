"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_finite(x: Column) -> Column:
    """Present, not NaN, not infinite."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def magnitude(x: Column, y: Column, z: Column) -> Column:
    """Rotation-invariant length of a 3-axis reading."""
    return F.sqrt(x * x + y * y + z * z)


def vector_magnitude(v: Column) -> Column:
    """Length of an array reading of any width."""
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e.cast("double") * e.cast("double")))


def skill_score(model: Column, persistence: Column) -> Column:
    """1 - model/persistence. A perfect model against a zero baseline scores 1."""
    return F.when(persistence == 0, F.when(model == 0, F.lit(1.0))).otherwise(1 - F.try_divide(model, persistence))


def inverse(x: Column) -> Column:
    """1/x, NULL for 0 and NULL."""
    return F.when(x != 0, F.lit(1.0) / x)


def yes_no(condition: Column) -> Column:
    return F.when(condition, F.lit("YES")).otherwise(F.lit("NO"))


def parse_number(text: Column) -> Column:
    """Blank, nan and na mean missing; anything unparsable is missing too."""
    clean = F.lower(F.trim(text))
    return F.when(~clean.isin("", "nan", "na"), clean.try_cast("double"))


def fixed3(x: Column) -> Column:
    return F.format_string("%.3f", x)


def interval_text(mean: Column, low: Column, high: Column) -> Column:
    return F.format_string("%.3f [%.3f, %.3f]", mean, low, high)


def overlap_seconds(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Length of the common part of two closed intervals, 0 if they are apart."""
    common = F.least(a_last, b_last) - F.greatest(a_first, b_first)
    known = a_first.isNotNull() & a_last.isNotNull() & b_first.isNotNull() & b_last.isNotNull()
    return F.when(known, F.greatest(common, F.lit(0.0)))


def overlap_fraction(a_first: Column, a_last: Column, b_first: Column, b_last: Column) -> Column:
    """Common part over the span of both."""
    span = F.greatest(a_last, b_last) - F.least(a_first, b_first)
    common = overlap_seconds(a_first, a_last, b_first, b_last)
    return F.when(common == 0, F.lit(0.0)).otherwise(F.try_divide(common, span))


def filter_order(sos: Column) -> Column:
    """True denominator order of second-order sections [b0,b1,b2,a0,a1,a2]."""
    section = lambda s: F.when(F.abs(s[5]) > 1e-12, 2).when(F.abs(s[4]) > 1e-12, 1).otherwise(0)
    return F.aggregate(sos, F.lit(0), lambda acc, s: acc + section(s))


def filter_name(sos: Column, rate_hz: Column) -> Column:
    return F.format_string("ellip_sos_order%d_fs%d", filter_order(sos), rate_hz.cast("int"))


def rotation_of(transform: Column) -> Column:
    """3x3 part, row-major 9 values, of a row-major 4x4 transform."""
    return F.concat(F.slice(transform, 1, 3), F.slice(transform, 5, 3), F.slice(transform, 9, 3))


def translation_of(transform: Column) -> Column:
    return F.array(transform[3], transform[7], transform[11])


def quaternion_wxyz(r: Column) -> Column:
    """Unit quaternion of a row-major 3x3 rotation (largest-component form)."""
    m = [[r[3 * i + j] for j in range(3)] for i in range(3)]
    trace = m[0][0] + m[1][1] + m[2][2]
    # Twice the off-diagonal sums and differences; each component is one of these
    # divided by four times the component with the largest square.
    diff = {0: m[2][1] - m[1][2], 1: m[0][2] - m[2][0], 2: m[1][0] - m[0][1]}
    total = {frozenset((i, j)): m[i][j] + m[j][i] for i in range(3) for j in range(i)}

    def led_by_axis(i: int) -> Column:
        others = [m[k][k] for k in range(3) if k != i]
        lead = F.sqrt(1 + m[i][i] - others[0] - others[1]) / 2
        axis = [lead if k == i else total[frozenset((i, k))] / (4 * lead) for k in range(3)]
        return F.array(diff[i] / (4 * lead), *axis)

    w = F.sqrt(trace + 1) / 2
    led_by_w = F.array(w, *[diff[k] / (4 * w) for k in range(3)])
    x_leads = (m[0][0] >= m[1][1]) & (m[0][0] >= m[2][2])
    return (
        F.when(trace > 0, led_by_w)
        .when(x_leads, led_by_axis(0))
        .when(m[1][1] >= m[2][2], led_by_axis(1))
        .otherwise(led_by_axis(2))
    )
