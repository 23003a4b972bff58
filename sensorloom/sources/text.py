"""Sensor text files: numbered lines, headers, tokens, channels.

Files may be far larger than a task, so nothing here depends on seeing a whole file
in one place. The lines are read twice. The first read keeps a few counts per file
split and kind of line (how many, how wide, where the first one stands); headers,
widths, line numbers and row numbers of all splits follow from that small table. The
second read looks them up and parses, without a shuffle of the lines.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sensorloom.functions.scalar import parse_number
from sensorloom.operators.ordering import assign_idx
from sensorloom.session import materialise

MISSING = ("", "nan", "na")
#: Counts per split are broadcast up to so many rows and header characters, and joined beyond.
MOST_SPLITS = 100_000
MOST_HEADER_CHARS = 20_000_000
#: `monotonically_increasing_id` counts the rows of a task in its low bits.
TASK_BITS = 33


class TextScan(NamedTuple):
    """`files` has one row per file (path, header, n_rows, ...), `rows` the data rows."""

    files: DataFrame
    rows: DataFrame


def _lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    if not paths:
        return spark.createDataFrame([], "path string, split_start bigint, scan_no bigint, line string")
    return spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("split_start"),
        F.monotonically_increasing_id().alias("scan_no"),
        F.col("value").alias("line"),
    )


def _splits(groups: DataFrame) -> DataFrame:
    """Per split: its first line, the lines before it in the file, and what turns a kept row's
    place among the kept rows of its task into its place in the file."""
    splits = groups.groupBy("path", "split_start").agg(F.min("first_no").alias("first_no"), F.sum("n").alias("n"), F.sum("kept").alias("kept"))
    until = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    in_file = until(Window.partitionBy("path").orderBy("split_start"))
    in_task = until(Window.partitionBy(F.shiftright("first_no", TASK_BITS)).orderBy("first_no"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0))
    return splits.select(
        "path", "split_start", "first_no", before("n", in_file).alias("lines_before"), (before("kept", in_file) - before("kept", in_task)).alias("kept_shift")
    )


def _small(groups: DataFrame, texts: Sequence[str], most_splits: int) -> bool:
    chars = sum((F.coalesce(F.sum(F.length(t)), F.lit(0)) for t in texts), F.lit(0))
    n, size = groups.agg(F.count(F.lit(1)), chars).first()
    return n <= most_splits and size <= MOST_HEADER_CHARS


def _line_no() -> Column:
    return F.col("scan_no") - F.col("first_no") + F.col("lines_before")


def numbered_lines(spark: SparkSession, paths: str | Sequence[str], most_splits: int = MOST_SPLITS) -> DataFrame:
    """Lines with `path` and 0-based `line_no`, in file order."""
    lines = _lines(spark, paths)
    counts = lines.groupBy("path", "split_start").agg(F.min("scan_no").alias("first_no"), F.count(F.lit(1)).alias("n"))
    groups = materialise(counts.withColumn("kept", F.lit(0).cast("bigint")), "text-splits")
    splits = _splits(groups)
    if _small(groups, [], most_splits):
        splits = F.broadcast(splits)
    return lines.join(splits, ["path", "split_start"]).select("path", _line_no().alias("line_no"), "line")


def _parsed(lines: DataFrame, groups: DataFrame, files: DataFrame, small: bool, tokens: Column, data: Column, columns: Sequence[str]) -> DataFrame:
    """Data rows: path, row_no, `columns` of the file, tokens; with `idx` where the splits are small enough to be sent along.

    `head_no` is the header among the lines that look like data. Behind a broadcast join the rows stay in
    scan order, so a row's place in its task and the counts before give `idx`; behind a shuffle they do not.
    """
    splits = _splits(groups)
    if small:
        found = lines.join(F.broadcast(splits), ["path", "split_start"]).join(F.broadcast(files), "path")
    else:
        found = lines.join(splits.join(files, "path"), ["path", "split_start"])
    body = found.filter(data & ~F.col("scan_no").eqNullSafe(F.col("head_no"))).withColumn("tokens", tokens).filter(F.forall("tokens", _parsable))
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << TASK_BITS) - 1)) + F.col("kept_shift")
    return body.select("path", _line_no().alias("row_no"), *([place.alias("idx")] if small else []), *columns, "tokens")


def _tokens(line: Column, comma: Column) -> Column:
    by_comma = F.transform(F.split(line, ","), lambda t: F.trim(t))
    by_space = F.filter(F.split(F.trim(line), r"\s+"), lambda t: t != "")
    return F.when(comma, by_comma).otherwise(by_space)


def _parsable(t: Column) -> Column:
    return F.lower(t).isin(*MISSING) | t.try_cast("double").isNotNull()


def _numeric_head(tokens: Column) -> Column:
    """The first three tokens are numbers (a data row rather than names)."""
    return F.forall(F.slice(tokens, 1, 3), lambda t: t.try_cast("double").isNotNull())


def _fit_header(names: Column, width: Column) -> Column:
    """Header of exactly `width` names; missing ones become colN."""
    filled = F.concat(names, F.transform(F.sequence(F.size(names), F.greatest(width - 1, F.size(names))), lambda i: F.concat(F.lit("col"), i)))
    return F.slice(filled, 1, width)


_NO_NAMES = "array<string>"


def _first_of_file(groups: DataFrame, eligible: Column, value: str) -> DataFrame:
    """groups with `value` of the file's first eligible line as `h`, and whether a group holds that line."""
    place = F.struct("split_start", "first_no")
    h = F.min_by(F.struct(F.col(value), place.alias("place")), F.when(eligible, place)).over(Window.partitionBy("path"))
    return groups.withColumn("h", h).withColumn("is_head", eligible & (F.col("h.place") == place))


def scan_asl(spark: SparkSession, paths: str | Sequence[str], most_splits: int = MOST_SPLITS) -> TextScan:
    """ASL-style tables. Files: path, header, header_line, n_rows; rows: path, row_no, idx, header, header_line, tokens.

    The first non-blank line is the header, unless it is plain numbers (header_line is null then). Later
    comment lines are skipped; a row with any unparsable token drops; integer tokens stay text
    here, so counters can be cast to BIGINT without loss.
    """
    lines, line = _lines(spark, paths), F.col("line")
    blank, comment = F.trim(line) == "", F.ltrim(line).startswith("#")
    tokens = _tokens(line, F.contains(line, F.lit(",")))
    names_of = lambda text: F.filter(_tokens(text, F.contains(text, F.lit(","))), lambda t: t != "")
    bare = lambda text: F.regexp_replace(F.trim(text), "^#", "")
    ok = ~blank & ~comment & F.forall(tokens, _parsable)
    plain = ~comment & _numeric_head(names_of(bare(line)))
    shaped = lines.select(
        "path", "split_start", "scan_no", blank.alias("blank"), ok.alias("ok"), F.when(ok, F.size(tokens)).alias("width"), plain.alias("plain"), F.when(~plain, line).alias("text")
    )
    counts = shaped.groupBy("path", "split_start", "blank", "ok", "width").agg(
        F.count(F.lit(1)).alias("n"), F.min("scan_no").alias("first_no"), F.min_by(F.struct("text", "plain"), "scan_no").alias("head")
    )
    written = materialise(counts, "text-splits")
    groups = _first_of_file(written, ~F.col("blank"), "head").withColumn(
        "kept", F.when(F.col("ok"), F.col("n") - F.when(F.col("is_head") & ~F.col("h.head.plain"), 1).otherwise(0)).otherwise(0)
    )
    facts = groups.filter("h is not null").groupBy("path").agg(
        F.first("h").alias("h"), F.max(F.when(F.col("kept") > 0, F.col("width"))).alias("width"), F.sum("kept").alias("n_rows")
    )
    plain_file = F.col("h.head.plain")
    names = F.when(plain_file, F.array().cast(_NO_NAMES)).otherwise(names_of(bare(F.col("h.head.text"))))
    files = facts.select(
        "path",
        F.col("h.head.text").alias("header_line"),
        _fit_header(names, F.coalesce("width", F.size(names))).alias("header"),
        "n_rows",
        F.when(~plain_file, F.col("h.place.first_no")).alias("head_no"),
    )
    small = _small(written, ["head.text"], most_splits)
    rows = _parsed(lines, groups, files, small, tokens, ~blank & ~comment, ["header_line", "header"])
    return TextScan(files.drop("head_no"), rows)


def read_asl_table(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The data rows of `scan_asl`."""
    return scan_asl(spark, paths).rows


#: What comments may say. Units and orders of the quaternion as the formats write them.
_SAID = {
    "has_accel_unit": lambda c: c.contains("m s^-2") | c.contains("m/s^2"),
    "has_gyro_unit": lambda c: c.contains("rad s^-1") | c.contains("rad/s"),
    "says_xyzw": lambda c: F.lower(c).contains("qx qy qz qw") | F.replace(F.lower(c), F.lit(" ")).contains("qx,qy,qz,qw"),
    "says_wxyz": lambda c: F.lower(c).contains("qw qx qy qz"),
}


def scan_sensor_text(spark: SparkSession, paths: str | Sequence[str], most_splits: int = MOST_SPLITS) -> TextScan:
    """Generic sensor text. Files: path, header, n_rows and what the comments say; rows: path, row_no, idx, header, has_accel_unit, has_gyro_unit, tokens.

    Comment lines start with # or %; the last one with at least four names is the
    header. A first data row of names is a header too. Comma separates only if it
    clearly does in the first row. Bad rows drop.
    """
    lines = _lines(spark, paths).withColumn("line", F.trim("line"))
    line = F.col("line")
    blank, comment = line == "", line.rlike("^[#%]")
    data = ~blank & ~comment
    commas, spaces = [F.length(line) - F.length(F.replace(line, F.lit(c))) for c in (",", " ")]
    comma_here = (commas >= 2) & (commas >= spaces)
    numeric = _numeric_head(_tokens(line, comma_here))
    by = {k: _tokens(line, F.lit(k == "comma")) for k in ("comma", "space")}
    shaped = lines.select(
        "path", "split_start", "scan_no", blank.alias("blank"), comment.alias("comment"),
        *[F.when(data, F.size(t)).alias(f"width_{k}") for k, t in by.items()],
        *[(data & F.forall(t, _parsable)).alias(f"ok_{k}") for k, t in by.items()],
        comma_here.alias("comma"), numeric.alias("numeric"), F.when(comment | ~numeric, line).alias("text"),
        *[F.when(comment, said(line)).alias(name) for name, said in _SAID.items()],
    )
    keys = ["path", "split_start", "blank", "comment", *[f"{c}_{k}" for c in ("width", "ok") for k in by]]
    counts = shaped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.min("scan_no").alias("first_no"), F.max("scan_no").alias("last_no"),
        F.min_by(F.struct("text", "comma", "numeric"), "scan_no").alias("head"), F.max_by("text", "scan_no").alias("last_text"),
        *[F.max(name).alias(name) for name in _SAID],
    )
    written = materialise(counts, "text-splits")
    own = lambda c: F.when(F.col("h.head.comma"), F.col(f"{c}_comma")).otherwise(F.col(f"{c}_space"))
    is_data = ~F.col("blank") & ~F.col("comment")
    groups = (
        _first_of_file(written, is_data, "head")
        .withColumn("rest", F.when(is_data, F.col("n") - F.when(F.col("is_head") & ~F.col("h.head.numeric"), 1).otherwise(0)).otherwise(0))
        .withColumn("kept", F.when(own("ok"), F.col("rest")).otherwise(0))
    )
    facts = groups.groupBy("path").agg(
        F.first("h").alias("h"),
        F.max(F.when(F.col("rest") > 0, own("width"))).alias("width"),
        F.sum("kept").alias("n_rows"),
        F.max_by("last_text", F.when(F.col("comment"), F.struct("split_start", "last_no"))).alias("last_comment"),
        *[F.coalesce(F.max(name), F.lit(False)).alias(name) for name in _SAID],
    )
    said = F.filter(F.split(F.regexp_replace(F.coalesce("last_comment", F.lit("")), "^[#% ]+", ""), r"[,\s]+"), lambda t: t != "")
    named = F.coalesce(~F.col("h.head.numeric"), F.lit(False))
    facts = facts.withColumn("comma", F.coalesce("h.head.comma", F.lit(False))).withColumn(
        "names", F.when(named, _tokens(F.col("h.head.text"), F.col("comma"))).when(F.size(said) >= 4, said).otherwise(F.array().cast(_NO_NAMES))
    )
    n = F.size("names")
    names = F.when((n > 0) & (F.col("width") == n + 1), F.concat(F.array(F.lit("index")), F.col("names"))).otherwise(F.col("names"))
    files = facts.select(
        "path", _fit_header(names, F.coalesce("width", n)).alias("header"), "n_rows", "comma", *_SAID, F.when(named, F.col("h.place.first_no")).alias("head_no")
    )
    small = _small(written, ["head.text", "last_text"], most_splits)
    rows = _parsed(lines, groups, files, small, _tokens(line, F.col("comma")), data, ["header", "has_accel_unit", "has_gyro_unit"])
    return TextScan(files.drop("head_no", "comma"), rows)


def read_sensor_text(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """The data rows of `scan_sensor_text`."""
    return scan_sensor_text(spark, paths).rows


# --- header rules ---------------------------------------------------------------
# Each channel lists, in order of preference, sets of substrings that must all occur
# in a column name. Fixed values of the supported formats.

ASL_IMU_RULES = {
    "ts": [("timestamp",), ("t",)],
    **{f"w{c}": [(f"w_rs_s_{c}",), (f"omega_{c}",), (f"gyro_{c}",), (f"w_{c}[",)] for c in "xyz"},
    **{f"f{c}": [(f"a_rs_s_{c}",), (f"acc_{c}",), (f"lin_acc_{c}",)] for c in "xyz"},
}
TEXT_IMU_RULES = {
    "ts": [("time",), ("stamp",)],
    **{f"w{c}": [("ang_vel", c), ("gyro", c), ("omega", c)] for c in "xyz"},
    "fx": [("lin_acc", "x"), ("linacc", "x"), ("lin_acc",), ("acc", "x")],
    **{f"f{c}": [("lin_acc", c), ("linacc", c), ("acc", c)] for c in "yz"},
}
ASL_POSE_RULES = {
    "ts": [("timestamp",)],
    **{f"p{c}": [(f"p_rs_r_{c}",), (f"p_{c}",)] for c in "xyz"},
    **{f"q{c}": [(f"q_rs_{c}",), (f"q_{c}",)] for c in "wxyz"},
    **{f"v{c}": [(f"v_rs_r_{c}",), (f"v_{c}",)] for c in "xyz"},
    "bias_gyro": [("b_w_rs_s_x",), ("bw_x",)],
    "bias_accel": [("b_a_rs_s_x",), ("ba_x",)],
}


TEXT_POSE_RULES = {
    "ts": [("time",), ("t",)],
    **{f"p{c}": [(c,)] for c in "xyz"},
    **{f"q{c}": [(f"q{c}",)] for c in "wxyz"},
}


def find_channel(header: Column, options: Sequence[Sequence[str]]) -> Column:
    """0-based index of the first column that matches the best option, or NULL."""

    def first(needles: Sequence[str]) -> Column:
        def matches(name: Column) -> Column:
            compact = F.replace(F.lower(name), F.lit(" "))
            hit = F.contains(compact, F.lit(needles[0]))
            for n in needles[1:]:
                hit = hit & F.contains(compact, F.lit(n))
            return hit

        hits = F.filter(F.transform(header, lambda h, i: F.when(matches(h), i)), lambda i: i.isNotNull())
        return F.get(hits, F.lit(0))

    return F.coalesce(*[first(n) for n in options])


def map_imu_header(headers: DataFrame, rules: dict = ASL_IMU_RULES, asl: bool = True) -> DataFrame:
    """Channel positions of an IMU table: `places` (name to index) and `layout`.

    `headers` has one row per file with `header`. Without named channels, seven or more
    columns are read as t, w x3, f x3. Plain text keeps named channels out of the way
    of the fallback label only when every channel was found.
    """
    channels = [c for c in rules if c != "ts"]
    found = headers.withColumn(
        "found", F.struct(*[find_channel(F.col("header"), rules[c]).alias(c) for c in rules])
    )
    missing = F.lit(False)
    none = F.lit(True)
    for c in channels:
        missing = missing | F.col(f"found.{c}").isNull()
        none = none & F.col(f"found.{c}").isNull()
    wide = F.size("header") >= 7
    if asl:
        layout = F.when(~missing, "HEADER_MAPPED").when(wide, "OFFICIAL_MATLAB_7COL_T_WXWYWZ_AXAYAZ").otherwise("UNRESOLVED")
    else:
        layout = (
            F.when(wide & none, "ASSUMED_7COL_T_WXWYWZ_AXAYAZ_UNCONFIRMED_BY_HEADER")
            .when(~missing, "HEADER_MAPPED")
            .when(wide, "FALLBACK_7COL")
            .otherwise("UNRESOLVED")
        )
    place = lambda c: F.when(missing & wide, F.lit(1 + channels.index(c))).otherwise(F.col(f"found.{c}"))
    ts = F.coalesce(F.when(wide & none & F.lit(not asl), F.lit(0)), F.col("found.ts"), F.lit(0))
    return found.withColumns({"layout": layout, "places": F.struct(ts.alias("ts"), *[place(c).alias(c) for c in channels])}).drop("found")


def name_at(header: Column, place: Column) -> Column:
    return F.coalesce(F.get(header, place), F.lit("UNRESOLVED"))


def header_units(text: Column) -> dict[str, Column]:
    """Units stated in header text; never invented."""
    stated = lambda *needles: F.coalesce(*[F.when(text.contains(n), F.lit(True)) for n in needles], F.lit(False))
    return {
        "unit_acceleration": F.when(stated("m s^-2", "m/s^2"), "m/s^2").otherwise("UNRESOLVED"),
        "unit_gyro": F.when(stated("rad s^-1", "rad/s"), "rad/s").otherwise("UNRESOLVED"),
        "unit_clock": F.when(stated("[ns]"), "nanoseconds").otherwise("UNRESOLVED"),
    }


def map_pose_header(headers: DataFrame, rules: dict = ASL_POSE_RULES) -> DataFrame:
    """Pose columns, quaternion order from column order, and what else is there.

    Bias columns are not accelerations.
    """
    at = {c: find_channel(F.col("header"), options) for c, options in rules.items()}
    fields = lambda cs: F.array_join(F.array(*[name_at(F.col("header"), F.col(f"at.{c}")) for c in cs]), ",")
    quats = [f"q{c}" for c in "wxyz"]
    ordered = F.array_sort(F.array(*[F.struct(F.col(f"at.{q}").alias("i"), F.lit(q[1]).alias("n")) for q in quats]))
    all_quats = F.lit(True)
    for q in quats:
        all_quats = all_quats & F.col(f"at.{q}").isNotNull()
    compact = lambda h: F.replace(F.lower(h), F.lit(" "))
    direct = F.filter("header", lambda h: F.contains(compact(h), F.lit("a_rs")) & ~F.contains(compact(h), F.lit("b_a")))
    extra = {}
    if "vx" in rules:
        extra = {
            "velocity_fields": F.when(F.col("at.vx").isNotNull(), fields(["vx", "vy", "vz"])).otherwise("NOT_PRESENT"),
            "bias_gyro_present": F.col("at.bias_gyro").isNotNull(),
            "bias_accel_present": F.col("at.bias_accel").isNotNull(),
        }
    return headers.withColumn("at", F.struct(*[c.alias(k) for k, c in at.items()])).withColumns(
        {
            "timestamp_field": name_at(F.col("header"), F.coalesce(F.col("at.ts"), F.lit(0))),
            "position_fields": fields(["px", "py", "pz"]),
            "orientation_fields": fields(quats),
            "quaternion_order": F.when(all_quats, F.array_join(F.transform(ordered, lambda s: s["n"]), "")).otherwise("UNRESOLVED"),
            "acceleration_fields": F.when(F.size(direct) > 0, F.array_join(direct, ",")).otherwise("NO_DIRECT_GT_ACCELERATION"),
            **extra,
        }
    )


TEXT_POSITION_RULES = {"ts": [("time",), ("t",)], **{f"p{c}": [(c,)] for c in "xyz"}}
POSITION = ["px", "py", "pz"]
POSE_CHANNELS = [*POSITION, "qw", "qx", "qy", "qz"]


def _found(rules: dict) -> Column:
    return F.struct(*[find_channel(F.col("header"), options).alias(c) for c, options in rules.items()])


def _fields(places: Sequence[Column]) -> Column:
    """Names of the columns that were found, comma-joined."""
    known = F.filter(F.array(*places), lambda i: i.isNotNull())
    return F.array_join(F.transform(known, lambda i: F.coalesce(F.get(F.col("header"), i), i.cast("string"))), ",")


def map_text_pose_header(files: DataFrame) -> DataFrame:
    """Pose columns of generic text: `places`, fields, and the quaternion's order with where it is said.

    Eight or more columns are t, position and quaternion, whatever the names; the order of the quaternion comes from
    the header, else from a comment, else it stays open. A table of fewer columns has what its header names.
    `files` comes from `scan_sensor_text`.
    """
    wide, at = F.size("header") >= 8, lambda c: F.col(f"at.{c}")
    in_header = at("qx").isNotNull()
    qw_first = F.coalesce(at("qw"), F.lit(0)) <= at("qx")
    order = (
        F.when(~wide, F.when(at("qw").isNotNull() & in_header & at("qy").isNotNull() & at("qz").isNotNull(), "HEADER_MAPPED").otherwise("UNRESOLVED"))
        .when(in_header, F.when(~qw_first, "xyzw_from_header").when(at("qw") < at("qx"), "wxyz_from_header").otherwise("UNRESOLVED"))
        .when(F.col("says_xyzw"), "xyzw_from_comment")
        .when(F.col("says_wxyz"), "wxyz_from_comment")
        .otherwise("UNRESOLVED_4TUPLE")
    )
    listed = "xyzw"
    for_wxyz = F.col("quaternion_order") == "wxyz_from_comment"
    open_order = F.col("quaternion_order") == "UNRESOLVED_4TUPLE"

    def quaternion(c: str) -> Column:
        by_place = F.when(for_wxyz, F.lit(4 + "wxyz".index(c))).otherwise(F.lit(4 + listed.index(c)))
        return F.when(wide & ~in_header, F.when(~open_order, by_place)).otherwise(at(f"q{c}"))

    position = [F.when(wide, F.lit(1 + i)).otherwise(at(c)) for i, c in enumerate(POSITION)]
    named = lambda hit: F.filter("header", hit)
    present = lambda names: F.when(F.size(names) > 0, F.array_join(names, ",")).otherwise("NOT_PRESENT")
    mapped = files.withColumn("at", _found(TEXT_POSE_RULES)).withColumn("quaternion_order", order)
    ts = F.coalesce(at("ts"), F.lit(0)).alias("ts")
    four = [F.when(wide & ~in_header, F.lit(4 + i)).otherwise(at(f"q{c}")) for i, c in enumerate(listed)]
    return mapped.withColumns(
        {
            "places": F.struct(ts, *[p.alias(c) for p, c in zip(position, POSITION)], *[quaternion(c[1]).alias(c) for c in POSE_CHANNELS[3:]]),
            "timestamp_field": name_at(F.col("header"), F.coalesce(at("ts"), F.lit(0))),
            "position_fields": _fields(position),
            "orientation_fields": _fields(four),
            "velocity_fields": present(named(lambda h: F.contains(F.lower(h), F.lit("vel")) | F.lower(h).isin("vx", "vy", "vz"))),
            "acceleration_fields": present(named(lambda h: F.contains(F.lower(h), F.lit("acc")))),
        }
    ).drop("at")


def map_text_position_header(files: DataFrame) -> DataFrame:
    """Position columns by name; a table of four or more columns without such names is t, x, y, z."""
    at = lambda c: F.col(f"at.{c}")
    unnamed = at("px").isNull() & at("py").isNull() & at("pz").isNull() & (F.size("header") >= 4)
    position = [F.when(unnamed, F.lit(1 + i)).otherwise(at(c)) for i, c in enumerate(POSITION)]
    ts = F.coalesce(at("ts"), F.lit(0))
    return files.withColumn("at", _found(TEXT_POSITION_RULES)).withColumns(
        {
            "places": F.struct(ts.alias("ts"), *[p.alias(c) for p, c in zip(position, POSITION)]),
            "timestamp_field": name_at(F.col("header"), ts),
            "position_fields": _fields(position),
        }
    ).drop("at")


def channel_values(channels: Sequence[str], places: str = "places") -> list[Column]:
    """clock_int, clock and the channels of a row, by the places of its file."""
    token = lambda c: F.get(F.col("tokens"), F.col(f"{places}.{c}"))
    return [token("ts").try_cast("bigint").alias("clock_int"), parse_number(token("ts")).alias("clock"), *[parse_number(token(c)).alias(c) for c in channels]]


IMU_CHANNELS = [f"{k}{c}" for k in "fw" for c in "xyz"]


def imu_samples(table: DataFrame, mapped: DataFrame, bounded: bool | None = None) -> DataFrame:
    """Body tokens to channels: path, idx, clock (exact BIGINT and DOUBLE), f*, w*.

    `mapped` is the per-file header table. Rows that carry `idx` come from a scan whose facts were checked
    to be small, so that `mapped` is broadcast; others are joined and numbered (`bounded` tells whether
    every file fits one task; if not given, rows are counted).
    """
    heads = mapped.select("path", "places")
    if "idx" in table.columns:
        return table.join(F.broadcast(heads), "path").select("path", "idx", *channel_values(IMU_CHANNELS))
    rows = table.join(heads, "path").select("path", "row_no", *channel_values(IMU_CHANNELS))
    # Rows keep file order; dropped lines leave no holes.
    return assign_idx(rows, ["path"], ["row_no"], bounded).drop("row_no")
