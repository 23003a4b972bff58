"""Text scans over many file splits, without a shuffle of the lines, and manifest files by role."""

import re

import pytest

from sensorloom.sources import files, text

ROUTES = [text.MOST_SPLITS, 0]  # split counts sent along, or joined


@pytest.fixture
def small_splits(spark):
    """Splits of 2,000 bytes, several of which share a task where files are short."""
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def above(plan: str, leaf: str) -> list[list[str]]:
    """The operators above each leaf of a printed plan."""
    found, path = [], []
    for line in plan.splitlines():
        m = re.match(r"^([\s:|]*(?:[+:]- )?)(.*)$", line)
        depth = len(m.group(1))
        path = [(d, n) for d, n in path if d < depth] + [(depth, m.group(2))]
        if leaf in m.group(2):
            found.append([n for _, n in path[:-1]])
    return found


def asl_bodies() -> dict[str, list[tuple[str, bool]]]:
    """Lines of several files and whether they are data rows."""
    out = {}
    for name, n in (("a", 1500), ("b", 40), ("c", 3), ("d", 900)):
        lines = [("", False)] if name == "d" else []
        lines += [("#timestamp,wx,wy" if name != "c" else "time,wx,wy", False)]
        for i in range(n):
            kind = (i * 7 + len(name)) % 11
            lines.append((f"{i},{i}.5,{'nan' if kind == 5 else i}", True) if kind else (["# note", "", "x,1,2"][i % 3], False))
        out[name] = lines
    return out


@pytest.mark.parametrize("most", ROUTES)
def test_asl_rows_over_many_splits(spark, tmp_path, small_splits, most):
    bodies = asl_bodies()
    for name, lines in bodies.items():
        (tmp_path / f"{name}.csv").write_text("".join(f"{line}\n" for line, _ in lines))
    scan = text.scan_asl(spark, str(tmp_path), most)
    got = {}
    for r in scan.rows.collect():
        got.setdefault(r.path[-5], []).append(r)
    for name, lines in bodies.items():
        rows = sorted(got[name], key=lambda r: r.row_no)
        want = [(i, line.split(",")) for i, (line, data) in enumerate(lines) if data]
        assert [(r.row_no, r.tokens) for r in rows] == want
        assert {tuple(r.header) for r in rows} == {("timestamp" if name != "c" else "time", "wx", "wy")}
        if most:
            assert [r.idx for r in rows] == list(range(len(want)))
    assert ("idx" in scan.rows.columns) == bool(most)
    assert {r.path[-5]: r.n_rows for r in scan.files.collect()} == {n: sum(data for _, data in lines) for n, lines in bodies.items()}
    numbers = text.numbered_lines(spark, str(tmp_path), most).collect()
    assert all(bodies[r.path[-5]][r.line_no][0] == r.line for r in numbers) and len(numbers) == sum(map(len, bodies.values()))


@pytest.mark.parametrize("most", ROUTES)
def test_sensor_text_over_many_splits(spark, tmp_path, small_splits, most):
    bodies = {
        "a": ["# t wx wy wz", *[f"{i} {i}.5 1 2 3" if i % 9 != 4 else f"{i} oops 1 2 3" for i in range(1200)], "% the end"],
        "b": ["time,wx,wy,wz", *[f"{i},1,2,na" for i in range(700)]],
        "c": ["1 2 3", "# late words stay a header", "4 5"],
    }
    for name, lines in bodies.items():
        (tmp_path / f"{name}.txt").write_text("".join(f"  {line}\n" for line in lines))
    scan = text.scan_sensor_text(spark, str(tmp_path), most)
    rows = {}
    for r in scan.rows.collect():
        rows.setdefault(r.path[-5], []).append(r)
    data = {
        "a": [(i + 1, [str(i), f"{i}.5", "1", "2", "3"]) for i in range(1200) if i % 9 != 4],
        "b": [(i + 1, [str(i), "1", "2", "na"]) for i in range(700)],
        "c": [(0, ["1", "2", "3"]), (2, ["4", "5"])],
    }
    heads = {"a": ["col0", "col1", "col2", "col3", "col4"], "b": ["time", "wx", "wy", "wz"], "c": ["late", "words", "stay"]}
    for name, want in data.items():
        got = sorted(rows[name], key=lambda r: r.row_no)
        assert [(r.row_no, r.tokens) for r in got] == want
        assert got[0].header == heads[name]
        if most:
            assert [r.idx for r in got] == list(range(len(want)))


def test_both_routes_give_the_same_samples(spark, tmp_path, small_splits):
    (tmp_path / "imu.csv").write_text("#timestamp,w_x[,w_y[,w_z[,acc_x,acc_y,acc_z\n" + "".join(f"{i * 5},{i},2,3,4,5,{i / 8}\n" + "# gap\n" * (i % 3 == 0) for i in range(800)))
    got = []
    for most in ROUTES:
        scan = text.scan_asl(spark, str(tmp_path), most)
        samples = text.imu_samples(scan.rows, text.map_imu_header(scan.files))
        got.append([tuple(r) for r in samples.orderBy("idx").select("idx", "clock_int", "wx", "fz").collect()])
    assert got[0] == got[1] == [(i, i * 5, float(i), i / 8) for i in range(800)]


def test_lines_are_not_shuffled(spark, tmp_path):
    (tmp_path / "imu.csv").write_text("#timestamp,w_x[,w_y[,w_z[,acc_x,acc_y,acc_z\n1,2,3,4,5,6,7\n")
    scan = text.scan_asl(spark, str(tmp_path))
    samples = text.imu_samples(scan.rows, text.map_imu_header(scan.files))
    plan = samples._jdf.queryExecution().sparkPlan().toString() + samples._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    scans = above(samples._jdf.queryExecution().executedPlan().toString(), "FileScan text")
    assert len(scans) == 1 and not any("Exchange" in n or "Sort" in n for n in scans[0])
    assert "BroadcastHashJoin" in plan


def manifest_of(spark, tmp_path, texts: dict[str, tuple[str, str]]):
    rows = []
    for name, (role, body) in texts.items():
        (tmp_path / name).write_text(body)
        rows.append((name, role, str(tmp_path / name), "DOWNLOADED"))
    return spark.createDataFrame(rows, "sequence_id string, content_role string, local_path string, download_status string")


def test_manifest_files_by_role(spark, tmp_path):
    eight = "".join(f"{i} 1 2 3 .1 .2 .3 .9\n" for i in range(3))
    manifest = manifest_of(spark, tmp_path, {
        "imu.txt": ("IMU", "# t in s, acceleration m s^-2, rates rad/s\n" + "0.5 1 2 3 4 5 6\n0.6 1 2 3 4 bad 6\n"),
        "gt_said.txt": ("GROUND_TRUTH", "# t x y z qx qy qz qw\n" + eight),
        "gt_wxyz.txt": ("GROUND_TRUTH", "# order: qw qx qy qz\n" + "% one\n" + eight),
        "gt_open.txt": ("GROUND_TRUTH", eight),
        "gt_named.txt": ("GROUND_TRUTH", "time,tx,ty,tz,qw,qx,qy,qz,vx,lin_acc\n1,2,3,4,.9,.1,.2,.3,7,8\n"),
        "gt_short.txt": ("GROUND_TRUTH", "time,x,y\n1,2,3\n"),
        "leica.txt": ("LEICA_POSITION", "1 2 3 4\n2 3 4 5\n"),
        "notes.txt": ("NOTES", "1 2\n"),
        "empty.txt": ("IMU", ""),
    })
    late = manifest.limit(1).selectExpr("'late' AS sequence_id", "content_role", "local_path", "'PLANNED' AS download_status")
    scan = files.scan_manifest(spark, manifest.unionByName(late))
    f = {r.sequence_id: r for r in scan.files.collect()}
    assert set(f) == {r.sequence_id for r in manifest.collect()}
    imu = f["imu.txt"]
    assert (imu.n_rows, imu.kind, imu.pose, imu.imu.unit_gyro, imu.imu.unit_acceleration) == (1, "imu", None, "rad/s", "m/s^2")
    orders = {k: (r.pose.quaternion_order, r.pose.position_fields) for k, r in f.items() if r.kind == "pose"}
    assert orders == {
        "gt_said.txt": ("xyzw_from_header", "x,y,z"), "gt_wxyz.txt": ("wxyz_from_comment", "col1,col2,col3"), "gt_open.txt": ("UNRESOLVED_4TUPLE", "col1,col2,col3"),
        "gt_named.txt": ("wxyz_from_header", "tx,ty,tz"), "gt_short.txt": ("UNRESOLVED", "x,y"),
    }
    assert (f["gt_named.txt"].pose.velocity_fields, f["gt_named.txt"].pose.acceleration_fields, f["gt_open.txt"].pose.velocity_fields) == ("vx", "lin_acc", "NOT_PRESENT")
    assert (f["notes.txt"].kind, f["notes.txt"].n_rows, f["empty.txt"].n_rows, f["empty.txt"].columns) == (None, 1, 0, None)
    rows = {}
    for r in scan.rows.collect():
        rows.setdefault(r.sequence_id, []).append(r)
    assert {k: len(v) for k, v in rows.items()} == {"imu.txt": 1, "gt_said.txt": 3, "gt_wxyz.txt": 3, "gt_open.txt": 3, "gt_named.txt": 1, "gt_short.txt": 1, "leica.txt": 2}
    assert [rows[k][0].pose.qw for k in ("gt_said.txt", "gt_wxyz.txt", "gt_open.txt", "gt_named.txt")] == [0.9, 0.1, None, 0.9]
    assert (rows["leica.txt"][0].position.pz, rows["leica.txt"][0].imu, rows["imu.txt"][0].imu.fz) == (4.0, None, 6.0)
    assert files.scan_manifest(spark, manifest.filter("false")).rows.count() == 0
