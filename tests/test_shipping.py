"""Python tasks find the package although only the driver has it on its path."""

import subprocess
import sys
from pathlib import Path

import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="driver tables are not here")
def test_workers_import_the_package(tmp_path):
    repo = Path(__file__).resolve().parent.parent
    code = (
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "from sensorloom.session import local_session\n"
        "from sensorloom.plans.catalog import QUERIES\n"
        "spark = local_session(2, 2, '2g')\n"
        f"print('ROWS', QUERIES['w7_causal_filter'](spark, {SF!r}).count())\n"
    )
    env = {"PATH": "/usr/bin:/bin", "HOME": str(tmp_path)} | {k: v for k, v in __import__("os").environ.items() if k.startswith("JAVA") or k == "PATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "ROWS 0" not in done.stdout and "ROWS" in done.stdout, done.stderr[-2000:]
