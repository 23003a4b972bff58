"""Python tasks of the corpus queries find the package although only the driver has it on its path."""

import os
import subprocess
import sys
from pathlib import Path


def test_queries_run_from_another_folder(sf, tmp_path):
    repo = Path(__file__).resolve().parents[2]
    code = (
        f"import sys; sys.path.insert(0, {str(repo)!r})\n"
        "from sensorloom.session import local_session\n"
        "from __spark_entry__ import queries\n"
        "spark = local_session(4, 4, '3g')\n"
        f"print('ROWS', [queries()[q](spark, {sf!r}).count() for q in ('op8_language_id', 'pipeline')])\n"
    )
    env = {"HOME": str(tmp_path)} | {k: v for k, v in os.environ.items() if k.startswith("JAVA") or k == "PATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ROWS [" in done.stdout and "ROWS [0" not in done.stdout and ", 0]" not in done.stdout, done.stderr[-2000:]
