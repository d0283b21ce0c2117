"""Python workers must not need the package on their path."""

from __future__ import annotations

import os
import subprocess
import sys

from conftest import ROOT

CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__ as e
from tailward.session import local_session
spark = local_session("2")
for name in ("f3_implied_vol", "k3_similar_history"):
    assert e.queries()[name](spark, {sf!r}).collect()
"""


def test_python_steps_run_from_another_folder(sf_dir, tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT), sf=sf_dir)], check=True, cwd=tmp_path, env=env)
