"""Queries with Python functions run where the package is not on the workers' path."""

import os
import subprocess
import sys

CODE = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec)
spec.loader.exec_module(entry)
from tallyflow.session import local_session
spark = local_session(2, "shipping", 2)
for name in ("level_changed_values", "guard_bilinear", "drift_publish", "sketch_udaf"):
    assert entry.queries()[name](spark, sys.argv[2]).count() > 0, name
print("all ran")
"""


def test_from_another_folder(data, tmp_path):
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run(
        [sys.executable, "-c", CODE, repo, data], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300
    )
    assert "all ran" in done.stdout, done.stderr[-2000:]
