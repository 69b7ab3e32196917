"""Workers need not have the package on their path."""

import pathlib
import subprocess
import sys

ROOT = pathlib.Path(__file__).resolve().parents[2]
SCRIPT = """
import sys
sys.path.insert(0, sys.argv[1])
from tessera.session import build_session
import __spark_entry__
spark = build_session(master="local[2]", settings={"spark.checkpoint.dir": sys.argv[2], "spark.sql.shuffle.partitions": "4"})
found = __spark_entry__.queries()
for name in found:
    if name.startswith("op") and name.split("_")[0] not in ("op3", "op4", "op8"):
        assert found[name](spark, "/root/testdata/sf0.001").count() > 0, name
"""


def test_from_another_folder(tmp_path):
    command = [sys.executable, "-c", SCRIPT, str(ROOT), str(tmp_path / "shared")]
    done = subprocess.run(command, cwd=tmp_path, capture_output=True, text=True, timeout=900, check=False)
    assert done.returncode == 0, done.stderr[-3000:]
