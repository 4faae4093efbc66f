"""The shared folder: a local session that names none gets one, and settings are not touched."""

import os
import subprocess
import sys
from pathlib import Path

CODE = """
from confsieve.session import cut_lineage, local_session, remove_run_folders, shared_folder
spark = local_session("bare", "1")
assert not spark.conf.get("spark.checkpoint.dir", None)
assert shared_folder(spark) == shared_folder(spark)
assert cut_lineage(spark.range(3)).count() == 3
remove_run_folders(spark)
print("fine")
"""


def test_session_without_a_checkpoint_folder(tmp_path):
    root = Path(__file__).resolve().parent.parent
    env = {**os.environ, "SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": f"{root}{os.pathsep}{os.environ.get('PYTHONPATH', '')}"}
    done = subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, timeout=180, check=False)
    assert done.returncode == 0 and "fine" in done.stdout, done.stderr[-2000:]
