"""The queries run where the workers cannot import the package: a session of another folder, without PYTHONPATH."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = str(Path(__file__).resolve().parents[2])
SCRIPT = f"""
import sys
sys.path.insert(0, {ROOT!r})
from lorespark.llm import catalog
from lorespark.runtime import local_session
spark = local_session("2", 2)
for name in sys.argv[2:]:
    print(name, catalog.queries()[name](spark, sys.argv[1]).count(), flush=True)
"""


def test_workers_need_not_have_the_package(tmp_path, sf):
    names = ["p3_pieces", "p6_ids", "p6_roundtrip", "p7_mix", "p8_languages"]
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, sf, *names], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-2000:]
    found = dict(line.split() for line in done.stdout.splitlines())
    assert sorted(found) == sorted(names) and all(int(n) > 0 for n in found.values())
