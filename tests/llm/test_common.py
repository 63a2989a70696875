from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

CODE = """
import re
from stagegraph.llm.common import pieces

def held():
    return int(re.search(r"VmRSS:\\s+(\\d+)", open("/proc/self/status").read())[1]) // 1024

texts = [bytes(1000) for _ in range(60_000)]
last = bytes(1000)  # above the others, so that what they leave free stays with the process
del texts
before = held()
list(pieces(iter([])))
print(before - held())
"""


def test_a_worker_gives_back_what_its_task_freed():
    env = os.environ | {"PYTHONPATH": os.pathsep.join([str(Path(__file__).parents[2]), os.environ.get("PYTHONPATH", "")])}
    assert int(subprocess.run([sys.executable, "-c", CODE], env=env, capture_output=True, text=True, check=True).stdout) > 30
