"""Operators give the same rows when a task fails and is run again."""
import os
import subprocess
import sys


def test_operators_survive_a_failed_task():
    here = os.path.dirname(os.path.abspath(__file__))
    repo = os.path.dirname(os.path.dirname(here))
    out = subprocess.run([sys.executable, os.path.join(here, "scripts", "retry_llm.py"), repo], capture_output=True,
                         text=True, timeout=900)
    assert "ALL_SAME" in out.stdout, out.stdout[-2000:] + out.stderr[-2000:]
