"""Results survive task failures: a task that fails once is retried and the
result equals the fault-free run (deterministic keys, reliable checkpoints)."""
import os
import subprocess
import sys


def test_operators_survive_a_failed_task():
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    script = os.path.join(repo, "tests", "scripts", "retry_check.py")
    out = subprocess.run([sys.executable, script, repo], capture_output=True, text=True, timeout=900)
    assert "ALL_SAME" in out.stdout, out.stdout[-2000:] + out.stderr[-2000:]
