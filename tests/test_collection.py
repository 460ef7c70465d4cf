"""All test files are collected, with the training-data tests and without them."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

TESTS = os.path.dirname(os.path.abspath(__file__))


@pytest.mark.parametrize("more", [[], [f"--ignore={TESTS}/llm"]])
def test_everything_is_collected(more):
    run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", TESTS, *more],
                         cwd=os.path.dirname(TESTS), capture_output=True, text=True, timeout=300)
    assert run.returncode == 0, run.stdout[-2000:]
    assert "test_oracle.py" in run.stdout
