"""The driver's contract holds before a session exists, and every query has its own SQL or none."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_needs_no_session():
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); assert set(s) <= set(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout.split()[-1]) > 80


def test_flagship(spark, data):
    import __spark_entry__ as e

    assert e.queries()["scan_topk"](spark, data).count() == 10


def test_core_does_not_use_the_subpackage():
    for f in (ROOT / "fieldloom").rglob("*.py"):
        if "llm" not in f.relative_to(ROOT).parts:
            assert "fieldloom.llm" not in f.read_text() and "import llm" not in f.read_text(), f
