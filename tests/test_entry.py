"""The entry points with and without the optional part."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_entry_points_without_the_corpus_part():
    code = "import sys; sys.modules['tracewright.llm'] = None; import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') for n in e.queries()), set(e.oracle_sql()) <= set(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr
    n, corpus, consistent = out.stdout.split()
    assert int(n) > 40 and corpus == "False" and consistent == "True"


def test_nothing_else_imports_the_corpus_part():
    for p in (ROOT / "tracewright").rglob("*.py"):
        if "llm" not in p.parts:
            assert not re.search(r"\bllm\b", p.read_text()), p
