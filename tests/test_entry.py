"""The driver's entry module with and without the optional parts."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import importlib.abc, sys
class Gone(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == {gone!r}:
            raise ModuleNotFoundError("No module named " + repr(name), name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {root!r})
import __spark_entry__ as entry
assert "pairwise_comparison" in entry.queries() and set(entry.oracle_sql()) <= set(entry.queries())
print([q for q in entry.queries() if q[:2] == "op" and q[2].isdigit() or q == "pipeline"])
"""


def run(gone):
    return subprocess.run([sys.executable, "-c", WITHOUT.format(gone=gone, root=str(ROOT))], capture_output=True, text=True)


def test_entry_works_without_the_optional_parts():
    for gone in ("ablaspark.llm", "corpus_pipeline"):
        done = run(gone)
        assert done.returncode == 0 and done.stdout.strip() == "[]", done.stderr[-500:]


def test_errors_inside_them_are_not_hidden():
    there = all((ROOT / part).exists() for part in ("corpus_pipeline.py", "ablaspark/llm/__init__.py"))
    assert run("pyarrow").returncode != 0 or not there
