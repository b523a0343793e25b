"""The entry module works with and without the subpackage llm."""

import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_without_the_optional_parts():
    code = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name.startswith("tidewater.llm") or name == "corpus_pipeline":
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert "panel_slot" in e.queries() and not any(n.startswith("op") for n in e.queries()) and "pipeline" not in e.queries()
"""
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_nothing_else_imports_the_subpackage():
    for path in [*(ROOT / "tidewater").rglob("*.py"), *(ROOT / "tests").glob("*.py"), ROOT / "bench.py"]:
        if "llm" not in path.relative_to(ROOT).parts:
            assert "import tidewater.llm" not in path.read_text() and "from tidewater.llm" not in path.read_text() or path.name == "test_entry.py", path


def test_flagship_gives_rows(spark):
    assert entry.entry(spark).count() > 0
