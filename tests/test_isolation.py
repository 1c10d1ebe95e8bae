"""The library and the entry module stand without the text operators."""

import re
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Absent:
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("noticelake.llm"):
            raise ImportError(name)
sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
assert len(e.queries()) > 100 and len(e.oracle_sql()) > 100
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in e.queries())
assert set(e.oracle_sql()) <= set(e.queries())
"""


def test_entry_without_text_operators():
    subprocess.run([sys.executable, "-c", BLOCKED], cwd=ROOT, check=True, timeout=120)


def test_library_does_not_import_them():
    for path in (ROOT / "noticelake").rglob("*.py"):
        if "llm" not in path.parts:
            assert not re.search(r"(import|from) [.\w]*\bllm\b|\.llm\b", path.read_text()), path
