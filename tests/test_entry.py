"""The entry points, with and without the part that can be left out."""

import subprocess
import sys
from pathlib import Path

from ledgerpulse.plans.catalog import QUERIES

ROOT = Path(__file__).resolve().parents[1]

WITHOUT = """
import importlib.abc, sys

class Missing(importlib.abc.MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name == "corpus_pipeline" or name.startswith("ledgerpulse.llm"):
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Missing())
"""


def names(prelude=""):
    code = f"{prelude}\nimport __spark_entry__ as e\nassert set(e.oracle_sql()) <= set(e.queries())\nprint(*e.queries())"
    return set(subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, check=True).stdout.split())


def test_reference_queries_do_not_need_the_text_operators():
    assert names(WITHOUT) == set(QUERIES) <= names()


def test_nothing_else_imports_the_text_operators():
    for file in [*ROOT.glob("ledgerpulse/**/*.py"), *ROOT.glob("tests/*.py")]:
        if "llm" not in file.relative_to(ROOT).parts and file != Path(__file__):
            assert "ledgerpulse.llm" not in file.read_text(), file
