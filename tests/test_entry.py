"""The entry points stand without the text operators."""

import importlib.util
import subprocess
import sys
from pathlib import Path

import __spark_entry__
from ferrule import catalog

HIDE = """
import importlib.util, sys
from importlib.abc import MetaPathFinder
class Hidden(MetaPathFinder):
    def find_spec(self, name, path=None, target=None):
        if name.startswith("ferrule.llm"):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__, bench
print(sorted(__spark_entry__.queries()) == {names}, sorted(__spark_entry__.oracle_sql()) == {sql})
"""


def test_without_text_operators():
    code = HIDE.replace("{names}", repr(sorted(catalog.QUERIES))).replace("{sql}", repr(sorted(catalog.ORACLE_SQL)))
    ran = subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], capture_output=True, text=True, check=False)
    assert ran.stdout.split() == ["True", "True"], ran.stderr


def test_all_queries_are_there():
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(catalog.ORACLE_SQL) <= set(__spark_entry__.oracle_sql())
    assert importlib.util.find_spec("ferrule.llm") is None or "pipeline" in __spark_entry__.queries()
