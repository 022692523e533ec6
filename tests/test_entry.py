"""The entry offers the other queries where the corpus operators cannot be imported."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name == {name!r} or name.startswith({name!r} + "."):
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
print(len(e.queries()), len(e.oracle_sql()), "op1_url_reputation" in e.queries(), "pipeline" in e.queries())
"""


@pytest.mark.parametrize("missing", ["curvecal.llm", "ahocorasick", "corpus_pipeline"])
def test_entry_without(missing):
    done = subprocess.run([sys.executable, "-c", BLOCK.format(name=missing)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    n, sql, corpus, pipeline = done.stdout.split()
    assert int(n) > 100 and int(sql) > 90 and pipeline == "False"
    if missing != "corpus_pipeline":
        assert corpus == "False"
