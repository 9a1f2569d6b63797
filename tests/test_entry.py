"""The entry point with and without the part that can be taken out."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
BLOCK = """
import sys

class Absent:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)

sys.meta_path.insert(0, Absent())
import __spark_entry__ as e
names = e.queries()
assert "knn_features" in names and set(e.oracle_sql()) <= set(names)
assert not any(n.startswith("op") or n == "pipeline" for n in names), names
"""


@pytest.mark.parametrize("absent", [["coldgraph.llm", "corpus_pipeline"], ["public_tokenizers"]])
def test_other_queries_stay_when_a_part_is_absent(absent):
    run = subprocess.run([sys.executable, "-c", BLOCK.format(names=absent)], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_every_oracle_belongs_to_a_query():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
