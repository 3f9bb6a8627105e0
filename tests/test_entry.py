"""The library without its optional part."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = """
import sys

class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] == "corpus_pipeline" or name.startswith("tallyframe.llm"):
            raise ModuleNotFoundError(name=name)

sys.meta_path.insert(0, Hidden())
import __spark_entry__ as entry
assert len(entry.queries()) > 80 and not [n for n in entry.queries() if n.startswith("op")]
"""


def test_entry_without_the_training_data_operators():
    done = subprocess.run([sys.executable, "-c", CODE], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
