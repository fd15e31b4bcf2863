"""The entry file gives every other query where the optional ones can't be imported."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

BLOCKED = """
import sys
class Missing:
    def find_spec(self, name, path=None, target=None):
        if name.split(".")[0] in {blocked!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Missing())
import __spark_entry__ as e
q, sql = e.queries(), e.oracle_sql()
assert len(q) > 150 and set(sql) <= set(q), len(q)
assert "pipeline" not in q
print(len(q))
"""


def run(*blocked):
    return subprocess.run([sys.executable, "-c", BLOCKED.format(blocked=blocked)], cwd=ROOT, capture_output=True, text=True, timeout=120)


def test_without_a_library_of_the_optional_operators():
    for name in ("ahocorasick", "corpus_pipeline"):
        done = run(name)
        assert done.returncode == 0, done.stderr
