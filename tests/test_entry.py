"""The entry file works without the text-preparation subpackage, its pipeline, or a library that they import."""

import subprocess
import sys

import pytest

REPO = __file__.rsplit("/", 2)[0]
BLOCK = """
import sys
class Gone:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name, name=name)
sys.meta_path.insert(0, Gone())
sys.path.insert(0, {repo!r})
import __spark_entry__ as e
q, s = e.queries(), e.oracle_sql()
assert "late_payer_segments" in q and set(s) <= set(q), "own jobs"
print(sum(k.startswith("op") for k in q), "pipeline" in q)
"""


@pytest.mark.parametrize("names,want", [(["public_tokenizers"], "0 False"), (["valuescope.llm"], "0 False")])
def test_entry_without_llm(names, want):
    got = subprocess.run([sys.executable, "-c", BLOCK.format(names=names, repo=REPO)], capture_output=True, text=True, timeout=120)
    assert got.returncode == 0, got.stderr
    assert got.stdout.strip() == want
