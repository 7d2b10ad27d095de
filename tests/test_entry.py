"""The registered queries load with and without the optional document operators."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HIDE = """
import sys
class Hidden:
    def find_spec(self, name, path=None, target=None):
        if name in {names!r}:
            raise ModuleNotFoundError(name)
sys.meta_path.insert(0, Hidden())
import __spark_entry__ as driver
print(len(driver.queries()), sum(k.startswith("op") and k[2].isdigit() for k in driver.queries()), "pipeline" in driver.queries(), set(driver.oracle_sql()) <= set(driver.queries()))
"""


def loaded(*names):
    done = subprocess.run([sys.executable, "-c", HIDE.format(names=names)], cwd=ROOT, capture_output=True, text=True, check=True)
    count, documents, pipeline, sound = done.stdout.split()
    return int(count), int(documents), pipeline, sound


def test_the_rest_loads_without_the_document_operators():
    everything = loaded()
    without = loaded("blockloom.llm", "blockloom.llm.queries")
    assert without[0] == everything[0] - everything[1] - (everything[2] == "True") and without[1:] == (0, "False", "True")
    assert loaded("corpus_pipeline") == without
    assert loaded("sentencepiece", "xxhash", "zstandard")[0] >= without[0]
