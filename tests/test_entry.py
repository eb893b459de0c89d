"""The driver's entry points without the optional parts."""

import os
import subprocess
import sys

import pytest

from tests.conftest import ROOT

SCRIPT = """
import sys, warnings
for name in sys.argv[1].split(","):
    sys.modules[name] = None            # importing it fails
warnings.simplefilter("ignore")
import __spark_entry__ as entry
print(len(entry.queries()), sum(k.startswith("op") or k == "pipeline" for k in entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))
"""


@pytest.mark.parametrize("missing", ["corpus_pipeline", "upkeep.llm", "zstandard", "tiktoken,regex,public_tokenizers", "numpy.polynomial"])
def test_entry_without(missing):
    out = subprocess.run([sys.executable, "-c", SCRIPT, missing], cwd=ROOT, capture_output=True, text=True,
                         env={**os.environ, "PYTHONPATH": ROOT}, timeout=120)
    total, llm, known = out.stdout.split()
    assert int(total) - int(llm) >= 110 and known == "True", out.stderr[-500:]
