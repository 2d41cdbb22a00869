"""The entry module without the corpus operators: the other queries stay."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]


@pytest.mark.parametrize("hidden", ["isolates.llm", "xxhash", "corpus_pipeline"])
def test_a_module_that_cannot_be_imported(hidden):
    code = f"""
import sys
sys.modules[{hidden!r}] = None
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
corpus = [n for n in names if n.startswith("op") and n[2].isdigit()]
print(len(names), len(sql), len(corpus), "pipeline" in names, set(sql) <= set(names))
"""
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.returncode == 0, out.stderr[-800:]
    names, sql, corpus, pipeline, known = out.stdout.split()
    assert int(names) >= 90 and int(sql) >= 85 and pipeline == "False" and known == "True"
    assert hidden == "corpus_pipeline" or corpus == "0"
