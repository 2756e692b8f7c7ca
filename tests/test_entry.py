import importlib
import os
import subprocess
import sys

import pytest

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


def test_catalogue_is_complete():
    from quillmark.plans import catalog

    assert set(catalog.SQL) <= set(catalog.QUERIES) and len(catalog.QUERIES) > 90


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")
def test_flagship(spark):
    sys.path.insert(0, HERE)
    entry = importlib.import_module("__spark_entry__")
    df = entry.entry(spark)
    assert df.count() > 0 and "question_text" in df.columns


def test_core_works_without_the_llm_subpackage():
    code = "import sys\nfor m in ('quillmark.llm', 'quillmark.llm.queries'): sys.modules[m] = None\nimport importlib.util as u\nreal = u.find_spec\nu.find_spec = lambda n, *a: None if n.startswith('quillmark.llm') else real(n, *a)\nimport __spark_entry__ as e\nassert not [q for q in e.queries() if q.startswith('p1_')] and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-c", code], cwd=HERE).returncode == 0
