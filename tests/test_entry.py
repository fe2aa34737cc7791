import os
import shutil
import subprocess
import sys

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 60


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    left_out = shutil.ignore_patterns(".git", "__pycache__", "llm")
    shutil.copytree(root, tmp_path / "copy", ignore=left_out)
    assert not (tmp_path / "copy" / "chronoloom" / "llm").exists() and not (tmp_path / "copy" / "tests" / "llm").exists()
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 60 and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') or n == 'pipeline' for n in q)"
    left = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    for lone in (True, False):  # with and without the pipeline's file
        if not lone:
            (tmp_path / "copy" / "corpus_pipeline.py").unlink(missing_ok=True)
        subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", env=left, check=True)
