"""Every query of the catalogue against its SQL, and the entry points without the optional subpackage."""

import os
import shutil
import subprocess
import sys

import pytest
from oracle import differences

import __spark_entry__
from docframe import queries as core

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query(spark, name):
    assert differences(spark, core, name, DATA) == []


def test_entry(spark):
    got = __spark_entry__.entry(spark)
    assert got.columns == ["doc_id", "lang", "source", "n_chars"] and got.count() == 20
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_entry_without_the_optional_parts(tmp_path, left):
    for name in ("__spark_entry__.py", *(n for n in left if os.path.exists(f"{ROOT}/{n}"))):
        shutil.copy(f"{ROOT}/{name}", tmp_path)
    shutil.copytree(f"{ROOT}/docframe", tmp_path / "docframe", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e; assert len(e.queries()) > 60 and not any(n.startswith('op') and n[2:3].isdigit() for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True)
