"""Every registered query against its SQL, and the driver's contract."""

import os
import shutil
import subprocess
import sys

import pytest

from candrank.plans.registry import ORACLE_SQL, QUERIES
from tests.conftest import DATA, ROOT


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(same, name):
    same(QUERIES[name], ORACLE_SQL[name])


def test_pairs_are_scored(spark):
    rows = QUERIES["pair_score_strong"](spark, DATA).collect()
    assert rows and all(0 <= r.aa_identity <= 100 for r in rows)


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_the_rest_stands_without_the_subpackage(tmp_path):
    shutil.copytree(os.path.join(ROOT, "candrank"), tmp_path / "candrank", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), tmp_path)
    code = "import __spark_entry__ as e; assert 'candidate_rank' in e.queries() and not any(k.startswith('op') for k in e.queries()); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
