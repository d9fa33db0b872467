import pathlib
import subprocess
import sys

import pytest

from evidentia.plans import registry
from tests.oracle import both, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows_equal_sql(spark, con, name):
    ours, theirs = both(spark, con, registry.queries()[name], registry.oracle_sql()[name], SF)
    assert ours == theirs


def test_entry_is_importable_without_a_session():
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql(); from pyspark.sql import SparkSession; assert SparkSession.getActiveSession() is None"
    done = subprocess.run([sys.executable, "-c", code], cwd=pathlib.Path(__file__).parents[1], capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
