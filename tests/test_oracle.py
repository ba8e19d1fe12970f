"""Every registered query with SQL gives DuckDB's rows; the others give rows."""

import pytest

from newsloom import plans
from tests.oracle import differences


@pytest.mark.parametrize("name", list(plans.QUERIES))
def test_query(spark, small, name):
    df = plans.QUERIES[name](spark, small)
    if name in plans.ORACLE_SQL:
        assert differences(df, small, plans.ORACLE_SQL[name]) == []
    else:
        assert df.count() > 0


def test_flagship(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_llm_folder(tmp_path):
    """The rest imports and registers its queries when the subpackage and the pipeline are gone."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    shutil.copytree(root / "newsloom", tmp_path / "newsloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()))"], cwd=tmp_path, env={"PATH": "/usr/bin:/bin"}, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0 and int(out.stdout) == len(plans.QUERIES), out.stderr
