"""Every core query that has SQL agrees with it on the smallest tables."""

import pytest
from compare import same

from cinegrid import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_agrees(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    if name in queries.SQL:
        ok, why = same(df, data, queries.SQL[name])
        assert ok, why
    else:
        assert df.count() >= 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_core_does_not_import_llm():
    import subprocess
    import sys

    code = "import sys; sys.modules['cinegrid.llm'] = None; import __spark_entry__ as e; assert e.llm is None and e.queries() and not any(m.startswith('cinegrid.llm.') for m in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=__file__.rsplit("/tests/", 1)[0]).returncode == 0
