"""Every registered query of the library's own operators: those with SQL against it, the others run and repeat."""

from __future__ import annotations

import pytest
from compare import by_spark, difference

from quern.queries import catalogue

PLAIN = sorted(set(catalogue.QUERIES) - set(catalogue.ORACLES))


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_as_sql(spark, tiny, name):
    assert difference(catalogue.QUERIES[name](spark, tiny), catalogue.ORACLES[name], tiny) is None


@pytest.mark.parametrize("name", PLAIN)
def test_without_sql_gives_rows_and_repeats(spark, tiny, name):
    first = by_spark(catalogue.QUERIES[name](spark, tiny))
    assert first[1] and first == by_spark(catalogue.QUERIES[name](spark, tiny))


def test_entry_points_agree():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_rest_works_without_the_optional_part():
    import subprocess
    import sys

    code = "import sys; sys.modules['quern.llm'] = None\nimport __spark_entry__ as e\nprint(len(e.queries()), any(n.startswith('op1') or n == 'pipeline' for n in e.queries()))"
    said = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0])
    assert said.stdout.split() == [str(len(catalogue.QUERIES)), "False"]
