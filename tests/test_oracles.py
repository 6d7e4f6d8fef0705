"""Every query of the library against its SQL on the smallest tables; the others have to give rows."""

import pytest

from tests_support import DATA, oracle, table
from docindex.plans.queries import ORACLES, QUERIES

SMALL = DATA / "sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, str(SMALL))
    if name not in ORACLES:
        assert df.count() > 0
        return
    want, columns = oracle(ORACLES[name], SMALL)
    assert sorted(df.columns) == columns
    assert table(df) == want


def test_entry_registers_everything():
    import __spark_entry__ as e

    assert set(QUERIES) <= set(e.queries())
    assert set(e.oracle_sql()) <= set(e.queries())


def test_nothing_outside_llm_imports_it():
    from tests_support import ROOT

    for p in (ROOT / "docindex").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT / "docindex").parts:
            assert "llm" not in p.read_text(), p
