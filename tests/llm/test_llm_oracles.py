"""Training-data queries against their DuckDB counterparts."""

import pytest

pytest.importorskip("sparkwarden.llm")

import __spark_entry__ as entry  # noqa: E402
from engines import compare, duck  # noqa: E402
from sparkwarden.llm.queries import llm_oracles, llm_queries  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_registered():
    names = set(entry.queries())
    assert set(llm_queries()) <= names and "pipeline" in names
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14))


@pytest.mark.parametrize("name", sorted(llm_oracles()))
def test_same_rows(spark, con, name):
    ok, note = compare(spark, con, SF, name, llm_queries()[name], llm_oracles()[name])
    assert ok, note
