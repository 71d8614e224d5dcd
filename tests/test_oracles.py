"""Every registered query against its SQL oracle, or for rows where there is none."""

import check
import pytest

import __spark_entry__ as contract

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connect(SF)


@pytest.mark.parametrize("name", list(contract.queries()))
def test_query(spark, con, name):
    ok, note = check.compare(spark, con, name, SF)
    assert ok, note


def test_entry(spark):
    df = contract.entry(spark)
    assert "severity" in df.columns


def test_every_oracle_has_a_query():
    assert set(contract.oracle_sql()) <= set(contract.queries())


@pytest.mark.parametrize("name", ["mean_pool", "embed_tokens", "context_vector"])
def test_whole_vectors_agree_with_the_narrow_ones(spark, name):
    narrow, whole = (contract.queries()[n](spark, SF) for n in (name, f"{name}_whole"))
    vector = [c for c in whole.columns if c[1:].isdigit()]
    assert [c[1:] for c in vector] == [str(i) for i in range(64)]
    assert sorted(whole.select(narrow.columns).collect()) == sorted(narrow.collect())
    assert all(whole.where(f"{c} != 0").head(1) for c in (vector[0], vector[8], vector[-1]))
