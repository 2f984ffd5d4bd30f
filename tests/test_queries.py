"""Registered queries against their SQL at the smallest scale, and plan checks."""

import io
from contextlib import redirect_stdout

import pytest

import __spark_entry__ as E
from tests.parity import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(E.queries()))
def test_parity(spark, con, key):
    ok, info = compare(spark, con, key, E.queries()[key], E.oracle_sql().get(key), SF)
    assert ok, info


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("key", ["hybrid_search", "vector_search", "text_match", "detect_program_filter", "grid_sections", "answer_cache_lookup"])
def test_no_cartesian_product(spark, key):
    p = plan(E.queries()[key](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_top_k_and_pushdown(spark):
    p = plan(E.queries()["vector_topk"](spark, SF))
    assert "WindowGroupLimit" in p and "IsNotNull(embedding)" in p
    p = plan(E.queries()["filter_documents"](spark, SF))
    assert "EqualTo(source,src3)" in p
    p = plan(E.queries()["scan_table"](spark, SF))
    assert "ReadSchema: struct<l_orderkey:bigint,l_linenumber:int,l_extendedprice:double>" in p


def test_candidates_before_texts(spark):
    """The candidates' semi-join sits on the scan of the texts, below every other join."""
    lines = E.queries()["hybrid_search"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    at = next(i for i, line in enumerate(lines) if "Join LeftSemi" in line)
    depth = lambda line: len(line) - len(line.lstrip(" :+-"))
    below = [line for line in lines[at + 1 :] if depth(line) > depth(lines[at])][: len(lines) - at]
    assert "text#" in below[0] and not any("Join" in line for line in below[: next(i for i, x in enumerate(below) if "Relation" in x)])


def test_entry(spark):
    assert E.entry(spark).count() > 0
