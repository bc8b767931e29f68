"""Plan-shape guards for scale: no pair explosion, partial aggregation before shuffles."""

import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


# queries of the optional subpackage have tests of their own
@pytest.mark.parametrize("name", sorted(n for n in E.queries() if not n.startswith("op") and n != "pipeline"))
def test_no_cartesian_or_nested_loop_join(spark, name):
    plan = _plan(E.queries()[name](spark, SF))
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name


def test_dedupe_combines_before_shuffle(spark):
    plan = _plan(E.queries()["dedupe_first_text"](spark, SF))
    assert "partial_min" in plan and "Exchange hashpartitioning" in plan


def test_top_k_limits_before_shuffle(spark):
    plan = _plan(E.queries()["exact_top_k"](spark, SF))
    assert "WindowGroupLimit" in plan and "Partial" in plan and "MapInPandas" in plan


def test_scan_prunes_columns(spark):
    plan = _plan(E.queries()["skip_existing"](spark, SF))
    assert "ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>" in plan


def test_retrieval_materialises_late(spark):
    plan = _plan(E.queries()["retrieve_sources"](spark, SF))
    # hits come from the checkpoint; only hit-owning documents are re-chunked
    assert "LeftSemi" in plan and "ExistingRDD" in plan
    assert "partial_min" not in plan  # no second de-duplication shuffle on the text side
