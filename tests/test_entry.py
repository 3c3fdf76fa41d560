import __spark_entry__ as e


def test_entry_and_names(spark):
    rows = e.entry(spark).collect()
    assert rows and {r.kind for r in rows} <= {"found", "not_found"} and all(bool(r.sentences) == (r.kind == "found") for r in rows)
    assert set(e.oracle_sql()) <= set(e.queries())


def test_no_nested_loop_joins(spark):
    for name in ("answer", "bm25_topk", "rrf_fusion", "field_context"):
        plan = e.queries()[name](spark, e.SF)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "CartesianProduct" not in plan
