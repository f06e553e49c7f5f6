"""Plan guards: no cartesian products or nested-loop joins in any registered query."""

from statgate.plans import catalog

SF = "/root/testdata/sf0.001"


def test_no_cross_or_nested_loop_joins(spark):
    offenders = {}
    for name, fn in catalog.QUERIES.items():
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        bad = [k for k in ("CartesianProduct", "BroadcastNestedLoopJoin") if k in plan]
        if bad:
            offenders[name] = bad
    assert not offenders, offenders
