"""The size of market_state's plan, which the driver holds."""

from barloom import plans


def test_vectors_are_planned_once(spark, sf):
    """Each timeframe's vectors and their bars are stored before the states read them several times."""
    plan = plans.queries()["market_state"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") < 100 and "FlatMapGroupsInPandas" not in plan
