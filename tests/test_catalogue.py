"""Every registered core query against its SQL on the smallest tables."""

import pytest
from helpers import same

from sdlweave.plans import catalogue, fixtures, generated, problems

QUERIES = {**problems.QUERIES, **catalogue.QUERIES, **generated.QUERIES, **{f"fixed_{n}": f for n, f in fixtures.QUERIES.items()}}
SQL = {**problems.SQL, **catalogue.SQL, **generated.SQL, **{f"fixed_{n}": q for n, q in fixtures.SQL.items()}}


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, duck):
    got = QUERIES[name](spark, data)
    assert len(set(got.columns)) == len(got.columns)
    if name in SQL:
        same(got.toPandas(), duck.sql(SQL[name]).df())
    else:
        got.count()


def test_plans_push_down(spark, data):
    plan = catalogue.QUERIES["meta_in"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "In(metadata.parentType" in plan and "content" not in plan.split("ReadSchema")[1]
    plan = catalogue.QUERIES["topk_filtered"](spark, data)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "EqualTo(label,3)" in plan


def test_staged_tables_are_dropped(spark, tmp_path):
    from sdlweave import runtime

    held = runtime.stage(spark.range(3))
    path = runtime._staged[-1][0]
    assert held.count() == 3 and runtime.shared_folder(spark) in path
    runtime.drop_staged(spark)
    import os

    assert not os.path.exists(path)
