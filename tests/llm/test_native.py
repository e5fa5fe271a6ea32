"""Native operators run no Python worker in any plan, written tables included."""

import pytest

from quillspark.llm import mixing, sharding, urlfilter
from quillspark.llm.entry import QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("module, name", [(mixing, "op4_mixing"), (urlfilter, "op8_urls"), (sharding, "op10_sharding")])
def test_no_python_in_any_plan(spark, monkeypatch, module, name):
    plans, write = [], module.stash

    def spied(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, label)

    monkeypatch.setattr(module, "stash", spied)
    plans.append(QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 1
    for p in plans:
        assert not any(x in p for x in ("Python", "MapInArrow", "MapInPandas", "ArrowEval", "Scan ExistingRDD", "CartesianProduct", "BroadcastNestedLoopJoin"))
