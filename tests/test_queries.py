"""Every query against its SQL."""

import os

import pytest
from held import DATA, assert_same

from frameloom.plans import registry

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLES[name])


def test_entry(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.count() > 0 and out.columns[0] == "clip_id"


def test_plans_push_down_and_stay_in_the_engine(spark):
    plan = registry.QUERIES["q_select_keyframes"](spark, DATA)._jdf.queryExecution().toString()
    assert "Python" not in plan and "ReadSchema" in plan and "props" in plan
    plan = registry.QUERIES["q_choose_topn"](spark, DATA)._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan
    plan = registry.QUERIES["q_motion_coverage"](spark, DATA)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan
