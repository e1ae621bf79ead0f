"""Plans of the registered operators: nowhere every row against every row; DataFrame functions only where promised."""

import pytest

from concord.llm.queries import QUERIES

SF001 = "/root/testdata/sf0.001"
#: These two use no Python on their main path.
NATIVE = ("op1_imatch", "op8_pii")


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cross_products(spark, name):
    df = QUERIES[name](spark, SF001)
    plan = df._sc._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "simple")
    banned = ("CartesianProduct", "BroadcastNestedLoopJoin")
    if name in NATIVE:
        banned += ("PythonUDF", "BatchEvalPython", "ArrowEvalPython", "MapInPandas", "MapInArrow", "FlatMapGroups")
    for bad in banned:
        assert bad not in plan, f"{name}: {bad}"
