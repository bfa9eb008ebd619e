"""Every registered bar query with SQL gives the SQL's rows."""

import os

import pytest

from glasstide.plans.queries import ORACLE_SQL, QUERIES
from tests.oracle import same

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"  # brands have too few bars at the smaller size
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the given tables are not here")


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, name):
    same(spark, QUERIES[name], ORACLE_SQL[name], LARGER if name == "feature_matrix_brands" else SF)


def exchanges(df) -> int:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return sum("Exchange" in line and "Broadcast" not in line for line in plan.split("\n"))


def test_reports_read_their_bars_once(spark):
    for name in ("latest_report", "both_validations", "feature_matrix"):
        assert exchanges(QUERIES[name](spark, SF)) < 15, name


def test_names():
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    got = __spark_entry__.entry(spark).toPandas()
    assert len(got) and set(got["horizon"]) == {5, 21, 63} and set(got["engine"]) == {"rules"}


def test_too_few_rows_to_fit_give_no_labels(spark, monkeypatch):
    from glasstide.plans import queries

    whole = queries.features.feature_matrix
    monkeypatch.setattr(queries.features, "feature_matrix", lambda *a: whole(*a).limit(20))
    assert queries.features.feature_matrix(queries.flag_bars(spark, SF), queries.UNIVERSE).count() == 20
    assert QUERIES["fit_state_model"](spark, SF).count() == 0
