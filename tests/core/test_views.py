"""Views that queries share."""

from flowlens.plans import QUERIES, base, catalogue  # noqa: F401
from flowlens.plans.split_queries import _samples

SMOKE = "/root/testdata/sf0.001"


def test_plans_over_shared_views_are_short(spark):
    """The samples stand on six views; a plan that holds those of all of them has a hundred joins."""
    rows = _samples(spark, SMOKE)
    assert rows.count() == QUERIES["dn6_export_samples"](spark, SMOKE).groupBy().sum("samples").first()[0]
    assert len(rows._jdf.queryExecution().toString()) < 20_000
    base.release()
    assert _samples(spark, SMOKE).count() > 0
    base.release()
