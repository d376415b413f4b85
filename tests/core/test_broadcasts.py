"""What registered queries broadcast."""

from pyspark.sql import functions as F

from flowlens.plans import QUERIES, catalogue, query  # noqa: F401
from flowlens.storage import materialise


def test_no_broadcast_by_the_size_of_files(spark):
    """A table whose file takes little is not broadcast for that; one that is small as shuffled may be."""
    wide = spark.range(1_500_000).select((F.col("id") * 0 + F.col("id") % 7).alias("k"), F.lit("x" * 60).alias("t"))
    table, other = materialise(wide, "wide"), materialise(spark.range(9_000_000).select((F.col("id") % 9 + 100).alias("k")), "other")

    @query("test_join")
    def run(spark, sf):
        return other.join(table, "k")

    try:
        found = QUERIES["test_join"](spark, "")
        assert found.count() == 0
        plan = found.groupBy().count()
        plan.collect()
        assert "Broadcast" not in plan._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        del QUERIES["test_join"]
