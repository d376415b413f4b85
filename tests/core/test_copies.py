"""Neighbours where most rows are copies."""

import math
import random

from pyspark.sql import functions as F

from flowlens.operators import neighbours as nb


def test_copies_are_searched_once(spark):
    """Most rows are copies of two vectors, and zeros have either sign; every query's row is left out."""
    draw = random.Random(5)
    kinds = [[draw.uniform(-1, 1) for _ in range(6)] for _ in range(30)] + [[0.0] * 6, [-0.0] * 6]
    rows = [(i, kinds[draw.choice((0, 30, 31)) if i % 3 else draw.randrange(30)]) for i in range(1500)]
    table = spark.createDataFrame(rows, "vec_id bigint, v array<double>").repartition(5)
    queries = table.where("vec_id % 7 = 0")
    got = {}
    for r in nb.knn(queries, table, 4, "vec_id", "v", slice_rows=25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["neighbour_id"], r["rank"]))
    for i in range(0, 1500, 7):
        near = sorted((math.dist(rows[i][1], v), j) for j, v in rows if j != i)[:4]
        assert got[i] == [(j, place + 1) for place, (_, j) in enumerate(near)]
    met = nb._searched(queries.select(F.col("vec_id").alias("id"), "v").limit(0), table.select(F.col("vec_id").alias("id"), "v"), 4, 25)
    assert met.count() == 0
