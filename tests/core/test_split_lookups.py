"""Purging looks up one entry of a table of time bins for each sequence; sequences take no objects in their buffers."""

import numpy as np
from pyspark.sql import functions as F

from flowlens.operators import sequences as sq
from flowlens.operators import split as sp
from flowlens.plans import base

SMOKE = "/root/testdata/sf0.001"


def _sequences(spark):
    draw = np.random.default_rng(3)
    start = draw.integers(0, 60, 400) * 100
    first = start + draw.integers(0, 100, 400)
    end = first + draw.choice([0, 5, 90, 400, 3000], 400)
    fold = {int(t): int(f) for t, f in zip(range(0, 6000, 100), draw.integers(0, 3, 60), strict=True)}
    rows = [(f"h{i}", int(s), int(f), int(e), 3 if i % 17 == 0 else fold[int(s)]) for i, (s, f, e) in enumerate(zip(start, first, end, strict=True))]
    return rows, spark.createDataFrame(rows, "source_ip string, window_start_ms bigint, first_ms bigint, max_end_ms bigint, fold int")


def test_purging_equals_all_pairs_and_explodes_nothing(spark):
    rows, table = _sequences(spark)
    points = {(s, f) for _, s, _, _, f in rows if f < 3}
    order = sorted(points)
    edges = [b for (_, f), (b, g) in zip(order, order[1:], strict=False) if f != g]
    for bin_ms in (100, 250, 900, 100_000):
        out = sp.exclude_boundaries(table, 100, 30, bin_ms)
        got = {r["source_ip"]: r["reason"] for r in out.collect()}
        for ip, s, first, end, f in rows:
            cross = f < 3 and any(first - 100 < o <= end and g != f for o, g in points)
            near = any(s - 30 < b < max(s + 100, end + 1) + 30 for b in edges)
            assert got[ip] == near + 2 * cross
        assert "Generate" not in out._jdf.queryExecution().toString()


def test_totals_of_sequences_are_hashed_in_place(spark):
    flows = base.events(spark, SMOKE)
    assert not hasattr(flows, "_flowlens_path")  # a column of one row's expressions is not worth a copy
    out = sq.primary_attack(flows)
    assert "collect_set" not in out._jdf.queryExecution().toString()
    other = sq.sequence_index(flows).select(*sq.KEYS, "flows", "attack_flows", "active_buckets", "first_ms", "last_ms", "max_end_ms")
    assert out.drop("primary_attack").exceptAll(other).count() == 0 and out.count() == other.count()


def test_all_buckets_of_the_widest_grid_count(spark):
    at = F.explode(F.array(*(F.lit(b) for b in (0, 1, 62, 63, 64, 65, 126, 126))))
    flows = spark.range(1).select(F.lit("h").alias("source_ip"), F.lit(0).cast("bigint").alias("window_start_ms"), at.alias("bucket"), F.lit(1).cast("bigint").alias("label"), F.lit("b").alias("attack"), F.lit(5).cast("bigint").alias("flow_start_milliseconds"), F.lit(9).cast("bigint").alias("flow_end_milliseconds"))
    r = sq.primary_attack(flows).first()
    assert (r["active_buckets"], r["flows"], r["attack_flows"], r["primary_attack"]) == (7, 8, 8, "b")
