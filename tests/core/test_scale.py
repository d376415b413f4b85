"""Orders that no task sees whole, refusals of the split, contracts on read, and joins of the diagnosis."""

import math
import random

import pytest
from pyspark.sql import functions as F

from flowlens.operators import diagnostics as dg
from flowlens.operators import features as ft
from flowlens.operators import ordering as od
from flowlens.operators import reports as rp
from flowlens.operators import split as sp
from flowlens.sources import flows as src
from flowlens.sources import sinks


def test_running_sums(spark):
    draw = random.Random(1)
    rows = [(draw.choice("abc"), i, draw.randrange(9)) for i in range(3000)]
    table = spark.createDataFrame(rows, "k string, i bigint, v bigint").repartition(7)
    got = {r["i"]: (r["s"], r["n"]) for r in od.running_sums(table, ["k"], [F.desc("i")], {"s": F.col("v"), "n": F.lit(1)}).collect()}
    sums = {}
    for k, i, v in sorted(rows, key=lambda x: -x[1]):
        s, n = sums.get(k, (0, 0))
        sums[k] = (s + v, n + 1)
        assert got[i] == sums[k]
    assert [r["n"] for r in od.numbered(table, [], ["i"], "n").orderBy("i").collect()] == list(range(1, 3001))
    assert od.numbered(table.limit(0), [], ["i"], "n").count() == 0
    od.release()


def test_matched_controls_against_all_pairs(spark):
    draw = random.Random(2)
    make = lambda ids: [(i, f"h{draw.randrange(4)}", draw.randrange(1, 4), 2 ** draw.randrange(12) + draw.randrange(3)) for i in ids]
    fn, tp = make(range(60)), make(range(100, 140))
    schema = "sample_id bigint, source_ip string, active_buckets bigint, flows bigint"
    got = {r["fn_id"]: (r["tier"], r["cost"], r["tp_id"]) for r in dg.matched_controls(spark.createDataFrame(fn, schema), spark.createDataFrame(tp, schema)).collect()}
    for i, h, a, f in fn:
        options = []
        for j, g, b, e in tp:
            cost = round(abs(math.log2(f) - math.log2(e)), 12)
            options.append((0 if (h, a) == (g, b) and cost <= 1 else 1 if a == b else 2, cost, j))
        assert got[i] == min(options)


def test_knn_of_repeated_vectors(spark):
    rows = [(i, [float(i % 5), 1.0]) for i in range(40)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in dg.knn(table.where("vec_id < 3"), table, 9, "vec_id", "embedding", slice_rows=11).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["distance"], r["neighbour_id"]))
    for q in range(3):
        assert got[q] == sorted((abs(i % 5 - q), i) for i in range(40) if i != q)[:9]


def finished(spark, rows):
    return spark.createDataFrame(rows, "source_ip string, window_start_ms bigint, first_ms bigint, max_end_ms bigint, fold int, attack_flows bigint")


def test_split_refusals(spark):
    good = [("a", 0, 0, 50, 0, 1), ("b", 1000, 1000, 1050, 1, 0), ("c", 2000, 2000, 2050, 2, 0)]
    attacks = spark.createDataFrame([("a", 0, "T", 1)], "source_ip string, window_start_ms bigint, attack string, flows bigint")
    made = [{"purpose": "T", "fold": 0, "source_ip": "a", "window_start_ms": 0}]
    sp.refuse_faults(finished(spark, good), attacks, made, 100, 1000)

    def refused(rows, text, notes=made):
        with pytest.raises(ValueError, match=text):
            sp.refuse_faults(finished(spark, rows), attacks, notes, 100, 1000)

    refused([("a", 0, 0, 50, 3, 1), *good[1:], ("d", 0, 0, 50, 0, 0)], "did not survive")
    refused([("a", 0, 0, 50, 1, 1), *good[1:], ("d", 5000, 5000, 5050, 0, 0)], "no training sequence", [])
    refused(good[:2], "empty fold")
    refused([*good, ("d", 500, 500, 1500, 0, 0)], "overlap")
    refused([*good, ("b", 1100, 1100, 1150, 2, 0)], "neighbouring|overlap")


def test_far_end_takes_no_more_bins(spark):
    rows = [("a", 0, 0, 10**15, 0, 0), ("b", 1000, 1000, 1050, 1, 0)]
    found = sp.envelope_overlap(finished(spark, rows), 100, 1000).collect()
    assert [r["source_ip"] for r in found] == ["a"]


def test_contract_on_read(spark, tmp_path):
    good = spark.createDataFrame([(1, "real_benign", [[1.0], [0.0]], [1, 0], [0, 0], [2, 0], 0, "train"), (2, "real_malicious", [[0.5], [1.0]], [1, 1], [0, 1], [1, 1], 1, "train")], "sample_id bigint, sample_type string, x array<array<double>>, mask array<int>, y_bucket array<int>, flow_counts array<bigint>, y int, split string")
    sinks.write_samples(good, str(tmp_path / "s"), 2, 1)
    assert src.read_samples(spark, str(tmp_path / "s"), "train", 2, 1).count() == 2
    with pytest.raises(ValueError):
        src.read_samples(spark, str(tmp_path / "s"), "train", 3, 1)
    scores = spark.createDataFrame([(1, 1, 0.9, "T", "h"), (2, 0, 0.2, "Benign", "h")], "sample_id bigint, y int, score double, primary_attack string, source_host string")
    scores.write.parquet(str(tmp_path / "p"))
    saved = spark.createDataFrame([("p", 0.5, 1, 0)], "point string, threshold double, tp bigint, fp bigint")
    assert src.read_predictions(spark, [str(tmp_path / "p")], saved).count() == 2
    with pytest.raises(ValueError):
        src.read_predictions(spark, [str(tmp_path / "p")], saved.withColumn("tp", F.lit(2).cast("bigint")))


def test_feature_names():
    made = {*ft.PLAIN, ft.LONGEST_GAP, *(ft.NAMED.get((f, s), f"{f}_{s}") for f, (_, _, kept) in ft.DIVERSE.items() for s in kept)}
    assert len(ft.FEATURES) == len(made) == 82 and set(ft.FEATURES) == made
    assert ft.FEATURES[:2] == ["flow_count", "in_bytes_sum"] and ft.FEATURES[57] == "dst_ip_entropy" and ft.FEATURES[-1] == "flow_start_span_ms"


def test_cohort_profiles(spark):
    s = spark.createDataFrame([("a", 0, "T", 5, 3), ("b", 0, "T", 7, 1)], "source_ip string, window_start_ms bigint, kind string, flows bigint, active_buckets bigint")
    active = spark.createDataFrame([("a", 0, 1), ("a", 0, 2), ("a", 0, 6), ("b", 0, 3)], "source_ip string, window_start_ms bigint, bucket int")
    row = rp.cohort_profiles(s, active, ["kind"]).first()
    assert (row["n"], row["flows_median"], row["longest_run_median"], row["largest_gap_median"]) == (2, 6.0, 1.5, 3.0)
