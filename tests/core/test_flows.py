"""Known values, boundaries and metamorphic checks of the flow engine."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.functions import arrays as ar
from flowlens.functions import scalars as sc
from flowlens.functions.grid import TemporalGrid, geometries
from flowlens.operators import features as ft
from flowlens.operators import metrics as mt
from flowlens.operators import quality as dq
from flowlens.operators import reports as rp
from flowlens.operators import sequences as sq
from flowlens.operators import split as sp
from flowlens.sources import flows as src
from flowlens.sources import sinks

GRID = TemporalGrid(100, 10)


def flow(**fields):
    row = dict.fromkeys(src.INTEGERS, 0) | {"raw_rowid": 1, "ipv4_src_addr": "a", "ipv4_dst_addr": "b", "attack": "Benign", "protocol": 6}
    row |= fields
    row["flow_end_milliseconds"] = max(row["flow_end_milliseconds"], row["flow_start_milliseconds"])
    return tuple(row[n] for n in src.FLOW_SCHEMA.names)


def flows(spark, rows):
    return spark.createDataFrame([flow(**r) for r in rows], src.FLOW_SCHEMA)


THREE = [
    {"raw_rowid": 1, "flow_start_milliseconds": 1000, "l7_proto": 5, "protocol": 6, "in_bytes": 50, "l4_src_port": 9, "ipv4_dst_addr": "x", "tcp_flags": 2, "out_pkts": 0},
    {"raw_rowid": 2, "flow_start_milliseconds": 1000, "l7_proto": 88, "protocol": 6, "in_bytes": 100, "l4_src_port": 9, "ipv4_dst_addr": "x", "tcp_flags": 2, "out_pkts": 2},
    {"raw_rowid": 3, "flow_start_milliseconds": 3000, "l7_proto": 999, "protocol": 17, "in_bytes": 150, "l4_src_port": 9, "ipv4_dst_addr": "y", "out_pkts": 2},
]


def test_grid():
    assert (GRID.buckets, GRID.window_ms, GRID.bucket_ms) == (10, 100_000, 10_000)
    for bad in ((100, 30), (True, 1), (10.0, 1), (0, 1), (1000, 1)):
        with pytest.raises(ValueError):
            TemporalGrid(*bad)
    with pytest.raises(ValueError):
        geometries([{"sequence_seconds": 100, "bucket_seconds": 10}] * 2)
    with pytest.raises(ValueError):
        geometries([{"sequence_seconds": 100, "bucket_seconds": 10, "x": 1}])


def test_bucket_stats_of_three_flows(spark):
    row = ft.bucket_stats(sq.events_on_grid(flows(spark, THREE), GRID)).first()
    assert len(ft.FEATURES) == 82 and (row["flow_count"], row["in_bytes_sum"]) == (3, 300)
    assert row["protocol_tcp_ratio"] == pytest.approx(2 / 3) and row["tcp_flag_syn_ratio"] == 1 and row["tcp_flag_fin_ratio"] == 0
    assert row["src_port_reuse_ratio"] == pytest.approx(2 / 3) and row["dst_ip_nunique"] == 2
    assert (row["flow_start_gap_mean_ms"], row["flow_start_gap_max_ms"], row["flow_start_span_ms"]) == (1000, 2000, 2000)
    assert row["l7_entropy"] == pytest.approx(1.0) and row["dns_query_type_nunique"] == 0 and row["y_bucket"] == 0


def test_distribution_of_known_values(spark):
    rows = [THREE[0], THREE[1] | {"in_bytes": 150, "ipv4_dst_addr": "z"}]
    row = ft.distribution_features(sq.events_on_grid(flows(spark, rows), GRID)).first()
    assert (row["in_bytes_std"], row["zero_reply_fraction"], row["destination_port_pair_unique_fraction"]) == (50, 0.5, 1)


def test_primary_attack_ties_by_name(spark):
    rows = [{"raw_rowid": i, "flow_start_milliseconds": i, "label": 1, "attack": a} for i, a in enumerate(["Beta", "Alpha", "Gamma"])] + [{"raw_rowid": 9, "flow_start_milliseconds": 200_000}]
    found = {r["window_start_ms"]: r["primary_attack"] for r in sq.primary_attack(sq.events_on_grid(flows(spark, rows), GRID)).collect()}
    assert found == {0: "Alpha", 200_000: "Benign"}


def test_controls_and_csv(spark, tmp_path):
    good = flows(spark, THREE)
    assert src.validate_flows(good).count() == 3
    with pytest.raises(ValueError):
        src.validate_flows(flows(spark, [THREE[0] | {"in_bytes": -1}]))
    with pytest.raises(ValueError):
        src.validate_flows(good.limit(0))
    good.select(*(F.col(c).alias(c.upper()) for c in good.columns)).write.option("header", True).csv(str(tmp_path / "flows"))
    back = src.read_flows_csv(spark, str(tmp_path / "flows"))
    assert sorted(map(tuple, back.select(good.columns).collect())) == sorted(map(tuple, good.collect()))
    good.withColumn("in_bytes", F.lit("1.5")).write.option("header", True).csv(str(tmp_path / "bad"))
    with pytest.raises(Exception, match="whole number"):
        src.read_flows_csv(spark, str(tmp_path / "bad")).collect()


def sequences(spark, rows):
    return spark.createDataFrame([(f"h{i}", *r) for i, r in enumerate(rows)], "source_ip string, window_start_ms bigint, first_ms bigint, max_end_ms bigint, fold int")


def test_boundary_case(spark):
    rows = [(0, 0, 199_999, 0), (100_000, 100_000, 200_000, 0), (200_000, 200_000, 220_000, 1), (300_000, 300_000, 320_000, 2)]
    found = sp.exclude_boundaries(sequences(spark, rows), 100_000, embargo_ms=0).orderBy("source_ip").collect()
    assert [r["fold"] for r in found] == [0, 3, 1, 2] and [r["reason"] for r in found] == [0, 2, 0, 0]


def test_split_keeps_single_block_type_in_train_and_repeats(spark):
    block, rows, attacks = 900_000, [], []
    for b in range(20):
        for h in range(5):
            start = b * block + 300_000
            bad = (h == 3 and b % 4 == 0) or (h == 4 and b == 7)
            rows.append((f"s{h}", start, 3, 2 if bad else 0, 1, start, start, start + 100, "x"))
            if bad:
                attacks.append((f"s{h}", start, "Alpha" if h == 3 else "Beta", 2))
    seq = spark.createDataFrame(rows, "source_ip string, window_start_ms bigint, flows bigint, attack_flows bigint, active_buckets bigint, first_ms bigint, last_ms bigint, max_end_ms bigint, primary_attack string")
    att = spark.createDataFrame(attacks, "source_ip string, window_start_ms bigint, attack string, flows bigint")
    one, notes = sp.split_sequences(seq, att, 100_000)
    got = {(r["source_ip"], r["window_start_ms"]): r["fold"] for r in one.collect()}
    assert got["s4", 7 * block + 300_000] == 0
    again, _ = sp.split_sequences(seq.repartition(3), att, 100_000)
    assert got == {(r["source_ip"], r["window_start_ms"]): r["fold"] for r in again.collect()}
    assert set(got.values()) >= {0, 1, 2} and len(notes["balance"]) == 4
    faults = sp.split_faults(one, 100_000).first()
    assert (faults["overlapping"], faults["empty_folds"]) == (0, 0)


def scores(spark, rows):
    return spark.createDataFrame([(i, y, s, "T" if y else "Benign", f"h{i % 3}") for i, (y, s) in enumerate(rows)], "sample_id bigint, y int, score double, primary_attack string, source_host string")


def test_tied_scores_keep_the_budget(spark):
    rows = scores(spark, [(1, 0.9)] * 5 + [(0, 0.9)] * 2 + [(1, 0.5)] * 5 + [(0, 0.1)] * 98)
    curve = mt.score_curve(rows, [])
    at = {r["point"]: r for r in mt.choose_thresholds(curve, [], {"tight": 0.01, "wide": 0.02}).collect()}
    assert at["tight"]["reject_all"] and at["tight"]["threshold"] > 0.9
    assert not at["wide"]["reject_all"] and at["wide"]["threshold"] == 0.5
    constant = mt.choose_thresholds(mt.score_curve(scores(spark, [(1, 0.3), (0, 0.3)]), []), [])
    assert all(r["reject_all"] for r in constant.collect() if r["point"] != "default_0.5")


def test_ap_and_auc_against_loops(spark):
    rows = [(1, 0.8), (0, 0.8), (1, 0.6), (0, 0.4), (1, 0.4), (0, 0.1), (0, 0.6)]
    curve = mt.score_curve(scores(spark, rows), [])
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
    ap, before = 0.0, 0
    for t in sorted({s for _, s in rows}, reverse=True):
        tp, fp = sum(p >= t for p in pos), sum(n >= t for n in neg)
        ap, before = ap + (tp - before) / len(pos) * tp / (tp + fp), tp
    assert mt.roc_auc(curve, []).first()[0] == pytest.approx(auc) and mt.average_precision(curve, []).first()[0] == pytest.approx(ap)


def test_rotation_and_superposition(spark):
    row = spark.range(1).select(ar.rotate(F.array(*map(F.lit, range(10))), 3).alias("r"), ar.circular_start(F.array(*map(F.lit, range(10))), 3).alias("s"), ar.superimpose(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0))).alias("v")).first()
    assert row["r"] == [7, 8, 9, 0, 1, 2, 3, 4, 5, 6] and row["s"] == [3, 4, 5, 6, 7, 8, 9, 0, 1, 2]
    assert row["v"] == pytest.approx([0.6, 0.8])


def test_seed_statistics(spark):
    rows = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 2.0), ("c", None)], "k string, v double")
    got = {r["k"]: r for r in rp.seed_statistics(rows, ["k"], "v").collect()}
    assert got["a"]["sd"] == pytest.approx(math.sqrt(2)) and got["b"]["sd"] is None and got["c"]["pairs"] == 0
    assert {r["k"]: r["sd"] for r in rp.seed_statistics(rows, ["k"], "v", zero_for_one=True).collect()}["b"] == 0.0


def test_contracts_and_sinks(spark, tmp_path):
    good = spark.createDataFrame([(1, "real_benign", [[1.0], [0.0]], [1, 0], [0, 0], [2, 0], 0, "train"), (2, "real_malicious", [[0.5], [1.0]], [1, 1], [0, 1], [1, 1], 1, "train")], "sample_id bigint, sample_type string, x array<array<double>>, mask array<int>, y_bucket array<int>, flow_counts array<bigint>, y int, split string")
    assert set(dq.sample_faults(good, 2, 1).first().asDict().values()) == {0}
    sinks.write_samples(good, str(tmp_path / "s"), 2, 1)
    assert src.read_samples(spark, str(tmp_path / "s"), "train").count() == 2 and len(list(src.iter_samples(spark, str(tmp_path / "s"), "train"))) == 2
    with pytest.raises(ValueError):
        sinks.write_samples(good.withColumn("y", F.lit(0)), str(tmp_path / "t"), 2, 1)
    sinks.write_metadata({"notes": good.select("sample_id")}, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m/complete")).count() == 1
    assert dq.prediction_faults(scores(spark, [(1, 1.5), (0, 0.5)])).first()["out_of_range"] == 1


def test_bins(spark):
    row = spark.range(1).select(sc.fraction_bin(F.lit(0.1)).alias("a"), sc.fraction_bin(F.lit(1.0)).alias("b"), sc.flow_bin(F.lit(10)).alias("c"), sc.active_bin(F.lit(5)).alias("d"), sc.occupancy_band(F.lit(5)).alias("e")).first()
    assert tuple(row) == ("1-10%", "all", "3-10", "2-5", 2)


def test_stream_matches_batch(spark, tmp_path):
    from flowlens.streaming.sequences import stream_sequence_index

    rows = flows(spark, THREE + [{"raw_rowid": 4, "flow_start_milliseconds": 90_000_000}])
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(src.FLOW_SCHEMA).parquet(str(tmp_path / "in"))
    q = stream_sequence_index(stream, GRID).writeStream.format("memory").queryName("seq").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = spark.sql("SELECT source_ip, window_start_ms, flows, active_buckets FROM seq").collect()
    assert [tuple(r) for r in got] == [("a", 0, 3, 1)]
