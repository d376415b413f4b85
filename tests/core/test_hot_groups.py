"""Operators whose groups may hold most of the rows, against plain Python: quantiles, ranks, neighbours, draws, contexts."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.functions.scalars import seeded_key
from flowlens.operators import context as cx
from flowlens.operators import diagnostics as dg
from flowlens.operators import metrics as mt
from flowlens.operators import neighbours as nb
from flowlens.operators import quantiles as qt
from flowlens.operators import reports as rp
from flowlens.operators import resampling as rs


def test_quantiles_of_large_and_small_groups(spark):
    draw = random.Random(1)
    rows = [("hot" if i % 3 else draw.choice("abc"), draw.choice([None, float(draw.randrange(40)), draw.gauss(0, 9)]), draw.randrange(5)) for i in range(900)] + [("none", None, 1)] * 30
    table = spark.createDataFrame(rows, "k string, x double, y int").repartition(5)
    wanted = {"lo": ("x", 0.1), "mid": ("x", 0.5), "hi": ("x", 0.9), "top": ("y", 1.0), "bottom": ("y", 0.0)}
    for held in (20, 10_000):
        got = {r["k"]: r for r in qt.with_quantiles(table, ["k"], [F.count("*").alias("n")], wanted, held).collect()}
        for k in {r[0] for r in rows}:
            assert got[k]["n"] == sum(r[0] == k for r in rows)
            for name, (field, q) in wanted.items():
                values = [r["xy".index(field) + 1] for r in rows if r[0] == k and r["xy".index(field) + 1] is not None]
                assert got[k][name] is None if not values else got[k][name] == pytest.approx(np.quantile(values, q)), (held, k, name)
    assert qt.group_quantiles(table.limit(0), ["k"], wanted).count() == 0


def test_field_differences_of_long_sequences(spark):
    draw = random.Random(2)
    flows, pairs = {}, [(i, i + 100) for i in range(12)]
    for i, j in pairs:
        a = [(draw.randrange(50), draw.randrange(3), 7) for _ in range(400 if i == 0 else draw.randrange(1, 30))]
        b = [(x + draw.choice([0, 0, 0, 5]), y, 7) for x, y, _ in a] if i % 3 else [(x, y, 7) for x, y, _ in a]
        flows[i], flows[j] = a, b + ([(1, 1, 1)] if i % 4 == 3 else [])
    table = spark.createDataFrame([(k, *f) for k, fs in flows.items() for f in fs], "sequence_id bigint, p bigint, q bigint, r bigint").repartition(9)
    pair_table = spark.createDataFrame(pairs + [(0, 103)], "a bigint, b bigint")
    got = {(r["a"], r["b"], r["field"]): r["largest_difference"] for r in dg.field_differences(pair_table, table, ["p", "q", "r"], ["a"], ["b"], ["sequence_id"]).collect()}
    want = {}
    for i, j in [*pairs, (0, 103)]:
        for c, name in enumerate("pqr"):
            x, y = sorted(f[c] for f in flows[i]), sorted(f[c] for f in flows[j])
            if x != y:
                want[i, j, name] = max(abs(u - v) for u, v in zip(x, y, strict=True)) if len(x) == len(y) else None
    assert got == want and len({v for v in want.values()}) > 2


def clustered(spark, n=4000, dim=8):
    draw = np.random.default_rng(3)
    centres = draw.normal(0, 10, (40, dim))
    rows = [(i, [float(x) for x in (centres[i % 40] if i % 3 == 0 else centres[i % 40] + draw.normal(0, 0.1, dim))]) for i in range(n)]
    return rows, spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")


def test_neighbours_read_few_blocks(spark):
    rows, table = clustered(spark)
    queries = table.where("vec_id % 80 = 7")
    got = {}
    for r in nb.knn(queries, table, 6, "vec_id", "embedding", slice_rows=25).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["neighbour_id"])
    x = np.array([v for _, v in rows])
    for i in range(7, len(rows), 80):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert got[i] == [int(j) for j in np.lexsort((np.arange(len(rows)), d)) if j != i][:6]
    groups, blocks, pivots = nb.prepared(queries, table, "vec_id", "embedding", 25)
    exact = spark.createDataFrame([(q, float(np.sort(np.sqrt(((x - x[q]) ** 2).sum(axis=1)))[6])) for q in got], "q bigint, d double")
    asked = nb.materialise(groups.select("block", "n", "ids", "rows", F.array_repeat(F.lit(float(exact.agg(F.max("d")).first()[0])), F.col("n").cast("int")).alias("within")), "asked")
    met = nb.reachable(asked, blocks, pivots, None).join(blocks.select("block", F.col("n").alias("m")), "block").join(groups.select(F.col("block").alias("grp"), "n"), "grp")
    assert met.agg(F.sum(F.col("n") * F.col("m"))).first()[0] < 0.1 * len(rows) * len(got)
    near = nb.approximate_knn(queries, table, 6, "vec_id", "embedding", within=2.0)
    found = {(r["query_id"], r["neighbour_id"]) for r in near.collect()}
    assert len(found & {(q, n) for q, ns in got.items() for n in ns}) >= 0.8 * 6 * len(got)
    assert nb.knn(queries, table.limit(0), 6, "vec_id", "embedding").count() == 0


def draw_key(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:12], 16)


def test_draws_by_rounds(spark):
    draw = random.Random(4)
    rows = [(i, "hot" if i % 4 else draw.choice("abcdefgh"), f"h{draw.randrange(3) if i % 2 else i % 60}", bool(draw.randrange(2)), draw.randrange(3)) for i in range(1500)]
    table = spark.createDataFrame(rows, "sample_id bigint, primary_attack string, source_host string, hit boolean, s int").repartition(6)
    got = rs.equal_size_samples(table, 30, 4, 9, ["primary_attack"]).collect()
    for kind in {r[1] for r in rows}:
        for b in range(4):
            want = sorted((r[0] for r in rows if r[1] == kind), key=lambda i: (draw_key(9, b, i), i))[:30]
            assert {r["sample_id"] for r in got if r["primary_attack"] == kind and r["b"] == b} == set(want)
    sides = [[r for r in rows if r[1] == "hot"], [r for r in rows if r[1] != "hot"]]
    one = rs.composition_matched(table.where("primary_attack = 'hot'"), table.where("primary_attack <> 'hot'"), 5, 3, ["s"]).first()
    for name, mine, other in zip("ab", sides, sides[::-1], strict=True):
        hits = n = 0
        for b in range(5):
            for s in range(3):
                m = min(sum(r[4] == s for r in mine), sum(r[4] == s for r in other))
                for r in sorted((r for r in mine if r[4] == s), key=lambda r: (draw_key(f"3:{name}", b, r[0]), r[0]))[:m]:
                    hits, n = hits + r[3], n + 1
        assert one[f"recall_{name}"] == pytest.approx(hits / n) and one[f"matched_{name}"] == n / 5


def test_a_bound_that_is_too_tight_is_widened(spark, monkeypatch):
    table = spark.createDataFrame([(i, "k") for i in range(400)], "sample_id bigint, g string")
    late = lambda b: F.lit(rs.KEYS_END - 1) - F.col("sample_id") * 0 + b * 0  # noqa: E731  every key at the far end
    assert rs.first_in_rounds(table, ["g"], 5, 2, late, "sample_id").select("sample_id", "b").distinct().count() == 10
    even = rs.first_in_rounds(table, ["g"], 500, 1, lambda b: seeded_key(1, b, F.col("sample_id")), "sample_id")
    assert even.count() == 400


def test_range_counts(spark):
    draw = random.Random(5)
    points = {(draw.choice("aab"), draw.randrange(300)): draw.randrange(9) for _ in range(200)}
    spans = [(i, draw.choice("abc"), lo, lo + draw.randrange(1, 90)) for i, lo in enumerate(draw.randrange(-20, 300) for _ in range(80))]
    p = spark.createDataFrame([(k, t, w) for (k, t), w in points.items()], "k string, t bigint, w bigint").repartition(4)
    got = {r["i"]: r["w"] for r in cx.range_counts(p, spark.createDataFrame(spans, "i int, k string, lo bigint, hi bigint"), ["w"], ["k"]).collect()}
    assert got == {i: sum(w for (q, t), w in points.items() if q == k and lo <= t < hi) for i, k, lo, hi in spans}


def test_context_of_a_busy_host(spark):
    window, bucket, block = 100, 10, 200
    draw = random.Random(6)
    flows, seqs = [], {}
    for host, n in (("busy", 600), ("calm", 40)):
        for _ in range(n):
            t = draw.randrange(0, 2000)
            attack = draw.choice([None, None, None, "A", "B"])
            flows.append((host, t, int(attack is not None), attack or "Benign"))
    for host, t, label, attack in flows:
        s = seqs.setdefault((host, t // window * window), [0, 0, set(), {}])
        s[0], s[1] = s[0] + 1, s[1] + label
        s[2].add(t % window // bucket)
        if label:
            s[3][attack] = s[3].get(attack, 0) + 1
    fold = lambda start: "test" if start // block in (3, 4) else "train"
    split = {k: "excluded" if k == ("busy", 1500) else fold(k[1]) for k in seqs}
    primary = {k: min(s[3], key=lambda a: (-s[3][a], a)) if s[3] else "Benign" for k, s in seqs.items()}
    keys = sorted(seqs)
    anchors = [(i, *k, primary[k], "benign" if not seqs[k][1] else "TP" if i % 2 else "FN", seqs[k][0], seqs[k][1], len(seqs[k][2])) for i, k in enumerate(keys) if split[k] == "train"]
    rows = cx.context_availability(
        spark.createDataFrame(anchors, "sample_id bigint, source_ip string, window_start_ms bigint, attack_type string, outcome string, flows bigint, attack_flows bigint, active_buckets bigint"),
        spark.createDataFrame(flows, "ipv4_src_addr string, flow_start_milliseconds bigint, label bigint, attack string"),
        spark.createDataFrame([(*k, split[k], fold(k[1])) for k in keys], "source_ip string, window_start_ms bigint, split string, assigned_split string"),
        window, bucket, "train", block,
    ).collect()
    observed = {k[1] // block for k in keys}
    want = {}
    for i, host, start, kind, *_ in anchors:
        for c, b in cx.GEOMETRIES:
            lo, hi = start + window - c * window, start + window
            blocks = range(lo // block, (hi - 1) // block + 1)
            near = [k for k in keys if k[0] == host and lo <= k[1] < hi]
            if any(x not in observed or fold(x * block) != "train" for x in blocks) or any(split[k] != "train" for k in near):
                continue
            inside = [f for f in flows if f[0] == host and lo <= f[1] < hi]
            want[i, c, b] = (len(inside), sum(f[2] for f in inside), sum(f[3] == kind and f[2] for f in inside), len({(f[1] - lo) // (b * bucket) for f in inside}))
    assert {(r["sample_id"], r["c"], r["b"]): (r["flows"], r["attack_flows"], r["target_attack_flows"], r["active_buckets"]) for r in rows} == want
    open4 = {i for i, c, _ in want if c == 4}
    assert open4 and all(r["common"] == (r["sample_id"] in open4) for r in rows)


def test_operating_points_from_the_curve(spark):
    draw = random.Random(7)
    rows = spark.createDataFrame([("r", i, int(draw.random() < 0.3), draw.randrange(20) / 20) for i in range(500)], "run string, sample_id bigint, y int, score double")
    points = spark.createDataFrame([("r", "a", 0.5), ("r", "b", 0.52), ("r", "none", 2.0), ("r", "all", -1.0)], "run string, point string, threshold double")
    a = mt.operating_points(mt.score_curve(rows, ["run"]), points, ["run"]).orderBy("point").collect()
    b = mt.at_thresholds(rows, points, ["run"]).orderBy("point").collect()
    assert [r.asDict() for r in a] == [{c: r[c] for c in a[0].asDict()} for r in b]


def test_paired_statistics(spark):
    rows = [("m", s, "ap", "pp", v, x) for s, (v, x) in enumerate([(0.2, 0.3), (0.5, 0.4), (0.7, 0.7)])] + [("m", 9, "empty", "pp", None, None), ("m", 1, "roc_auc", "absolute", 0.5, 0.75)]
    table = spark.createDataFrame([(m, s, "base", k, u, v) for m, s, k, u, v, _ in rows] + [(m, s, "new", k, u, x) for m, s, k, u, _, x in rows] + [("m", 8, "new", "ap", "pp", 0.9)], "m string, seed int, variant string, metric string, unit string, value double")
    pairs = rp.paired_shift(table, ["m", "seed"], "variant", "base", ["metric"])
    got = {r["metric"]: r for r in rp.paired_statistics(pairs, ["m", "metric"]).collect()}
    ap = got["ap"]
    assert (ap["n_pairs"], ap["n_nonempty_pairs"], ap["positive_seeds"], ap["negative_seeds"], ap["zero_seeds"]) == (4, 3, 1, 1, 1)
    assert ap["delta_mean"] == pytest.approx(0) and ap["delta_sd"] == pytest.approx(10)
    assert got["empty"]["n_nonempty_pairs"] == 0 and got["empty"]["delta_mean"] is None and got["empty"]["delta_sd"] is None
    assert got["roc_auc"]["delta_mean"] == pytest.approx(0.25) and got["roc_auc"]["unit"] == "absolute" and got["roc_auc"]["delta_sd"] is None
