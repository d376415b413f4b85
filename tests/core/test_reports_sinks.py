"""Arm comparisons, training profiles, summaries, and sinks that are replaced and read back."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import ml
from flowlens.operators import quality as dq
from flowlens.operators import reports as rp
from flowlens.sources import sinks


def test_arms_against_a_control(spark):
    rows = [("base", s, "A", 10, 2, "recall", v) for s, v in ((1, 0.5), (2, 0.25))] + [("alt", s, "A", 10, 2, "recall", v) for s, v in ((1, 0.25), (2, None))]
    schema = "arm string, seed int, primary_attack string, n bigint, hosts bigint, measure string, value double"
    row = rp.compare_arms(spark.createDataFrame(rows, schema), "arm", "base", ["A"]).first()
    assert (row["control_mean"], row["arm_mean"], row["delta_mean"], row["delta_sd"], row["seeds_lower"], row["held_out"]) == (0.375, 0.25, -0.25, 0.0, 1, True)
    assert row["arm_by_seed"] == "0.250000;n/a" and row["control_by_seed"] == "0.500000;0.250000"
    with pytest.raises(Exception, match="seeds are not those"):
        rp.compare_arms(spark.createDataFrame(rows[:3], schema), "arm", "base", ["A"]).collect()


def test_training_profile(spark):
    samples = spark.createDataFrame([("real_malicious", "A")] * 3 + [("real_malicious", "B")] + [("synthetic_malicious", "A")] * 2 + [("synthetic_benign", "Benign")], "sample_type string, target_attack string")
    got = {r["primary_attack"]: tuple(r)[1:] for r in rp.training_profile(samples, spark.createDataFrame([("A",), ("B",), ("C",)], "primary_attack string")).collect()}
    assert got == {"A": (3, 2, 0.875), "B": (1, 0, 0.125), "C": (0, 0, 0.0)}


def test_scores_that_are_no_numbers_have_no_range(spark):
    rows = spark.createDataFrame([(1, float("nan")), (0, float("inf")), (1, None), (0, 1.5), (1, -0.5), (0, 0.5)], "y int, score double")
    assert tuple(dq.prediction_faults(rows).first()) == (3, 2, 0, 0)


def test_metadata_is_replaced_as_one_set(spark, tmp_path):
    path = str(tmp_path / "m")
    table = spark.createDataFrame([(1,)], "a int")
    sinks.write_metadata({"x": table, "y": table}, path)
    bad = table.select(F.raise_error(F.lit("stop")).cast("int").alias("a"))
    with pytest.raises(Exception, match="stop"):
        sinks.write_metadata({"x": table.withColumn("a", F.lit(2)), "y": bad}, path)
    assert [tuple(r) for r in spark.read.json(f"{path}/x").collect()] == [(1,)] and sorted(p.name for p in tmp_path.iterdir()) == ["m"]
    sinks.write_metadata({"x": table.withColumn("a", F.lit(3))}, path)
    assert spark.read.json(f"{path}/x").first()[0] == 3 and not (tmp_path / "m/y").exists() and sorted(p.name for p in tmp_path.iterdir()) == ["m"]


def test_vectors_and_metadata_stay_together(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sinks, "LINES", 7)
    rows = spark.createDataFrame([(i // 2, [i / 3, -float(i)], f"t\t{i}") for i in range(40)], "sample_id bigint, v array<double>, kind string").repartition(5)
    done = sinks.write_vectors_tsv(rows, "v", ["sample_id", "kind"], str(tmp_path / "v")).first()
    assert tuple(done) == (40, 0, 0)
    both = sinks.read_lines(spark, str(tmp_path / "v/vectors")).withColumnRenamed("lines", "v").join(sinks.read_lines(spark, str(tmp_path / "v/metadata")), "part").collect()
    pairs = [(int(m.split("\t")[1].split()[-1]), v) for r in both for v, m in zip(r["v"], r["lines"], strict=True)]
    assert sorted(pairs) == [(i, f"{i / 3:.6f}\t{-float(i):.6f}") for i in range(40)]
    with pytest.raises(Exception, match="not finite"):
        sinks.write_vectors_tsv(rows.withColumn("v", F.array(F.lit(float("nan")))), "v", ["kind"], str(tmp_path / "w"))


def test_best_prefix_replays_the_measure(spark):
    rows = spark.createDataFrame([(i, int(i % 7 in (1, 2)), [float(i % 7), float(i % 3)]) for i in range(120)], "sample_id bigint, y int, flat array<double>").withColumn("weight", F.lit(1.0))
    model = ml.fit_boosted_trees(rows.where("sample_id % 2 = 0"), rounds=4, depth=2)
    held = rows.where("sample_id % 2 = 1")
    scored = ml.prefix_scores(model, held).select("y", "scores").collect()
    want = {}
    for n in range(4):
        pairs = [(r["scores"][n], r["y"]) for r in scored]
        positives, ap, before = sum(y for _, y in pairs), 0.0, 0
        for t in sorted({s for s, _ in pairs}, reverse=True):
            tp, every = sum(y for s, y in pairs if s >= t), sum(s >= t for s, _ in pairs)
            ap, before = ap + (tp - before) / positives * tp / every, tp
        want[n + 1] = ap
    got = {r["rounds"]: r["average_precision"] for r in ml.prefix_precision(model, held).collect()}
    assert got == pytest.approx(want) and ml.best_prefix(ml.prefix_precision(model, held)) == min(want, key=lambda n: (-round(want[n], 12), n))
    whole = model.transform(held.withColumn("features", ml.array_to_vector("flat"))).select(ml.vector_to_array("probability")[1].alias("p"), "sample_id").collect()
    mine = {r["sample_id"]: r["score"] for r in ml.score_trees(model, held).select("sample_id", "score").collect()}
    assert all(mine[r["sample_id"]] == pytest.approx(r["p"]) for r in whole)


def test_rebuilt_inputs(spark):
    import numpy as np

    draw = np.random.default_rng(1)
    x = draw.normal(size=(60, 3)) @ draw.normal(size=(3, 6)) + 2
    table = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "i int, " + ", ".join(f"c{j} double" for j in range(6)))
    columns = [f"c{j}" for j in range(6)]
    for dims in (2, 3):
        got = np.array([r["rebuilt"] for r in ml.rebuild(ml.fit_encoder(table, columns, dims), table).orderBy("i").collect()])
        u, s, v = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
        assert np.allclose(got, (u[:, :dims] * s[:dims]) @ v[:dims] + x.mean(axis=0), atol=1e-8)
