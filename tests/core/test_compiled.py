"""Wide aggregates and projections: methods of a size that is compiled, values of a scaler found by place."""

import math

import __spark_entry__
from flowlens.operators import features as ft
from flowlens.operators import histograms as hg
from flowlens.operators.scaling import fit_scaler, standardize
from flowlens.plans.base import events, folded, statistics

SF = "/root/testdata/sf0.001"


def test_generated_methods_stay_compilable(spark):
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    __spark_entry__.queries()["w_scalars"](spark, SF)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_scaled_values_need_no_search(spark):
    names = [f"c{i}" for i in range(5)]
    rows = spark.createDataFrame([(i, *(float(i * j) for j in range(5))) for i in range(4)], ["i", *names])
    scaler = spark.createDataFrame([(n, float(j), 2.0 + j) for j, n in reversed(list(enumerate(names)))], ["feature", "mean", "scale"])
    out = standardize(rows, scaler, names)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    above = plan.split("Join")[0]  # what is worked out for each row
    assert "_mean" in above and "element_at" not in above and "[c0]" not in above
    for r in out.collect():
        for j, n in enumerate(names):
            assert math.isclose(r[n], (math.log1p(r["i"] * j) - j) / (2.0 + j), rel_tol=1e-12, abs_tol=1e-12)


def test_scaler_is_one_short_aggregate(spark):
    rows = spark.createDataFrame([("h", 0, float(i), 2.0) for i in range(5)], ["source_ip", "window_start_ms", "a", "b"])
    out = fit_scaler(rows, None, ["b", "a"])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("stddev_pop") == 1
    got = {r["feature"]: r for r in out.collect()}
    logs = [math.log1p(i) for i in range(5)]
    mean = sum(logs) / 5
    assert got["a"]["n"] == 5 and math.isclose(got["a"]["mean"], mean) and math.isclose(got["a"]["scale"], math.sqrt(sum((x - mean) ** 2 for x in logs) / 5))
    assert got["b"]["constant"] and got["b"]["scale"] == 1.0


def test_shares_of_all_fields_in_one_aggregate(spark):
    e, train, fields = events(spark, SF), folded(spark, SF).where("fold = 0"), ("protocol", "l7", "service")
    known = hg.fit_vocabularies(e, train.where("window_start_ms % 7 = 0"), fields)
    one = hg.share_arrays(e, known)
    assert one._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1
    for f in fields:
        counts = hg.category_histogram(e, f)
        vocabulary = hg.fit_vocabulary(counts, train.where("window_start_ms % 7 = 0"))
        assert known[f] == [r["code"] for r in vocabulary.orderBy("slot").collect()]
        old = hg.histogram_arrays(hg.dense_histogram(counts, vocabulary), vocabulary.count())
        new = one.select(*ft.BUCKET, f"{f}_shares")
        assert new.count() == old.count() and new.exceptAll(old).isEmpty()


def test_statistics_hold_the_fold(spark):
    rows, plain = statistics(spark, SF), ft.bucket_stats(events(spark, SF))
    assert rows.drop("fold").exceptAll(plain).isEmpty() and rows.count() == plain.count()
    folds = folded(spark, SF).select("source_ip", "window_start_ms", "fold")
    assert rows.join(folds, ["source_ip", "window_start_ms", "fold"], "left_anti").isEmpty()


def test_candidate_features_shuffle_rows_and_no_buffers(spark):
    """Where no group is large, rows meet before they are aggregated: one shuffle."""
    out = ft.candidate_features(events(spark, SF))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
