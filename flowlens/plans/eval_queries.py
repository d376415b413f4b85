"""Queries over score tables: metrics, reports, diagnostics, resampling, MLlib jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions.scalars import outcome, paired_outcome
from flowlens.operators import context as cx
from flowlens.operators import diagnostics as dg
from flowlens.operators import metrics as mt
from flowlens.operators import ml
from flowlens.operators import quality as dq
from flowlens.operators import reports as rp
from flowlens.operators import resampling as rs
from flowlens.operators.context import GEOMETRIES, MEDIANS
from flowlens.plans import query
from flowlens.plans.base import BLOCK, GRID, attacks, curve_ctes, embeddings, events, folded, hits, predictions, purged, rounded, sequences, shared, statistics, with_ctes, with_ids
from flowlens.plans.flow_queries import r
from flowlens.plans.split_queries import _PLAN, _encoded, _plan

RUN = ["model", "seed"]
RUNS = "model, seed"
CUT = 0.7


@shared
def curve(spark, sf):
    return mt.score_curve(predictions(spark, sf), RUN)


def thresholds(spark, sf):
    return mt.choose_thresholds(curve(spark, sf), RUN)


@query("ev1_score_curve", with_ctes(f"SELECT {RUNS}, score, p, n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, " + ", ".join(r(c, c) for c in ("tpr", "fpr", "precision")) + " FROM curve", "curve"))
def ev1(spark, sf):
    return rounded(curve(spark, sf).drop("positives", "negatives"))


@query("ev2_average_precision", with_ctes(f"SELECT {RUNS}, " + r("sum(p * 1.0 / positives * precision)", "average_precision") + f" FROM curve GROUP BY {RUNS}", "curve"))
def ev2(spark, sf):
    return rounded(mt.average_precision(curve(spark, sf), RUN))


@query("ev3_roc_auc", with_ctes(f"SELECT {RUNS}, " + r("sum(p * (negatives - fp + n / 2)) / any_value(positives * negatives)", "roc_auc") + f" FROM curve GROUP BY {RUNS}", "curve"))
def ev3(spark, sf):
    return rounded(mt.roc_auc(curve(spark, sf), RUN))


@query("ev4_thresholds", with_ctes("+" + curve_ctes("pred", "4") + " SELECT model, seed, point, " + r("threshold", "threshold", 12) + ", reject_all FROM thr4", "pred", "points"))
def ev4(spark, sf):
    return rounded(thresholds(spark, sf), 12)


_COUNTS = f"c AS (SELECT {RUNS}, point, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn FROM pred JOIN thr USING ({RUNS}) GROUP BY 1, 2, 3, 4)"
_MEASURES = (
    f"SELECT {RUNS}, point, tp, fp, tn, fn, " + r("threshold", "threshold") + ", " + r("CASE WHEN tp + fp > 0 THEN tp * 1.0 / (tp + fp) ELSE 0 END", "precision") + ", " + r("tp * 1.0 / (tp + fn)", "recall") + ", " + r("fp * 1.0 / (fp + tn)", "fpr") + ", " + r("CASE WHEN tp > 0 THEN 2.0 * tp / (2 * tp + fp + fn) ELSE 0 END", "f1")
    + ", " + r("(tp + tn) * 1.0 / (tp + fp + tn + fn)", "accuracy") + ", " + r("(tp * 1.0 / (tp + fn) + tn * 1.0 / (tn + fp)) / 2", "balanced_accuracy") + ", " + r("CASE WHEN tp + fp > 0 THEN (CAST(tp AS DOUBLE) * tn - CAST(fp AS DOUBLE) * fn) / sqrt(CAST(tp + fp AS DOUBLE) * (tp + fn) * (tn + fp) * (tn + fn)) ELSE 0 END", "mcc") + " FROM c"
)


def usable(spark, sf):
    return thresholds(spark, sf).where("NOT reject_all").select(*RUN, "point", "threshold")


@query("ev5_operating_points", with_ctes(f"+{_COUNTS} {_MEASURES}", "pred", "thr"))
def ev5(spark, sf):
    return rounded(mt.operating_points(curve(spark, sf), usable(spark, sf), RUN))


_ATT = f"a AS (SELECT {RUNS}, primary_attack, point, count(*) AS n, count(DISTINCT source_host) AS hosts, count(*) FILTER (score >= threshold) AS tp, count(*) FILTER (score < threshold) AS fn, count(*) FILTER (score >= threshold) * 1.0 / count(*) AS recall FROM pred JOIN thr USING ({RUNS}) WHERE y = 1 GROUP BY 1, 2, 3, 4)"


@query("ev6_attack_recall", with_ctes(f"+{_ATT} SELECT {RUNS}, primary_attack, point, n, hosts, tp, fn, " + r("recall", "recall") + " FROM a", "pred", "thr"))
def ev6(spark, sf):
    return rounded(mt.attack_recall(predictions(spark, sf), usable(spark, sf), RUN))


@query("ev6_macro_recall", with_ctes(f"+{_ATT} SELECT {RUNS}, point, " + r("avg(recall) FILTER (n >= 20)", "macro_recall") + f" FROM a GROUP BY {RUNS}, point", "pred", "thr"))
def ev6_macro(spark, sf):
    return rounded(mt.macro_recall(mt.attack_recall(predictions(spark, sf), usable(spark, sf), RUN), RUN))


@query("ev7_attack_table", with_ctes(f"+{_ATT}, {_COUNTS} SELECT a.model, a.seed, a.primary_attack, a.point, a.n, a.hosts, a.tp, a.fn, " + r("a.recall", "recall") + ", " + r("c.threshold", "threshold") + ", " + r("c.fp * 1.0 / (c.fp + c.tn)", "fpr") + ", " + r("(a.recall - b.recall) * 100", "delta_pp") + " FROM a JOIN c USING (model, seed, point) LEFT JOIN a b ON b.model = 'base' AND b.seed = a.seed AND b.point = a.point AND b.primary_attack = a.primary_attack", "pred", "thr"))
def ev7(spark, sf):
    return rounded(mt.attack_table(predictions(spark, sf), usable(spark, sf), RUN, "model", "base"))


@query("ev8_host_macro_recall", with_ctes(f"SELECT {RUNS}, point, " + r("avg(x)", "host_macro_recall") + f", count(*) AS hosts FROM (SELECT {RUNS}, point, source_host, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS x FROM pred JOIN thr USING ({RUNS}) WHERE y = 1 GROUP BY 1, 2, 3, 4) GROUP BY {RUNS}, point", "pred", "thr"))
def ev8(spark, sf):
    return rounded(mt.host_macro_recall(predictions(spark, sf), usable(spark, sf), RUN))


_SUB = (
    f"sc AS (SELECT {RUNS}, primary_attack, score, sum(p) AS p, sum(n) AS n FROM (SELECT {RUNS}, primary_attack, score, count(*) AS p, 0 AS n FROM pred WHERE y = 1 GROUP BY 1, 2, 3, 4 UNION ALL SELECT b.model, b.seed, t.primary_attack, score, 0, b.n FROM (SELECT {RUNS}, score, count(*) AS n FROM pred WHERE y = 0 GROUP BY 1, 2, 3) b JOIN (SELECT DISTINCT {RUNS}, primary_attack FROM pred WHERE y = 1) t USING ({RUNS})) GROUP BY 1, 2, 3, 4), "
    f"su AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER v AS pp, sum(n) OVER v AS nn FROM sc WINDOW w AS (PARTITION BY {RUNS}, primary_attack ORDER BY score DESC ROWS UNBOUNDED PRECEDING), v AS (PARTITION BY {RUNS}, primary_attack))"
)


@query("ev9_subtype_ap", with_ctes(f"+{_SUB} SELECT {RUNS}, primary_attack, " + r("sum(p * 1.0 / pp * tp / (tp + fp))", "average_precision") + f" FROM su GROUP BY {RUNS}, primary_attack", "pred"))
def ev9(spark, sf):
    return rounded(mt.subtype_ap(predictions(spark, sf), RUN))


@query("ev10_subtype_auc", with_ctes(f"+{_SUB} SELECT {RUNS}, primary_attack, " + r("sum(p * (nn - fp + n / 2)) / any_value(pp * nn)", "roc_auc") + f" FROM su GROUP BY {RUNS}, primary_attack", "pred"))
def ev10(spark, sf):
    return rounded(mt.subtype_auc(predictions(spark, sf), RUN))


@query("ev11_benign_tail", with_ctes(f"SELECT {RUNS}, sample_id, score, " + r("fpr", "benign_tail") + f" FROM pred JOIN (SELECT {RUNS}, score, fpr FROM curve) USING ({RUNS}, score) WHERE y = 1", "pred", "curve"))
def ev11(spark, sf):
    return rounded(mt.benign_tail(predictions(spark, sf), RUN))


@query("ev12_bucket_scores", with_ctes("+b AS (SELECT sequence_id AS sample_id, bucket, CASE WHEN sum(label) > 0 THEN 1 ELSE 0 END AS y, CAST((sequence_id * 7 + bucket * 13) % 90 + 5 AS DOUBLE) / 100 AS score FROM g JOIN ids USING (source_ip, window_start_ms) GROUP BY sequence_id, bucket), cc AS (SELECT score, sum(y) AS p, sum(1 - y) AS n FROM b GROUP BY 1), cu AS (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER () AS pp FROM cc WINDOW w AS (ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) SELECT " + r("(SELECT sum(p * 1.0 / pp * tp / (tp + fp)) FROM cu)", "average_precision") + ", " + r("(SELECT avg(l) FROM (SELECT sample_id, avg(-CASE WHEN y = 1 THEN ln(score) ELSE ln(1 - score) END) AS l FROM b GROUP BY 1))", "bce"), "g", "ids"))
def ev12(spark, sf):
    e = events(spark, sf).groupBy("source_ip", "window_start_ms", "bucket").agg((F.sum("label") > 0).cast("int").alias("y"), F.lit(1).alias("mask"))
    ids = with_ids(spark, sf).select("source_ip", "window_start_ms", F.col("sequence_id").alias("sample_id"))
    b = e.join(ids, ["source_ip", "window_start_ms"]).withColumn("score", (F.pmod(F.col("sample_id") * 7 + F.col("bucket") * 13, F.lit(90)) + 5).cast("double") / 100)
    return rounded(mt.bucket_ap(b, []).crossJoin(mt.masked_bce(b, [])))  # one row each


@query("ev13_multiclass", "SELECT " + r("sum(hit) * 1.0 / sum(n)", "accuracy") + ", " + r("avg(hit * 1.0 / n)", "balanced_accuracy") + ", count(*) AS classes, " + r("(avg(hit * 1.0 / n) - 1.0 / count(*)) / (1 - 1.0 / count(*))", "chance_adjusted") + " FROM (SELECT label, count(*) AS n, count(*) FILTER (label = (label + vec_id % 3) % 10) AS hit FROM embeddings GROUP BY 1)")
def ev13(spark, sf):
    rows = embeddings(spark, sf).withColumn("predicted", F.pmod(F.col("label") + F.col("vec_id") % 3, F.lit(10)))
    return rounded(mt.multiclass(rows, []))


@query("ev14_wilson", with_ctes("SELECT primary_attack, n, tp, " + r("(p + 3.8416 / (2 * n) - 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)", "low") + ", " + r("(p + 3.8416 / (2 * n) + 1.96 * sqrt(p * (1 - p) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)", "high") + " FROM (SELECT primary_attack, count(*) AS n, count(*) FILTER (score >= 0.7) AS tp, CAST(count(*) FILTER (score >= 0.7) AS DOUBLE) / count(*) AS p FROM pred WHERE model = 'base' AND seed = 1 AND y = 1 GROUP BY 1)", "pred"))
def ev14(spark, sf):
    per = hits(spark, sf).groupBy("primary_attack").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("bigint")).alias("tp"))
    return rounded(per.withColumn("w", mt.wilson(F.col("tp"), F.col("n"))).select("primary_attack", "n", "tp", "w.low", "w.high"))


@query("ev15_group_weights", "SELECT label, count(*) AS n, " + r("(SELECT count(*) FROM embeddings) * 1.0 / (10 * count(*))", "weight") + " FROM embeddings GROUP BY 1")
def ev15(spark, sf):
    return rounded(mt.group_weights(embeddings(spark, sf), "label").groupBy("label").agg(F.count("*").alias("n"), F.max("weight").alias("weight")))


@query("ev16_reconstruction_loss", "SELECT vec_id, " + r("list_sum(list_transform(embedding, lambda x: pow(CAST(x AS DOUBLE) / 2, 2))) / 64 + 0.5 * ln(4) + 0.5 * ln(4)", "loss") + " FROM embeddings")
def ev16(spark, sf):
    v = F.transform("embedding", lambda x: x.cast("double"))
    half = F.array(F.lit(0.5), F.lit(0.5))
    logs = F.array(F.log(F.lit(0.25)), F.log(F.lit(0.25)))
    return rounded(mt.reconstruction_loss(embeddings(spark, sf), v, F.transform(v, lambda x: x / 2), half, logs).select("vec_id", "loss"))


_FROZEN = (
    "+pf AS (SELECT p.*, f.fold FROM pred p JOIN (SELECT sequence_id AS sample_id, fold FROM fold) f USING (sample_id)), va AS (SELECT * FROM pf WHERE fold = 1), te AS (SELECT * FROM pf WHERE fold = 2), "
    + curve_ctes("va", "v") + ", " + curve_ctes("te", "t")
    + f", c AS (SELECT {RUNS}, point, threshold, count(*) FILTER (score >= threshold AND y = 1) AS tp, count(*) FILTER (score >= threshold AND y = 0) AS fp, count(*) FILTER (score < threshold AND y = 0) AS tn, count(*) FILTER (score < threshold AND y = 1) AS fn FROM te JOIN thrv USING ({RUNS}) GROUP BY 1, 2, 3, 4), "
    f"ap AS (SELECT {RUNS}, " + r("sum(p * 1.0 / positives * precision)", "average_precision") + ", " + r("sum(p * (negatives - fp + n / 2)) / any_value(positives * negatives)", "roc_auc") + f" FROM curvet GROUP BY {RUNS}) "
    + _MEASURES.replace("FROM c", f", average_precision, roc_auc FROM c JOIN ap USING ({RUNS})")
)


@query("ev17_frozen_evaluate", with_ctes(_FROZEN, "pred", "fold", "points"))
def ev17(spark, sf):
    """Test rows at the thresholds of the validation rows."""
    fold = folded(spark, sf).select(F.col("sequence_id").alias("sample_id"), "fold")
    p = predictions(spark, sf).join(fold, "sample_id")
    fitted, held = p.where("fold = 1").drop("fold"), p.where("fold = 2").drop("fold")
    saved = mt.choose_thresholds(mt.score_curve(fitted, RUN), RUN).select(*RUN, "point", "threshold")
    return rounded(mt.frozen_evaluate(held, saved, RUN, fitted))


@query("w13_outcomes", with_ctes("SELECT CASE WHEN y = 1 THEN CASE WHEN score >= 0.7 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN score >= 0.7 THEN 'FP' ELSE 'TN' END END AS outcome, count(*) AS n FROM pred GROUP BY 1", "pred"))
def w13(spark, sf):
    p = predictions(spark, sf)
    return p.groupBy(outcome(F.col("y"), F.col("score") >= CUT).alias("outcome")).agg(F.count("*").alias("n"))


_K1, _K2, _K3 = "sample_id % 101 = 0", "sample_id % 103 = 0", "sample_id % 107 = 0"


@query("dq4_prediction_faults", with_ctes(f"SELECT {RUNS}, count(*) FILTER ({_K1}) AS not_finite, count(*) FILTER ({_K2} AND NOT {_K1}) AS out_of_range, count(*) FILTER ({_K3}) AS bad_label, 2 - count(DISTINCT CASE WHEN NOT {_K3} THEN y END) AS missing_class FROM pred GROUP BY 1, 2", "pred"))
def dq4(spark, sf):
    """Score tables with planted faults, by the sample id: no number, a number out of range, another label."""
    bad = predictions(spark, sf).withColumn("score", F.expr(f"CASE WHEN {_K1} THEN CASE WHEN seed = 1 THEN CAST('NaN' AS DOUBLE) WHEN seed = 2 THEN CAST('Infinity' AS DOUBLE) END WHEN {_K2} THEN score + 1.5 ELSE score END"))
    return dq.prediction_faults(bad.withColumn("y", F.expr(f"CASE WHEN {_K3} THEN 2 ELSE y END")), RUN)


@query("dq5_same_population", with_ctes(f"SELECT model || ':' || seed AS run, CAST(CASE WHEN model = 'alt' AND seed = 2 THEN 2 * (SELECT count(*) FROM ids WHERE sequence_id % 101 = 0) WHEN model = 'fine' AND seed = 1 THEN (SELECT count(*) FROM ids WHERE sequence_id % 103 = 0) ELSE 0 END AS BIGINT) AS differences FROM runs WHERE model <> 'base' OR seed <> 1", "runs", "ids"))
def dq5(spark, sf):
    """One run has other labels for some samples, and one lacks some."""
    p = predictions(spark, sf).withColumn("run", F.concat_ws(":", "model", F.col("seed").cast("string")))
    p = p.withColumn("y", F.expr(f"CASE WHEN run = 'alt:2' AND {_K1} THEN 1 - y ELSE y END")).where(f"NOT (run = 'fine:1' AND {_K2})")
    return dq.population_differences(p, "run", "base:1", ["sample_id", "y", "primary_attack", "source_host"])


@query("dq6_fingerprint", with_ctes("SELECT count(*) AS n_rows, " + ", ".join(f"CAST(sum(CAST('0x' || substr(md5('0:' || {c}), 1, 12) AS BIGINT)) AS BIGINT) AS {c}" for c in ("sample_id", "y", "primary_attack", "source_host")) + " FROM pred", "pred"))
def dq6(spark, sf):
    return dq.fingerprint(predictions(spark, sf), ["sample_id", "y", "primary_attack", "source_host"])


@query("dq7_metric_replay", with_ctes("SELECT count(*) FILTER (seed = 2 OR (model = 'alt' AND seed = 3)) AS average_precision_differ, count(*) FILTER (model = 'alt' AND seed = 3) AS roc_auc_differ FROM runs", "runs"))
def dq7(spark, sf):
    """Replayed against saved measures of which one run is missing and some are off by a thousandth."""
    found = summary(spark, sf)
    off = F.when(F.col("seed") == 2, 0.001).otherwise(0.0)
    saved = found.where("NOT (model = 'alt' AND seed = 3)").withColumn("average_precision", F.col("average_precision") + off)
    return dq.replay_differences(found, saved, RUN, ["average_precision", "roc_auc"], 1e-9)


def summary(spark, sf):
    c = curve(spark, sf)
    return mt.average_precision(c, RUN).join(mt.roc_auc(c, RUN), RUN)


_SUM = f"m AS (SELECT {RUNS}, sum(p * 1.0 / positives * precision) AS ap, sum(p * (negatives - fp + n / 2)) / any_value(positives * negatives) AS auc FROM curve GROUP BY {RUNS})"


@query("rp1_rank_models", with_ctes(f"+{_SUM}, {curve_ctes('pred', '1')}, st AS (SELECT {RUNS}, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS rs FROM pred JOIN thr1 USING ({RUNS}) WHERE y = 1 AND point = 'fpr_0.1pct' GROUP BY {RUNS}) SELECT model || seed AS model, CAST(rank() OVER (ORDER BY round(ap, 2) DESC, round(rs, 9) DESC, round(auc, 9) DESC) AS INTEGER) AS place FROM m JOIN st USING ({RUNS})", "curve", "pred", "points"))
def rp1(spark, sf):
    """Ranked by average precision in whole per cents, so that the later keys decide between close runs."""
    strict = mt.at_thresholds(predictions(spark, sf), thresholds(spark, sf).where("point = 'fpr_0.1pct'").select(*RUN, "point", "threshold"), RUN)
    s = summary(spark, sf).join(strict.select(*RUN, F.round("recall", 9).alias("recall_strict")), RUN)
    s = s.select(F.concat("model", F.col("seed").cast("string")).alias("model"), F.round("average_precision", 2).alias("average_precision"), "recall_strict", F.round("roc_auc", 9).alias("roc_auc"), F.lit("same").alias("contract"))
    return rp.rank_models(s).select("model", "place")


_METRICS = (
    f"{_SUM}, {curve_ctes('pred', '2')}, at2 AS (SELECT {RUNS}, point, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 1) AS recall, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) FILTER (y = 0) AS fpr FROM pred JOIN thr2 USING ({RUNS}) GROUP BY {RUNS}, point), "
    f"type2 AS (SELECT {RUNS}, primary_attack, count(*) AS n, count(DISTINCT source_host) AS hosts, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS recall FROM pred JOIN thr2 USING ({RUNS}) WHERE y = 1 AND point = 'fpr_1pct' GROUP BY {RUNS}, primary_attack), "
    f"long2 AS (SELECT {RUNS}, 'average_precision' AS metric, ap AS value FROM m UNION ALL SELECT {RUNS}, 'roc_auc', auc FROM m UNION ALL SELECT {RUNS}, 'recall_at_' || replace(point, 'fpr_', ''), recall FROM at2 WHERE point LIKE 'fpr%' UNION ALL SELECT {RUNS}, 'fpr_at_' || replace(point, 'fpr_', ''), fpr FROM at2 WHERE point LIKE 'fpr%' UNION ALL SELECT {RUNS}, 'macro_recall', avg(recall) FILTER (n >= 20) FROM type2 GROUP BY {RUNS}), "
    "pair2 AS (SELECT a.seed, a.model, a.metric, CASE WHEN a.metric = 'roc_auc' THEN 'absolute' ELSE 'pp' END AS unit, b.value * k AS baseline, a.value * k AS shifted, (a.value - b.value) * k AS delta FROM (SELECT *, CASE WHEN metric = 'roc_auc' THEN 1 ELSE 100 END AS k FROM long2) a LEFT JOIN long2 b ON a.seed = b.seed AND a.metric = b.metric AND b.model = 'base' WHERE a.model <> 'base') "
)


def attack_recalls(spark, sf, point):
    return mt.attack_recall(predictions(spark, sf), thresholds(spark, sf).where(F.col("point") == point).select(*RUN, "point", "threshold"), RUN)


def shifts(spark, sf):
    long = mt.run_metrics(curve(spark, sf), thresholds(spark, sf), attack_recalls(spark, sf, "fpr_1pct"), RUN)
    return rp.paired_shift(long, ["seed"], "model", "base", ["metric"])


@query("rp2_paired_shift", with_ctes(f"+{_METRICS}SELECT seed, model, metric, unit, " + ", ".join(r(c, c, 5) for c in ("baseline", "shifted", "delta")) + " FROM pair2", "curve", "pred", "points"))
def rp2(spark, sf):
    return rounded(shifts(spark, sf), 5)


@query("rp2_paired_attacks", with_ctes(f"+{_METRICS}SELECT a.seed, a.model, a.primary_attack, a.n, a.hosts, " + r("b.recall * 100", "baseline", 5) + ", " + r("a.recall * 100", "shifted", 5) + ", " + r("(a.recall - b.recall) * 100", "delta", 5) + " FROM type2 a LEFT JOIN type2 b ON a.seed = b.seed AND a.primary_attack = b.primary_attack AND b.model = 'base' WHERE a.model <> 'base'", "curve", "pred", "points"))
def rp2_attacks(spark, sf):
    rows = attack_recalls(spark, sf, "fpr_1pct").select(*RUN, "primary_attack", "n", "hosts", F.lit("pp").alias("unit"), F.col("recall").alias("value"))
    return rounded(rp.paired_shift(rows, ["seed"], "model", "base", ["primary_attack", "n", "hosts"]).drop("unit"), 5)


@query("rp3_seed_statistics", with_ctes(f"+{_METRICS}SELECT model, metric, unit, count(*) AS n_pairs, count(delta) AS n_nonempty_pairs, " + ", ".join(f"{r(f'avg({c}) FILTER (delta IS NOT NULL)', c + '_mean', 5)}, {r(f'stddev_samp({c}) FILTER (delta IS NOT NULL)', c + '_sd', 5)}" for c in ("baseline", "shifted", "delta")) + ", count(*) FILTER (delta > 0) AS positive_seeds, count(*) FILTER (delta < 0) AS negative_seeds, count(*) FILTER (delta = 0) AS zero_seeds, " + r("min(delta)", "delta_min", 5) + ", " + r("max(delta)", "delta_max", 5) + " FROM pair2 GROUP BY 1, 2, 3", "curve", "pred", "points"))
def rp3(spark, sf):
    return rounded(rp.paired_statistics(shifts(spark, sf), ["model", "metric"]), 5)


def pairs(spark, sf, seed=1):
    p = predictions(spark, sf).where(F.col("seed") == seed)
    keep = ["primary_attack", "source_host", "flows", "attack_flows", "active_buckets"]
    return rp.paired_predictions(p.where("model = 'base'"), p.where("model = 'alt'"), CUT, CUT, keep)


_PAIR = "pr AS (SELECT a.sample_id, a.primary_attack, a.source_host, a.flows, a.attack_flows, a.active_buckets, a.score >= 0.7 AS before, b.score >= 0.7 AS after FROM pred a JOIN pred b ON a.sample_id = b.sample_id AND a.seed = 1 AND b.seed = 1 AND a.model = 'base' AND b.model = 'alt' WHERE a.y = 1)"
_TRANS = "count(*) AS n, count(*) FILTER (NOT before AND after) AS recovered, count(*) FILTER (before AND NOT after) AS lost, count(*) FILTER (NOT before AND NOT after) AS still_missed, count(*) FILTER (before AND after) AS still_detected"


@query("rp4_occupancy_slices", with_ctes(f"+{_PAIR} SELECT CASE active_buckets WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '>=3' END AS slice, {_TRANS} FROM pr GROUP BY 1", "pred"))
def rp4(spark, sf):
    return rp.occupancy_slices(pairs(spark, sf), [])


@query("rp5_pooled_types", with_ctes(f"+{_ATT}, h AS (SELECT {RUNS}, point, primary_attack, n, tp, fn FROM a WHERE primary_attack IN ('Type1', 'Type3')) SELECT *, " + r("tp * 1.0 / n", "recall") + f" FROM (SELECT * FROM h UNION ALL SELECT {RUNS}, point, 'ALL HELD OUT', CAST(sum(n) AS BIGINT), CAST(sum(tp) AS BIGINT), CAST(sum(fn) AS BIGINT) FROM h GROUP BY {RUNS}, point)", "pred", "thr"))
def rp5(spark, sf):
    return rounded(rp.pooled_types(mt.attack_recall(predictions(spark, sf), usable(spark, sf), RUN), ["Type1", "Type3"], RUN))


@query("rp5_arm_table", with_ctes(f"+{_SUM} SELECT model, count(*) AS n, count(ap) AS pairs, " + r("avg(ap)", "mean") + ", " + r("stddev_samp(ap)", "sd") + ", count(*) FILTER (ap > 0) AS positive, count(*) FILTER (ap < 0) AS negative, count(*) FILTER (ap = 0) AS zero, " + r("min(ap)", "least") + ", " + r("max(ap)", "greatest") + " FROM m GROUP BY 1", "curve"))
def rp5_arms(spark, sf):
    return rounded(rp.arm_table(summary(spark, sf), ["model"], "average_precision").drop("by_seed"))


_HELD = "('Type1', 'Type3')"
_ARMS = (
    f"lab AS (SELECT * FROM pred WHERE model <> 'fine' UNION ALL SELECT * REPLACE ('ALL HELD OUT' AS primary_attack) FROM pred WHERE model <> 'fine' AND y = 1 AND primary_attack IN {_HELD}), "
    + _SUB.replace("FROM pred", "FROM lab") + f", at5 AS (SELECT {RUNS}, primary_attack, 'recall_' || point AS measure, avg(CASE WHEN score >= threshold THEN 1.0 ELSE 0.0 END) AS value FROM lab JOIN thr5 USING ({RUNS}) WHERE y = 1 GROUP BY {RUNS}, primary_attack, point "
    f"UNION ALL SELECT {RUNS}, primary_attack, 'average_precision', sum(p * 1.0 / pp * tp / (tp + fp)) FROM su GROUP BY {RUNS}, primary_attack), "
    "siz AS (SELECT primary_attack, count(*) AS n, count(DISTINCT source_host) AS hosts FROM lab WHERE model = 'alt' AND seed = 1 AND y = 1 GROUP BY 1), "
    "pr5 AS (SELECT h.model, h.seed, h.primary_attack, h.measure, c.value AS control, h.value AS arm, h.value - c.value AS delta FROM at5 h LEFT JOIN at5 c ON c.model = 'base' AND c.seed = h.seed AND c.primary_attack = h.primary_attack AND c.measure = h.measure WHERE h.model <> 'base') "
)


@query("rp5_arm_comparison", with_ctes(f"+{curve_ctes('pred', '5')}, {_ARMS}SELECT model, primary_attack, measure, any_value(n) AS n, any_value(hosts) AS hosts, " + ", ".join(f"{r(f'avg({c})', c + '_mean')}, {r(f'coalesce(stddev_samp({c}), 0)', c + '_sd')}, string_agg(printf('%.9f', {c}), ';' ORDER BY seed) AS {c}_by_seed" for c in ("control", "arm", "delta")) + f", count(*) FILTER (delta < 0) AS seeds_lower, primary_attack IN {_HELD} OR primary_attack = 'ALL HELD OUT' AS held_out FROM pr5 JOIN siz USING (primary_attack) GROUP BY 1, 2, 3", "pred", "points"))
def rp5_comparison(spark, sf):
    held = ["Type1", "Type3"]
    rows = rp.with_pooled(predictions(spark, sf).where("model <> 'fine'"), held)
    return rounded(rp.compare_arms(rp.arm_measures(rows, thresholds(spark, sf).select(*RUN, "point", "threshold"), "model"), "model", "base", held, digits=9))


_WIL = "(p{0} + 3.8416 / (2 * n) {1} 1.96 * sqrt(p{0} * (1 - p{0}) / n + 3.8416 / (4.0 * n * n))) / (1 + 3.8416 / n)"


@query("rp6_unseen_subtype", with_ctes(f"+{_PAIR}, u AS (SELECT primary_attack, count(*) AS n, count(*) FILTER (before) AS control_tp, count(*) FILTER (after) AS holdout_tp, CAST(count(*) FILTER (before) AS DOUBLE) / count(*) AS pb, CAST(count(*) FILTER (after) AS DOUBLE) / count(*) AS pa FROM pr GROUP BY 1) SELECT primary_attack, n, control_tp, holdout_tp, " + r("pb", "control_recall") + ", " + r("pa", "holdout_recall") + ", " + ", ".join(r(_WIL.format(c, s), f"{n}_{e}") for n, c in (("control", "b"), ("holdout", "a")) for e, s in (("low", "-"), ("high", "+"))) + ", primary_attack IN ('Type1') AS withheld FROM u", "pred"))
def rp6(spark, sf):
    p = predictions(spark, sf).where("seed = 1")
    return rounded(rp.unseen_subtype(p.where("model = 'base'"), p.where("model = 'alt'"), CUT, CUT, ["Type1"]))


@query("rp7_transitions", with_ctes(f"+{_PAIR} " + " UNION ALL ".join(f"SELECT '{s}' AS slice, {_TRANS} FROM pr WHERE {t} HAVING count(*) > 0" for s, t in {"all": "true", "pure": "attack_flows = flows", "mixed": "attack_flows < flows", "single_bucket": "active_buckets = 1", "multi_bucket": "active_buckets > 1"}.items()), "pred"))
def rp7(spark, sf):
    return rp.transition_slices(pairs(spark, sf), [])


_VOTES = "v AS (SELECT sample_id, count(*) FILTER (model = 'base' AND score >= 0.7) AS base, count(*) FILTER (model = 'alt' AND score >= 0.7) AS alt FROM pred WHERE y = 1 GROUP BY 1)"


@query("rp8_seed_votes", with_ctes(f"+{_VOTES} SELECT *, CASE WHEN base >= 2 AND alt <= 1 THEN 'base_only' WHEN alt >= 2 AND base <= 1 THEN 'alt_only' WHEN base >= 2 AND alt >= 2 THEN 'both' WHEN base <= 1 AND alt <= 1 THEN 'neither' ELSE 'unstable' END AS \"group\" FROM v", "pred"))
def rp8(spark, sf):
    p = predictions(spark, sf)
    cut = p.select(*RUN).distinct().withColumn("threshold", F.lit(CUT))
    return rp.stable_groups(rp.seed_votes(p, cut, "model", "seed", ["base", "alt"]), "base", "alt", 2, 1)


@query("rp10_interventions", with_ctes("+q AS (SELECT a.active_buckets, ln(greatest(least(a.score, 1 - 1e-7), 1e-7) / (1 - greatest(least(a.score, 1 - 1e-7), 1e-7))) AS l0, ln(greatest(least(b.score, 1 - 1e-7), 1e-7) / (1 - greatest(least(b.score, 1 - 1e-7), 1e-7))) AS l1, a.score >= 0.7 AS was, b.score >= 0.7 AS now_ FROM pred a JOIN pred b ON a.sample_id = b.sample_id AND a.seed = 1 AND b.seed = 1 AND a.model = 'base' AND b.model = 'alt') SELECT active_buckets, count(*) AS n, " + r("avg(l1 - l0)", "mean_delta", 5) + ", " + r("median(l1 - l0)", "median_delta", 5) + ", " + r("avg(CASE WHEN l1 - l0 > 0 THEN 1.0 ELSE 0.0 END)", "share_up") + ", count(*) FILTER (NOT was AND now_) AS gained, count(*) FILTER (was AND NOT now_) AS lost FROM q GROUP BY 1", "pred"))
def rp10(spark, sf):
    p = predictions(spark, sf).where("seed = 1")
    a = p.where("model = 'base'").select("sample_id", "active_buckets", "score", F.lit(CUT).alias("threshold"))
    joined = a.join(p.where("model = 'alt'").select("sample_id", F.col("score").alias("changed")), "sample_id")
    out = rp.intervention_summary(joined, ["active_buckets"])
    return rounded(out.withColumn("mean_delta", F.round("mean_delta", 5)).withColumn("median_delta", F.round("median_delta", 5)))


@query("rp14_supervision", with_ctes("+s AS (SELECT source_host FROM pred WHERE model = 'base' AND seed = 1 GROUP BY 1 HAVING count(*) >= 20) SELECT primary_attack, count(*) AS n, count(DISTINCT source_host) AS hosts, " + r("avg(CASE WHEN source_host IN (SELECT source_host FROM s) THEN 1.0 ELSE 0.0 END)", "covered") + " FROM pred WHERE model = 'base' AND seed = 1 AND y = 1 GROUP BY 1", "pred"))
def rp14(spark, sf):
    p = predictions(spark, sf).where("model = 'base' AND seed = 1")
    return rounded(rp.supervision_coverage(p, rp.supported_hosts(p)))


_HIT = "h AS (SELECT *, score >= 0.7 AS hit, attack_flows * 1.0 / flows AS fraction FROM pred WHERE model = 'base' AND seed = 1 AND y = 1)"
_SEEN = "source_host IN (SELECT source_ip FROM fold WHERE fold = 0)"


@query("rp15_attack_profile", with_ctes(f"+{_HIT}, mac AS (SELECT primary_attack, avg(x) AS m FROM (SELECT primary_attack, source_host, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS x FROM h GROUP BY 1, 2) GROUP BY 1) SELECT primary_attack, count(*) AS n, " + r("avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)", "recall") + ", " + ", ".join(r(f"median({c}) FILTER ({t})", f"{c}_median_{s}") for c in ("flows", "attack_flows", "active_buckets", "fraction") for s, t in (("all", "true"), ("tp", "hit"), ("fn", "NOT hit"))) + f", count(*) FILTER (fraction = 1) AS pure, count(*) FILTER (fraction <= 0.01) AS at_most_1pct, " + r(f"avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER ({_SEEN})", "recall_seen_hosts") + ", " + r(f"avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FILTER (NOT {_SEEN})", "recall_unseen_hosts") + ", count(DISTINCT window_start_ms) AS windows, " + r("any_value(m)", "host_macro_recall") + " FROM h JOIN mac USING (primary_attack) GROUP BY 1", "pred", "fold"))
def rp15(spark, sf):
    train = folded(spark, sf).where("fold = 0").select(F.col("source_ip").alias("source_host"))
    return rounded(rp.attack_profile(hits(spark, sf), train))


@query("rp15_training_profile", with_ctes(f"+{_HIT}, {_PLAN.strip().lstrip('+')}, tr15 AS (SELECT primary_attack AS t, 'r' AS k FROM fold WHERE fold = 0 AND attack_flows > 0 UNION ALL SELECT target_attack, 's' FROM plan_ WHERE sample_type = 'synthetic_malicious'), sh AS (SELECT DISTINCT primary_attack FROM h), att2 AS (SELECT i.sequence_id, a.attack FROM att a JOIN ids i USING (source_ip, window_start_ms)), mm AS (SELECT sequence_id FROM att2 GROUP BY 1 HAVING count(*) > 1) SELECT primary_attack, count(*) FILTER (k = 'r') AS real_train_n, count(*) FILTER (k = 's') AS synthetic_train_n, " + r("(count(*) FILTER (k = 'r') * 1.0 / (SELECT count(*) FROM tr15 WHERE k = 'r') + count(*) FILTER (k = 's') * 1.0 / (SELECT count(*) FROM tr15 WHERE k = 's')) / 2", "positive_objective_share") + ", (SELECT count(*) FROM h WHERE h.primary_attack = sh.primary_attack AND sample_id IN (SELECT sequence_id FROM mm)) AS within_type_mixed_attack_n FROM sh LEFT JOIN tr15 ON tr15.t = sh.primary_attack GROUP BY 1", "pred", "fold", "att", "ids"))
def rp15_training(spark, sf):
    """What the attack profile says of training: samples of each type, its share of the objective, and mixed sequences."""
    positives = hits(spark, sf)
    real = folded(spark, sf).where("fold = 0 AND attack_flows > 0").select(F.lit("real_malicious").alias("sample_type"), F.col("primary_attack").alias("target_attack"))
    profile = rp.training_profile(real.unionByName(_plan(spark, sf)[2].select("sample_type", "target_attack")), positives)
    held = attacks(spark, sf).join(with_ids(spark, sf).select("source_ip", "window_start_ms", F.col("sequence_id").alias("sample_id")), ["source_ip", "window_start_ms"])
    return rounded(profile.join(rp.mixed_types(positives, held), "primary_attack"))


_BINS = {"host": "source_host", "fraction": "CASE WHEN fraction = 1 THEN 'all' WHEN fraction <= 0.01 THEN '<=1%' WHEN fraction <= 0.1 THEN '1-10%' WHEN fraction <= 0.5 THEN '10-50%' ELSE '50-100%' END", "active": "CASE WHEN active_buckets <= 1 THEN '1' WHEN active_buckets <= 5 THEN '2-5' ELSE '6-10' END", "flows": "CASE WHEN flows <= 2 THEN '1-2' WHEN flows <= 10 THEN '3-10' WHEN flows <= 100 THEN '11-100' ELSE '101+' END"}


@query("rp16_recall_slices", with_ctes(f"+{_HIT} " + " UNION ALL ".join(f"SELECT primary_attack, '{v}' AS variable, {x} AS bin, count(*) AS n, count(*) FILTER (hit) AS tp, " + r("avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)", "recall") + " FROM h GROUP BY 1, 3" for v, x in _BINS.items()), "pred"))
def rp16(spark, sf):
    return rounded(rp.recall_slices(hits(spark, sf), ["primary_attack"]))


@query("rp17_outcome_summary", with_ctes(f"+{_HIT} SELECT hit, count(*) AS n, " + r("avg(flows)", "flows_mean") + ", " + r("median(active_buckets)", "active_buckets_median") + " FROM h GROUP BY 1", "pred"))
def rp17(spark, sf):
    return rounded(rp.outcome_summary(hits(spark, sf), ["hit"], ["flows"], ["active_buckets"]))


_STAGES = {"first_bucket": 0, "second_bucket": 1}
_VEC = "vn AS (SELECT count(*) AS nv FROM embeddings), vx AS MATERIALIZED (SELECT f.sequence_id, s.i, f.attack_flows > 0 AS bad, CASE WHEN (f.sequence_id + s.i) % 3 <> 0 THEN CAST(embedding AS DOUBLE[]) ELSE list_transform(range(64), lambda z: CAST(0 AS DOUBLE)) END AS v FROM ids f, (SELECT unnest(range(2)) AS i) s, vn JOIN embeddings ON vec_id = (f.sequence_id * 4 + s.i) % nv) "


@query("rp17_neighbour_summary", with_ctes(f"+{_HIT}, {_VEC}, dd AS (SELECT a.i, a.sequence_id, b.bad, row_number() OVER (PARTITION BY a.i, a.sequence_id ORDER BY list_distance(a.v, b.v), b.sequence_id) AS rk FROM vx a JOIN vx b ON a.i = b.i AND a.sequence_id <> b.sequence_id WHERE a.bad), q AS (SELECT i, sequence_id, avg(CASE WHEN bad THEN 0.0 ELSE 1.0 END) AS x FROM dd WHERE rk <= 10 GROUP BY 1, 2) SELECT CASE i WHEN 0 THEN 'first_bucket' ELSE 'second_bucket' END AS stage, CASE WHEN hit THEN 'TP' ELSE 'FN' END AS outcome, count(*) AS n, " + r("avg(x)", "mean_benign_share") + " FROM q JOIN h ON h.sample_id = q.sequence_id GROUP BY 1, 2", "pred", "ids"))
def rp17_neighbours(spark, sf):
    """Neighbours of the positives among all sequences, by the vector of their first and of their second bucket."""
    labels = with_ids(spark, sf).select("sequence_id", (F.col("attack_flows") > 0).cast("int").alias("y"))
    found = []
    for stage, place in _STAGES.items():
        pool = _encoded(spark, sf).select("sequence_id", F.get("x", place).alias("v")).join(labels, "sequence_id")
        near = dg.knn(pool.where("y = 1"), pool, 10, "sequence_id", "v")
        found.append(dg.neighbour_profile(near, labels, "sequence_id", "y").withColumn("stage", F.lit(stage)))
    outcomes = hits(spark, sf).select("sample_id", F.when(F.col("hit"), "TP").otherwise("FN").alias("outcome"))
    return rounded(rp.neighbour_summary(found[0].unionByName(found[1]), outcomes))


@query("rp17_collision_summary", with_ctes(f"+{_HIT}, st AS (SELECT 'flows' AS stage, CAST(flows AS VARCHAR) AS k, sequence_id, attack_flows > 0 AS bad FROM ids UNION ALL SELECT 'flows_active', flows || ':' || active_buckets, sequence_id, attack_flows > 0 FROM ids), be AS (SELECT DISTINCT stage, k FROM st WHERE NOT bad) SELECT s.stage, CASE WHEN hit THEN 'TP' ELSE 'FN' END AS outcome, count(*) AS n, count(b.k) AS with_exact_benign_counterpart, (SELECT count(*) FROM ids WHERE attack_flows = 0) AS searched_benign_n FROM st s JOIN h ON h.sample_id = s.sequence_id LEFT JOIN be b ON b.stage = s.stage AND b.k = s.k GROUP BY 1, 2", "pred", "ids"))
def rp17_collisions(spark, sf):
    """Positives with an identical benign row, by flows alone and by flows and active buckets."""
    rows = _rows(spark, sf)
    found = [dg.exact_collisions(rows.where("y = 1"), rows.where("y = 0"), fields).withColumn("stage", F.lit(stage)) for stage, fields in (("flows", ["flows"]), ("flows_active", ["flows", "active_buckets"]))]
    searched = rows.where("y = 0").agg(F.count("*").alias("searched_benign_n")).withColumn("stage", F.explode(F.array(F.lit("flows"), F.lit("flows_active"))))
    outcomes = hits(spark, sf).select("sample_id", F.when(F.col("hit"), "TP").otherwise("FN").alias("outcome"))
    return rp.collision_summary(found[0].unionByName(found[1]), outcomes, searched)


@query("rp18_ab_table", with_ctes(f"+{_PAIR} SELECT primary_attack, count(*) AS n, count(*) FILTER (before) AS tp_before, count(*) FILTER (after) AS tp_after, " + r("(count(*) FILTER (after) - count(*) FILTER (before)) * 100.0 / count(*)", "delta_pp") + ", count(*) FILTER (NOT before AND after) AS recovered, count(*) FILTER (before AND NOT after) AS lost FROM pr GROUP BY 1", "pred"))
def rp18(spark, sf):
    p = predictions(spark, sf).where("seed = 1")
    return rounded(rp.ab_table(p.where("model = 'base'"), p.where("model = 'alt'"), CUT, CUT))


@query("rp19_changed_profile", with_ctes(f"+{_PAIR} SELECT primary_attack, CASE WHEN before AND after THEN 'retained_tp' WHEN before THEN 'lost' WHEN after THEN 'recovered' ELSE 'persistent_fn' END AS outcome, count(*) AS n, count(DISTINCT source_host) AS hosts, " + r("median(flows)", "flows_median") + " FROM pr GROUP BY 1, 2", "pred"))
def rp19(spark, sf):
    return rounded(rp.changed_profile(pairs(spark, sf), ["primary_attack"], ["flows"]))


@query("w13_paired_outcomes", with_ctes(f"+{_PAIR} SELECT sample_id, CASE WHEN before AND after THEN 'retained_tp' WHEN before THEN 'lost' WHEN after THEN 'recovered' ELSE 'persistent_fn' END AS outcome FROM pr", "pred"))
def w13_paired(spark, sf):
    return pairs(spark, sf).select("sample_id", paired_outcome(F.col("before"), F.col("after")).alias("outcome"))


# Diagnostics


@query("j7_past_context", with_ctes(f"+s AS (SELECT *, CASE WHEN fold = 0 THEN 'train' ELSE 'other' END AS split FROM fold), an AS (SELECT source_ip, window_start_ms AS anchor_ms, window_start_ms + {GRID.window_ms} - {3 * GRID.window_ms} AS lo, window_start_ms + {GRID.window_ms} AS hi FROM s WHERE attack_flows > 0 AND split = 'train'), bl AS (SELECT window_start_ms // {2 * GRID.window_ms} AS bin, max(CASE WHEN split <> 'train' THEN 1 ELSE 0 END) AS foreign_ FROM s GROUP BY 1) SELECT a.source_ip, a.anchor_ms, s.window_start_ms, s.flows FROM an a JOIN s ON s.source_ip = a.source_ip AND s.window_start_ms >= a.lo AND s.window_start_ms < a.hi WHERE NOT EXISTS (SELECT 1 FROM bl WHERE foreign_ = 1 AND bin BETWEEN a.lo // {2 * GRID.window_ms} AND (a.hi - 1) // {2 * GRID.window_ms})", "fold"))
def j7(spark, sf):
    s = folded(spark, sf).withColumn("split", F.when(F.col("fold") == 0, "train").otherwise("other"))
    out = dg.past_context(s.where("attack_flows > 0 AND split = 'train'"), s, GRID.window_ms, 3 * GRID.window_ms, 2 * GRID.window_ms, "train")
    return out.select("source_ip", "anchor_ms", "window_start_ms", "flows")


def _rows(spark, sf):
    return with_ids(spark, sf).select(F.col("sequence_id").alias("sample_id"), "source_ip", "flows", "active_buckets", "attack_flows", "primary_attack", (F.col("attack_flows") > 0).cast("int").alias("y"))


_ROWS = "rw AS (SELECT sequence_id AS sample_id, source_ip, flows, active_buckets, attack_flows, primary_attack, CASE WHEN attack_flows > 0 THEN 1 ELSE 0 END AS y FROM ids)"


@query("j8_exact_collisions", with_ctes(f"+{_ROWS} SELECT a.sample_id AS target_id, count(*) AS collisions, min(b.sample_id) AS example_id FROM rw a JOIN rw b ON a.flows = b.flows AND a.active_buckets = b.active_buckets AND a.y = 1 AND b.y = 0 GROUP BY 1", "ids"))
def j8(spark, sf):
    rows = _rows(spark, sf)
    return dg.exact_collisions(rows.where("y = 1"), rows, ["flows", "active_buckets"])


@query("j9_signature_matches", with_ctes(f"+{_ROWS} SELECT a.sample_id AS target_id, count(*) FILTER (b.y = 0) AS real_benign, count(*) FILTER (b.y = 1) AS real_malicious, CAST(0 AS BIGINT) AS synthetic_benign, CAST(0 AS BIGINT) AS synthetic_malicious, min(b.y) <> max(b.y) AS both_labels, " + r("sum((1 + b.y) * b.y) * 1.0 / sum(1 + b.y)", "positive_share") + ", coalesce(string_agg(DISTINCT CASE WHEN b.y = 1 THEN b.primary_attack END, ',' ORDER BY CASE WHEN b.y = 1 THEN b.primary_attack END), '') AS attack_types, min(b.sample_id) AS example_id FROM rw a JOIN rw b ON a.flows = b.flows AND a.active_buckets = b.active_buckets AND a.y = 1 GROUP BY 1", "ids"))
def j9(spark, sf):
    rows = _rows(spark, sf).withColumn("sample_type", F.when(F.col("y") == 1, "real_malicious").otherwise("real_benign")).withColumn("weight", 1.0 + F.col("y"))
    return rounded(dg.signature_matches(rows.where("y = 1"), rows, ["flows", "active_buckets"]).withColumn("attack_types", F.array_join("attack_types", ",")))


_FIELDS = ("in_bytes", "protocol", "l4_dst_port")


@query(
    "j11_field_differences",
    with_ctes(
        f"+{_ROWS}, px AS (SELECT a.sample_id AS a, min(b.sample_id) AS b FROM rw a JOIN rw b ON a.flows = b.flows AND a.active_buckets = b.active_buckets AND a.y = 1 AND b.y = 0 GROUP BY 1), ev AS MATERIALIZED (SELECT i.sequence_id, g.* FROM g JOIN ids i USING (source_ip, window_start_ms)), "
        + "l AS (" + " UNION ALL ".join(f"SELECT sequence_id, '{f}' AS field, list_sort(list(CAST({f} AS DOUBLE))) AS v FROM ev GROUP BY 1" for f in _FIELDS) + ") "
        "SELECT px.a, px.b, x.field, CASE WHEN len(x.v) = len(y.v) THEN list_max(list_transform(range(1, len(x.v) + 1), lambda i: abs(x.v[i] - y.v[i]))) END AS largest_difference FROM px JOIN l x ON x.sequence_id = px.a JOIN l y ON y.sequence_id = px.b AND y.field = x.field WHERE x.v <> y.v",
        "ids", "g",
    ),
)
def j11(spark, sf):
    rows = _rows(spark, sf)
    pairs_ = dg.exact_collisions(rows.where("y = 1"), rows, ["flows", "active_buckets"]).select(F.col("target_id").alias("a"), F.col("example_id").alias("b"))
    ids = with_ids(spark, sf).select("source_ip", "window_start_ms", "sequence_id")
    e = events(spark, sf).join(ids, ["source_ip", "window_start_ms"])
    return dg.field_differences(pairs_, e, list(_FIELDS), ["a"], ["b"], ["sequence_id"])


@query("j12_knn", "WITH q AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 25 = 0), d AS (SELECT q.vec_id AS query_id, p.vec_id AS neighbour_id, list_distance(q.e, CAST(p.embedding AS DOUBLE[])) AS distance FROM q, embeddings p WHERE p.vec_id <> q.vec_id) SELECT query_id, neighbour_id, " + r("distance", "distance") + ", CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbour_id) AS rank FROM d) WHERE rank <= 10")
def j12(spark, sf):
    e = embeddings(spark, sf)
    return rounded(dg.knn(e.where("vec_id % 25 = 0"), e, 10, "vec_id", "embedding"))


@query("j12_neighbour_profile", "WITH q AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id % 25 = 0), d AS (SELECT q.vec_id AS query_id, q.label AS ql, p.label AS nl, list_distance(q.e, CAST(p.embedding AS DOUBLE[])) AS distance, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_distance(q.e, CAST(p.embedding AS DOUBLE[])), p.vec_id) AS rank FROM q, embeddings p WHERE p.vec_id <> q.vec_id) SELECT query_id, " + r("avg(CASE WHEN nl = 0 THEN 1.0 ELSE 0.0 END)", "benign_share") + ", " + r("avg(CASE WHEN nl = ql THEN 1.0 ELSE 0.0 END)", "same_share") + ", " + r("min(distance) FILTER (nl = 0)", "nearest_benign") + ", " + r("min(distance) FILTER (nl <> 0)", "nearest_attack") + ", " + r("min(distance) FILTER (nl <> 0) / min(distance) FILTER (nl = 0)", "ratio") + " FROM d WHERE rank <= 10 GROUP BY 1")
def j12_profile(spark, sf):
    e = embeddings(spark, sf)
    return rounded(dg.neighbour_profile(dg.knn(e.where("vec_id % 25 = 0"), e, 10, "vec_id", "embedding"), e, "vec_id", "label"))


_SPLITHIT = "hh AS (SELECT sample_id, source_host AS source_ip, active_buckets, flows, score >= 0.7 AS hit FROM pred WHERE model = 'base' AND seed = 1 AND y = 1)"


@query("j13_matched_controls", with_ctes(f"+{_SPLITHIT}, c AS (SELECT f.sample_id AS fn_id, t.sample_id AS tp_id, round(abs(log2(f.flows) - log2(t.flows)), 12) AS cost, CASE WHEN f.source_ip = t.source_ip AND f.active_buckets = t.active_buckets AND abs(log2(f.flows) - log2(t.flows)) <= 1 THEN 0 WHEN f.active_buckets = t.active_buckets THEN 1 ELSE 2 END AS tier FROM hh f JOIN hh t ON NOT f.hit AND t.hit) SELECT fn_id, tp_id, tier, round(cost, 6) + 0.0 AS cost FROM (SELECT *, row_number() OVER (PARTITION BY fn_id ORDER BY tier, cost, tp_id) AS rn FROM c) WHERE rn = 1", "pred"))
def j13(spark, sf):
    h = hits(spark, sf).select("sample_id", F.col("source_host").alias("source_ip"), "active_buckets", "flows", "hit")
    return rounded(dg.matched_controls(h.where("NOT hit"), h.where("hit")))


@query("j14_case_control", with_ctes(f"+{_ROWS}, k AS (SELECT *, CAST(floor(log2(flows)) AS INTEGER) AS v, CAST('0x' || substr(md5('3:' || sample_id), 1, 12) AS BIGINT) AS o FROM rw), need AS (SELECT source_ip, active_buckets, v, count(*) * 2 AS most FROM k WHERE y = 1 GROUP BY 1, 2, 3), mt AS (SELECT sample_id, most, row_number() OVER (PARTITION BY source_ip, active_buckets, v ORDER BY o, sample_id) AS rn FROM k JOIN need USING (source_ip, active_buckets, v) WHERE y = 0), al AS (SELECT sample_id, 'positive' AS role FROM k WHERE y = 1 UNION (SELECT sample_id, 'random' FROM k WHERE y = 0 ORDER BY o, sample_id LIMIT 100) UNION SELECT sample_id, 'matched' FROM mt WHERE rn <= most) SELECT sample_id, string_agg(role, ',' ORDER BY role) AS roles FROM al GROUP BY 1", "ids"))
def j14(spark, sf):
    rows = _rows(spark, sf)
    return dg.case_control(rows.where("y = 1"), rows.where("y = 0"), 3, 100)


_W, _B, _BL = GRID.window_ms, GRID.bucket_ms, BLOCK
_CTX = (
    "sco AS (SELECT sample_id, score FROM pred WHERE model = 'base' AND seed = 1), "
    "an AS (SELECT k.sequence_id AS sample_id, k.source_ip, k.window_start_ms, k.primary_attack AS attack_type, CASE WHEN k.attack_flows = 0 THEN 'benign' WHEN s.score >= 0.7 THEN 'TP' ELSE 'FN' END AS outcome, k.flows, k.attack_flows, k.active_buckets FROM kept k JOIN sco s ON s.sample_id = k.sequence_id WHERE k.fold = 0), "
    f"geo AS (SELECT * FROM (VALUES {', '.join(map(str, GEOMETRIES))}) AS t(c, b)), "
    f"sp AS MATERIALIZED (SELECT a.*, c, a.window_start_ms + {_W} - c * {_W} AS lo, a.window_start_ms + {_W} AS hi FROM an a, (SELECT DISTINCT c FROM geo)), "
    f"own AS MATERIALIZED (SELECT DISTINCT window_start_ms - window_start_ms % {_BL} AS block FROM kept WHERE assigned = 0), "
    f"cov AS MATERIALIZED (SELECT sample_id, c FROM (SELECT sample_id, c, unnest(range(lo - lo % {_BL}, hi, {_BL})) AS block FROM sp) LEFT JOIN own o USING (block) GROUP BY 1, 2 HAVING count(*) = count(o.block)), "
    "frn AS MATERIALIZED (SELECT DISTINCT s.sample_id, s.c FROM sp s JOIN kept k ON k.source_ip = s.source_ip AND k.window_start_ms >= s.lo AND k.window_start_ms < s.hi AND k.fold <> 0), "
    "opn AS MATERIALIZED (SELECT s.* FROM sp s JOIN cov USING (sample_id, c) LEFT JOIN frn f ON f.sample_id = s.sample_id AND f.c = s.c WHERE f.c IS NULL), "
    f"cnt AS (SELECT o.sample_id, o.attack_type, o.outcome, o.c, g.b, any_value(o.flows) AS f0, any_value(o.attack_flows) AS a0, any_value(o.active_buckets) AS b0, count(*) AS flows, CAST(sum(e.label) AS BIGINT) AS attack_flows, count(*) FILTER (e.label = 1 AND e.attack = o.attack_type) AS target_attack_flows, count(DISTINCT (e.flow_start_milliseconds - o.lo) // (g.b * {_B})) AS active FROM opn o JOIN geo g ON g.c = o.c JOIN g e ON e.source_ip = o.source_ip AND e.flow_start_milliseconds >= o.lo AND e.flow_start_milliseconds < o.hi GROUP BY ALL), "
    f"ctx AS MATERIALIZED (SELECT sample_id, attack_type, outcome, b0 <= 2 AS sparse, sample_id IN (SELECT sample_id FROM opn WHERE c = 4) AS common, c, b, f0 AS original_flows, a0 AS original_attack_flows, b0 AS original_active_buckets, flows, attack_flows, target_attack_flows, active AS active_buckets, active / (c * {_W} / (b * {_B})) AS active_fraction, flows / active AS flows_per_active_bucket, attack_flows / flows AS attack_fraction, flows - f0 AS added_flows, attack_flows - a0 AS added_attack_flows, flows - f0 - attack_flows + a0 AS added_benign_flows, flows > f0 AS has_additional_flows, a0 = 0 AND attack_flows > 0 AS benign_anchor_gains_attack FROM cnt) "
)
_SHARES = ("active_fraction", "flows_per_active_bucket", "attack_fraction")


@shared
def context(spark, sf):
    """Anchors are the sequences that stay in the first fold; outcomes are those of one run at a fixed threshold."""
    kept = purged(spark, sf).select("sequence_id", "source_ip", "window_start_ms", "primary_attack", "flows", "attack_flows", "active_buckets", F.col("fold").cast("string").alias("split"), F.col("assigned").cast("string").alias("assigned_split"))
    scores = predictions(spark, sf).where("model = 'base' AND seed = 1").select(F.col("sample_id").alias("sequence_id"), "score")
    result = F.when(F.col("attack_flows") == 0, "benign").when(F.col("score") >= CUT, "TP").otherwise("FN")
    anchors = kept.where("split = '0'").join(scores, "sequence_id").select(F.col("sequence_id").alias("sample_id"), "source_ip", "window_start_ms", F.col("primary_attack").alias("attack_type"), result.alias("outcome"), "flows", "attack_flows", "active_buckets")
    return cx.context_availability(anchors, events(spark, sf), kept, GRID.window_ms, GRID.bucket_ms, "0", BLOCK)


@query("rp11_context_availability", with_ctes(f"+{_CTX}SELECT * REPLACE (" + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in _SHARES) + ") FROM ctx", "kept", "pred", "g"))
def rp11(spark, sf):
    return rounded(context(spark, sf))


@query("rp11_paired_summary", with_ctes(f"+{_CTX}, lng AS (SELECT *, unnest(CASE WHEN outcome = 'benign' THEN ['all'] ELSE ['all', outcome] END) AS original_outcome FROM ctx WHERE common), sps AS (SELECT *, unnest(CASE WHEN sparse THEN [false, true] ELSE [false] END) AS sparse_only FROM lng) SELECT attack_type, original_outcome, sparse_only, c, b, count(*) AS anchors, count(*) FILTER (has_additional_flows) AS has_additional_flows_count, count(*) FILTER (benign_anchor_gains_attack) AS benign_anchor_gains_attack_count, count(*) FILTER (added_attack_flows > 0) AS gained_attack_flow_count, count(*) FILTER (added_flows > 0 AND added_attack_flows = 0) AS only_added_benign_count, " + ", ".join(r(f"quantile_cont({m}, 0.5)", f"median_{m}") for m in MEDIANS) + " FROM sps GROUP BY 1, 2, 3, 4, 5", "kept", "pred", "g"))
def rp11_paired(spark, sf):
    return rounded(cx.paired_summary(context(spark, sf)))


# Resampling: seeded draws

_K = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"
_Q = lambda x: r(f"avg({x})", "mean") + ", " + r(f"quantile_cont({x}, 0.025)", "low") + ", " + r(f"quantile_cont({x}, 0.975)", "high")


@query("sm1_benign_subsample", with_ctes(f"+{_ROWS} SELECT sample_id, y FROM rw WHERE y = 1 UNION ALL (SELECT sample_id, y FROM rw WHERE y = 0 ORDER BY CAST('0x' || substr(md5('2:' || sample_id), 1, 12) AS BIGINT), sample_id LIMIT 300)", "ids"))
def sm1(spark, sf):
    return rs.benign_subsample(_rows(spark, sf), 300, 2).select("sample_id", "y")


@query("sm2_host_bootstrap", with_ctes(f"+{_HIT}, ho AS (SELECT *, row_number() OVER (PARTITION BY primary_attack ORDER BY source_host) - 1 AS i, count(*) OVER (PARTITION BY primary_attack) AS n FROM (SELECT primary_attack, source_host, count(*) AS c, count(*) FILTER (hit) AS t FROM h GROUP BY 1, 2)), dr AS (SELECT primary_attack, b, {_K.format(chr(39) + '1:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || primary_attack || ' + chr(39) + ':' + chr(39) + ' || i')} % n AS i FROM ho, (SELECT unnest(range(50)) AS b)), q AS (SELECT primary_attack, b, sum(t) / sum(c) AS x FROM dr JOIN ho USING (primary_attack, i) GROUP BY 1, 2) SELECT primary_attack, " + _Q("x") + " FROM q GROUP BY 1", "pred"))
def sm2(spark, sf):
    return rounded(rs.host_bootstrap(hits(spark, sf), 50, 1))


@query("sm3_equal_size", with_ctes(f"+{_HIT}, d AS (SELECT primary_attack, hit, b, row_number() OVER (PARTITION BY primary_attack, b ORDER BY CAST('0x' || substr(md5('1:' || b || ':' || sample_id), 1, 12) AS BIGINT), sample_id) AS rn FROM h, (SELECT unnest(range(20)) AS b)), q AS (SELECT primary_attack, b, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS x FROM d WHERE rn <= 10 GROUP BY 1, 2) SELECT primary_attack, " + r("avg(x)", "mean") + ", " + r("quantile_cont(x, 0.025)", "low") + ", " + r("quantile_cont(x, 0.975)", "high") + " FROM q GROUP BY 1", "pred"))
def sm3(spark, sf):
    return rounded(rs.equal_size_recall(hits(spark, sf), 10, 20, 1))


@query("sm3_dispersion", f"WITH d AS (SELECT label, b, vec_id, row_number() OVER (PARTITION BY label, b ORDER BY {_K.format(chr(39) + '1:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || vec_id')}, vec_id) AS rn FROM embeddings, (SELECT unnest(range(5)) AS b)), x AS (SELECT d.label, b, i, var_samp(CAST(embedding[i] AS DOUBLE)) AS v FROM d JOIN embeddings USING (vec_id), (SELECT unnest(range(1, 65)) AS i) WHERE rn <= 20 GROUP BY 1, 2, 3) SELECT label AS primary_attack, " + r("avg(t)", "dispersion") + " FROM (SELECT label, b, sum(v) AS t FROM x GROUP BY 1, 2) GROUP BY 1")
def sm3_dispersion(spark, sf):
    e = embeddings(spark, sf).select(F.col("vec_id").alias("sample_id"), F.col("label").alias("primary_attack"), F.col("embedding").cast("array<double>").alias("v"))
    return rounded(rs.dispersion(e, 20, 5, 1, "v"))


@query("sm4_one_per_host", with_ctes(f"+{_HIT}, m AS (SELECT primary_attack, b, source_host, arg_min(hit, (o, sample_id)) AS hit FROM (SELECT *, {_K.format(chr(39) + '1:member:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || sample_id')} AS o FROM h, (SELECT unnest(range(20)) AS b)) GROUP BY 1, 2, 3), q AS (SELECT *, row_number() OVER (PARTITION BY primary_attack, b ORDER BY {_K.format(chr(39) + '1:host:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || source_host')}, source_host) AS rn FROM m) SELECT primary_attack, CAST(b AS INTEGER) AS b, " + r("avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END)", "recall") + ", count(*) AS hosts FROM q WHERE rn <= 8 GROUP BY 1, 2", "pred"))
def sm4(spark, sf):
    return rounded(rs.one_per_host(hits(spark, sf), 8, 20, 1))


@query("sm5_duplication_control", with_ctes(f"+{_HIT}, nu AS (SELECT primary_attack, hit, row_number() OVER (PARTITION BY primary_attack ORDER BY sample_id) - 1 AS i, count(*) OVER (PARTITION BY primary_attack) AS n FROM h), dr AS (SELECT primary_attack, b, {_K.format(chr(39) + '1:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || primary_attack || ' + chr(39) + ':' + chr(39) + ' || d')} % n AS i FROM (SELECT DISTINCT primary_attack, n FROM nu), (SELECT unnest(range(20)) AS b), (SELECT unnest(range(60)) AS d)), q AS (SELECT primary_attack, b, avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) AS x FROM dr JOIN nu USING (primary_attack, i) GROUP BY 1, 2) SELECT primary_attack, " + r("min(x)", "least") + ", " + r("max(x)", "greatest") + " FROM q GROUP BY 1", "pred"))
def sm5(spark, sf):
    return rounded(rs.duplication_control(hits(spark, sf), 60, 20, 1))


@query("sm6_composition_matched", with_ctes(f"+{_HIT}, need AS (SELECT active_buckets, least(count(*) FILTER (primary_attack = 'Type0'), count(*) FILTER (primary_attack = 'Type1')) AS m FROM h GROUP BY 1 HAVING m > 0), pa AS (SELECT hit, m, row_number() OVER (PARTITION BY active_buckets, b ORDER BY {_K.format(chr(39) + '1:a:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || sample_id')}, sample_id) AS rn FROM h JOIN need USING (active_buckets), (SELECT unnest(range(20)) AS b) WHERE primary_attack = 'Type0'), pb AS (SELECT hit, m, row_number() OVER (PARTITION BY active_buckets, b ORDER BY {_K.format(chr(39) + '1:b:' + chr(39) + ' || b || ' + chr(39) + ':' + chr(39) + ' || sample_id')}, sample_id) AS rn FROM h JOIN need USING (active_buckets), (SELECT unnest(range(20)) AS b) WHERE primary_attack = 'Type1') SELECT " + ", ".join(r(f"(SELECT avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END) FROM p{x} WHERE rn <= m)", f"recall_{x}") + ", " + r(f"(SELECT count(*) / 20 FROM p{x} WHERE rn <= m)", f"matched_{x}") + f", (SELECT count(*) FROM h WHERE primary_attack = '{t}') AS n_{x}, " + r(f"(SELECT count(*) / 20 FROM p{x} WHERE rn <= m) / (SELECT count(*) FROM h WHERE primary_attack = '{t}')", f"coverage_{x}") for x, t in (("a", "Type0"), ("b", "Type1"))), "pred"))
def sm6(spark, sf):
    h = hits(spark, sf)
    return rounded(rs.composition_matched(h.where("primary_attack = 'Type0'"), h.where("primary_attack = 'Type1'"), 20, 1, ["active_buckets"]))


@query("sm7_probe_cohort", with_ctes("+ x AS (SELECT sequence_id AS sample_id, source_ip, CASE WHEN sequence_id % 5 = 0 THEN 'eval' ELSE 'fit' END AS part FROM ids), ok AS (SELECT source_ip FROM x GROUP BY 1 HAVING count(*) FILTER (part = 'fit') >= 10 AND count(*) FILTER (part = 'eval') >= 3) SELECT sample_id, source_ip, part FROM (SELECT *, row_number() OVER (PARTITION BY source_ip, part ORDER BY CAST('0x' || substr(md5('1:' || sample_id), 1, 12) AS BIGINT), sample_id) AS rn FROM x SEMI JOIN ok USING (source_ip)) WHERE rn <= CASE WHEN part = 'fit' THEN 64 ELSE 32 END AND (SELECT count(*) FROM ok) >= 2", "ids"))
def sm7(spark, sf):
    rows = with_ids(spark, sf).select(F.col("sequence_id").alias("sample_id"), "source_ip", F.when(F.col("sequence_id") % 5 == 0, "eval").otherwise("fit").alias("part"))
    return rs.probe_cohort(rows, 1)


@query("sm8_host_member_draws", with_ctes(f"+ ho AS (SELECT source_ip, count(*) AS n, row_number() OVER (ORDER BY source_ip) - 1 AS h FROM ids GROUP BY 1), me AS (SELECT source_ip, sequence_id, row_number() OVER (PARTITION BY source_ip ORDER BY sequence_id) - 1 AS m FROM ids), dr AS (SELECT draw, {_K.format(chr(39) + '1:host:' + chr(39) + ' || draw')} % (SELECT count(*) FROM ho) AS h, {_K.format(chr(39) + '1:member:' + chr(39) + ' || draw')} AS km FROM (SELECT unnest(range(500)) AS draw)) SELECT draw, source_ip, sequence_id FROM dr JOIN ho USING (h) JOIN me USING (source_ip) WHERE m = km % n", "ids"))
def sm8(spark, sf):
    from flowlens.operators.donors import draw_members

    return draw_members(with_ids(spark, sf), 500, 1)


# MLlib


@shared
def _encoder_inputs(spark, sf):
    """Scaled features and the three histograms of every bucket, with the fold of its sequence; scaling and vocabularies
    are those of the first fold."""
    from pyspark.ml.functions import array_to_vector

    from flowlens.operators import features as ft
    from flowlens.operators import histograms as hg
    from flowlens.operators.scaling import fit_scaler, standardize

    stats = statistics(spark, sf)
    rows = standardize(stats, fit_scaler(stats.where("fold = 0"), None, ft.FEATURES), ft.FEATURES)
    shares = hg.share_arrays(events(spark, sf), hg.fit_vocabularies(events(spark, sf), folded(spark, sf).where("fold = 0"), HISTOGRAMS))
    return rows.join(shares.select(*ft.BUCKET, *(array_to_vector(f"{f}_shares").alias(f"{f}_shares") for f in HISTOGRAMS)), ft.BUCKET)


HISTOGRAMS = ("protocol", "l7", "service")


def _encoder(spark, sf):
    from flowlens.operators import features as ft

    rows = _encoder_inputs(spark, sf)
    return rows, ml.fit_encoder(rows.where("fold = 0"), [*ft.FEATURES, *(f"{f}_shares" for f in HISTOGRAMS)], 64)


@query("ml1_bucket_encoder")
def ml1(spark, sf):
    rows, model = _encoder(spark, sf)
    return ml.encode(model, rows).select("source_ip", "window_start_ms", "bucket", "embedding")


@query("ml1_encoder_loss")
def ml1_loss(spark, sf):
    """Mean loss of the frozen encoder by fold: what was fitted, validation and test."""
    from flowlens.operators import features as ft

    rows, model = _encoder(spark, sf)
    first = rows.select(*(f"{f}_shares" for f in HISTOGRAMS)).first()
    lost = ml.encoder_loss(model, rows, len(ft.FEATURES), [len(v) for v in first])
    return lost.groupBy("fold").agg(F.count("*").alias("buckets"), F.avg("loss").alias("loss"))


def _flat_samples(spark, sf):
    from flowlens.functions.arrays import flatten_sample
    from flowlens.plans.split_queries import _samples

    return _samples(spark, sf).select("sample_id", "sample_type", "split", "y", flatten_sample(F.col("x"), F.col("mask")).alias("flat"))


_TREES: dict[tuple[str, str], object] = {}


def _trees(spark, sf):
    """The ensemble of one session, fitted once."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _TREES:
        rows = _flat_samples(spark, sf)
        _TREES[key] = ml.fit_boosted_trees(mt.group_weights(rows.where("split = 'train'"), "sample_type"))
    return _TREES[key]


@query("ml2_ml8_boosted_trees")
def ml2(spark, sf):
    """Trees on the flat inputs of the training samples, with group weights, cut where validation AP is best; the
    responses are those of the test samples."""
    rows, model = _flat_samples(spark, sf), _trees(spark, sf)
    rounds = ml.best_prefix(ml.prefix_precision(model, rows.where("split = 'validation'")))
    scored = ml.score_trees(model, rows.where("split = 'test'"), rounds)
    return ml.tree_responses(model, scored).select("sample_id", "y", "score", "responses")


@query("ml2_rounds")
def ml2_rounds(spark, sf):
    """Validation AP after each round."""
    return rounded(ml.prefix_precision(_trees(spark, sf), _flat_samples(spark, sf).where("split = 'validation'")))


def _probe_rows(spark, sf):
    e = embeddings(spark, sf)
    named = e.select("vec_id", F.when(F.col("vec_id") % 4 == 0, "eval").otherwise("fit").alias("part"), (F.col("label") < 5).cast("int").alias("y"), F.lit(1.0).alias("weight"), *(F.get("embedding", i).cast("double").alias(f"f{i}") for i in range(64)))
    return named


@query("ml3_feature_probe")
def ml3(spark, sf):
    return ml.feature_probe(_probe_rows(spark, sf), [f"f{i}" for i in range(64)])


@query("ml3_family_probes")
def ml3_families(spark, sf):
    """Sequence means of the 82 features against means with each candidate family, by time block and by host."""
    from flowlens.operators import features as ft

    key = ["source_ip", "window_start_ms"]
    old = statistics(spark, sf)
    new = ft.candidate_features(events(spark, sf))
    families = ft.candidate_families(new.columns)
    mean = lambda t, names: t.groupBy(*key).agg(*(F.avg(n).alias(n) for n in names))
    added = [n for ns in families.values() for n in ns]
    renamed = new.select(*key, *(F.col(n).alias(f"new_{n}") for n in added))
    rows = mean(old, ft.FEATURES).join(mean(renamed, [f"new_{n}" for n in added]), key).join(sequences(spark, sf).select(*key, (F.col("attack_flows") > 0).cast("int").alias("y")), key)
    rows = rows.withColumn("block", F.col("window_start_ms") - F.col("window_start_ms") % BLOCK)
    return ml.family_probes(rows, ft.FEATURES, {f: [f"new_{n}" for n in ns] for f, ns in families.items()}, {"time_block": "block", "source_host": "source_ip"})


def _screen_sql() -> str:
    long = " UNION ALL ".join(f"SELECT 'f{i}' AS feature, CASE WHEN vec_id % 4 = 0 THEN 'eval' ELSE 'fit' END AS part, CASE WHEN label < 5 THEN 1 ELSE 0 END AS y, CAST(embedding[{i + 1}] AS DOUBLE) AS score FROM embeddings" for i in range(64))
    return f"WITH l AS ({long}), u AS (SELECT a.feature, a.part, avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) AS auc FROM l a JOIN l b USING (feature, part) WHERE a.y = 1 AND b.y = 0 GROUP BY 1, 2) SELECT e.feature, {r('f.auc', 'fit_auc')}, {r('CASE WHEN f.auc >= 0.5 THEN e.auc ELSE 1 - e.auc END', 'auc')}, CASE WHEN f.auc >= 0.5 THEN 'up' ELSE 'down' END AS direction FROM u e JOIN u f ON e.feature = f.feature AND e.part = 'eval' AND f.part = 'fit'"


@query("ml4_univariate_screen", _screen_sql())
def ml4(spark, sf):
    return rounded(ml.univariate_screen(_probe_rows(spark, sf), [f"f{i}" for i in range(64)]))


@query("ml5_host_probe")
def ml5(spark, sf):
    """How well a sequence's vectors tell the host, on the cohort of SM7."""
    from flowlens.operators.ordering import numbered
    from flowlens.plans.split_queries import _encoded

    rows = with_ids(spark, sf).select(F.col("sequence_id").alias("sample_id"), "source_ip", F.when(F.col("sequence_id") % 5 == 0, "eval").otherwise("fit").alias("part"))
    cohort = rs.probe_cohort(rows, 1)
    hosts = numbered(cohort.select("source_ip").distinct(), [], ["source_ip"], "label").withColumn("label", (F.col("label") - 1).cast("double"))
    vectors = _encoded(spark, sf).select(F.col("sequence_id").alias("sample_id"), F.flatten("x").alias("v"))
    return ml.host_probe(cohort.join(hosts, "source_ip").join(vectors, "sample_id"), "v", "label")


@query("ml6_projection")
def ml6(spark, sf):
    e = embeddings(spark, sf).withColumn("v", F.col("embedding").cast("array<double>"))
    return ml.project(e.where("label = 0"), e, "v", 2)[0].select("vec_id", "projected")


@query("ml7_centroid_distance", "WITH x AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS m FROM embeddings, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2), rad AS (SELECT sqrt(avg(d)) AS radius FROM (SELECT vec_id, sum(pow(CAST(embedding[i] AS DOUBLE) - m, 2)) AS d FROM embeddings e JOIN x ON x.label = 0 AND e.label = 0 GROUP BY 1)) SELECT a.label, " + r("sqrt(sum(pow(a.m - b.m, 2))) / any_value(radius)", "radii", 5) + " FROM x a JOIN x b ON a.i = b.i AND b.label = 0, rad GROUP BY 1")
def ml7(spark, sf):
    return rounded(ml.centroid_distance(embeddings(spark, sf), "embedding", "label"), 5)
