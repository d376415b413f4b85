"""Evaluation of score tables (EV1-EV17). Rows: sample_id, y, score, primary_attack, source_host, and keys of a run.

All measures start from counts by (run, score): ties are one block, and the ordered table has a row for
each distinct score of a run, not for each sample. It is dealt out by ranges of scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ordering import running_sums

Z95 = 1.96


def score_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Positives and negatives by score."""
    return rows.groupBy(*keys, "score").agg(F.sum("y").cast("bigint").alias("p"), F.sum(1 - F.col("y")).cast("bigint").alias("n"))


def score_curve(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV1, SNK8: running tp and fp from the highest score down, with tpr, fpr, precision."""
    return curve_of(score_counts(rows, keys), keys)


def curve_of(counts: DataFrame, keys: list[str]) -> DataFrame:
    whole = counts.groupBy(*keys).agg(F.sum("p").alias("_P"), F.sum("n").alias("_N"))
    out = running_sums(counts, keys, [F.desc("score")], {"tp": F.col("p"), "fp": F.col("n")})
    out = out.join(F.broadcast(whole), keys) if keys else out.crossJoin(F.broadcast(whole))  # a row for each run
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b))
    return out.select(*keys, "score", "p", "n", "tp", "fp", share("tp", "_P").alias("tpr"), share("fp", "_N").alias("fpr"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"), F.col("_P").alias("positives"), F.col("_N").alias("negatives"))


def average_precision(curve: DataFrame, keys: list[str]) -> DataFrame:
    """EV2: sum of recall steps times precision."""
    return curve.groupBy(*keys).agg(F.sum(F.col("p") / F.col("positives") * F.col("precision")).alias("average_precision"))


def roc_auc(curve: DataFrame, keys: list[str]) -> DataFrame:
    """EV3: Mann-Whitney share of ordered pairs; ties count half."""
    below = F.col("negatives") - F.col("fp")
    return curve.groupBy(*keys).agg((F.sum(F.col("p") * (below + F.col("n") / 2)) / F.first(F.col("positives") * F.col("negatives"))).alias("roc_auc"))


def choose_thresholds(curve: DataFrame, keys: list[str], budgets: dict[str, float] | None = None) -> DataFrame:
    """EV4: 0.5, and for each false-positive budget the highest threshold of the best recall within it.

    Where no score fits the budget, ``reject_all`` is set and the threshold is the next double above the
    greatest score.
    """
    budgets = {"fpr_1pct": 0.01, "fpr_0.1pct": 0.001} if budgets is None else budgets
    top = curve.groupBy(*keys).agg(F.max("score").alias("_top"))
    names = curve.sparkSession.createDataFrame([(n, float(b)) for n, b in budgets.items()], "point string, budget double")
    fits = curve.crossJoin(F.broadcast(names)).where("fpr <= budget")  # a row for each budget
    best = fits.groupBy(*keys, "point").agg(F.max(F.struct("tpr", "score")).alias("b"))
    slots = top.crossJoin(F.broadcast(names))
    found = slots.join(best, [*keys, "point"], "left")
    # a best recall of zero is that of rejecting all
    none = F.col("b").isNull() | (F.col("b.tpr") == 0)
    above = F.col("_top") + F.greatest(F.abs(F.col("_top")), F.lit(2.2250738585072014e-308)) * F.lit(2.220446049250313e-16)
    chosen = found.select(*keys, "point", F.when(none, above).otherwise(F.col("b.score")).alias("threshold"), none.alias("reject_all"))
    half = top.select(*keys, F.lit("default_0.5").alias("point"), F.lit(0.5).alias("threshold"), F.lit(False).alias("reject_all"))
    return chosen.unionByName(half)


def at_thresholds(rows: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """EV5: counts and measures at each threshold of the run (score >= threshold is positive)."""
    joined = rows.join(F.broadcast(thresholds), keys) if keys else rows.crossJoin(F.broadcast(thresholds))  # a few rows for each run
    hit = F.col("score") >= F.col("threshold")
    c = lambda t: F.sum(t.cast("bigint"))
    y = F.col("y") == 1
    out = joined.groupBy(*keys, "point", "threshold").agg(c(hit & y).alias("tp"), c(hit & ~y).alias("fp"), c(~hit & ~y).alias("tn"), c(~hit & y).alias("fn"))
    return with_measures(out)


def operating_points(curve: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """EV5 from EV1: what a threshold accepts is the curve's last block at or above it, so that no sample is read again."""
    joined = curve.join(F.broadcast(thresholds), keys) if keys else curve.crossJoin(F.broadcast(thresholds))  # a few rows for each run
    accepted = lambda c: F.coalesce(F.max(F.when(F.col("score") >= F.col("threshold"), F.col(c))), F.lit(0)).alias(c)
    out = joined.groupBy(*keys, "point", "threshold").agg(accepted("tp"), accepted("fp"), F.first("positives").alias("_P"), F.first("negatives").alias("_N"))
    return with_measures(out.select(*keys, "point", "threshold", "tp", "fp", (F.col("_N") - F.col("fp")).alias("tn"), (F.col("_P") - F.col("tp")).alias("fn")))


def run_metrics(curve: DataFrame, thresholds: DataFrame, attacks: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """The measures of a run that reports compare, in long form: keys, metric, unit, value.

    Average precision, ROC-AUC (absolute; all others are shares in per cent), recall and false-positive rate at both
    budgets, and the macro recall at one per cent over types with ``least`` samples. ``attacks``: EV6.
    """
    names = {"fpr_1pct": "1pct", "fpr_0.1pct": "0.1pct"}
    whole = average_precision(curve, keys).join(roc_auc(curve, keys), keys)
    points = operating_points(curve, thresholds.where(F.col("point").isin(*names)).select(*keys, "point", "threshold"), keys)
    pick = lambda c, p: F.max(F.when(F.col("point") == p, F.col(c)))
    points = points.groupBy(*keys).agg(*(pick(c, p).alias(f"{c}_at_{n}") for p, n in names.items() for c in ("recall", "fpr")))
    macro = macro_recall(attacks.where("point = 'fpr_1pct'"), keys, least).select(*keys, "macro_recall")
    wide = whole.join(points, keys).join(macro, keys, "left")
    values = [c for c in wide.columns if c not in keys]
    long = wide.unpivot(keys, [F.col(f"`{v}`") for v in values], "metric", "value")
    return long.withColumn("unit", F.when(F.col("metric") == "roc_auc", "absolute").otherwise("pp"))


def with_measures(counts: DataFrame) -> DataFrame:
    """EV5 from tp, fp, tn, fn."""
    tp, fp, tn, fn = (F.col(x).cast("double") for x in ("tp", "fp", "tn", "fn"))
    safe = lambda a, b: F.when(b != 0, a / b).otherwise(0.0)
    recall, specificity, precision = safe(tp, tp + fn), safe(tn, tn + fp), safe(tp, tp + fp)
    product = F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))
    return counts.withColumns({
        "precision": precision,
        "recall": recall,
        "fpr": 1 - specificity,
        "f1": safe(2 * tp, 2 * tp + fp + fn),
        "accuracy": (tp + tn) / (tp + fp + tn + fn),
        "balanced_accuracy": (recall + specificity) / 2,
        "mcc": safe(tp * tn - fp * fn, product),
    })


def attack_recall(rows: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """EV6, EV7: by type and operating point — n, hosts, tp, fn, recall."""
    joined = rows.where("y = 1").join(F.broadcast(thresholds), keys) if keys else rows.where("y = 1").crossJoin(F.broadcast(thresholds))
    hit = (F.col("score") >= F.col("threshold")).cast("bigint")
    return joined.groupBy(*keys, "primary_attack", "point").agg(F.count("*").alias("n"), F.countDistinct("source_host").alias("hosts"), F.sum(hit).alias("tp"), (F.count("*") - F.sum(hit)).alias("fn"), F.avg(hit).alias("recall"))


def macro_recall(attacks: DataFrame, keys: list[str], least: int = 20) -> DataFrame:
    """EV6: mean recall over types with at least ``least`` samples."""
    return attacks.groupBy(*keys, "point").agg(F.avg(F.when(F.col("n") >= least, F.col("recall"))).alias("macro_recall"))


def attack_table(rows: DataFrame, thresholds: DataFrame, keys: list[str], arm: str, baseline: str) -> DataFrame:
    """EV7: attack by operating point with the threshold, the run's FPR, and the change to a baseline arm."""
    per = attack_recall(rows, thresholds, keys)
    overall = at_thresholds(rows, thresholds, keys).select(*keys, "point", "threshold", "fpr")
    table = per.join(overall, [*keys, "point"])
    others = [k for k in keys if k != arm]
    base = table.where(F.col(arm) == baseline).select(*others, "primary_attack", "point", F.col("recall").alias("_base"))
    return table.join(base, [*others, "primary_attack", "point"], "left").withColumn("delta_pp", (F.col("recall") - F.col("_base")) * 100).drop("_base")


def host_macro_recall(rows: DataFrame, thresholds: DataFrame, keys: list[str]) -> DataFrame:
    """EV8: mean over hosts of each host's recall."""
    joined = rows.where("y = 1").join(F.broadcast(thresholds), keys)
    per = joined.groupBy(*keys, "point", "source_host").agg(F.avg((F.col("score") >= F.col("threshold")).cast("double")).alias("r"))
    return per.groupBy(*keys, "point").agg(F.avg("r").alias("host_macro_recall"), F.count("*").alias("hosts"))


def against_benign(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Score counts of each attack type against all benign rows: benign counts are replicated, not rows."""
    bad = rows.where("y = 1").groupBy(*keys, "primary_attack", "score").agg(F.count("*").alias("p"), F.lit(0).cast("bigint").alias("n"))
    types = rows.where("y = 1").select(*keys, "primary_attack").distinct()
    good = rows.where("y = 0").groupBy(*keys, "score").agg(F.count("*").alias("n"))
    good = (good.join(F.broadcast(types), keys) if keys else good.crossJoin(F.broadcast(types))).select(*keys, "primary_attack", "score", F.lit(0).cast("bigint").alias("p"), "n")
    return bad.union(good).groupBy(*keys, "primary_attack", "score").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))


def subtype_ap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV9: average precision of each type against all benign rows."""
    per = [*keys, "primary_attack"]
    return average_precision(curve_of(against_benign(rows, keys), per), per)


def subtype_auc(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV10: AUC of each type against all benign rows."""
    per = [*keys, "primary_attack"]
    return roc_auc(curve_of(against_benign(rows, keys), per), per)


def benign_tail(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV11: for each positive's score, the share of benign scores at or above it."""
    curve = score_curve(rows, keys).select(*keys, "score", F.col("fpr").alias("benign_tail"))
    return rows.where("y = 1").join(curve, [*keys, "score"]).select(*keys, "sample_id", "score", "benign_tail")


def bucket_ap(rows: DataFrame, keys: list[str]) -> DataFrame:
    """EV12: AP over active buckets; rows hold bucket, mask, y (bucket label), score."""
    return average_precision(score_curve(rows.where("mask = 1"), keys), keys)


def masked_bce(rows: DataFrame, keys: list[str], eps: float = 1e-7) -> DataFrame:
    """EV12: mean over sequences of the mean cross-entropy of their active buckets."""
    s = F.greatest(F.least(F.col("score"), F.lit(1 - eps)), F.lit(eps))
    loss = -F.when(F.col("y") == 1, F.log(s)).otherwise(F.log(1 - s))
    per = rows.where("mask = 1").groupBy(*keys, "sample_id").agg(F.avg(loss).alias("l"))
    return per.groupBy(*keys).agg(F.avg("l").alias("bce"))


def multiclass(rows: DataFrame, keys: list[str], truth: str = "label", predicted: str = "predicted") -> DataFrame:
    """EV13: accuracy, balanced accuracy, and the latter above chance for k classes."""
    per = rows.groupBy(*keys, truth).agg(F.count("*").alias("_n"), F.sum((F.col(truth) == F.col(predicted)).cast("bigint")).alias("_hit"))
    out = per.groupBy(*keys).agg((F.sum("_hit") / F.sum("_n")).alias("accuracy"), F.avg(F.col("_hit") / F.col("_n")).alias("balanced_accuracy"), F.count("*").alias("classes"))
    return out.withColumn("chance_adjusted", F.when(F.col("classes") > 1, (F.col("balanced_accuracy") - 1 / F.col("classes")) / (1 - 1 / F.col("classes"))))


def wilson(hits: Column, n: Column, z: float = Z95) -> Column:
    """EV14: struct(low, high); null without samples."""
    p = hits / n
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return F.when(n > 0, F.struct(((middle - spread) / scale).alias("low"), ((middle + spread) / scale).alias("high")))


def group_weights(rows: DataFrame, group: str = "sample_type") -> DataFrame:
    """EV15: N / (groups * count), so that groups weigh alike and the mean is one."""
    counts = rows.groupBy(group).agg(F.count("*").alias("_c"))
    total = counts.agg(F.sum("_c").alias("_N"), F.count("*").alias("_g"))
    weights = counts.crossJoin(F.broadcast(total)).select(group, (F.col("_N") / (F.col("_g") * F.col("_c"))).alias("weight"))
    return rows.join(F.broadcast(weights), group)  # a row for each group


def reconstruction_loss(rows: DataFrame, numeric: Column, rebuilt: Column, shares: Column, log_shares: Column) -> DataFrame:
    """EV16: mean squared error of the numbers plus cross-entropy of the histograms, by row."""
    mse = F.aggregate(F.zip_with(numeric, rebuilt, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) / F.size(numeric)
    ce = -F.aggregate(F.zip_with(shares, log_shares, lambda p, q: p * q), F.lit(0.0), lambda s, x: s + x)
    return rows.withColumn("loss", mse + ce)


def evaluate(rows: DataFrame, keys: list[str], thresholds: DataFrame | None = None) -> DataFrame:
    """AP, AUC, and EV5 at each operating point."""
    curve = score_curve(rows, keys)
    thresholds = choose_thresholds(curve, keys) if thresholds is None else thresholds
    points = at_thresholds(rows, thresholds.select(*keys, "point", "threshold"), keys)
    return points.join(average_precision(curve, keys), keys).join(roc_auc(curve, keys), keys)


def frozen_evaluate(rows: DataFrame, saved: DataFrame, keys: list[str], fitted_on: DataFrame | None = None) -> DataFrame:
    """EV17: evaluation of another split at saved thresholds; shared sample ids are an error."""
    if fitted_on is not None and not rows.select("sample_id").join(fitted_on.select("sample_id"), "sample_id", "left_semi").isEmpty():
        raise ValueError("the splits share samples")
    return evaluate(rows, keys, saved)
