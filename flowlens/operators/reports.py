"""Paired comparisons and reports over score tables (RP1-RP19)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import active_bin, flow_bin, fraction_bin
from flowlens.operators import metrics


def rank_models(summary: DataFrame) -> DataFrame:
    """RP1: by AP, then recall at the strict budget, then AUC; more than one contract is an error.

    ``summary`` has a row for each model: average_precision, recall_strict, roc_auc, contract.
    """
    check = summary.agg(F.countDistinct("contract").alias("_contracts"))
    rows = summary.crossJoin(F.broadcast(check))
    place = F.rank().over(Window.orderBy(F.desc("average_precision"), F.desc("recall_strict"), F.desc("roc_auc")))
    model = F.when(F.col("_contracts") > 1, F.raise_error(F.lit("models follow different contracts")).cast("string")).otherwise(F.col("model"))
    return rows.withColumn("model", model).withColumn("place", place).drop("_contracts")


def paired_shift(rows: DataFrame, run: list[str], variant: str, baseline: str, item: list[str]) -> DataFrame:
    """RP2: each value of a variant beside that of the baseline of the same run, and the difference.

    ``rows``: ``run``, ``variant``, ``item`` (the metric, or the attack), unit and value. Shares (unit pp) come out in
    percentage points. A value without a counterpart has a null baseline and difference.
    """
    keys = [*run, *item]
    scaled = rows.select(*keys, variant, "unit", (F.col("value") * F.when(F.col("unit") == "absolute", 1).otherwise(100)).alias("shifted"))
    base = scaled.where(F.col(variant) == baseline).select(*keys, F.col("shifted").alias("baseline"))
    found = scaled.where(F.col(variant) != baseline).join(base, keys, "left")
    return found.select(*run, variant, *item, "unit", "baseline", "shifted", (F.col("shifted") - F.col("baseline")).alias("delta"))


def paired_statistics(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RP3 over RP2: pairs in all and with both values, mean and sample SD of each side and of the difference, its signs and ends.

    Only pairs with a difference count for the statistics; a sample SD needs two of them.
    """
    whole = F.col("delta").isNotNull()
    sides = [a for c in ("baseline", "shifted", "delta") for a in (F.avg(F.when(whole, F.col(c))).alias(f"{c}_mean"), F.when(F.count("delta") > 1, F.stddev_samp(F.when(whole, F.col(c)))).alias(f"{c}_sd"))]
    sign = lambda t: F.sum(F.when(t, 1).otherwise(0)).cast("bigint")
    d = F.col("delta")
    return pairs.groupBy(*keys, "unit").agg(F.count("*").alias("n_pairs"), F.count("delta").alias("n_nonempty_pairs"), *sides, sign(d > 0).alias("positive_seeds"), sign(d < 0).alias("negative_seeds"), sign(d == 0).alias("zero_seeds"), F.min("delta").alias("delta_min"), F.max("delta").alias("delta_max"))


def seed_statistics(rows: DataFrame, keys: list[str], value: str, zero_for_one: bool = False) -> DataFrame:
    """RP3, RP5: n, mean, sample SD (null for one value; RP5 has zero there), signs, least, greatest."""
    v = F.col(value)
    sd = F.stddev_samp(v)
    sd = F.when(F.count(v) == 1, F.lit(0.0)).otherwise(sd) if zero_for_one else F.when(F.count(v) > 1, sd)
    sign = lambda t: F.sum(F.when(t, 1).otherwise(0)).cast("bigint")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.count(v).alias("pairs"), F.avg(v).alias("mean"), sd.alias("sd"), sign(v > 0).alias("positive"), sign(v < 0).alias("negative"), sign(v == 0).alias("zero"), F.min(v).alias("least"), F.max(v).alias("greatest"))


def occupancy_slices(pairs: DataFrame, keys: list[str], active: str = "active_buckets") -> DataFrame:
    """RP4: gained and lost positives by 1, 2, and 3 or more active buckets. ``pairs``: before, after."""
    part = F.when(F.col(active) == 1, "1").when(F.col(active) == 2, "2").otherwise(">=3")
    return transitions(pairs.withColumn("slice", part), [*keys, "slice"])


def transitions(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RP7 on one set of slices: recovered, lost, still missed, still detected."""
    b, a = F.col("before"), F.col("after")
    c = lambda t: F.sum(t.cast("bigint"))
    return pairs.groupBy(*keys).agg(F.count("*").alias("n"), c(~b & a).alias("recovered"), c(b & ~a).alias("lost"), c(~b & ~a).alias("still_missed"), c(b & a).alias("still_detected"))


def transition_slices(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RP7: transitions over all, pure, mixed, single-bucket and multi-bucket positives."""
    pure = F.col("attack_flows") == F.col("flows")
    one = F.col("active_buckets") == 1
    names = F.array(F.lit("all"), F.when(pure, "pure").otherwise("mixed"), F.when(one, "single_bucket").otherwise("multi_bucket"))
    return transitions(pairs.withColumn("slice", F.explode(names)), [*keys, "slice"])


def paired_predictions(before: DataFrame, after: DataFrame, before_at: Column | float, after_at: Column | float, keep: list[str]) -> DataFrame:
    """Positives under two runs, with whether each detects them."""
    a = before.where("y = 1").select("sample_id", *keep, (F.col("score") >= before_at).alias("before"))
    b = after.where("y = 1").select("sample_id", (F.col("score") >= after_at).alias("after"))
    return a.join(b, "sample_id")


def pooled_types(attacks: DataFrame, types: list[str], keys: list[str], name: str = "ALL HELD OUT") -> DataFrame:
    """RP5: rows of the withheld types, and one that pools them."""
    held = attacks.where(F.col("primary_attack").isin(*types))
    pooled = held.groupBy(*keys, "point").agg(F.lit(name).alias("primary_attack"), F.sum("n").alias("n"), F.sum("tp").alias("tp"), F.sum("fn").alias("fn"))
    columns = [*keys, "point", "primary_attack", "n", "tp", "fn"]
    both = held.select(columns).union(pooled.select(columns))
    return both.withColumn("recall", F.col("tp") / F.col("n"))


def arm_table(rows: DataFrame, keys: list[str], value: str, seed: str = "seed") -> DataFrame:
    """RP5: mean, SD (zero for one seed) and the values by seed, in order."""
    listed = rows.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, value))), lambda s: F.format_number(s[value], 6)), ";").alias("by_seed"))
    return seed_statistics(rows, keys, value, zero_for_one=True).join(listed, keys)


def with_pooled(rows: DataFrame, types: list[str], name: str = "ALL HELD OUT") -> DataFrame:
    """Score rows, and those of the withheld types once more under one name, so that every measure covers the pool too."""
    return rows.unionByName(rows.where((F.col("y") == 1) & F.col("primary_attack").isin(*types)).withColumn("primary_attack", F.lit(name)))


def arm_measures(rows: DataFrame, thresholds: DataFrame, arm: str, seed: str = "seed") -> DataFrame:
    """RP5: (arm, seed, primary_attack, n, hosts, measure, value): recall of each type at every point, and its AP."""
    keys = [arm, seed]
    recalls = metrics.attack_recall(rows, thresholds, keys).select(*keys, "primary_attack", "n", "hosts", F.concat(F.lit("recall_"), "point").alias("measure"), F.col("recall").alias("value"))
    sizes = rows.where("y = 1").groupBy(*keys, "primary_attack").agg(F.count("*").alias("n"), F.countDistinct("source_host").alias("hosts"))
    precision = metrics.subtype_ap(rows, keys).join(sizes, [*keys, "primary_attack"])
    return recalls.unionByName(precision.select(*keys, "primary_attack", "n", "hosts", F.lit("average_precision").alias("measure"), F.col("average_precision").alias("value")))


def compare_arms(measures: DataFrame, arm: str, control: str, withheld: list[str], pooled: str = "ALL HELD OUT", seed: str = "seed", digits: int = 6) -> DataFrame:
    """RP5: each arm against the control of the same seeds, by type and measure.

    Mean and SD (zero for one seed) of control, arm and difference, seeds where the arm is lower, and the values by seed.
    An arm whose seeds are not those of the control is an error.
    """
    item = ["primary_attack", "measure"]
    base = measures.where(F.col(arm) == control).select(seed, *item, F.col("value").alias("control"))
    rows = measures.where(F.col(arm) != control)
    seeds = lambda t: F.array_sort(F.collect_set(t))
    wanted = measures.where(F.col(arm) == control).agg(seeds(seed).alias("_w"))
    checked = rows.groupBy(arm).agg(seeds(seed).alias("_s")).crossJoin(F.broadcast(wanted))  # one row
    checked = checked.select(arm, F.when(F.col("_s") != F.col("_w"), F.raise_error(F.concat(F.lit("the seeds are not those of the control: "), F.col(arm))).cast("int")).otherwise(1).alias("_ok"))
    pairs = rows.join(base, [seed, *item], "left").join(checked, arm).where("_ok = 1").withColumn("delta", F.col("value") - F.col("control"))
    sides = {"control": "control", "arm": "value", "delta": "delta"}
    sd = lambda c: F.when(F.count(c) == 1, F.lit(0.0)).otherwise(F.stddev_samp(c))
    text = lambda c: F.when(c.isNull(), "n/a").otherwise(F.format_string(f"%.{digits}f", c))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(seed, text(F.col(c)).alias("t")))), lambda s: s["t"]), ";")  # noqa: E731  a value for each seed
    values = [a for n, c in sides.items() for a in (F.avg(c).alias(f"{n}_mean"), sd(c).alias(f"{n}_sd"), listed(c).alias(f"{n}_by_seed"))]
    out = pairs.groupBy(arm, *item).agg(F.max("n").alias("n"), F.max("hosts").alias("hosts"), *values, F.sum((F.col("delta") < 0).cast("bigint")).alias("seeds_lower"))
    return out.withColumn("held_out", F.col("primary_attack").isin(*withheld, pooled))


def unseen_subtype(control: DataFrame, holdout: DataFrame, control_at: float, holdout_at: float, withheld: list[str]) -> DataFrame:
    """RP6: recall of each type with and without it in training, with Wilson bounds; withheld types first."""
    pairs = paired_predictions(control, holdout, control_at, holdout_at, ["primary_attack"])
    n = F.count("*")
    hits = lambda c: F.sum(F.col(c).cast("bigint"))
    out = pairs.groupBy("primary_attack").agg(n.alias("n"), hits("before").alias("control_tp"), hits("after").alias("holdout_tp"))
    bounds = {f"{p}_{e}": metrics.wilson(F.col(f"{p}_tp"), F.col("n"))[e] for p in ("control", "holdout") for e in ("low", "high")}
    out = out.withColumns({"control_recall": F.col("control_tp") / F.col("n"), "holdout_recall": F.col("holdout_tp") / F.col("n"), **bounds})
    return out.withColumn("withheld", F.col("primary_attack").isin(*withheld)).orderBy(F.desc("withheld"), F.desc("n"), "primary_attack")


def seed_votes(rows: DataFrame, thresholds: DataFrame, model: str, seed: str, models: list[str]) -> DataFrame:
    """RP8: for each positive, how many seeds of each model detect it."""
    joined = rows.where("y = 1").join(F.broadcast(thresholds), [model, seed])
    hit = (F.col("score") >= F.col("threshold")).cast("bigint")
    return joined.groupBy("sample_id").pivot(model, models).agg(F.sum(hit))


def stable_groups(votes: DataFrame, a: str, b: str, most: int = 4, least: int = 1) -> DataFrame:
    """RP8: detected by most seeds of one model and by few of the other."""
    group = F.when((F.col(a) >= most) & (F.col(b) <= least), f"{a}_only").when((F.col(b) >= most) & (F.col(a) <= least), f"{b}_only").when((F.col(a) >= most) & (F.col(b) >= most), "both").when((F.col(a) <= least) & (F.col(b) <= least), "neither").otherwise("unstable")
    return votes.withColumn("group", group)


def intervention_summary(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """RP10: original against changed scores: change of the logit, its direction, gained and lost.

    ``pairs``: score, changed, threshold.
    """
    clip = lambda c: F.greatest(F.least(F.col(c), F.lit(1 - 1e-7)), F.lit(1e-7))
    logit = lambda c: F.log(clip(c) / (1 - clip(c)))
    rows = pairs.withColumn("_d", logit("changed") - logit("score"))
    was, now = F.col("score") >= F.col("threshold"), F.col("changed") >= F.col("threshold")
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), F.avg("_d").alias("mean_delta"), F.median("_d").alias("median_delta"), F.avg((F.col("_d") > 0).cast("double")).alias("share_up"), F.sum((~was & now).cast("bigint")).alias("gained"), F.sum((was & ~now).cast("bigint")).alias("lost"))


def supervision_coverage(rows: DataFrame, supported: DataFrame) -> DataFrame:
    """RP14: by attack — n, hosts, and the share that supported hosts cover."""
    known = supported.select(F.col("source_host")).distinct().withColumn("_k", F.lit(1))
    joined = rows.where("y = 1").join(known, "source_host", "left")
    return joined.groupBy("primary_attack").agg(F.count("*").alias("n"), F.countDistinct("source_host").alias("hosts"), F.avg(F.coalesce("_k", F.lit(0))).alias("covered"))


def supported_hosts(rows: DataFrame, least: int = 20) -> DataFrame:
    """RP14: hosts with at least ``least`` rows."""
    return rows.groupBy("source_host").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def attack_profile(rows: DataFrame, train_hosts: DataFrame) -> DataFrame:
    """RP15: by type — n, recall, host-macro recall, medians, pure and sparse counts, recall on seen hosts.

    ``rows``: positives with hit, flows, attack_flows, active_buckets, window_start_ms.
    """
    seen = train_hosts.select("source_host").distinct().withColumn("_s", F.lit(1))
    joined = rows.join(seen, "source_host", "left").withColumn("fraction", F.col("attack_flows") / F.col("flows"))
    hit = F.col("hit").cast("double")
    macro = joined.groupBy("primary_attack", "source_host").agg(F.avg(hit).alias("_r")).groupBy("primary_attack").agg(F.avg("_r").alias("host_macro_recall"))
    sides = {"all": F.lit(True), "tp": F.col("hit"), "fn": ~F.col("hit")}
    medians = [F.median(F.when(t, F.col(c))).alias(f"{c}_median_{s}") for c in ("flows", "attack_flows", "active_buckets", "fraction") for s, t in sides.items()]
    out = joined.groupBy("primary_attack").agg(
        F.count("*").alias("n"),
        F.avg(hit).alias("recall"),
        *medians,
        F.sum((F.col("fraction") == 1).cast("bigint")).alias("pure"),
        F.sum((F.col("fraction") <= 0.01).cast("bigint")).alias("at_most_1pct"),
        F.avg(F.when(F.col("_s") == 1, hit)).alias("recall_seen_hosts"),
        F.avg(F.when(F.col("_s").isNull(), hit)).alias("recall_unseen_hosts"),
        F.countDistinct("window_start_ms").alias("windows"),
    )
    return out.join(macro, "primary_attack")


def training_profile(samples: DataFrame, attacks: DataFrame, types: str = "target_attack") -> DataFrame:
    """RP15: by type, real and synthetic malicious training samples and the type's share of the positive objective.

    Real and synthetic samples weigh the same in sum, so the share is the mean of the type's shares in both groups.
    ``samples``: sample_type and the type; ``attacks``: the types wanted.
    """
    kinds = ("real_malicious", "synthetic_malicious")
    count = lambda k: F.sum(F.when(F.col("sample_type") == k, 1).otherwise(0)).cast("bigint")
    bad = samples.where(F.col("sample_type").isin(*kinds))
    per = bad.groupBy(F.col(types).alias("primary_attack")).agg(count(kinds[0]).alias("real_train_n"), count(kinds[1]).alias("synthetic_train_n"))
    whole = bad.agg(count(kinds[0]).alias("_r"), count(kinds[1]).alias("_s"))
    both = attacks.select("primary_attack").distinct().join(per, "primary_attack", "left").fillna(0).crossJoin(F.broadcast(whole))  # one row
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    return both.select("primary_attack", "real_train_n", "synthetic_train_n", ((share("real_train_n", "_r") + share("synthetic_train_n", "_s")) / 2).alias("positive_objective_share"))


def mixed_types(rows: DataFrame, memberships: DataFrame, key: str = "sample_id") -> DataFrame:
    """RP15: by primary type, sequences that hold another attack type too. ``memberships``: a row for each sequence and type."""
    several = memberships.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1").select(key, F.lit(1).alias("_m"))
    joined = rows.select(key, "primary_attack").join(several, key, "left")
    return joined.groupBy("primary_attack").agg(F.count("_m").alias("within_type_mixed_attack_n"))


def recall_slices(rows: DataFrame, keys: list[str]) -> DataFrame:
    """RP16: recall by host, attack-fraction bin, active-bucket bin and flow-count bin."""
    fraction = F.col("attack_flows") / F.col("flows")
    parts = F.create_map(F.lit("host"), F.col("source_host"), F.lit("fraction"), fraction_bin(fraction), F.lit("active"), active_bin(F.col("active_buckets")), F.lit("flows"), flow_bin(F.col("flows")))
    long = rows.select(*keys, "hit", F.explode(parts).alias("variable", "bin"))
    return long.groupBy(*keys, "variable", "bin").agg(F.count("*").alias("n"), F.sum(F.col("hit").cast("bigint")).alias("tp"), F.avg(F.col("hit").cast("double")).alias("recall"))


def outcome_summary(rows: DataFrame, keys: list[str], means: list[str], medians: list[str]) -> DataFrame:
    """RP17: size, means and medians of neighbour or collision results by outcome."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *(F.avg(c).alias(f"{c}_mean") for c in means), *(F.median(c).alias(f"{c}_median") for c in medians))


def neighbour_summary(profiles: DataFrame, outcomes: DataFrame, stage: str = "stage", key: str = "query_id") -> DataFrame:
    """RP17: by stage and outcome, queries and the mean benign share among their neighbours. ``profiles``: J12 by stage."""
    joined = profiles.join(outcomes.select(F.col("sample_id").alias(key), "outcome"), key)
    return joined.groupBy(stage, "outcome").agg(F.count("*").alias("n"), F.avg("benign_share").alias("mean_benign_share"))


def collision_summary(collisions: DataFrame, outcomes: DataFrame, searched: DataFrame, stage: str = "stage") -> DataFrame:
    """RP17: by stage and outcome, targets, those with an identical benign row, and how many benign rows were searched.

    ``collisions``: J8 by stage (target_id); ``searched``: stage and the number of benign rows of its pool.
    """
    found = collisions.select(stage, F.col("target_id").alias("sample_id"), F.lit(1).alias("_hit"))
    every = outcomes.select("sample_id", "outcome").crossJoin(F.broadcast(searched.select(stage, "searched_benign_n")))  # a row for each stage
    joined = every.join(found, [stage, "sample_id"], "left")
    return joined.groupBy(stage, "outcome").agg(F.count("*").alias("n"), F.count("_hit").alias("with_exact_benign_counterpart"), F.max("searched_benign_n").alias("searched_benign_n"))


def ab_table(before: DataFrame, after: DataFrame, before_at: float, after_at: float) -> DataFrame:
    """RP18: by type on one cohort — tp and fn of both runs, change of recall, recovered and lost."""
    pairs = paired_predictions(before, after, before_at, after_at, ["primary_attack"])
    out = transitions(pairs, ["primary_attack"])
    return out.select("primary_attack", "n", (F.col("lost") + F.col("still_detected")).alias("tp_before"), (F.col("recovered") + F.col("still_detected")).alias("tp_after"), ((F.col("recovered") - F.col("lost")) / F.col("n") * 100).alias("delta_pp"), "recovered", "lost")


def changed_profile(pairs: DataFrame, keys: list[str], medians: list[str], host: str = "source_host") -> DataFrame:
    """RP19: retained, lost, recovered and persistent positives — counts, hosts, medians."""
    from flowlens.functions.scalars import paired_outcome

    rows = pairs.withColumn("outcome", paired_outcome(F.col("before"), F.col("after")))
    return rows.groupBy(*keys, "outcome").agg(F.count("*").alias("n"), F.countDistinct(host).alias("hosts"), *(F.median(c).alias(f"{c}_median") for c in medians))


def cohort_profiles(sequences: DataFrame, active: DataFrame, groups: list[str]) -> DataFrame:
    """RP9: for each group of sequences its size and the medians of the mask features and the flow counts.

    ``active``: buckets in long form (keys, bucket).
    """
    from flowlens.functions.arrays import mask_features
    from flowlens.operators.features import group_medians

    shapes = mask_features(active).select("source_ip", "window_start_ms", "adjacent_pairs", "longest_run", "largest_gap")
    rows = sequences.join(shapes, ["source_ip", "window_start_ms"])
    return group_medians(rows, groups, ["flows", "active_buckets", "adjacent_pairs", "longest_run", "largest_gap"])
