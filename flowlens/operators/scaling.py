"""Train-only scaling and feature extension (W9, W10, AG10, AG12)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import logged

CONSTANT = 1e-12


def fit_scaler(stats: DataFrame, train: DataFrame | None, names: list[str]) -> DataFrame:
    """AG10: (feature, n, mean, scale, constant) of log1p values over active training buckets.

    ``train`` lists the training sequences; without it all rows of ``stats`` are training buckets.

    One partial and one final aggregate over (feature, value); mean and deviation merge by Spark's own moments. An
    aggregate with columns for each feature would be too long to be compiled.
    """
    rows = stats if train is None else stats.join(train.select("source_ip", "window_start_ms").distinct(), ["source_ip", "window_start_ms"], "left_semi")
    values = F.posexplode(F.array(*(logged(n).cast("double") for n in names))).alias("i", "x")
    found = rows.select(values).groupBy("i").agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    constant = F.col("std") < CONSTANT
    feature = F.get(F.array(*(F.lit(n) for n in names)), F.col("i")).alias("feature")
    return found.select(feature, "n", "mean", F.when(constant, 1.0).otherwise(F.col("std")).alias("scale"), constant.alias("constant"))


def standardize(stats: DataFrame, scaler: DataFrame, names: list[str]) -> DataFrame:
    """(log1p(x) - mean) / scale of each feature. The scaler is one row for each feature.

    The one row that is joined holds a feature's values at its place in ``names``: a map would be searched for each value.
    """
    row = scaler.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "scale")))).alias("_m"))
    row = row.select(*(F.array(*(F.element_at("_m", F.lit(n))[c] for n in names)).alias(f"_{c}") for c in ("mean", "scale")))
    joined = stats.crossJoin(F.broadcast(row))  # one row
    scaled = [((logged(n) - F.get("_mean", F.lit(i))) / F.get("_scale", F.lit(i))).alias(n) for i, n in enumerate(names)]
    return joined.select(*(c for c in stats.columns if c not in names), *scaled)


def extend_features(base: DataFrame, added: DataFrame, train: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """AG12: scaled base columns as they are, with ``names`` of ``added`` scaled on training buckets.

    Both must cover the same buckets: an unmatched one on either side is an error.
    """
    extra = standardize(added, fit_scaler(added, train, names), names)
    joined = base.withColumn("_b", F.lit(1)).join(extra.select(*keys, *names, F.lit(1).alias("_a")), keys, "full_outer")
    check = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.raise_error(F.lit("features and base differ in buckets")).cast("int")).otherwise(F.col("_a"))
    return joined.withColumn("_a", check).where("_a = 1").drop("_a", "_b")
