"""Category histograms and vocabularies (AG6-AG9)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import service_id
from flowlens.operators.features import BUCKET

UNKNOWN = 0


def code_column(field: str):
    """The code of a category field: protocol, l7 or service."""
    if field == "service":
        return service_id(F.col("l4_dst_port")).cast("bigint")
    return F.col({"protocol": "protocol", "l7": "l7_proto"}[field])


def category_histogram(events: DataFrame, field: str) -> DataFrame:
    """AG7: flows by bucket and code."""
    return events.groupBy(*BUCKET, code_column(field).alias("code")).agg(F.count("*").alias("n"))


def fit_vocabulary(histogram: DataFrame, train: DataFrame) -> DataFrame:
    """AG9: (code, slot): codes of training sequences in order, from slot 1; slot 0 is UNKNOWN."""
    codes = histogram.join(train.select("source_ip", "window_start_ms").distinct(), ["source_ip", "window_start_ms"], "left_semi").select("code").distinct()
    return codes.withColumn("slot", F.row_number().over(Window.orderBy("code")))  # one row for each code


def dense_histogram(histogram: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """AG8: shares by bucket and slot; codes outside the vocabulary share slot 0."""
    slots = histogram.join(F.broadcast(vocabulary), "code", "left")  # one row for each code
    summed = slots.groupBy(*BUCKET, F.coalesce("slot", F.lit(UNKNOWN)).alias("slot")).agg(F.sum("n").alias("n"))
    return summed.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*BUCKET)))


def histogram_arrays(dense: DataFrame, width: int) -> DataFrame:
    """AG8 as arrays: one share for each slot 0 .. width."""
    entries = dense.groupBy(*BUCKET).agg(F.map_from_entries(F.collect_list(F.struct("slot", "share"))).alias("_m"))
    return entries.select(*BUCKET, F.transform(F.sequence(F.lit(0), F.lit(width)), lambda i: F.coalesce(F.element_at("_m", i), F.lit(0.0))).alias("shares"))


def l7_ratios(events: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """AG6: share of each known L7 code, and of all others together (code null)."""
    dense = dense_histogram(category_histogram(events, "l7"), vocabulary)
    return dense.join(F.broadcast(vocabulary), "slot", "left").select(*BUCKET, "code", "share")


def fit_vocabularies(events: DataFrame, train: DataFrame, fields: tuple[str, ...]) -> dict[str, list[int]]:
    """AG9 of several fields in one pass: their codes in training sequences, in order; a code's slot is its place from 1."""
    keys = ["source_ip", "window_start_ms"]
    codes = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), code_column(f).alias("code")) for f in fields))).alias("x")
    seen = events.join(train.select(*keys).distinct(), keys, "left_semi").select(codes).select("x.*").where("code IS NOT NULL").distinct()
    found = {f: [] for f in fields}
    for row in seen.orderBy("field", "code").collect():  # one row for each code
        found[row["field"]].append(row["code"])
    return found


def share_arrays(events: DataFrame, vocabularies: dict[str, list[int]]) -> DataFrame:
    """AG8 of several fields as arrays <field>_shares, in one aggregate: shares of slot 0 (all other codes) and of each code."""
    count = lambda f, c: F.sum((code_column(f).eqNullSafe(F.lit(c))).cast("bigint"))
    sums = [count(f, c).alias(f"_{f}_{i}") for f, codes in vocabularies.items() for i, c in enumerate(codes)]
    found = events.groupBy(*BUCKET).agg(F.count("*").alias("_n"), *sums)
    arrays = []
    for f, codes in vocabularies.items():
        known = [F.col(f"_{f}_{i}") for i in range(len(codes))]
        rest = F.col("_n") - sum(known, F.lit(0).cast("bigint"))
        arrays.append(F.array(*(n / F.col("_n") for n in (rest, *known))).alias(f"{f}_shares"))
    return found.select(*BUCKET, *arrays)
