"""Data contracts as violation counts (DQ1-DQ10, J5, J10)."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.scalars import seeded_key
from flowlens.storage import collect_garbage, materialise


def _count(test: Column) -> Column:
    """Rows for which the test holds or cannot be told."""
    return F.coalesce(F.sum(F.coalesce(test, F.lit(True)).cast("bigint")), F.lit(0))


def validate_export(samples: DataFrame, rebuilt: DataFrame, rtol: float = 2e-5, atol: float = 2e-6, again: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """DQ1: samples against what their donors give again: missing, repeated, differing ones by column.

    Vectors are compared by 128-bit digests first, and only where these differ, or a number is not finite, by their numbers: those
    of equal ones are not shuffled. ``again`` makes both tables once more, of a table's ``sample_id`` at least, where they are
    made on the way and need not be made whole.
    """
    flat = F.flatten("x")
    finite = F.forall(flat, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    digest = F.when(finite, F.struct(F.xxhash64(flat).alias("a"), F.xxhash64(F.lit(1), flat).alias("b")))
    marks = ("mask", "y_bucket", "flow_counts")
    a = samples.select("sample_id", *marks, digest.alias("digest"))
    b = rebuilt.select("sample_id", *(F.col(c).alias(f"_{c}") for c in marks), digest.alias("_digest"))
    rows = materialise(a.join(b, "sample_id", "full_outer"), "compared")
    open_ = rows.where(F.col("mask").isNotNull() & F.col("_mask").isNotNull() & ~F.coalesce(F.col("digest") == F.col("_digest"), F.lit(False))).select("sample_id").distinct()
    open_ = materialise(open_, "open")
    collect_garbage(samples.sparkSession)
    some, right = again(open_) if again else (samples, rebuilt)
    left = some.join(open_, "sample_id", "left_semi").select("sample_id", "x")
    right = right.join(open_, "sample_id", "left_semi").select("sample_id", F.col("x").alias("_x"))
    close = F.forall(F.zip_with(F.flatten("x"), F.flatten("_x"), lambda a, e: F.abs(a - e) <= atol + rtol * F.abs(e)), lambda t: t)
    far = left.join(right, "sample_id").agg(_count(~close).alias("far"))
    # a sample that one side lacks differs, too
    lone = _count(F.when(F.col("mask").isNull() | F.col("_mask").isNull(), True).otherwise(False))
    found = rows.agg(
        _count(F.col("mask").isNull()).alias("missing_samples"),
        _count(F.col("_mask").isNull()).alias("unplanned_samples"),
        (F.count("sample_id") - F.countDistinct("sample_id")).alias("repeated_samples"),
        lone.alias("lone"),
        *(_count(F.col(c) != F.col(f"_{c}")).alias(f"{c}_differ") for c in marks),
    )
    both = found.crossJoin(F.broadcast(far))  # one row each
    return both.select("missing_samples", "unplanned_samples", "repeated_samples", (F.col("lone") + F.col("far")).alias("vectors_differ"), *(f"{c}_differ" for c in marks))


def sample_faults(samples: DataFrame, buckets: int, width: int) -> DataFrame:
    """DQ2: the contract of model samples."""
    finite = F.forall(F.flatten("x"), lambda v: ~F.isnan(v) & (F.abs(v) < float("inf")))
    padded = F.forall(F.arrays_zip("x", "mask"), lambda b: (b["mask"] == 1) | F.forall(b["x"], lambda v: v == 0))
    bad = F.col("sample_type").isin("real_malicious", "synthetic_malicious")
    return samples.agg(
        _count((F.size("x") != buckets) | ~F.forall("x", lambda v: F.size(v) == width)).alias("bad_shape"),
        _count(~finite).alias("not_finite"),
        _count(~F.forall("mask", lambda m: m.isin(0, 1))).alias("bad_mask"),
        _count(~padded).alias("padding_not_zero"),
        _count(F.array_max("mask") == 0).alias("empty_samples"),
        _count(F.col("y") != F.array_max("y_bucket")).alias("label_mismatch"),
        _count((F.col("y") == 1) != bad).alias("type_mismatch"),
        _count(~F.forall(F.arrays_zip("flow_counts", "mask"), lambda b: (b["flow_counts"] > 0) == (b["mask"] == 1))).alias("flow_mask_mismatch"),
        (F.count("*") - F.countDistinct("sample_id")).alias("repeated_ids"),
        (F.lit(2) - F.countDistinct("y")).alias("missing_classes"),
    )


def bucket_target_faults(samples: DataFrame) -> DataFrame:
    """DQ3: bucket targets are binary, zero on padding, and their greatest is the label."""
    return samples.agg(
        _count(~F.forall("y_bucket", lambda y: y.isin(0, 1))).alias("not_binary"),
        _count(~F.forall(F.arrays_zip("y_bucket", "mask"), lambda b: (b["mask"] == 1) | (b["y_bucket"] == 0))).alias("target_on_padding"),
        _count(F.array_max("y_bucket") != F.col("y")).alias("label_mismatch"),
    )


def prediction_faults(rows: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """DQ4: scores are finite and in [0, 1], labels binary, both classes there. A score that is no finite number has no range."""
    s = F.col("score")
    finite = s.isNotNull() & ~F.isnan(s) & (F.abs(s) != float("inf"))
    return rows.groupBy(*(keys or [])).agg(
        _count(~finite).alias("not_finite"),
        _count(finite & ((s < 0) | (s > 1))).alias("out_of_range"),
        _count(~F.col("y").isin(0, 1)).alias("bad_label"),
        (F.lit(2) - F.countDistinct(F.when(F.col("y").isin(0, 1), F.col("y")))).alias("missing_class"),
    )


def population_differences(rows: DataFrame, run: str, baseline, columns: list[str]) -> DataFrame:
    """DQ5: by run, rows that the baseline run lacks or has otherwise, either way round."""
    base = rows.where(F.col(run) == baseline).select(*columns)
    others = rows.where(F.col(run) != baseline).select(run).distinct()
    wanted = base.crossJoin(F.broadcast(others)).select(run, *columns, F.lit(1).alias("_b"), F.lit(0).alias("_o"))  # a row for each run
    have = rows.where(F.col(run) != baseline).select(run, *columns, F.lit(0).alias("_b"), F.lit(1).alias("_o"))
    per = wanted.union(have).groupBy(run, *columns).agg(F.sum("_b").alias("_b"), F.sum("_o").alias("_o"))
    return per.groupBy(run).agg(F.sum(F.abs(F.col("_b") - F.col("_o"))).alias("differences"))


def fingerprint(rows: DataFrame, columns: list[str]) -> DataFrame:
    """DQ6: order-free digest of each column and the row count: sums of seeded keys of the values as text.

    A sum beyond 64 bits wraps round, as two's complement does, so that tables of any size have a digest.
    """
    return rows.agg(F.count("*").alias("n_rows"), *(_wrapped_sum(seeded_key(0, F.coalesce(F.col(c).cast("string"), F.lit("")))).alias(c) for c in columns))


def _wrapped_sum(key: Column) -> Column:
    """Sum of keys of 48 bits modulo 2**64, as a signed number; neither half of the keys can overflow by itself."""
    high, low = F.sum(F.shiftright(key, 24)), F.sum(key.bitwiseAND(F.lit((1 << 24) - 1)))
    number = lambda v: F.lit(Decimal(v))
    total = (high.cast("decimal(20,0)") * number(1 << 24) + low.cast("decimal(20,0)")) % number(1 << 64)
    return F.coalesce(F.when(total >= number(1 << 63), total - number(1 << 64)).otherwise(total).cast("bigint"), F.lit(0).cast("bigint"))


def replay_differences(found: DataFrame, saved: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-12) -> DataFrame:
    """DQ7: recomputed measures against saved ones: missing rows and values that differ."""
    joined = found.select(*keys, *values).join(saved.select(*keys, *(F.col(v).alias(f"_{v}") for v in values)), keys, "full_outer")
    return joined.agg(*(_count(F.abs(F.col(v) - F.col(f"_{v}")) > tolerance).alias(f"{v}_differ") for v in values))


def shared_ids(splits: DataFrame, key: str = "sample_id", split: str = "split") -> DataFrame:
    """DQ8: ids that are in more than one split, by pair of splits."""
    ids = splits.select(key, split).distinct()
    other = ids.select(key, F.col(split).alias("other"))
    return ids.join(other, key).where(F.col(split) < F.col("other")).groupBy(split, "other").agg(F.count("*").alias("shared"))


def partition_faults(kept: DataFrame, block_ms: int, window_ms: int) -> DataFrame:
    """DQ9: blocks in two folds and envelopes that overlap another fold."""
    from flowlens.operators.split import EXCLUDED, block_of, envelope_overlap

    blocks = kept.where(F.col("fold") < EXCLUDED).groupBy(block_of("window_start_ms", block_ms)).agg(F.countDistinct("fold").alias("k"))
    a = blocks.agg(_count(F.col("k") > 1).alias("shared_blocks"))
    b = envelope_overlap(kept, window_ms, block_ms).agg(F.count("*").alias("overlapping"))
    return a.crossJoin(b)  # one row each


def membership_faults(rows: DataFrame, allowed: DataFrame, key: str) -> DataFrame:
    """Ids that the allowed table lacks."""
    return rows.select(key).distinct().join(allowed.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("unknown_ids"))


def label_provenance(staged: DataFrame, source: DataFrame, key: str = "raw_rowid", label: str = "label") -> DataFrame:
    """Staged labels against the source's, by row id."""
    joined = staged.select(key, F.col(label).alias("_s")).join(source.select(key, F.col(label).alias("_t")), key, "full_outer")
    return joined.agg(F.count("*").alias("compared"), _count(F.col("_s").isNull()).alias("not_staged"), _count(F.col("_t").isNull()).alias("not_in_source"), F.sum((F.col("_s") != F.col("_t")).cast("bigint")).alias("labels_differ"))
