"""Array columns: dense buckets, rotation, superposition, vectors, occupancy patterns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEQ_KEY = ("source_ip", "window_start_ms")


def densify(df: DataFrame, values: Sequence[str], buckets: int, keys: Sequence[str] = SEQ_KEY) -> DataFrame:
    """V1: long bucket rows to arrays of ``buckets`` entries, zero where there is no row, and ``mask``."""
    names = list(values)
    rows = df.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(F.col("bucket").cast("int"), F.struct(*names)))).alias("_m"))
    places = F.sequence(F.lit(0), F.lit(buckets - 1))
    kinds = dict(df.dtypes)

    def dense_of(n: str) -> Column:
        return F.transform(places, lambda i: F.coalesce(F.element_at("_m", i)[n], F.lit(0).cast(kinds[n]))).alias(n)

    dense = [dense_of(n) for n in names]
    return rows.select(*keys, *dense, F.transform(places, lambda i: F.element_at("_m", i).isNotNull().cast("int")).alias("mask"))


def rotate(a: Column, shift: Column | int) -> Column:
    """V2: out[t] = a[(t - shift) mod T]."""
    shift = F.lit(shift) if isinstance(shift, int) else shift
    return F.transform(a, lambda x, i: F.get(a, F.pmod(i - shift, F.size(a))))


def circular_start(a: Column, start: Column | int) -> Column:
    """V3: out[t] = a[(t + start) mod T]."""
    return rotate(a, -start if isinstance(start, int) else -start)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it, also in lambdas of its own."""
    return F.get(F.transform(F.array(value), body), 0)


def dot(a: Column, b: Column) -> Column:
    """V9: inner product."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, least: float = 1e-8) -> Column:
    """V4: a / max(norm, least)."""
    size = lambda v: F.greatest(norm(v), F.lit(least))
    return let(a, lambda v: let(size(v), lambda n: F.transform(v, lambda x: x.cast("double") / n)))


def cosine(a: Column, b: Column, least: float = 1e-12) -> Column:
    """V9."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(least)) * F.greatest(norm(b), F.lit(least)))


def euclidean(a: Column, b: Column) -> Column:
    """V9: distance."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x))


def superimpose(a: Column, b: Column) -> Column:
    """V5 for one bucket: sum of two vectors (zero where a side is empty), as a unit vector."""
    return l2_normalize(F.zip_with(a, b, lambda x, y: x.cast("double") + y.cast("double")))


def masked(a: Column, mask: Column) -> Column:
    """Vector of zeros where mask is 0."""
    return F.transform(a, lambda x: x * mask)


def drop_buckets(a: Column, keep: Column) -> Column:
    """Buckets (scalars) whose keep flag is 0 become zero."""
    return F.zip_with(a, keep, lambda x, k: F.when(k != 0, x).otherwise(F.lit(0).cast("double")))


def intensity(total: Column, mean: Column | float, scale: Column | float, mask: Column) -> Column:
    """V6: (log1p(total) - mean) / scale where the bucket is active, else 0."""
    return (F.log1p(total) - mean) / scale * mask


def flatten_sample(x: Column, mask: Column, start: Column | int = 0) -> Column:
    """V8: the vectors of all buckets one after the other, then the mask, from a given start."""
    return F.concat(F.flatten(circular_start(x, start)), F.transform(circular_start(mask, start), lambda m: m.cast("double")))


def decision_margin(v: Column, weights: Sequence[float], bias: float, threshold: float) -> Column:
    """W.h + b - logit(t)."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    logit = F.log(F.lit(threshold) / (1 - F.lit(threshold)))
    return dot(v, w) + bias - logit


def residual(v: Column, weights: Sequence[float]) -> Column:
    """Length of the part of v that is orthogonal to w."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    along = dot(v, w) / F.greatest(norm(w), F.lit(1e-12))
    return F.sqrt(F.greatest(dot(v, v) - along * along, F.lit(0.0)))


def mask_features(active: DataFrame, keys: Sequence[str] = SEQ_KEY) -> DataFrame:
    """V10 over active buckets in long form: active, adjacent pairs, longest run, largest inner gap.

    The largest gap counts empty buckets between successive active ones; null under two of them.
    """
    w = Window.partitionBy(*keys).orderBy("bucket")
    rows = active.select(*keys, "bucket").distinct()
    rows = rows.withColumn("_gap", F.col("bucket") - F.lag("bucket").over(w) - 1).withColumn("_island", F.col("bucket") - F.row_number().over(w))
    runs = rows.groupBy(*keys, "_island").agg(F.count("*").alias("_run"), F.sum((F.col("_gap") == 0).cast("int")).alias("_pairs"), F.max("_gap").alias("_gap"))
    return runs.groupBy(*keys).agg(F.sum("_run").alias("active"), F.coalesce(F.sum("_pairs"), F.lit(0)).alias("adjacent_pairs"), F.max("_run").alias("longest_run"), F.max("_gap").alias("largest_gap"))


def embedding_smoothness(rows: DataFrame, keys: Sequence[str], order: str, vector: str) -> DataFrame:
    """Mean cosine of successive vectors, its mean over all orders, and the excess; k >= 3.

    Vectors are scaled to unit length, so that the mean over orders is (|sum v|^2 - k) / (k (k - 1)).
    """
    w = Window.partitionBy(*keys).orderBy(order)
    unit = rows.withColumn("_v", l2_normalize(F.col(vector), 1e-12))
    unit = unit.withColumn("_c", dot(F.col("_v"), F.lag("_v").over(w)))
    steps = unit.groupBy(*keys).agg(F.count("*").alias("k"), F.avg("_c").alias("successive"), F.sum(dot(F.col("_v"), F.col("_v"))).alias("_own"))
    parts = unit.select(*keys, F.posexplode("_v").alias("_d", "_x")).groupBy(*keys, "_d").agg(F.sum("_x").alias("_x"))
    square = parts.groupBy(*keys).agg(F.sum(F.col("_x") * F.col("_x")).alias("_square"))
    joined = steps.where("k >= 3").join(square, list(keys))
    expected = (F.col("_square") - F.col("_own")) / (F.col("k") * (F.col("k") - 1))
    return joined.select(*keys, "k", "successive", expected.alias("permuted"), (F.col("successive") - expected).alias("excess"))
