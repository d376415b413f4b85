"""Writers (SNK1-SNK9). All refuse to overwrite; a finished write leaves Spark's success marker."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.operators.ordering import numbered
from flowlens.storage import exists, materialise, remove, rename

DAY_MS = 86_400_000
#: Lines of a file of vectors.
LINES = 10_000
#: Files that a task writes side by side.
WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


def write_raw_buckets(buckets: DataFrame, path: str) -> None:
    """SNK1: bucket rows before any split, by day of the window."""
    day = F.to_date(F.timestamp_millis(F.col("window_start_ms")))
    buckets.withColumn("window_day", day).repartition("window_day", F.pmod(F.xxhash64("source_ip"), F.lit(16))).write.mode("errorifexists").partitionBy("window_day").parquet(path)


def write_splits(rows: DataFrame, path: str) -> DataFrame:
    """SNK2: one directory for each split; rows by split as written."""
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)
    return rows.sparkSession.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"))


def write_samples(samples: DataFrame, path: str, buckets: int, width: int) -> None:
    """SNK3: model samples that keep their contract; any violation stops the write."""
    from flowlens.operators.quality import sample_faults

    faults = sample_faults(samples, buckets, width).first().asDict()
    if any(faults[k] for k in faults if k != "missing_classes"):
        raise ValueError(f"samples break their contract: {faults}")
    # rows go to the files of their splits, which are few, as they come: sorted by split, they would be spilled with all their numbers
    spark = samples.sparkSession
    before = spark.conf.get(WRITERS)
    spark.conf.set(WRITERS, "8")
    try:
        samples.write.mode("errorifexists").option("compression", "zstd").option("parquet.block.size", 32 << 20).partitionBy("split").parquet(path)
    finally:
        spark.conf.set(WRITERS, before)


def write_metadata(frames: dict[str, DataFrame], path: str) -> None:
    """SNK4: schema, scaler, manifest and notes as JSON lines, replaced as one set.

    The set is written aside, ``complete`` last, and then renamed to ``path``; a set that was there before is renamed away
    first and removed at the end. So a reader never finds a part of a set, and a write that fails leaves the old one.
    """
    if not frames:
        return
    spark, mark = next(iter(frames.values())).sparkSession, uuid.uuid4().hex
    aside, old = f"{path}.new-{mark}", f"{path}.old-{mark}"
    try:
        for name, frame in frames.items():
            frame.coalesce(1).write.mode("errorifexists").json(f"{aside}/{name}")
        spark.createDataFrame([(sorted(frames),)], "tables array<string>").coalesce(1).write.mode("errorifexists").json(f"{aside}/complete")
    except Exception:
        remove(spark, aside)
        raise
    had = exists(spark, path)
    if had:
        rename(spark, path, old)
    try:
        rename(spark, aside, path)
    except OSError:
        if had:
            rename(spark, old, path)
        raise
    if had:
        remove(spark, old)


def flow_metadata(samples: DataFrame, sequences: DataFrame, split: str) -> DataFrame:
    """SNK5: (sample_id, total_flows, attack_flows, y) of an evaluation split; ids must agree both ways."""
    if split not in ("validation", "test"):
        raise ValueError("flow metadata is for validation and test")
    a = samples.where(F.col("split") == split).select("sample_id", "y")
    b = sequences.where(F.col("split") == split).select(F.col("sequence_id").alias("sample_id"), F.col("flows").alias("total_flows"), "attack_flows")
    joined = a.join(b, "sample_id", "full_outer")
    check = F.when(F.col("y").isNull() | F.col("total_flows").isNull(), F.raise_error(F.lit("samples and sequences differ")).cast("bigint")).otherwise(F.col("total_flows"))
    return joined.select("sample_id", check.alias("total_flows"), "attack_flows", "y")


def write_csv(rows: DataFrame, path: str) -> None:
    """SNK6: a report, which is small, as one CSV file with a header."""
    rows.coalesce(1).write.mode("errorifexists").option("header", True).csv(path)


def vector_lines(rows: DataFrame, vector: str, key: str = "sample_id", digits: int = 6) -> DataFrame:
    """SNK7: vectors as tab-separated text in the order of their ids."""
    return rows.orderBy(key).select(_vector_text(vector, digits).alias("value"))


def _vector_text(vector: str, digits: int) -> Column:
    return F.array_join(F.transform(vector, lambda v: F.format_string(f"%.{digits}f", v.cast("double"))), "\t")


def write_vectors_tsv(rows: DataFrame, vector: str, meta: list[str], path: str, key: str = "sample_id", digits: int = 6) -> DataFrame:
    """SNK7: vectors and metadata in the same row order; returns rows, ``vectors_differ`` and ``metadata_differ``.

    Both texts of a row are made at once and numbered in one order by id (ties by the texts), which is written. The two
    outputs are two columns of that table, in the same files of LINES lines, so that line n of one belongs to line n of
    the other. Both are read back and compared with it, file by file and line by line; what differs is counted by files. A
    vector with a value that is not finite stops the write.
    """
    spark = rows.sparkSession
    number = lambda v: v.cast("double")
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(number(v)) & (F.abs(number(v)) != float("inf")))
    text = F.when(F.coalesce(finite, F.lit(False)), _vector_text(vector, digits)).otherwise(F.raise_error(F.lit("a vector holds a value that is not finite")).cast("string"))
    about = F.concat_ws("\t", *(F.regexp_replace(F.coalesce(F.col(m).cast("string"), F.lit("")), "[\t\n\r]", " ") for m in meta))
    lines = materialise(numbered(rows.select(F.col(key).alias("id"), text.alias("vectors"), about.alias("metadata")), [], ["id", "vectors", "metadata"], "line"), "lines")
    lines = lines.select(F.floor((F.col("line") - 1) / LINES).cast("int").alias("part"), "line", "vectors", "metadata")
    dealt = lines.repartition("part").sortWithinPartitions("part", "line")
    want = lines.groupBy("part").agg(F.array_sort(F.collect_list(F.struct("line", "vectors", "metadata"))).alias("all"))  # at most LINES
    found = want
    for name in ("vectors", "metadata"):
        dealt.select("part", F.col(name).alias("value")).write.mode("errorifexists").partitionBy("part").text(f"{path}/{name}")
        found = found.join(read_lines(spark, f"{path}/{name}").withColumnRenamed("lines", f"got_{name}"), "part", "left")
    differ = lambda name: F.sum((~F.coalesce(F.transform("all", lambda x: x[name]) == F.col(f"got_{name}"), F.lit(False))).cast("bigint")).alias(f"{name}_differ")
    return found.agg(F.coalesce(F.sum(F.size("all")), F.lit(0)).cast("bigint").alias("rows"), differ("vectors"), differ("metadata"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """SNK7: (part, lines) of an output of ``write_vectors_tsv``, a file as one row of at most LINES lines."""
    whole = spark.read.schema("value string, part int").text(path, wholetext=True)
    return whole.select("part", F.split(F.regexp_replace("value", "\n$", ""), "\n").alias("lines"))


def attack_subsets(rows: DataFrame) -> DataFrame:
    """SNK9: for each attack type, its rows and all benign ones, in column ``subset``.

    Benign rows are replicated once for each type; types are few.
    """
    types = rows.where("y = 1").select(F.col("primary_attack").alias("subset")).distinct()
    benign = rows.where("y = 0").crossJoin(F.broadcast(types))
    return rows.where("y = 1").withColumn("subset", F.col("primary_attack")).unionByName(benign)


def write_attack_subsets(rows: DataFrame, path: str) -> None:
    """SNK9: one folder for each type."""
    attack_subsets(rows).write.mode("errorifexists").partitionBy("subset").parquet(path)
