"""Sources and sinks as queries: tables are written to the shared folder, read back and counted."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import diagnostics as dg
from flowlens.operators import features as ft
from flowlens.operators import metrics as mt
from flowlens.operators import reports as rp
from flowlens.plans import query
from flowlens.plans.base import GRID, embeddings, events, folded, predictions, rounded, sequences, with_ctes
from flowlens.plans.eval_queries import _ATT, RUN, usable
from flowlens.plans.flow_queries import r
from flowlens.plans.split_queries import _samples
from flowlens.sources import flows as src
from flowlens.sources import sinks
from flowlens.storage import scratch_path

COLUMNS = [*src.INTEGERS, *src.TEXTS]


@query("src1_csv_round_trip", with_ctes("SELECT raw_rowid, " + ", ".join(COLUMNS) + " FROM flows", "flows"))
def src1(spark, sf):
    path = scratch_path(spark, "csv")
    flows = src.event_flows(spark, sf)
    flows.select("raw_rowid", *(F.col(c).alias(c.upper()) for c in COLUMNS)).write.option("header", True).csv(path)
    return src.read_flows_csv(spark, path).select("raw_rowid", *COLUMNS)


@query("snk1_raw_buckets", with_ctes("SELECT strftime(make_timestamp(window_start_ms * 1000), '%Y-%m-%d') AS day, count(*) AS buckets, CAST(sum(n) AS BIGINT) AS flows FROM (SELECT source_ip, window_start_ms, bucket, count(*) AS n FROM g GROUP BY 1, 2, 3) GROUP BY 1", "g"))
def snk1(spark, sf):
    path = scratch_path(spark, "buckets")
    sinks.write_raw_buckets(events(spark, sf).groupBy(*ft.BUCKET).agg(F.count("*").alias("n")), path)
    return spark.read.parquet(path).groupBy(F.date_format("window_day", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("buckets"), F.sum("n").alias("flows"))


@query("snk2_splits", with_ctes("SELECT CASE fold WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(*) AS rows FROM fold GROUP BY 1", "fold"))
def snk2(spark, sf):
    name = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.col("fold") + 1)
    return sinks.write_splits(folded(spark, sf).withColumn("split", name), scratch_path(spark, "splits"))


@query("snk3_src6_samples", with_ctes("SELECT CASE WHEN attack_flows > 0 THEN 'real_malicious' ELSE 'real_benign' END AS sample_type, count(*) AS samples FROM fold WHERE fold = 1 GROUP BY 1", "fold"))
def snk3(spark, sf):
    """Samples that keep their contract are written, and read with the contract checked."""
    path = scratch_path(spark, "samples")
    clean = F.transform(F.arrays_zip("x", "mask"), lambda b: F.transform(b["x"], lambda e: e * b["mask"]))
    sinks.write_samples(_samples(spark, sf).withColumn("x", clean), path, 4, 65)
    return src.read_samples(spark, path, "validation", 4, 65).groupBy("sample_type").agg(F.count("*").alias("samples"))


@query("snk4_metadata", with_ctes("SELECT fold, count(*) AS n FROM fold GROUP BY 1", "fold"))
def snk4(spark, sf):
    """A set that has replaced another."""
    path = scratch_path(spark, "metadata")
    sinks.write_metadata({"folds": folded(spark, sf).select("fold").distinct()}, path)
    sinks.write_metadata({"folds": folded(spark, sf).groupBy("fold").agg(F.count("*").alias("n"))}, path)
    return spark.read.schema("fold int, n bigint").json(f"{path}/folds")


@query("snk7_vectors", "SELECT row_number() OVER (ORDER BY vec_id) AS line, vec_id AS sample_id, label, " + r("list_sum(list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 6)))", "total", 4) + ", CAST(0 AS BIGINT) AS vectors_differ, CAST(0 AS BIGINT) AS metadata_differ FROM embeddings")
def snk7(spark, sf):
    """Lines of both outputs, put together by their number as read back, and what the writer's own check found."""
    path = scratch_path(spark, "vectors")
    checked = sinks.write_vectors_tsv(embeddings(spark, sf).withColumnRenamed("vec_id", "sample_id"), "embedding", ["sample_id", "label"], path)
    both = sinks.read_lines(spark, f"{path}/vectors").withColumnRenamed("lines", "v").join(sinks.read_lines(spark, f"{path}/metadata").withColumnRenamed("lines", "m"), "part")
    rows = both.select("part", F.posexplode(F.arrays_zip("v", "m")).alias("at", "x"))
    total = F.aggregate(F.transform(F.split("x.v", "\t"), lambda t: t.cast("double")), F.lit(0.0), lambda s, v: s + v)
    about = F.split("x.m", "\t")
    rows = rows.select((F.col("part").cast("bigint") * sinks.LINES + F.col("at") + 1).alias("line"), F.get(about, 0).cast("bigint").alias("sample_id"), F.get(about, 1).cast("int").alias("label"), total.alias("total"))
    return rounded(rows.crossJoin(F.broadcast(checked.drop("rows"))), 4)  # one row


@query("snk6_csv_report", with_ctes("SELECT primary_attack, count(*) AS n FROM seq GROUP BY 1", "seq"))
def snk6(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_csv(sequences(spark, sf).groupBy("primary_attack").agg(F.count("*").alias("n")), path)
    return spark.read.option("header", True).schema("primary_attack string, n bigint").csv(path)


@query("src8_read_predictions", with_ctes("SELECT model, seed, count(*) AS n FROM pred GROUP BY 1, 2", "pred"))
def src8(spark, sf):
    """Scores are written with their counts at each threshold and replayed on reading."""
    path = scratch_path(spark, "scores")
    predictions(spark, sf).write.parquet(path)
    saved = mt.at_thresholds(predictions(spark, sf), usable(spark, sf), RUN)
    return src.read_predictions(spark, [path], saved, RUN).groupBy(*RUN).agg(F.count("*").alias("n"))


@query(
    "rp9_cohort_profiles",
    with_ctes(
        "+ b AS (SELECT DISTINCT source_ip, window_start_ms, bucket FROM g), q AS (SELECT *, bucket - lag(bucket) OVER w - 1 AS gap, bucket - row_number() OVER w AS island FROM b WINDOW w AS (PARTITION BY source_ip, window_start_ms ORDER BY bucket)), "
        "ru AS (SELECT source_ip, window_start_ms, island, count(*) AS run, count(*) FILTER (gap = 0) AS pairs, max(gap) AS gap FROM q GROUP BY 1, 2, 3), sh AS (SELECT source_ip, window_start_ms, sum(pairs) AS adjacent_pairs, max(run) AS longest_run, max(gap) AS largest_gap FROM ru GROUP BY 1, 2) "
        "SELECT primary_attack, count(*) AS n, " + ", ".join(r(f"median({c})", f"{c}_median") for c in ("flows", "active_buckets", "adjacent_pairs", "longest_run", "largest_gap")) + " FROM seq JOIN sh USING (source_ip, window_start_ms) GROUP BY 1",
        "g", "seq",
    ),
)
def rp9(spark, sf):
    return rounded(rp.cohort_profiles(sequences(spark, sf), events(spark, sf), ["primary_attack"]))


@query("rp13_temporal_comparison", with_ctes(f"+{_ATT} SELECT seed, primary_attack, point, n, tp, " + r("recall", "recall") + f", 'seq{GRID.window_ms}_' || model AS geometry FROM a WHERE model <> 'fine' AND primary_attack IN ('Type0', 'Type2')", "pred", "thr"))
def rp13(spark, sf):
    per = mt.attack_recall(predictions(spark, sf), usable(spark, sf), RUN).select("model", "seed", "primary_attack", "point", "n", "tp", "recall")
    tables = {f"seq{GRID.window_ms}_{m}": per.where(F.col("model") == m).drop("model") for m in ("base", "alt")}
    return rounded(dg.temporal_comparison(tables, ["Type0", "Type2"]))
