"""The sequence index as a watermarked stream, for flows that arrive late.

The reference has no streams; this is its window aggregation on Structured Streaming. A window is
emitted once the watermark has passed its end, so the last open windows wait for later flows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.grid import TemporalGrid


def stream_sequence_index(flows: DataFrame, grid: TemporalGrid, lateness: str = "10 minutes") -> DataFrame:
    """AG1 without distinct counts: buckets are kept as a set of at most T numbers."""
    rows = flows.withColumn("event_time", F.timestamp_millis("flow_start_milliseconds")).withWatermark("event_time", lateness)
    local = F.pmod(F.col("flow_start_milliseconds"), F.lit(grid.window_ms))
    rows = rows.withColumn("bucket", F.floor(local / grid.bucket_ms).cast("int"))
    window = F.window("event_time", f"{grid.sequence_seconds} seconds")
    out = rows.groupBy(window.alias("w"), F.col("ipv4_src_addr").alias("source_ip")).agg(F.count("*").alias("flows"), F.sum("label").alias("attack_flows"), F.size(F.collect_set("bucket")).alias("active_buckets"), F.min("flow_start_milliseconds").alias("first_ms"), F.max("flow_start_milliseconds").alias("last_ms"), F.max("flow_end_milliseconds").alias("max_end_ms"))
    return out.withColumn("window_start_ms", F.unix_millis("w.start")).drop("w")
