"""Flow tables: schema, readers (SRC1-SRC9), and the flow view over the driver's event table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The integer columns of a flow record, in order.
INTEGERS = (
    "flow_start_milliseconds flow_end_milliseconds l4_src_port l4_dst_port protocol l7_proto in_bytes out_bytes in_pkts out_pkts "
    "flow_duration_milliseconds tcp_flags client_tcp_flags server_tcp_flags icmp_ipv4_type dns_query_id dns_query_type dns_ttl_answer "
    "duration_in duration_out min_ip_pkt_len max_ip_pkt_len retransmitted_in_bytes retransmitted_in_pkts retransmitted_out_bytes "
    "retransmitted_out_pkts num_pkts_up_to_128_bytes num_pkts_128_to_256_bytes num_pkts_256_to_512_bytes num_pkts_512_to_1024_bytes "
    "num_pkts_1024_to_1514_bytes tcp_win_max_in tcp_win_max_out label"
).split()
TEXTS = ("ipv4_src_addr", "ipv4_dst_addr", "attack")
PACKET_BINS = tuple(n for n in INTEGERS if n.startswith("num_pkts_"))
RETRANSMISSION = tuple(n for n in INTEGERS if n.startswith("retransmitted_"))
FLOW_SCHEMA = T.StructType([T.StructField("raw_rowid", T.LongType())] + [T.StructField(n, T.LongType()) for n in INTEGERS] + [T.StructField(n, T.StringType()) for n in TEXTS])

#: Integer columns of the view as (Spark SQL expression, DuckDB expression); e event_id, u user_id, v value.
_PORTS = "CASE e % 8 WHEN 0 THEN 53 WHEN 1 THEN 80 WHEN 2 THEN 443 WHEN 3 THEN 22 WHEN 4 THEN 21 WHEN 5 THEN 25 WHEN 6 THEN 3389 ELSE 445 END"
_VIEW = {
    "flow_start_milliseconds": "ms",
    "flow_end_milliseconds": "ms + dur",
    "l4_src_port": "1024 + (e * 31) % 5000",
    "l4_dst_port": "port",
    "protocol": "CASE WHEN e % 5 <= 2 THEN 6 WHEN e % 5 = 3 THEN 17 ELSE 1 END",
    "l7_proto": "e % 11",
    "in_bytes": "floor(v * 10)",
    "out_bytes": "CASE WHEN e % 4 = 0 THEN 0 ELSE floor(v * 3) END",
    "in_pkts": "1 + e % 17",
    "out_pkts": "e % 4",
    "flow_duration_milliseconds": "dur",
    "tcp_flags": "e % 256",
    "client_tcp_flags": "(e * 3) % 256",
    "server_tcp_flags": "(e * 5) % 256",
    "icmp_ipv4_type": "CASE WHEN e % 5 = 4 THEN (e * 7) % 6 ELSE 0 END",
    "dns_query_id": "CASE WHEN port = 53 THEN e % 1000 ELSE 0 END",
    "dns_query_type": "CASE WHEN port = 53 THEN 1 + e % 3 ELSE 0 END",
    "dns_ttl_answer": "CASE WHEN port = 53 THEN e % 600 ELSE 0 END",
    "duration_in": "(dur - dur % 2) / 2",
    "duration_out": "(dur - dur % 3) / 3",
    "min_ip_pkt_len": "40 + e % 20",
    "max_ip_pkt_len": "100 + e % 1400",
    "retransmitted_in_bytes": "(e % 3) * 100",
    "retransmitted_in_pkts": "e % 3",
    "retransmitted_out_bytes": "(e % 5) * 40",
    "retransmitted_out_pkts": "e % 5",
    "num_pkts_up_to_128_bytes": "e % 3",
    "num_pkts_128_to_256_bytes": "e % 4",
    "num_pkts_256_to_512_bytes": "e % 5",
    "num_pkts_512_to_1024_bytes": "e % 6",
    "num_pkts_1024_to_1514_bytes": "e % 7",
    "tcp_win_max_in": "(e * 13) % 65536",
    "tcp_win_max_out": "(e * 17) % 65536",
    "label": "lab",
}
#: Further columns for the feature families that need fields beyond the staged ones.
EXTRA = {f"{d}_iat_{s}": f"(e * {7 + 2 * i + 5 * j}) % {400 + 100 * j}" for i, d in enumerate(("src_to_dst", "dst_to_src")) for j, s in enumerate(("min", "max", "avg", "stddev"))}
EXTRA |= {f"{d}_{s}": f"(e * {11 + 3 * i + 2 * j}) % {9000 + 500 * j}" for i, d in enumerate(("src_to_dst", "dst_to_src")) for j, s in enumerate(("second_bytes", "avg_throughput"))}
EXTRA |= {"min_ttl": "e % 64", "max_ttl": "64 + e % 64", "longest_flow_pkt": "100 + (e * 3) % 1400", "shortest_flow_pkt": "40 + e % 60"}


def view_sql(extra: bool = False) -> str:
    """DuckDB SQL of the flow view, as the body of a CTE."""
    columns = ", ".join(f"CAST({x} AS BIGINT) AS {n}" for n, x in (_VIEW | (EXTRA if extra else {})).items())
    return (
        f"SELECT e AS raw_rowid, {columns}, '10.0.0.' || u AS ipv4_src_addr, '192.0.2.' || ((e * 7 + u) % 13) AS ipv4_dst_addr, "
        "CASE WHEN lab = 1 THEN 'Type' || ((u // 5) % 4) ELSE 'Benign' END AS attack FROM ("
        f"SELECT event_id AS e, user_id AS u, value AS v, epoch_us(ts) // 1000 AS ms, CAST(floor(value * 1000) AS BIGINT) % 200000 AS dur, "
        f"{_PORTS.replace('e %', 'event_id %')} AS port, CASE WHEN event_type = 'error' AND user_id % 5 = 0 THEN 1 ELSE 0 END AS lab FROM events)"
    )


def event_flows(spark: SparkSession, sf_dir: str, extra: bool = False) -> DataFrame:
    """Flows over the driver's ``events`` table; every column is a function of one event."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("e"),
        F.col("user_id").alias("u"),
        F.col("value").alias("v"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"),
        (F.floor(F.col("value") * 1000).cast("bigint") % 200000).alias("dur"),
        ((F.col("event_type") == "error") & (F.col("user_id") % 5 == 0)).cast("bigint").alias("lab"),
    )
    rows = rows.withColumn("port", F.expr(_PORTS))
    kind = F.when(F.col("lab") == 1, F.concat(F.lit("Type"), F.expr("(u div 5) % 4"))).otherwise("Benign")
    return rows.select(
        F.col("e").alias("raw_rowid"),
        *(F.expr(x).cast("bigint").alias(n) for n, x in (_VIEW | (EXTRA if extra else {})).items()),
        F.concat(F.lit("10.0.0."), F.col("u")).alias("ipv4_src_addr"),
        F.concat(F.lit("192.0.2."), F.expr("(e * 7 + u) % 13")).alias("ipv4_dst_addr"),
        kind.alias("attack"),
    )


def read_flows_csv(spark: SparkSession, path: str) -> DataFrame:
    """SRC1: flows from CSV with a header in any case; only whole numbers in numeric columns.

    Columns are taken by name; a missing one is an error. Text that is no whole number fails the read.
    """
    raw = spark.read.option("header", True).csv(path)
    raw = raw.toDF(*(c.strip().lower() for c in raw.columns))
    missing = [n for n in (*INTEGERS, *TEXTS) if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    whole = lambda n: F.when(F.col(n).rlike(r"^\s*-?[0-9]+\s*$"), F.trim(n).cast("bigint")).otherwise(F.raise_error(F.concat(F.lit(f"{n} is no whole number: "), F.coalesce(n, F.lit("null")))).cast("bigint"))
    rowid = F.col("raw_rowid").cast("bigint") if "raw_rowid" in raw.columns else F.monotonically_increasing_id()
    return raw.select(rowid.alias("raw_rowid"), *(whole(n).alias(n) for n in INTEGERS), *TEXTS)


def read_flows_table(spark: SparkSession, path: str) -> DataFrame:
    """SRC2: flows from Parquet; columns by name in any case, numbers as long."""
    raw = spark.read.parquet(path)
    raw = raw.toDF(*(c.lower() for c in raw.columns))
    missing = [n for n in (*INTEGERS, *TEXTS) if n not in raw.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    rowid = F.col("raw_rowid").cast("bigint") if "raw_rowid" in raw.columns else F.monotonically_increasing_id()
    return raw.select(rowid.alias("raw_rowid"), *(F.col(n).cast("bigint").alias(n) for n in INTEGERS), *TEXTS)


def control_totals(flows: DataFrame) -> DataFrame:
    """SRC3: rows, attack rows and invalid rows in one pass."""
    bad = F.lit(False)
    for n in INTEGERS:
        bad = bad | F.col(n).isNull() | (F.col(n) < 0)
    bad = bad | ~F.col("label").isin(0, 1) | (F.col("flow_end_milliseconds") < F.col("flow_start_milliseconds"))
    bad = bad | F.col("ipv4_src_addr").isNull() | F.col("ipv4_dst_addr").isNull() | F.col("attack").isNull()
    return flows.agg(F.count("*").alias("n_rows"), F.coalesce(F.sum("label"), F.lit(0)).alias("attack_rows"), F.coalesce(F.sum(F.coalesce(bad, F.lit(True)).cast("bigint")), F.lit(0)).alias("invalid_rows"))


def validate_flows(flows: DataFrame) -> DataFrame:
    """SRC3: the flows, after a check; empty or invalid input is an error."""
    total = control_totals(flows).first()
    if not total["n_rows"] or total["invalid_rows"]:
        raise ValueError(f"{total['n_rows']} rows, {total['invalid_rows']} of them invalid")
    return flows


def read_samples(spark: SparkSession, path: str, split: str, buckets: int | None = None, width: int | None = None) -> DataFrame:
    """SRC6: model samples of one split; the partition column prunes the files.

    With ``buckets`` and ``width`` the contract of samples is checked in one pass, and a breach is an error.
    """
    rows = spark.read.parquet(path).where(F.col("split") == split)
    if buckets is not None and width is not None:
        from flowlens.operators.quality import sample_faults

        faults = sample_faults(rows, buckets, width).first().asDict()
        if any(faults.values()):
            raise ValueError(f"samples of {split} break their contract: {faults}")
    return rows


def iter_samples(spark: SparkSession, path: str, split: str):
    """SRC7: samples of one split as an iterator of rows, one partition at a time."""
    return read_samples(spark, path, split).toLocalIterator(prefetchPartitions=True)


def read_predictions(spark: SparkSession, paths: list[str], saved: DataFrame | None = None, keys: list[str] | None = None) -> DataFrame:
    """SRC8: score tables of several runs; scores are checked on reading them.

    ``saved`` (keys, point, threshold, tp, fp) are measures that were written with the scores: they are counted
    again, and any difference or missing run is an error.
    """
    from flowlens.operators.quality import prediction_faults

    rows = spark.read.parquet(*paths)
    faults = prediction_faults(rows).first()
    if any(faults[c] for c in ("not_finite", "out_of_range", "bad_label", "missing_class")):
        raise ValueError(f"invalid predictions: {faults.asDict()}")
    if saved is not None:
        from flowlens.operators.metrics import at_thresholds
        from flowlens.operators.quality import replay_differences

        found = at_thresholds(rows, saved.select(*(keys or []), "point", "threshold"), keys or [])
        off = replay_differences(found, saved, [*(keys or []), "point"], ["tp", "fp"]).first()
        if any(off):
            raise ValueError(f"scores do not give the saved counts: {off.asDict()}")
    return rows


def split_metadata(sequences: DataFrame, split: str) -> DataFrame:
    """SRC9: sequence metadata of one split."""
    return sequences.where(F.col("split") == split)
