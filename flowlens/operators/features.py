"""Bucket statistics (AG4-AG6, AG11-AG17). Keys are source_ip, window_start_ms, bucket."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import FLAG_BITS, byte_share, bytes_per_packet, is_dns
from flowlens.operators.quantiles import with_quantiles
from flowlens.operators.sequences import KEYS
from flowlens.sources.flows import PACKET_BINS, RETRANSMISSION

BUCKET = [*KEYS, "bucket"]
_SHARE = "avg(CASE WHEN {} THEN 1.0D ELSE 0.0D END)"
_BINS = " + ".join(f"sum({b})" for b in PACKET_BINS)
_DNS = "dns_query_id <> 0 OR dns_query_type <> 0 OR dns_ttl_answer <> 0"

#: Features that are one aggregate over a bucket's flows, in SQL.
PLAIN: dict[str, str] = {
    "flow_count": "count(*)",
    **{f"{c}_sum": f"sum(CAST({c} AS DOUBLE))" for c in ("in_bytes", "out_bytes", "in_pkts", "out_pkts")},
    "duration_mean": "avg(flow_duration_milliseconds)",
    "duration_min": "min(flow_duration_milliseconds)",
    "duration_max": "max(flow_duration_milliseconds)",
    "protocol_tcp_ratio": _SHARE.format("protocol = 6"),
    "protocol_udp_ratio": _SHARE.format("protocol = 17"),
    "protocol_other_ratio": _SHARE.format("protocol <> 6 AND protocol <> 17"),
    **{
        f"{p}_{f}_ratio": f"coalesce(avg(CASE WHEN protocol = 6 THEN CASE WHEN ({p}s & {bit}) <> 0 THEN 1.0D ELSE 0.0D END END), 0.0D)"
        for p in ("tcp_flag", "client_tcp_flag", "server_tcp_flag")
        for f, bit in FLAG_BITS.items()
        if (p, f) != ("server_tcp_flag", "urg")
    },
    "icmp_flow_ratio": _SHARE.format("protocol = 1"),
    "dns_flow_ratio": _SHARE.format(_DNS),
    **{f"{c}_{s}": f"{a}({c})" for c in ("duration_in", "duration_out") for s, a in (("mean", "avg"), ("max", "max"))},
    "min_ip_pkt_len_min": "min(min_ip_pkt_len)",
    "min_ip_pkt_len_mean": "avg(min_ip_pkt_len)",
    "max_ip_pkt_len_mean": "avg(max_ip_pkt_len)",
    "max_ip_pkt_len_max": "max(max_ip_pkt_len)",
    **{f"{c}_sum": f"sum(CAST({c} AS DOUBLE))" for c in RETRANSMISSION},
    **{f"{c}_ratio": f"CASE WHEN {_BINS} = 0 THEN 0.0D ELSE CAST(sum({c}) AS DOUBLE) / ({_BINS}) END" for c in PACKET_BINS},
    **{f"{c}_{s}": f"coalesce({a}(CASE WHEN protocol = 6 THEN {c} END), 0)" for c in ("tcp_win_max_in", "tcp_win_max_out") for s, a in (("mean", "avg"), ("max", "max"))},
    "flow_start_gap_mean_ms": "CASE WHEN count(*) = 1 THEN 0.0D ELSE CAST(max(flow_start_milliseconds) - min(flow_start_milliseconds) AS DOUBLE) / (count(*) - 1) END",
    "flow_start_span_ms": "max(flow_start_milliseconds) - min(flow_start_milliseconds)",
}
#: The longest time between successive starts, by the flows' starts in order.
LONGEST_GAP = "flow_start_gap_max_ms"
#: Diversity features: field, value, eligible flows, and which of the four measures are kept.
DIVERSE: dict[str, tuple[str, str, tuple[str, ...]]] = {
    "protocol": ("protocol", "true", ("nunique",)),
    "l7": ("l7_proto", "true", ("nunique", "top1_ratio", "entropy")),
    "src_port": ("l4_src_port", "true", ("nunique", "reuse_ratio", "top1_ratio", "entropy")),
    "dst_port": ("l4_dst_port", "true", ("nunique", "reuse_ratio", "top1_ratio", "entropy")),
    "icmp_type": ("icmp_ipv4_type", "protocol = 1", ("nunique", "top1_ratio", "entropy")),
    "dns_query_type": ("dns_query_type", _DNS, ("nunique", "top1_ratio", "entropy")),
    "dst_ip": ("ipv4_dst_addr", "true", ("nunique", "reuse_ratio", "top1_ratio", "entropy")),
}
NAMED = {("l7", "nunique"): "l7_proto_nunique"}
#: The names of the 82 features in the order of a feature vector.
FEATURES = (
    "flow_count in_bytes_sum out_bytes_sum in_pkts_sum out_pkts_sum "
    "duration_mean duration_min duration_max protocol_tcp_ratio protocol_udp_ratio protocol_other_ratio protocol_nunique "
    "l7_proto_nunique l7_top1_ratio l7_entropy "
    "src_port_nunique src_port_reuse_ratio src_port_top1_ratio src_port_entropy "
    "dst_port_nunique dst_port_reuse_ratio dst_port_top1_ratio dst_port_entropy "
    "tcp_flag_fin_ratio tcp_flag_syn_ratio tcp_flag_rst_ratio tcp_flag_psh_ratio tcp_flag_ack_ratio tcp_flag_urg_ratio tcp_flag_ece_ratio tcp_flag_cwr_ratio "
    "client_tcp_flag_fin_ratio client_tcp_flag_syn_ratio client_tcp_flag_rst_ratio client_tcp_flag_psh_ratio client_tcp_flag_ack_ratio client_tcp_flag_urg_ratio client_tcp_flag_ece_ratio client_tcp_flag_cwr_ratio "
    "server_tcp_flag_fin_ratio server_tcp_flag_syn_ratio server_tcp_flag_rst_ratio server_tcp_flag_psh_ratio server_tcp_flag_ack_ratio server_tcp_flag_ece_ratio server_tcp_flag_cwr_ratio "
    "icmp_flow_ratio icmp_type_nunique icmp_type_top1_ratio icmp_type_entropy "
    "dns_flow_ratio dns_query_type_nunique dns_query_type_top1_ratio dns_query_type_entropy "
    "dst_ip_nunique dst_ip_reuse_ratio dst_ip_top1_ratio dst_ip_entropy "
    "duration_in_mean duration_in_max duration_out_mean duration_out_max "
    "min_ip_pkt_len_min min_ip_pkt_len_mean max_ip_pkt_len_mean max_ip_pkt_len_max "
    "retransmitted_in_bytes_sum retransmitted_in_pkts_sum retransmitted_out_bytes_sum retransmitted_out_pkts_sum "
    "num_pkts_up_to_128_bytes_ratio num_pkts_128_to_256_bytes_ratio num_pkts_256_to_512_bytes_ratio num_pkts_512_to_1024_bytes_ratio num_pkts_1024_to_1514_bytes_ratio "
    "tcp_win_max_in_mean tcp_win_max_in_max tcp_win_max_out_mean tcp_win_max_out_max "
    "flow_start_gap_mean_ms flow_start_gap_max_ms flow_start_span_ms"
).split()


def diversity(rows: DataFrame, keys: list[str], value: str, count: str = "n") -> DataFrame:
    """AG4 over (keys, value, count): k, reuse 1 - k/n, share of the commonest, entropy over log k."""
    sized = rows.groupBy(*keys).agg(F.count("*").alias("nunique"), F.sum(count).alias("_n"), F.max(count).alias("_top"), F.sum(F.col(count) * F.log(count)).alias("_clog"))
    # -sum(c/n log(c/n)) = log n - sum(c log c) / n
    entropy = F.when(F.col("nunique") > 1, (F.log("_n") - F.col("_clog") / F.col("_n")) / F.log("nunique")).otherwise(0.0)
    return sized.select(*keys, F.col("nunique").cast("double").alias("nunique"), (1 - F.col("nunique") / F.col("_n")).alias("reuse_ratio"), (F.col("_top") / F.col("_n")).alias("top1_ratio"), entropy.alias("entropy"))


def bucket_diversity(events: DataFrame) -> DataFrame:
    """AG4 of all seven fields in one shuffle: (field, value) pairs are exploded and counted map-side."""
    fields = F.array(*(F.when(F.expr(ok), F.struct(F.lit(f).alias("f"), F.col(c).cast("string").alias("v"))) for f, (c, ok, _) in DIVERSE.items()))
    pairs = events.select(*BUCKET, F.explode(fields).alias("p")).where("p IS NOT NULL")
    counts = pairs.groupBy(*BUCKET, "p.f", "p.v").agg(F.count("*").alias("n"))
    measured = diversity(counts, [*BUCKET, "f"], "v")
    columns = [F.coalesce(F.max(F.when(F.col("f") == f, F.col(s))), F.lit(0.0)).alias(NAMED.get((f, s), f"{f}_{s}")) for f, (_, _, kept) in DIVERSE.items() for s in kept]
    return measured.groupBy(*BUCKET).agg(*columns)


def bucket_stats(events: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """AG5: the 82 numeric features of every active bucket, with flows, attack_flows and y_bucket.

    ``marks`` has a row for each sequence; its columns are added while rows are narrow, so that no later join on the
    sequence moves the features.

    Plain features are one aggregate without distinct counts, so that it is combined before its shuffle. The
    longest gap sorts distinct starts alone, by bucket; the join on the bucket keys reuses that partitioning.
    """
    start = "flow_start_milliseconds"
    plain = events.groupBy(*BUCKET).agg(*(F.expr(x).cast("double").alias(n) for n, x in PLAIN.items()), F.count("*").alias("flows"), F.sum("label").alias("attack_flows"))
    starts = events.select(*BUCKET, start).distinct()
    gap = F.col(start) - F.lag(start).over(Window.partitionBy(*BUCKET).orderBy(start))
    gaps = starts.select(*BUCKET, gap.alias("gap")).groupBy(*BUCKET).agg(F.coalesce(F.max("gap"), F.lit(0)).cast("double").alias(LONGEST_GAP))
    added = [] if marks is None else [c for c in marks.columns if c not in KEYS]
    gaps = gaps if marks is None else gaps.join(marks, KEYS)
    found = plain.join(bucket_diversity(events), BUCKET).join(gaps, BUCKET)
    return found.select(*BUCKET, *FEATURES, "flows", "attack_flows", (F.col("attack_flows") > 0).cast("int").alias("y_bucket"), *added)


def feature_faults(stats: DataFrame) -> DataFrame:
    """Invariants of AG5: counts of values that are not finite, negative, or shares above one."""
    bad = lambda test, names: sum((F.sum(test(F.col(n)).cast("bigint")) for n in names), F.lit(0))
    shares = [n for n in FEATURES if n.endswith(("_ratio", "_entropy"))]
    return stats.agg(bad(lambda c: F.isnan(c) | c.isNull() | (F.abs(c) == float("inf")), FEATURES).alias("not_finite"), bad(lambda c: c < -1e-12, FEATURES).alias("negative"), bad(lambda c: c > 1 + 1e-10, shares).alias("above_one"))


DISTRIBUTION = ("in_bytes", "out_bytes", "in_pkts", "out_pkts", "flow_duration_milliseconds")


def distribution_features(events: DataFrame) -> DataFrame:
    """AG11: 15 features of spread and joint shape; quantiles are exact and interpolate linearly."""
    rows = events.withColumn("_share", byte_share()).withColumn("_bpp", bytes_per_packet())
    q90 = {f"{c}_q90": (c, 0.9) for c in ("in_bytes", "out_bytes", "flow_duration_milliseconds")}
    plain = [
        *(F.stddev_pop(c).alias(f"{c}_std") for c in DISTRIBUTION),
        F.avg((F.col("out_pkts") == 0).cast("double")).alias("zero_reply_fraction"),
        F.avg("_share").alias("in_byte_share_mean"),
        F.stddev_pop("_share").alias("in_byte_share_std"),
        F.avg("_bpp").alias("bytes_per_packet_mean"),
        F.stddev_pop("_bpp").alias("bytes_per_packet_std"),
        (F.countDistinct("ipv4_dst_addr", "l4_dst_port") / F.count("*")).alias("destination_port_pair_unique_fraction"),
    ]
    return with_quantiles(rows, BUCKET, plain, {**q90, "flow_duration_milliseconds_median": ("flow_duration_milliseconds", 0.5)})


#: Fields and codes of the candidate families.
IAT = tuple(f"{d}_iat_{s}" for d in ("src_to_dst", "dst_to_src") for s in ("min", "max", "avg", "stddev"))
RATES = tuple(f"{d}_{s}" for d in ("src_to_dst", "dst_to_src") for s in ("second_bytes", "avg_throughput"))
TTL = ("min_ttl", "max_ttl")
DNS_TYPES = (0, 1, 2, 5, 6, 12, 15, 16, 28, 255)
ICMP_TYPES = (0, 3, 5, 8, 11, 12)


def candidate_features(events: DataFrame) -> DataFrame:
    """AG13: five families — arrival gaps, rates, TTL, distribution, DNS and ICMP type shares."""
    usable = lambda c: F.when(F.col(c) >= 0, F.col(c)).otherwise(0)
    moments = [a for c in (*IAT, *RATES, *TTL) for a in (F.avg(usable(c)).alias(f"{c}_mean"), F.max(usable(c)).cast("double").alias(f"{c}_max"), F.avg((usable(c) > 0).cast("double")).alias(f"{c}_positive_fraction"))]
    spread = [F.stddev_pop(c).alias(f"{c}_std") for c in DISTRIBUTION]
    quantiles = {f"{c}_{n}": (c, q) for c in DISTRIBUTION for n, q in (("median", 0.5), ("q90", 0.9))}
    share = lambda test: F.avg(test.cast("double"))
    dns, icmp = is_dns(with_port=True), F.col("protocol") == 1
    codes = lambda name, field, ok, known: [*(share(ok & (F.col(field) == k)).alias(f"{name}_{k}_fraction") for k in known), share(ok & ~F.col(field).isin(*known)).alias(f"{name}_other_fraction")]
    rows = events.withColumn("_share", byte_share()).withColumn("_bpp", bytes_per_packet())
    plain = [
        *moments,
        *spread,
        share(F.col("out_pkts") == 0).alias("zero_reply_fraction"),
        share(F.col("flow_duration_milliseconds") == 0).alias("zero_duration_fraction"),
        share(F.col("flow_duration_milliseconds") <= 1).alias("one_ms_or_less_duration_fraction"),
        F.avg("_share").alias("in_byte_share_mean"),
        F.stddev_pop("_share").alias("in_byte_share_std"),
        F.avg("_bpp").alias("bytes_per_packet_mean"),
        F.stddev_pop("_bpp").alias("bytes_per_packet_std"),
        (F.countDistinct("ipv4_dst_addr", "l4_dst_port") / F.count("*")).alias("destination_port_pair_unique_fraction"),
        F.avg("longest_flow_pkt").alias("longest_flow_pkt_mean"),
        F.avg("shortest_flow_pkt").alias("shortest_flow_pkt_mean"),
        *codes("dns_type", "dns_query_type", dns, DNS_TYPES),
        *codes("icmp_ipv4_type", "icmp_ipv4_type", icmp, ICMP_TYPES),
    ]
    return with_quantiles(rows, BUCKET, plain, quantiles)


def candidate_families(columns: list[str]) -> dict[str, list[str]]:
    """AG13: the columns of ``candidate_features`` by family."""
    starts = {"iat": IAT, "rates": RATES, "ttl": TTL}
    out = {f: [c for c in columns if c.startswith(tuple(f"{n}_" for n in names))] for f, names in starts.items()}
    out["categories"] = [c for c in columns if c.startswith(("dns_type_", "icmp_ipv4_type_"))]
    known = {c for cs in out.values() for c in cs}
    out["distribution"] = [c for c in columns if c not in known and c not in BUCKET]
    return out


def unpivot(df: DataFrame, ids: list[str], fields: list[str], name: str = "field", value: str = "value") -> DataFrame:
    """Long form of numeric columns, as doubles."""
    return df.select(*ids, *(F.col(f).cast("double").alias(f) for f in fields)).unpivot(ids, fields, name, value)


def field_quality(rows: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """AG14: by group and field — flows, zero, positive, negative, non-finite values, least and greatest."""
    v = F.col("value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    count = lambda test: F.sum(F.coalesce(test, F.lit(False)).cast("bigint"))
    return unpivot(rows, [group], fields).groupBy(group, "field").agg(F.count("*").alias("flows"), count(finite & (v == 0)).alias("zero"), count(finite & (v > 0)).alias("positive"), count(finite & (v < 0)).alias("negative"), count(~finite).alias("non_finite"), F.min(F.when(finite, v)).alias("least"), F.max(F.when(finite, v)).alias("greatest"))


def raw_profile(events: DataFrame) -> DataFrame:
    """AG15: shares, sorted distinct ports and codes, totals of each sequence."""
    share = lambda test: F.avg(test.cast("double"))
    return events.groupBy(*KEYS).agg(
        share(F.col("protocol") == 6).alias("tcp_share"),
        share(F.col("protocol") == 17).alias("udp_share"),
        share(F.col("protocol") == 1).alias("icmp_share"),
        share(is_dns()).alias("dns_share"),
        share(F.col("l4_dst_port") == 53).alias("port53_share"),
        share(F.col("l4_dst_port").isin(80, 443)).alias("web_share"),
        F.array_sort(F.collect_set("l4_dst_port")).alias("ports"),
        F.array_sort(F.collect_set("l7_proto")).alias("l7_codes"),
        F.sum(F.col("in_bytes") + F.col("out_bytes")).alias("bytes"),
        F.sum(F.col("in_pkts") + F.col("out_pkts")).alias("packets"),
        share(F.col("out_pkts") == 0).alias("zero_reply_share"),
        F.avg("flow_duration_milliseconds").alias("mean_duration"),
        share(F.col("tcp_flags").bitwiseAND(F.lit(4)) != 0).alias("rst_share"),
        share(F.col("tcp_flags").bitwiseAND(F.lit(2)) != 0).alias("syn_share"),
        F.countDistinct("ipv4_dst_addr").alias("destinations"),
        F.countDistinct("l4_src_port").alias("source_ports"),
    )


def flow_family(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The majority kind of flows — UDP to port 53, TCP to port 3389, or other."""
    dns, rdp = (F.col("protocol") == 17) & (F.col("l4_dst_port") == 53), (F.col("protocol") == 6) & (F.col("l4_dst_port") == 3389)
    counted = rows.groupBy(*keys).agg(F.count("*").alias("flows"), F.sum(dns.cast("bigint")).alias("udp53"), F.sum(rdp.cast("bigint")).alias("tcp3389"))
    kind = F.when(F.col("udp53") * 2 > F.col("flows"), "udp_53").when(F.col("tcp3389") * 2 > F.col("flows"), "tcp_3389").otherwise("other")
    return counted.withColumn("family", kind)


def flow_label_profile(events: DataFrame) -> DataFrame:
    """AG16: by sequence and flow label — counts, families, medians."""
    names = ("in_bytes", "out_bytes", "in_pkts", "out_pkts", "flow_duration_milliseconds")
    medians = with_quantiles(events, [*KEYS, "label"], [], {f"{n}_median": (n, 0.5) for n in names})
    return flow_family(events, [*KEYS, "label"]).join(medians, [*KEYS, "label"])


def mixture_profile(events: DataFrame) -> DataFrame:
    """AG17: attack, mixed, benign-only and pure buckets, attack share in mixed ones, attack byte share."""
    total = F.col("in_bytes") + F.col("out_bytes")
    b = events.groupBy(*BUCKET).agg(F.count("*").alias("n"), F.sum("label").alias("a"), F.sum(total).alias("bytes"), F.sum(F.when(F.col("label") == 1, total).otherwise(0)).alias("attack_bytes"))
    attack, mixed = F.col("a") > 0, (F.col("a") > 0) & (F.col("a") < F.col("n"))
    return b.groupBy(*KEYS).agg(
        F.sum(attack.cast("bigint")).alias("attack_buckets"),
        F.sum(mixed.cast("bigint")).alias("mixed_buckets"),
        F.sum((F.col("a") == 0).cast("bigint")).alias("benign_buckets"),
        F.sum((F.col("a") == F.col("n")).cast("bigint")).alias("pure_buckets"),
        (F.sum(F.when(mixed, F.col("a"))) / F.sum(F.when(mixed, F.col("n")))).alias("attack_share_in_mixed"),
        (F.sum("attack_bytes") / F.greatest(F.sum("bytes"), F.lit(1))).alias("attack_byte_share"),
    )


def group_medians(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """AG18: medians that skip nulls, and the group's size."""
    return with_quantiles(rows, keys, [F.count("*").alias("n")], {f"{c}_median": (c, 0.5) for c in columns})

