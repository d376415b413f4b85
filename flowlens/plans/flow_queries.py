"""Queries over flows: sources, sequences, bucket statistics, histograms, scaling, exploration."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import arrays as ar
from flowlens.functions import scalars as sc
from flowlens.functions.grid import geometries
from flowlens.operators import features as ft
from flowlens.operators import histograms as hg
from flowlens.operators import quality as dq
from flowlens.operators import scaling as sl
from flowlens.operators import sequences as sq
from flowlens.plans import query
from flowlens.plans.base import GRID, attacks, events, folded, key_sql, rounded, sequences, statistics, with_ctes, with_ids
from flowlens.sources import flows as src
from flowlens.sources import sinks
from flowlens.storage import materialise

B = "source_ip, window_start_ms, bucket"


def r(x: str, name: str, digits: int = 6) -> str:
    return f"round(CAST({x} AS DOUBLE), {digits}) + 0.0 AS {name}"


@query("src2_flow_table", with_ctes("SELECT raw_rowid, flow_start_milliseconds, flow_end_milliseconds, protocol, in_bytes, out_bytes, label, attack, ipv4_src_addr, ipv4_dst_addr FROM flows", "flows"))
def src2(spark, sf):
    return src.event_flows(spark, sf).select("raw_rowid", "flow_start_milliseconds", "flow_end_milliseconds", "protocol", "in_bytes", "out_bytes", "label", "attack", "ipv4_src_addr", "ipv4_dst_addr")


@query("src3_control_totals", with_ctes("SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS attack_rows, CAST(0 AS BIGINT) + count(*) FILTER (flow_end_milliseconds < flow_start_milliseconds OR in_bytes < 0 OR label NOT IN (0, 1)) AS invalid_rows FROM flows", "flows"))
def src3(spark, sf):
    return src.control_totals(src.event_flows(spark, sf))


@query("src4_reconcile", with_ctes("SELECT a.*, b.*, a.raw_flows AS event_flows, a.raw_attacks AS event_attacks, raw_flows = sequence_flows AND raw_attacks = sequence_attacks AS agree FROM (SELECT count(*) AS raw_flows, CAST(sum(label) AS BIGINT) AS raw_attacks FROM flows) a, (SELECT CAST(sum(flows) AS BIGINT) AS sequence_flows, CAST(sum(attack_flows) AS BIGINT) AS sequence_attacks FROM seq0) b", "seq0"))
def src4(spark, sf):
    e = events(spark, sf)
    return sq.reconcile(src.event_flows(spark, sf), sq.sequence_index(e), e)


@query("src9_split_metadata", with_ctes("SELECT source_ip, window_start_ms, flows, attack_flows, primary_attack FROM fold WHERE fold = 1", "fold"))
def src9(spark, sf):
    return src.split_metadata(folded(spark, sf).withColumn("split", F.when(F.col("fold") == 1, "validation")), "validation").select("source_ip", "window_start_ms", "flows", "attack_flows", "primary_attack")


_SCALAR_SQL = (
    "SELECT raw_rowid, window_start_ms, bucket, "
    "CASE WHEN l4_dst_port = 53 THEN 0 WHEN l4_dst_port IN (80, 443) THEN 1 WHEN l4_dst_port = 22 THEN 2 WHEN l4_dst_port IN (20, 21) THEN 3 WHEN l4_dst_port IN (25, 110, 143, 465, 587, 993, 995) THEN 4 WHEN l4_dst_port = 3389 THEN 5 WHEN l4_dst_port IN (139, 445) THEN 6 ELSE 7 END AS service, "
    "protocol = 6 AS tcp, protocol = 17 AS udp, protocol = 1 AS icmp, dns_query_id <> 0 OR dns_query_type <> 0 OR dns_ttl_answer <> 0 AS dns, "
    "(tcp_flags & 2) <> 0 AS syn, (tcp_flags & 16) <> 0 AS ack, " + r("in_bytes / greatest(in_bytes + out_bytes, 1)", "share") + ", " + r("(in_bytes + out_bytes) / greatest(in_pkts + out_pkts, 1)", "bpp") + ", "
    "substr(sha256(ipv4_src_addr), 1, 16) AS host FROM g"
)


@query("w_scalars", with_ctes(_SCALAR_SQL, "g"))
def w_scalars(spark, sf):
    e = events(spark, sf)
    return rounded(e.select("raw_rowid", "window_start_ms", "bucket", sc.service_id(F.col("l4_dst_port")).alias("service"), sc.is_tcp().alias("tcp"), sc.is_udp().alias("udp"), sc.is_icmp().alias("icmp"), sc.is_dns().alias("dns"), sc.has_flag("tcp_flags", "syn").alias("syn"), sc.has_flag("tcp_flags", "ack").alias("ack"), sc.byte_share().alias("share"), sc.bytes_per_packet().alias("bpp"), sc.pseudonym(F.col("ipv4_src_addr")).alias("host")))


@query("w11_w12_bands", with_ctes("SELECT source_ip, window_start_ms, CASE WHEN active_buckets <= 1 THEN 0 WHEN active_buckets <= 4 THEN 1 ELSE 2 END AS band, CASE WHEN f = 1 THEN 'all' WHEN f <= 0.01 THEN '<=1%' WHEN f <= 0.1 THEN '1-10%' WHEN f <= 0.5 THEN '10-50%' ELSE '50-100%' END AS fraction, CASE WHEN active_buckets <= 1 THEN '1' WHEN active_buckets <= 5 THEN '2-5' ELSE '6-10' END AS active, CASE WHEN flows <= 2 THEN '1-2' WHEN flows <= 10 THEN '3-10' WHEN flows <= 100 THEN '11-100' ELSE '101+' END AS size FROM (SELECT *, attack_flows * 1.0 / flows AS f FROM seq0)", "seq0"))
def bands(spark, sf):
    s = sq.sequence_index(events(spark, sf))
    return s.select("source_ip", "window_start_ms", sc.occupancy_band(F.col("active_buckets")).alias("band"), sc.fraction_bin(F.col("attack_flows") / F.col("flows")).alias("fraction"), sc.active_bin(F.col("active_buckets")).alias("active"), sc.flow_bin(F.col("flows")).alias("size"))


@query("w15_dense_ids", with_ctes("SELECT source_ip, window_start_ms, sequence_id FROM ids", "ids"))
def w15(spark, sf):
    return with_ids(spark, sf).select("source_ip", "window_start_ms", "sequence_id")


@query("w19_seeded_key", with_ctes(f"SELECT raw_rowid, {key_sql(chr(39) + '7:' + chr(39) + ' || raw_rowid')} AS k FROM flows", "flows"))
def w19(spark, sf):
    return src.event_flows(spark, sf).select("raw_rowid", sc.seeded_key(7, F.col("raw_rowid")).alias("k"))


@query("ag1_sequence_index", with_ctes("SELECT * FROM seq0", "seq0"))
def ag1(spark, sf):
    return sq.sequence_index(events(spark, sf))


@query("ag2_sequence_attacks", with_ctes("SELECT * FROM att", "att"))
def ag2(spark, sf):
    return attacks(spark, sf)


@query("ag3_primary_attack", with_ctes("SELECT * FROM seq", "seq"))
def ag3(spark, sf):
    return sequences(spark, sf)


@query("j1_events_with_sequence", with_ctes("SELECT g.raw_rowid, s.flows, s.attack_flows, s.primary_attack FROM g JOIN seq s USING (source_ip, window_start_ms)", "g", "seq"))
def j1(spark, sf):
    return sq.join_sequences(events(spark, sf), sequences(spark, sf)).select("raw_rowid", "flows", "attack_flows", "primary_attack")


def _diversity_sql() -> str:
    rows = " UNION ALL ".join(f"SELECT {B}, '{f}' AS f, CAST({c} AS VARCHAR) AS v FROM g WHERE {ok}" for f, (c, ok, _) in ft.DIVERSE.items())
    per = f"SELECT {B}, f, count(*) AS k, sum(n) AS n, max(n) AS top, sum(n * ln(n)) AS cl FROM (SELECT {B}, f, v, count(*) AS n FROM ({rows}) GROUP BY {B}, f, v) GROUP BY {B}, f"
    value = {"nunique": "k", "reuse_ratio": "1 - k * 1.0 / n", "top1_ratio": "top * 1.0 / n", "entropy": "CASE WHEN k > 1 THEN (ln(n) - cl / n) / ln(k) ELSE 0 END"}
    return f"SELECT {B}, " + ", ".join(r(f"coalesce(max(CASE WHEN f = '{f}' THEN {value[s]} END), 0)", ft.NAMED.get((f, s), f"{f}_{s}")) for f, (_, _, kept) in ft.DIVERSE.items() for s in kept) + f" FROM ({per}) GROUP BY {B}"


@query("ag4_diversity", with_ctes(_diversity_sql(), "g"))
def ag4(spark, sf):
    return rounded(ft.bucket_diversity(events(spark, sf)))


_PLAIN = ft.PLAIN | {ft.LONGEST_GAP: "coalesce(max(flow_start_milliseconds - prev_start), 0)"}


def _bucket_sql() -> str:
    plain = ", ".join(r(x.replace("0.0D", "0.0").replace("1.0D", "1.0"), n) for n, x in _PLAIN.items())
    gaps = f"SELECT *, lag(flow_start_milliseconds) OVER (PARTITION BY {B} ORDER BY flow_start_milliseconds) AS prev_start FROM g"
    return f"+ plain AS (SELECT {B}, {plain}, count(*) AS flows, CAST(sum(label) AS BIGINT) AS attack_flows, CASE WHEN sum(label) > 0 THEN 1 ELSE 0 END AS y_bucket FROM ({gaps}) GROUP BY {B}), d AS ({_diversity_sql()}) SELECT * FROM plain JOIN d USING ({B})"


@query("ag5_bucket_stats", with_ctes(_bucket_sql(), "g"))
def ag5(spark, sf):
    return rounded(ft.bucket_stats(events(spark, sf)))


@query("ag5_invariants", with_ctes("SELECT CAST(0 AS BIGINT) AS not_finite, CAST(0 AS BIGINT) AS negative, CAST(0 AS BIGINT) AS above_one", "runs"))
def ag5_invariants(spark, sf):
    return ft.feature_faults(ft.bucket_stats(events(spark, sf)))


for _field, _code in (("protocol", "protocol"), ("l7", "l7_proto"), ("service", "CASE WHEN l4_dst_port = 53 THEN 0 WHEN l4_dst_port IN (80, 443) THEN 1 WHEN l4_dst_port = 22 THEN 2 WHEN l4_dst_port IN (20, 21) THEN 3 WHEN l4_dst_port IN (25, 110, 143, 465, 587, 993, 995) THEN 4 WHEN l4_dst_port = 3389 THEN 5 WHEN l4_dst_port IN (139, 445) THEN 6 ELSE 7 END")):

    @query(f"ag7_histogram_{_field}", with_ctes(f"SELECT {B}, CAST({_code} AS BIGINT) AS code, count(*) AS n FROM g GROUP BY {B}, 4", "g"))
    def ag7(spark, sf, field=_field):
        return hg.category_histogram(events(spark, sf), field)


_HIST = f"+ h AS (SELECT {B}, l7_proto AS code, count(*) AS n FROM g GROUP BY 1, 2, 3, 4), vocab AS (SELECT code, row_number() OVER (ORDER BY code) AS slot FROM (SELECT DISTINCT code FROM h SEMI JOIN (SELECT * FROM fold WHERE fold = 0) f USING (source_ip, window_start_ms))), dense AS (SELECT {B}, coalesce(slot, 0) AS slot, CAST(sum(n) AS BIGINT) AS n FROM h LEFT JOIN vocab USING (code) GROUP BY 1, 2, 3, 4) "


def _vocabulary(spark, sf):
    histogram = hg.category_histogram(events(spark, sf), "l7")
    return histogram, hg.fit_vocabulary(histogram, folded(spark, sf).where("fold = 0"))


@query("ag8_dense_histogram", with_ctes(_HIST + f"SELECT {B}, CAST(slot AS INTEGER) AS slot, n, " + r(f"n * 1.0 / sum(n) OVER (PARTITION BY {B})", "share") + " FROM dense", "g", "fold"))
def ag8(spark, sf):
    return rounded(hg.dense_histogram(*_vocabulary(spark, sf)))


@query("ag9_vocabulary", with_ctes(_HIST + "SELECT code, CAST(slot AS INTEGER) AS slot FROM vocab", "g", "fold"))
def ag9(spark, sf):
    return _vocabulary(spark, sf)[1]


@query("ag6_l7_ratios", with_ctes(_HIST + f"SELECT {B}, v.code, " + r(f"n * 1.0 / sum(n) OVER (PARTITION BY {B})", "share") + " FROM dense LEFT JOIN vocab v USING (slot)", "g", "fold"))
def ag6(spark, sf):
    return rounded(hg.l7_ratios(events(spark, sf), _vocabulary(spark, sf)[1]))


_SCALED = ["flow_count", "in_bytes_sum", "duration_mean", "protocol_tcp_ratio", "src_port_entropy", "flow_start_gap_max_ms"]


def _scaler_sql() -> str:
    used = {n: f"ln(1 + {n})" if sc.is_logged(n) else n for n in _SCALED}
    plain = {n: _PLAIN[n].replace("0.0D", "0.0").replace("1.0D", "1.0") for n in _SCALED if n in _PLAIN}
    gaps = f"SELECT *, lag(flow_start_milliseconds) OVER (PARTITION BY {B} ORDER BY flow_start_milliseconds) AS prev_start FROM g"
    stats = f"SELECT {B}, " + ", ".join(f"CAST({x} AS DOUBLE) AS {n}" for n, x in plain.items()) + f" FROM ({gaps}) GROUP BY {B}"
    d = _diversity_sql().replace("round(", "(").replace(", 6) + 0.0", ")")
    parts = " UNION ALL ".join(f"SELECT '{n}' AS feature, count(*) AS n, avg({x}) AS mean, stddev_pop({x}) AS sd FROM t" for n, x in used.items())
    return f"+ st AS ({stats}), dv AS ({d}), full_ AS (SELECT * FROM st JOIN dv USING ({B})), t AS (SELECT * FROM full_ SEMI JOIN (SELECT * FROM fold WHERE fold = 0) f USING (source_ip, window_start_ms)), scaler AS ({parts}) "


@query("ag10_scaler", with_ctes(_scaler_sql() + "SELECT feature, n, " + r("mean", "mean") + ", " + r("CASE WHEN sd < 1e-12 THEN 1 ELSE sd END", "scale") + ", sd < 1e-12 AS constant FROM scaler", "g", "fold"))
def ag10(spark, sf):
    return rounded(sl.fit_scaler(ft.bucket_stats(events(spark, sf)), folded(spark, sf).where("fold = 0"), _SCALED))


@query("w10_standardize", with_ctes(_scaler_sql() + f"SELECT {B}, " + ", ".join(r(f"({'ln(1 + ' + n + ')' if sc.is_logged(n) else n} - (SELECT mean FROM scaler WHERE feature = '{n}')) / (SELECT CASE WHEN sd < 1e-12 THEN 1 ELSE sd END FROM scaler WHERE feature = '{n}')", n, 5) for n in _SCALED) + " FROM full_", "g", "fold"))
def w10(spark, sf):
    stats = ft.bucket_stats(events(spark, sf)).select(*ft.BUCKET, *_SCALED)
    return rounded(sl.standardize(stats, sl.fit_scaler(stats, folded(spark, sf).where("fold = 0"), _SCALED), _SCALED), 5)


_DIST_SQL = (
    f"SELECT {B}, " + ", ".join(r(f"stddev_pop({c})", f"{c}_std") for c in ft.DISTRIBUTION) + ", " + ", ".join(r(f"quantile_cont({c}, 0.9)", f"{c}_q90") for c in ("in_bytes", "out_bytes", "flow_duration_milliseconds"))
    + ", " + r("avg(CASE WHEN out_pkts = 0 THEN 1.0 ELSE 0.0 END)", "zero_reply_fraction") + ", " + r("avg(sh)", "in_byte_share_mean") + ", " + r("stddev_pop(sh)", "in_byte_share_std") + ", " + r("avg(bpp)", "bytes_per_packet_mean") + ", " + r("stddev_pop(bpp)", "bytes_per_packet_std")
    + ", " + r("count(DISTINCT (ipv4_dst_addr, l4_dst_port)) * 1.0 / count(*)", "destination_port_pair_unique_fraction") + ", " + r("median(flow_duration_milliseconds)", "flow_duration_milliseconds_median")
    + f" FROM (SELECT *, in_bytes / greatest(in_bytes + out_bytes, 1) AS sh, (in_bytes + out_bytes) / greatest(in_pkts + out_pkts, 1) AS bpp FROM g) GROUP BY {B}"
)


@query("ag11_distribution", with_ctes(_DIST_SQL, "g"))
def ag11(spark, sf):
    return rounded(ft.distribution_features(events(spark, sf)))


_ADDED = [*(f"{c}_std" for c in ft.DISTRIBUTION), "in_bytes_q90", "out_bytes_q90", "flow_duration_milliseconds_q90", "zero_reply_fraction", "in_byte_share_mean", "in_byte_share_std", "bytes_per_packet_mean", "bytes_per_packet_std", "destination_port_pair_unique_fraction", "flow_duration_milliseconds_median"]


def _extended_sql() -> str:
    bare = lambda sql: sql.replace("round(", "(").replace(", 6) + 0.0", ")")
    used = {n: f"ln(1 + {n})" if sc.is_logged(n) else n for n in [*ft.FEATURES, *_ADDED]}
    plain = ", ".join(f"CAST({x.replace('0.0D', '0.0').replace('1.0D', '1.0')} AS DOUBLE) AS {n}" for n, x in _PLAIN.items())
    gaps = f"SELECT *, lag(flow_start_milliseconds) OVER (PARTITION BY {B} ORDER BY flow_start_milliseconds) AS prev_start FROM g"
    moments = ", ".join(f"avg({x}) AS {n}_m, CASE WHEN stddev_pop({x}) < 1e-12 THEN 1 ELSE stddev_pop({x}) END AS {n}_s" for n, x in used.items())
    return (
        f"+ st AS (SELECT {B}, {plain} FROM ({gaps}) GROUP BY {B}), dv AS ({bare(_diversity_sql())}), di AS ({bare(_DIST_SQL)}), full_ AS (SELECT * FROM st JOIN dv USING ({B}) JOIN di USING ({B})), "
        f"m AS (SELECT {moments} FROM full_ SEMI JOIN (SELECT * FROM fold WHERE fold = 0) f USING (source_ip, window_start_ms)) "
        f"SELECT {B}, " + ", ".join(r(f"({x} - {n}_m) / {n}_s", n, 5) for n, x in used.items()) + " FROM full_, m"
    )


@query("ag12_extended_features", with_ctes(_extended_sql(), "g", "fold"))
def ag12(spark, sf):
    train = folded(spark, sf).where("fold = 0")
    stats = statistics(spark, sf)
    scaler = sl.fit_scaler(stats.where("fold = 0"), None, ft.FEATURES)
    base = sl.standardize(stats.select(*ft.BUCKET, *ft.FEATURES), scaler, ft.FEATURES)
    added = materialise(ft.distribution_features(events(spark, sf)), "distribution")  # read to fit its scaler, and again
    return rounded(sl.extend_features(base, added, train, _ADDED, ft.BUCKET), 5)


def _candidate_sql() -> str:
    out = [x for c in (*ft.IAT, *ft.RATES, *ft.TTL) for x in (r(f"avg({c})", f"{c}_mean"), r(f"max({c})", f"{c}_max"), r(f"avg(CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END)", f"{c}_positive_fraction"))]
    out += [x for c in ft.DISTRIBUTION for x in (r(f"stddev_pop({c})", f"{c}_std"), r(f"median({c})", f"{c}_median"), r(f"quantile_cont({c}, 0.9)", f"{c}_q90"))]
    share = lambda t, n: r(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END)", n)
    dns, icmp = "(dns_query_id <> 0 OR dns_query_type <> 0 OR dns_ttl_answer <> 0 OR l4_dst_port = 53)", "protocol = 1"
    out += [share("out_pkts = 0", "zero_reply_fraction"), share("flow_duration_milliseconds = 0", "zero_duration_fraction"), share("flow_duration_milliseconds <= 1", "one_ms_or_less_duration_fraction"), r("avg(sh)", "in_byte_share_mean"), r("stddev_pop(sh)", "in_byte_share_std"), r("avg(bpp)", "bytes_per_packet_mean"), r("stddev_pop(bpp)", "bytes_per_packet_std"), r("count(DISTINCT (ipv4_dst_addr, l4_dst_port)) * 1.0 / count(*)", "destination_port_pair_unique_fraction"), r("avg(longest_flow_pkt)", "longest_flow_pkt_mean"), r("avg(shortest_flow_pkt)", "shortest_flow_pkt_mean")]
    for name, field, ok, known in (("dns_type", "dns_query_type", dns, ft.DNS_TYPES), ("icmp_ipv4_type", "icmp_ipv4_type", icmp, ft.ICMP_TYPES)):
        out += [share(f"{ok} AND {field} = {k}", f"{name}_{k}_fraction") for k in known] + [share(f"{ok} AND {field} NOT IN {known}", f"{name}_other_fraction")]
    return f"SELECT {B}, {', '.join(out)} FROM (SELECT *, in_bytes / greatest(in_bytes + out_bytes, 1) AS sh, (in_bytes + out_bytes) / greatest(in_pkts + out_pkts, 1) AS bpp FROM g) GROUP BY {B}"


@query("ag13_candidate_families", with_ctes(_candidate_sql(), "g"))
def ag13(spark, sf):
    return rounded(ft.candidate_features(events(spark, sf)))


_QUALITY = ["in_bytes", "out_bytes", "icmp_ipv4_type", "dns_query_id"]


@query("ag14_field_quality", with_ctes(" UNION ALL ".join(f"SELECT attack, '{f}' AS field, count(*) AS flows, count(*) FILTER ({f} = 0) AS zero, count(*) FILTER ({f} > 0) AS positive, count(*) FILTER ({f} < 0) AS negative, CAST(0 AS BIGINT) AS non_finite, CAST(min({f}) AS DOUBLE) AS least, CAST(max({f}) AS DOUBLE) AS greatest FROM flows GROUP BY attack" for f in _QUALITY), "flows"))
def ag14(spark, sf):
    return ft.field_quality(src.event_flows(spark, sf), "attack", _QUALITY)


@query("ag15_raw_profile", with_ctes("SELECT source_ip, window_start_ms, " + ", ".join(r(f"avg(CASE WHEN {t} THEN 1.0 ELSE 0.0 END)", n) for n, t in {"tcp_share": "protocol = 6", "udp_share": "protocol = 17", "icmp_share": "protocol = 1", "dns_share": "dns_query_id <> 0 OR dns_query_type <> 0 OR dns_ttl_answer <> 0", "port53_share": "l4_dst_port = 53", "web_share": "l4_dst_port IN (80, 443)", "zero_reply_share": "out_pkts = 0", "rst_share": "(tcp_flags & 4) <> 0", "syn_share": "(tcp_flags & 2) <> 0"}.items()) + ", array_to_string(list_sort(list(DISTINCT l4_dst_port)), ',') AS ports, array_to_string(list_sort(list(DISTINCT l7_proto)), ',') AS l7_codes, CAST(sum(in_bytes + out_bytes) AS BIGINT) AS bytes, CAST(sum(in_pkts + out_pkts) AS BIGINT) AS packets, " + r("avg(flow_duration_milliseconds)", "mean_duration") + ", count(DISTINCT ipv4_dst_addr) AS destinations, count(DISTINCT l4_src_port) AS source_ports FROM g GROUP BY 1, 2", "g"))
def ag15(spark, sf):
    p = rounded(ft.raw_profile(events(spark, sf)))
    return p.withColumn("ports", F.array_join(F.col("ports").cast("array<string>"), ",")).withColumn("l7_codes", F.array_join(F.col("l7_codes").cast("array<string>"), ","))


_FAM = "CASE WHEN udp53 * 2 > flows THEN 'udp_53' WHEN tcp3389 * 2 > flows THEN 'tcp_3389' ELSE 'other' END AS family"


@query("ag16_flow_label_profile", with_ctes(f"SELECT *, {_FAM} FROM (SELECT source_ip, window_start_ms, label, count(*) AS flows, count(*) FILTER (protocol = 17 AND l4_dst_port = 53) AS udp53, count(*) FILTER (protocol = 6 AND l4_dst_port = 3389) AS tcp3389, " + ", ".join(r(f"median({n})", f"{n}_median") for n in ("in_bytes", "out_bytes", "in_pkts", "out_pkts", "flow_duration_milliseconds")) + " FROM g GROUP BY 1, 2, 3)", "g"))
def ag16(spark, sf):
    return rounded(ft.flow_label_profile(events(spark, sf)))


@query("w17_flow_family", with_ctes(f"SELECT *, {_FAM} FROM (SELECT attack, count(*) AS flows, count(*) FILTER (protocol = 17 AND l4_dst_port = 53) AS udp53, count(*) FILTER (protocol = 6 AND l4_dst_port = 3389) AS tcp3389 FROM g GROUP BY 1)", "g"))
def w17(spark, sf):
    return ft.flow_family(events(spark, sf), ["attack"])


@query("ag17_mixture_profile", with_ctes(f"SELECT source_ip, window_start_ms, count(*) FILTER (a > 0) AS attack_buckets, count(*) FILTER (a > 0 AND a < n) AS mixed_buckets, count(*) FILTER (a = 0) AS benign_buckets, count(*) FILTER (a = n) AS pure_buckets, " + r("sum(a) FILTER (a > 0 AND a < n) * 1.0 / sum(n) FILTER (a > 0 AND a < n)", "attack_share_in_mixed") + ", " + r("sum(ab) / greatest(sum(b), 1)", "attack_byte_share") + f" FROM (SELECT {B}, count(*) AS n, sum(label) AS a, sum(in_bytes + out_bytes) AS b, sum(CASE WHEN label = 1 THEN in_bytes + out_bytes ELSE 0 END) AS ab FROM g GROUP BY {B}) GROUP BY 1, 2", "g"))
def ag17(spark, sf):
    return rounded(ft.mixture_profile(events(spark, sf)))


@query("ag18_group_medians", with_ctes("SELECT primary_attack, count(*) AS n, " + r("median(flows)", "flows_median") + ", " + r("median(active_buckets)", "active_buckets_median") + " FROM seq GROUP BY 1", "seq"))
def ag18(spark, sf):
    return rounded(ft.group_medians(sequences(spark, sf), ["primary_attack"], ["flows", "active_buckets"]))


@query("ag19_split_composition", with_ctes("SELECT CASE fold WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END AS split, count(*) AS sequences, count(*) FILTER (attack_flows > 0) AS positive_sequences, CAST(sum(flows) AS BIGINT) AS flows, CAST(sum(attack_flows) AS BIGINT) AS attack_flows, count(DISTINCT source_ip) AS sources FROM fold GROUP BY 1", "fold"))
def ag19(spark, sf):
    name = F.when(F.col("fold") == 0, "train").when(F.col("fold") == 1, "validation").otherwise("test")
    return sq.split_composition(folded(spark, sf).withColumn("split", name))


@query("v1_densify", with_ctes(f"SELECT source_ip, window_start_ms, " + "string_agg(coalesce(n, 0), ',' ORDER BY i) AS counts, string_agg(CASE WHEN n IS NULL THEN 0 ELSE 1 END, ',' ORDER BY i) AS mask FROM (SELECT DISTINCT source_ip, window_start_ms FROM g) s CROSS JOIN (SELECT unnest(range(10)) AS i) t LEFT JOIN (SELECT source_ip, window_start_ms, bucket AS i, count(*) AS n FROM g GROUP BY 1, 2, 3) b USING (source_ip, window_start_ms, i) GROUP BY 1, 2", "g"))
def v1(spark, sf):
    b = events(spark, sf).groupBy(*ft.BUCKET).agg(F.count("*").alias("counts"))
    d = ar.densify(b, ["counts"], GRID.buckets)
    text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
    return d.select("source_ip", "window_start_ms", text("counts"), text("mask"))


@query("v10_mask_features", with_ctes("+ b AS (SELECT DISTINCT source_ip, window_start_ms, bucket FROM g), q AS (SELECT *, bucket - lag(bucket) OVER w - 1 AS gap, bucket - row_number() OVER w AS island FROM b WINDOW w AS (PARTITION BY source_ip, window_start_ms ORDER BY bucket)), runs_ AS (SELECT source_ip, window_start_ms, island, count(*) AS run FROM q GROUP BY 1, 2, 3) SELECT source_ip, window_start_ms, count(*) AS active, count(*) FILTER (gap = 0) AS adjacent_pairs, (SELECT max(run) FROM runs_ r WHERE r.source_ip = q.source_ip AND r.window_start_ms = q.window_start_ms) AS longest_run, max(gap) AS largest_gap FROM q GROUP BY 1, 2", "g"))
def v10(spark, sf):
    out = ar.mask_features(events(spark, sf))
    return out.select("source_ip", "window_start_ms", "active", "adjacent_pairs", "longest_run", F.col("largest_gap").cast("bigint").alias("largest_gap"))


@query("ed1_attack_inventory", with_ctes("SELECT attack, count(*) AS flows, count(DISTINCT source_ip) AS sources, count(DISTINCT ipv4_dst_addr) AS destinations, count(DISTINCT source_ip || '|' || window_start_ms) AS windows, count(DISTINCT CASE WHEN s.attack_flows < s.flows THEN source_ip || '|' || window_start_ms END) AS hybrid_windows, " + r("count(DISTINCT CASE WHEN s.attack_flows < s.flows THEN source_ip || '|' || window_start_ms END) * 1.0 / count(DISTINCT source_ip || '|' || window_start_ms)", "hybrid_share") + " FROM g JOIN seq0 s USING (source_ip, window_start_ms) WHERE label = 1 GROUP BY 1", "g", "seq0"))
def ed1(spark, sf):
    return rounded(sq.attack_inventory(events(spark, sf)))


@query("ed2_daily_sources", with_ctes(f"SELECT day_ms, count(DISTINCT source_ip) AS sources, CAST(sum(n) AS BIGINT) AS flows, CAST(sum(a) AS BIGINT) AS attack_flows, count(*) AS buckets, count(*) FILTER (a > 0) AS attack_buckets FROM (SELECT flow_start_milliseconds - flow_start_milliseconds % 86400000 AS day_ms, {B}, count(*) AS n, sum(label) AS a FROM g GROUP BY 1, 2, 3, 4) GROUP BY 1", "g"))
def ed2(spark, sf):
    return sq.daily_sources(events(spark, sf))


@query("ed3_occupancy", with_ctes("SELECT *, " + r("sequences * 1.0 / sum(sequences) OVER (PARTITION BY kind)", "share") + " FROM (SELECT CASE WHEN attack_flows = 0 THEN 'benign' WHEN attack_flows = flows THEN 'attack' ELSE 'hybrid' END AS kind, active_buckets, count(*) AS sequences FROM seq0 GROUP BY 1, 2)", "seq0"))
def ed3(spark, sf):
    return rounded(sq.occupancy(sequences(spark, sf)))


_SCALES = (3600, 21600, 86400)


@query("ed4_window_scales", with_ctes(" UNION ALL ".join(f"SELECT {s} AS seconds, count(*) AS windows, count(*) FILTER (a > 0) AS positive_windows, count(*) FILTER (a > 0 AND a < n) AS hybrid_windows, count(*) FILTER (k = 1) AS single_bucket_windows, " + r("avg(n)", "mean_flows") + f" FROM (SELECT source_ip, flow_start_milliseconds // {s * 1000} AS w, count(*) AS n, sum(label) AS a, count(DISTINCT (flow_start_milliseconds % {s * 1000}) // {s * 100}) AS k FROM g GROUP BY 1, 2)" for s in _SCALES), "g"))
def ed4(spark, sf):
    return rounded(sq.window_scales(src.event_flows(spark, sf), list(_SCALES)))


def _ed5_sql() -> str:
    part = lambda x: f"CASE WHEN {x} < 6 THEN 'train' WHEN {x} < 8 THEN 'validation' ELSE 'test' END"
    q = "'1:' || "
    ways = {"random": part(f"{key_sql(q + 'source_ip || chr(124) || window_start_ms')} % 10"), "chronological": part("floor((window_start_ms - lo) * 10 / (hi - lo + 1))"), "shuffled_days": part(f"{key_sql(q + 'window_start_ms // 86400000')} % 10")} | {f"block_{m}min": part(f"{key_sql(q + f'window_start_ms // {m * 60000}')} % 10") for m in (15, 30, 60)}
    rows = " UNION ALL ".join(f"SELECT '{n}' AS way, {x} AS part, primary_attack, attack_flows FROM s" for n, x in ways.items())
    return f"+ s AS (SELECT *, min(window_start_ms) OVER () AS lo, max(window_start_ms) OVER () AS hi FROM seq) SELECT way, part, count(*) AS sequences, count(DISTINCT CASE WHEN attack_flows > 0 THEN primary_attack END) AS attack_types FROM ({rows}) GROUP BY 1, 2"


@query("ed5_candidate_splits", with_ctes(_ed5_sql(), "seq"))
def ed5(spark, sf):
    return sq.candidate_splits(sequences(spark, sf))


@query("ed6_attack_episodes", with_ctes("SELECT source_ip, attack, CAST(episode AS BIGINT) AS episode, count(*) AS flows, min(flow_start_milliseconds) AS first_ms, max(flow_start_milliseconds) AS last_ms FROM (SELECT *, sum(nw) OVER (PARTITION BY source_ip, attack ORDER BY flow_start_milliseconds, raw_rowid) AS episode FROM (SELECT *, CASE WHEN flow_start_milliseconds - lag(flow_start_milliseconds) OVER (PARTITION BY source_ip, attack ORDER BY flow_start_milliseconds, raw_rowid) <= 86400000 THEN 0 ELSE 1 END AS nw FROM g WHERE label = 1)) GROUP BY 1, 2, 3", "g"))
def ed6(spark, sf):
    return sq.attack_episodes(events(spark, sf), 86_400_000)


@query("ed7_error_concentration", with_ctes("SELECT f AS fraction, CAST(ceil(f * (SELECT count(*) FROM seq0)) AS BIGINT) AS rows, " + r("(SELECT sum(flows) FROM (SELECT flows, row_number() OVER (ORDER BY flows DESC) AS rn FROM seq0) WHERE rn <= ceil(f * (SELECT count(*) FROM seq0))) / (SELECT sum(flows) FROM seq0)", "share") + " FROM (VALUES (CAST(0.01 AS DOUBLE)), (CAST(0.1 AS DOUBLE))) AS t(f)", "seq0"))
def ed7(spark, sf):
    losses = sq.sequence_index(events(spark, sf)).select(F.col("flows").cast("double").alias("loss"))
    return rounded(sq.error_concentration(losses, [0.01, 0.1]))


@query("src5_rp12_geometries", with_ctes(" UNION ALL ".join(f"SELECT 'seq{s}_bucket{b}' AS geometry, split, count(*) AS sequences, count(*) FILTER (a > 0) AS positive_sequences, CAST(sum(n) AS BIGINT) AS flows, CAST(sum(a) AS BIGINT) AS attack_flows, count(DISTINCT ipv4_src_addr) AS sources FROM (SELECT ipv4_src_addr, flow_start_milliseconds - flow_start_milliseconds % {s * 1000} AS w, count(*) AS n, sum(label) AS a, CASE WHEN (flow_start_milliseconds // {s * 1000}) % 5 < 3 THEN 'train' WHEN (flow_start_milliseconds // {s * 1000}) % 5 = 3 THEN 'validation' ELSE 'test' END AS split FROM flows GROUP BY ALL) GROUP BY 2" for s, b in ((86400, 8640), (43200, 4320))), "flows"))
def rp12(spark, sf):
    from flowlens.operators.diagnostics import geometry_index

    grids = geometries([{"sequence_seconds": 86400, "bucket_seconds": 8640}, {"sequence_seconds": 43200, "bucket_seconds": 4320}])

    out = None
    for grid in grids:
        turn = F.pmod(F.floor(F.col("window_start_ms") / grid.window_ms), F.lit(5))
        name = F.when(turn < 3, "train").when(turn == 3, "validation").otherwise("test")
        one = geometry_index(src.event_flows(spark, sf), [grid], lambda s, name=name: s.withColumn("split", name))
        out = one if out is None else out.unionByName(one)
    return out


@query("snk5_flow_metadata", with_ctes("SELECT sequence_id AS sample_id, flows AS total_flows, attack_flows, CASE WHEN attack_flows > 0 THEN 1 ELSE 0 END AS y FROM fold WHERE fold = 2", "fold"))
def snk5(spark, sf):
    s = folded(spark, sf).withColumn("split", F.when(F.col("fold") == 2, "test").otherwise("train"))
    samples = s.select(F.col("sequence_id").alias("sample_id"), "split", (F.col("attack_flows") > 0).cast("int").alias("y"))
    return sinks.flow_metadata(samples, s, "test")


@query("snk9_attack_subsets", with_ctes("SELECT subset, count(*) AS n, count(*) FILTER (primary_attack = 'Benign') AS benign FROM (SELECT primary_attack AS subset, primary_attack FROM seq WHERE attack_flows > 0 UNION ALL SELECT t.subset, s.primary_attack FROM seq s, (SELECT DISTINCT primary_attack AS subset FROM seq WHERE attack_flows > 0) t WHERE s.attack_flows = 0) GROUP BY 1", "seq"))
def snk9(spark, sf):
    s = sequences(spark, sf).withColumn("y", (F.col("attack_flows") > 0).cast("int"))
    return sinks.attack_subsets(s).groupBy("subset").agg(F.count("*").alias("n"), F.sum((F.col("primary_attack") == "Benign").cast("bigint")).alias("benign"))


@query("j10_label_provenance", with_ctes("SELECT count(*) AS compared, count(*) FILTER (raw_rowid % 101 = 0 AND raw_rowid % 103 <> 0) AS not_staged, count(*) FILTER (raw_rowid % 103 = 0 AND raw_rowid % 101 <> 0) AS not_in_source, count(*) FILTER (raw_rowid % 107 = 0 AND raw_rowid % 101 <> 0 AND raw_rowid % 103 <> 0) AS labels_differ FROM flows WHERE NOT (raw_rowid % 101 = 0 AND raw_rowid % 103 = 0)", "flows"))
def j10(spark, sf):
    """With planted faults, by row id: rows that are not staged, rows that the source lacks, and other labels."""
    staged = events(spark, sf).where("raw_rowid % 101 <> 0").withColumn("label", F.expr("CASE WHEN raw_rowid % 107 = 0 THEN 1 - label ELSE label END"))
    return dq.label_provenance(staged, src.event_flows(spark, sf).where("raw_rowid % 103 <> 0"))
