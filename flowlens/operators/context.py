"""Past context of anchors in several window geometries, by running counts (J7, RP11).

What an anchor's span [end - context, end) holds is a difference of two running counts of its host, looked up at the
two ends. Flows are counted on the time step of the ends first, occupied buckets once each; counts and look-ups then
form one order by (series, host, time), which is dealt out by ranges. So the work is one row for each host and
step, and a few for each anchor and geometry: no flow is joined to an anchor, and no task sees a host whole.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.operators.ordering import running_sums
from flowlens.operators.quantiles import group_quantiles
from flowlens.storage import materialise

#: Past context and bucket, in multiples of the anchor's window and bucket.
GEOMETRIES = ((1, 1), (1, 2), (2, 1), (2, 2), (4, 1), (4, 2), (4, 4))
FLOWS, TARGET, FOREIGN, BLOCKS = "flows", "target", "foreign", "blocks"
START = "flow_start_milliseconds"


def _floor(t: Column, step: int, phase: Column | int = 0) -> Column:
    return t - F.pmod(t - phase, F.lit(step))


def _bucket_series(bucket_ms: Column | int, phase: Column) -> Column:
    return F.concat_ws(":", F.lit("bucket"), F.lit(bucket_ms) if isinstance(bucket_ms, int) else bucket_ms, phase)


def range_counts(points: DataFrame, wanted: DataFrame, sums: list[str], keys: list[str]) -> DataFrame:
    """``wanted`` (keys, lo, hi and more) with the sums of ``points`` (keys, t, sums) that have lo <= t < hi.

    ``points`` has a row for each key and time. Both ends are looked up in one running order over points and ends.
    """
    ends = wanted.select(*keys, F.explode(F.array("lo", "hi")).alias("t")).distinct()
    rows = points.select(*keys, "t", F.lit(1).alias("kind"), *sums).unionByName(ends.select(*keys, "t", F.lit(0).alias("kind"), *(F.lit(0).cast("bigint").alias(s) for s in sums)))
    found = running_sums(rows, keys, ["t", "kind"], {f"to_{s}": F.col(s) for s in sums}).where("kind = 0")
    found = materialise(found.select(*keys, "t", *(f"to_{s}" for s in sums)), "ends")
    out = wanted
    for end in ("lo", "hi"):
        out = out.join(found.select(*keys, F.col("t").alias(end), *(F.col(f"to_{s}").alias(f"{end}_{s}") for s in sums)), [*keys, end])
    return out.select(*wanted.columns, *((F.col(f"hi_{s}") - F.col(f"lo_{s}")).alias(s) for s in sums))


def _points(flows: DataFrame, sequences: DataFrame, step: int, buckets: dict[int, list[int]], split: str, block_ms: int) -> DataFrame:
    """(series, host, t, n, bad): flows and attacks, attack flows by type, foreign sequences, blocks of the split, occupied buckets."""
    host, t = F.col("ipv4_src_addr").alias("host"), _floor(F.col(START), step).alias("t")
    n, none = F.count("*").alias("n"), F.lit(0).cast("bigint").alias("bad")
    by_type = flows.where("label = 1").groupBy(host, t, "attack").agg(n).select(F.concat_ws(":", F.lit(TARGET), "attack").alias("series"), "host", "t", "n", none)
    every = flows.groupBy(host, t).agg(n, F.sum("label").alias("bad")).select(F.lit(FLOWS).alias("series"), "host", "t", "n", "bad")
    foreign = sequences.where(F.col("split") != split).groupBy(F.col("source_ip").alias("host"), F.col("window_start_ms").alias("t")).agg(n).select(F.lit(FOREIGN).alias("series"), "host", "t", "n", none)
    blocks = sequences.where(F.col("assigned_split") == split).select(_floor(F.col("window_start_ms"), block_ms).alias("t")).distinct().select(F.lit(BLOCKS).alias("series"), F.lit("").alias("host"), "t", F.lit(1).cast("bigint").alias("n"), none)
    grids = F.array(*(F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(p).cast("bigint").alias("p")) for b, ps in buckets.items() for p in ps))
    held = flows.select(host, F.col(START).alias("at"), F.explode(grids).alias("g")).select("host", F.col("g.b").alias("b"), F.col("g.p").alias("p"), (F.col("at") - F.pmod(F.col("at") - F.col("g.p"), F.col("g.b"))).alias("at")).distinct()
    held = held.groupBy(_bucket_series(F.col("b"), F.col("p")).alias("series"), "host", _floor(F.col("at"), step).alias("t")).agg(n).select("series", "host", "t", "n", none)
    return every.unionByName(by_type).unionByName(foreign).unionByName(blocks).unionByName(held)


def context_availability(anchors: DataFrame, flows: DataFrame, sequences: DataFrame, window_ms: int, bucket_ms: int, split: str, block_ms: int, geometries: tuple[tuple[int, int], ...] = GEOMETRIES) -> DataFrame:
    """RP11: a row for each anchor and geometry that is open to it.

    ``anchors``: sample_id, source_ip, window_start_ms, attack_type, outcome, flows, attack_flows, active_buckets.
    ``sequences``: source_ip, window_start_ms, split (after the purge) and assigned_split (of the block). A context is
    open if every block that it touches is assigned to ``split`` and every sequence of the host inside is in it.
    ``common``: the longest context is open, so that geometries can be compared on the same anchors.
    """
    contexts = sorted({c for c, _ in geometries})
    step = gcd(window_ms, *(c * window_ms for c in contexts))
    buckets = {b * bucket_ms: sorted({(k * step) % (b * bucket_ms) for k in range(b * bucket_ms // gcd(step, b * bucket_ms))}) for b in sorted({b for _, b in geometries})}
    points = _points(flows, sequences, step, buckets, split, block_ms)
    table = F.array(*(F.struct(F.lit(c).alias("c"), F.lit(b).alias("b"), F.lit(c * window_ms).cast("bigint").alias("context_ms"), F.lit(b * bucket_ms).cast("bigint").alias("bucket_ms")) for c, b in geometries))
    end = F.col("window_start_ms") + window_ms
    spans = anchors.select("sample_id", F.col("source_ip").alias("host"), "attack_type", end.alias("hi"), F.explode(table).alias("g")).select("sample_id", "host", "attack_type", "hi", "g.*").withColumn("lo", F.col("hi") - F.col("context_ms"))
    once = spans.select("sample_id", "host", "attack_type", "c", "lo", "hi").distinct()
    whole_blocks = once.select("sample_id", "c", F.lit(0).alias("b"), F.lit(BLOCKS).alias("series"), F.lit("").alias("host"), _floor(F.col("lo"), block_ms).alias("lo"), "hi")
    per = lambda series: once.select("sample_id", "c", F.lit(0).alias("b"), series.alias("series"), "host", "lo", "hi")
    active = spans.select("sample_id", "c", "b", _bucket_series(F.col("bucket_ms"), F.pmod("lo", "bucket_ms")).alias("series"), "host", "lo", "hi")
    wanted = active.unionByName(per(F.lit(FLOWS))).unionByName(per(F.concat_ws(":", F.lit(TARGET), "attack_type"))).unionByName(per(F.lit(FOREIGN))).unionByName(whole_blocks)
    found = materialise(range_counts(points, wanted, ["n", "bad"], ["series", "host"]), "context")
    of = lambda series, c: F.coalesce(F.max(F.when(F.col("series") == series, F.col(c))), F.lit(0))
    covered = F.max(F.when(F.col("series") == BLOCKS, F.col("n") * block_ms >= F.col("hi") - F.col("lo")))
    counts = found.where("b = 0").groupBy("sample_id", "c").agg(of(FLOWS, "n").alias("in_flows"), of(FLOWS, "bad").alias("in_attacks"), F.coalesce(F.max(F.when(F.col("series").startswith(TARGET), F.col("n"))), F.lit(0)).alias("target_attack_flows"), (covered & (of(FOREIGN, "n") == 0)).alias("open"))
    longest = counts.where(F.col("c") == contexts[-1]).select("sample_id", F.col("open").alias("common"))
    rows = found.where("b > 0").select("sample_id", "c", "b", F.col("n").alias("active")).join(counts.where("open"), ["sample_id", "c"]).join(longest, "sample_id").join(anchors, "sample_id")
    share = F.col("c") * window_ms / (F.col("b") * bucket_ms)
    added, bad = F.col("in_flows") - F.col("flows"), F.col("in_attacks") - F.col("attack_flows")
    return rows.select(
        "sample_id", "attack_type", "outcome", (F.col("active_buckets") <= 2).alias("sparse"), "common", "c", "b",
        F.col("flows").alias("original_flows"), F.col("attack_flows").alias("original_attack_flows"), F.col("active_buckets").alias("original_active_buckets"),
        F.col("in_flows").alias("flows"), F.col("in_attacks").alias("attack_flows"), "target_attack_flows", F.col("active").alias("active_buckets"),
        (F.col("active") / share).alias("active_fraction"), (F.col("in_flows") / F.col("active")).alias("flows_per_active_bucket"), (F.col("in_attacks") / F.col("in_flows")).alias("attack_fraction"),
        added.alias("added_flows"), bad.alias("added_attack_flows"), (added - bad).alias("added_benign_flows"), (added > 0).alias("has_additional_flows"), ((F.col("attack_flows") == 0) & (F.col("in_attacks") > 0)).alias("benign_anchor_gains_attack"),
    )


MEDIANS = ("flows", "attack_flows", "target_attack_flows", "active_buckets", "active_fraction", "flows_per_active_bucket", "attack_fraction", "added_flows")


def paired_summary(rows: DataFrame) -> DataFrame:
    """RP11: medians and counts on anchors whose longest context is open, by type, outcome, sparsity and geometry.

    Each anchor counts under outcome "all" and its own, and under ``sparse_only`` false and, if it is sparse, true.
    """
    outcomes = F.array_distinct(F.array(F.lit("all"), F.col("outcome")))
    long = rows.where("common").withColumn("original_outcome", F.explode(outcomes)).where("original_outcome IN ('all', 'FN', 'TP')")
    long = long.withColumn("sparse_only", F.explode(F.when(F.col("sparse"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))))
    keys = ["attack_type", "original_outcome", "sparse_only", "c", "b"]
    count = lambda t: F.sum(F.when(t, 1).otherwise(0)).cast("bigint")
    counts = long.groupBy(*keys).agg(
        F.count("*").alias("anchors"), count(F.col("has_additional_flows")).alias("has_additional_flows_count"), count(F.col("benign_anchor_gains_attack")).alias("benign_anchor_gains_attack_count"),
        count(F.col("added_attack_flows") > 0).alias("gained_attack_flow_count"), count((F.col("added_flows") > 0) & (F.col("added_attack_flows") == 0)).alias("only_added_benign_count"),
    )
    return counts.join(group_quantiles(long, keys, {f"median_{m}": (m, 0.5) for m in MEDIANS}), keys)

