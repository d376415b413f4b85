"""Joins for diagnosis: context, collisions, neighbours, matched controls (J7-J14, RP12, RP13)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalars import canonical_zero, seeded_key
from flowlens.operators.neighbours import knn  # noqa: F401  (J12 stands in a module of its own)
from flowlens.operators.ordering import running_sums
from flowlens.operators.sequences import KEYS
from flowlens.storage import materialise


def past_context(anchors: DataFrame, sequences: DataFrame, window_ms: int, context_ms: int, block_ms: int, split: str) -> DataFrame:
    """Same-host sequences in [end - context, end) of each anchor.

    An anchor is kept only if every neighbour and every time block that the span touches belongs to the
    wanted split. Host and time bin are equi-keys, so a busy host is cut by time.
    """
    end = F.col("window_start_ms") + window_ms
    spans = anchors.select("source_ip", F.col("window_start_ms").alias("anchor_ms"), (end - context_ms).alias("lo"), end.alias("hi"))
    bins = F.explode(F.sequence(F.floor(F.col("lo") / block_ms), F.floor((F.col("hi") - 1) / block_ms)))
    spans = spans.withColumn("bin", bins)
    blocks = sequences.groupBy(F.floor(F.col("window_start_ms") / block_ms).alias("bin")).agg(F.max((F.col("split") != split).cast("int")).alias("foreign"))
    bad = spans.join(blocks.where("foreign = 1"), "bin", "left_semi").select("source_ip", "anchor_ms").distinct()
    near = sequences.withColumn("bin", F.floor(F.col("window_start_ms") / block_ms))
    found = spans.join(near, ["source_ip", "bin"]).where("window_start_ms >= lo AND window_start_ms < hi")
    return found.join(bad, ["source_ip", "anchor_ms"], "left_anti").drop("bin", "lo", "hi")


def signature(vector: str | list[str]):
    """Digest of a feature row with 0.0 for -0.0; equal rows have equal digests."""
    if isinstance(vector, str):
        return F.sha2(F.concat_ws(",", F.transform(vector, lambda v: canonical_zero(v.cast("double")).cast("string"))), 256)
    return F.sha2(F.concat_ws(",", *(canonical_zero(F.col(c).cast("double")).cast("string") for c in vector)), 256)


def exact_collisions(targets: DataFrame, pool: DataFrame, features: str | list[str], key: str = "sample_id", label: str = "y") -> DataFrame:
    """For each target, pool rows with an identical feature row and another label: count and least id."""
    a = targets.select(F.col(key).alias("target_id"), F.col(label).alias("_ty"), signature(features).alias("sig"))
    # pool rows with one signature and label are counted before the join
    b = pool.select(F.col(key).alias("_pid"), F.col(label).alias("_py"), signature(features).alias("sig")).groupBy("sig", "_py").agg(F.count("*").alias("_c"), F.min("_pid").alias("_least"))
    return a.join(b, "sig").where("_ty <> _py").groupBy("target_id").agg(F.sum("_c").alias("collisions"), F.min("_least").alias("example_id"))


def signature_matches(targets: DataFrame, train: DataFrame, features: str | list[str], key: str = "sample_id") -> DataFrame:
    """Training rows with the target's feature row: counts by sample type, both labels, weighted share.

    ``train``: sample_type, y, weight, primary_attack.
    """
    kinds = ("real_benign", "real_malicious", "synthetic_benign", "synthetic_malicious")
    b = train.withColumn("sig", signature(features))
    counts = [F.sum((F.col("sample_type") == k).cast("bigint")).alias(k) for k in kinds]
    per = b.groupBy("sig").agg(*counts, F.min("y").alias("_lo"), F.max("y").alias("_hi"), (F.sum(F.col("weight") * F.col("y")) / F.sum("weight")).alias("positive_share"), F.array_sort(F.collect_set(F.when(F.col("y") == 1, F.col("primary_attack")))).alias("attack_types"), F.min(key).alias("example_id"))
    a = targets.select(F.col(key).alias("target_id"), signature(features).alias("sig"))
    return a.join(per, "sig").select("target_id", *kinds, (F.col("_lo") != F.col("_hi")).alias("both_labels"), "positive_share", "attack_types", "example_id")


def ranked_values(events: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """(keys, field, place, value): the values of each field in order, places from 1, dealt out by ranges.

    Values are counted first, so that a value that many flows share is one row until its places are needed.
    """
    entries = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("value")) for f in fields)))
    counts = events.select(*keys, entries.alias("e")).select(*keys, "e.*").where("value IS NOT NULL").groupBy(*keys, "field", "value").agg(F.count("*").alias("n"))
    return running_sums(counts, [*keys, "field"], ["value"], {"last": F.col("n")}).withColumn("first", F.col("last") - F.col("n") + 1)


def field_differences(pairs: DataFrame, events: DataFrame, fields: list[str], left: list[str], right: list[str], keys: list[str] | None = None) -> DataFrame:
    """For each pair of sequences, the fields whose sorted values differ, and by how much at most.

    The largest gap is that of the values of one place; it is null where the numbers of values differ. Values of both sides are
    runs of places; where a run of either side begins, a running pass over the pair's runs carries the other side's value
    along. So the work is one row for each distinct value of a sequence, and no sequence is ever one row.
    """
    keys = keys or KEYS
    taken = [*left, *right]
    wanted = pairs.select(*taken).distinct()
    ends = wanted.select(*(F.col(n).alias(k) for k, n in zip(keys, left, strict=True))).union(wanted.select(*(F.col(n).alias(k) for k, n in zip(keys, right, strict=True)))).distinct()
    runs = materialise(ranked_values(events.join(ends, keys, "left_semi"), fields, keys).select(*keys, "field", "value", "first", "last"), "runs")
    side = lambda names, s: wanted.join(runs.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), "field", "value", "first", "last"), names).withColumn("side", F.lit(s))
    both = materialise(side(left, 0).unionByName(side(right, 1)), "sides")
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    sizes = both.groupBy(*taken, "field").agg(F.coalesce(F.max(of(0, "last")), F.lit(0)).alias("na"), F.coalesce(F.max(of(1, "last")), F.lit(0)).alias("nb"))
    gaps = _carried_gaps(both, [*taken, "field"])
    found = sizes.join(gaps, [*taken, "field"], "left").where("na <> nb OR gap > 0")
    return pairs.join(found, taken).select(*pairs.columns, "field", F.when(F.col("na") == F.col("nb"), F.col("gap")).alias("largest_difference"))


def _carried_gaps(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, gap): the largest difference of the two sides' values at one place.

    Both sides' runs are ordered by their first place. Inside a range a window carries each side's last value; what
    a range begins with is carried over a table with a row for each range and key.
    """
    ranged = materialise(runs.repartitionByRange(*keys, "first").withColumn("part", F.spark_partition_id()), "carried")  # runs of one place stay together
    value = lambda s: F.when(F.col("side") == s, F.col("value"))
    edges = ranged.groupBy("part", *keys).agg(*(F.max_by("value", F.when(F.col("side") == s, F.col("first"))).alias(f"end{s}") for s in (0, 1)))
    before = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    edges = edges.select("part", *keys, *(F.last(f"end{s}", True).over(before).alias(f"from{s}") for s in (0, 1)))
    within = Window.partitionBy("part", *keys).orderBy("first").rangeBetween(Window.unboundedPreceding, 0)
    carried = ranged.join(edges, ["part", *keys]).select(*keys, *(F.coalesce(F.last(value(s), True).over(within), F.col(f"from{s}")).alias(f"v{s}") for s in (0, 1)))
    return carried.groupBy(*keys).agg(F.max(F.abs(F.col("v0") - F.col("v1"))).alias("gap"))


def neighbour_profile(neighbours: DataFrame, labels: DataFrame, id_col: str, label: str, benign=0) -> DataFrame:
    """Benign share and same-label share among the neighbours, nearest of each, and their ratio."""
    own = labels.select(F.col(id_col).alias("query_id"), F.col(label).alias("_q"))
    other = labels.select(F.col(id_col).alias("neighbour_id"), F.col(label).alias("_n"))
    rows = neighbours.join(own, "query_id").join(other, "neighbour_id")
    out = rows.groupBy("query_id").agg(F.avg((F.col("_n") == benign).cast("double")).alias("benign_share"), F.avg((F.col("_n") == F.col("_q")).cast("double")).alias("same_share"), F.min(F.when(F.col("_n") == benign, F.col("distance"))).alias("nearest_benign"), F.min(F.when(F.col("_n") != benign, F.col("distance"))).alias("nearest_attack"))
    return out.withColumn("ratio", F.col("nearest_attack") / F.col("nearest_benign"))


def _nearest_counts(wanted: DataFrame, found: DataFrame, on: list[str]) -> DataFrame:
    """(on, ff, m): for each flow count ``ff`` of ``wanted`` the next entries (ff, tp_id) of ``found`` below and above.

    Counts are cut into bins of their logarithm, of which 64-bit counts have about a thousand: order inside a bin is a
    window over the bin, and what lies beyond it is carried over a table with a row for each bin.
    """
    binned = lambda t: t.withColumn("bin", F.floor(F.log2("ff") * 16))
    entry = F.struct("ff", "tp_id")
    rows = binned(found.select(*on, "ff", entry.alias("e"))).unionByName(binned(wanted.select(*on, "ff").distinct().withColumn("e", F.lit(None).cast("struct<ff:bigint,tp_id:bigint>"))))
    edges = rows.groupBy(*on, "bin").agg(F.min("e").alias("first"), F.max("e").alias("last"))
    order = Window.partitionBy(*on).orderBy("bin")
    edges = edges.select(*on, "bin", F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("below"), F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("above"))
    inner = Window.partitionBy(*on, "bin").orderBy("ff")
    rows = rows.withColumn("lower", F.last("e", True).over(inner.rangeBetween(Window.unboundedPreceding, 0))).withColumn("upper", F.first("e", True).over(inner.rangeBetween(0, Window.unboundedFollowing)))
    rows = rows.where("e IS NULL").join(edges, [*on, "bin"])
    return rows.select(*on, "ff", F.explode(F.array(F.coalesce("lower", "below"), F.coalesce("upper", "above"))).alias("m")).where("m IS NOT NULL")


def matched_controls(fn: DataFrame, tp: DataFrame, key: str = "sample_id") -> DataFrame:
    """For each missed positive the best detected one: same host, occupancy and flows within a factor
    of two; else same occupancy; else any. Cost is the difference of log2 flows, then the least id.

    Both sides are reduced to the flow counts of each (host, occupancy), (occupancy) and of all before they
    meet: for one count only the next lower and next higher one can win.
    """
    a = fn.select(F.col(key).alias("fn_id"), F.col("source_ip").alias("fh"), F.col("active_buckets").alias("fa"), F.col("flows").cast("bigint").alias("ff"))
    b = tp.groupBy(F.col("source_ip").alias("fh"), F.col("active_buckets").alias("fa"), F.col("flows").cast("bigint").alias("ff")).agg(F.min(F.col(key).cast("bigint")).alias("tp_id"))
    tiers = []
    for tier, on in ((0, ["fh", "fa"]), (1, ["fa"]), (2, [])):
        c = b.groupBy(*on, "ff").agg(F.min("tp_id").alias("tp_id"))
        rows = a.join(_nearest_counts(a, c, on), [*on, "ff"]).select("fn_id", "m", F.abs(F.log2("ff") - F.log2("m.ff")).alias("cost"), F.lit(tier).alias("tier"))
        tiers.append(rows.where("cost <= 1") if tier == 0 else rows)
    union = tiers[0].unionByName(tiers[1]).unionByName(tiers[2])
    best = union.groupBy("fn_id").agg(F.min(F.struct("tier", F.round("cost", 12).alias("cost"), F.col("m.tp_id").alias("tp_id"))).alias("b"))
    return best.select("fn_id", "b.tp_id", "b.tier", "b.cost")


def case_control(positives: DataFrame, negatives: DataFrame, seed: int, random_n: int, per_case: int = 2, key: str = "sample_id") -> DataFrame:
    """All positives, ``random_n`` benign ones, and up to two benign matches each, with their roles.

    Matches share host, active buckets and floor(log2(flows)); of those, the first in seeded order.
    """
    volume = F.floor(F.log2("flows")).cast("int")
    order = [seeded_key(seed, F.col(key)), F.col(key)]
    cases = positives.select(F.col(key), F.lit("positive").alias("role"))
    drawn = negatives.orderBy(*order).limit(random_n).select(F.col(key), F.lit("random").alias("role"))
    match = ["source_ip", "active_buckets", "_v"]
    wanted = positives.withColumn("_v", volume).groupBy(*match).agg((F.count("*") * per_case).alias("_most"))
    ranked = negatives.withColumn("_v", volume).join(wanted, match).withColumn("_r", F.row_number().over(Window.partitionBy(*match).orderBy(*order)))
    matched = ranked.where("_r <= _most").select(F.col(key), F.lit("matched").alias("role"))
    return cases.union(drawn).union(matched).groupBy(key).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("roles"))


def _stacked(frames: Iterator[DataFrame]) -> DataFrame:
    out = next(frames)
    for f in frames:
        out = out.unionByName(f)
    return out


def geometry_index(flows: DataFrame, grids: list, fold) -> DataFrame:
    """RP12: sequences, positives and flows by geometry and split; ``fold`` maps sequences to ones with ``split``."""
    from flowlens.operators.sequences import events_on_grid, sequence_index, split_composition

    return _stacked(split_composition(fold(sequence_index(events_on_grid(flows, g)))).withColumn("geometry", F.lit(g.name)) for g in grids)


def temporal_comparison(tables: dict[str, DataFrame], focus: list[str]) -> DataFrame:
    """RP13: recall of focus attacks by geometry and operating point, unpaired."""
    return _stacked(t.where(F.col("primary_attack").isin(*focus)).withColumn("geometry", F.lit(n)) for n, t in tables.items())
