"""Sequences: flows of one source host inside one window (AG1-AG3, AG19, W15, J1, SRC4, ED1-ED6)."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.arrays import SEQ_KEY
from flowlens.functions.grid import MAX_BUCKETS, TemporalGrid, on_grid
from flowlens.operators.ordering import numbered, running_sums

KEYS = list(SEQ_KEY)


def events_on_grid(flows: DataFrame, grid: TemporalGrid) -> DataFrame:
    """Flows with source_ip, window_start_ms and bucket: the staged events."""
    return on_grid(flows.withColumn("source_ip", F.col("ipv4_src_addr")), grid)


def sequence_index(events: DataFrame) -> DataFrame:
    """AG1."""
    start = "flow_start_milliseconds"
    return events.groupBy(*KEYS).agg(
        F.count("*").alias("flows"),
        F.sum("label").alias("attack_flows"),
        F.countDistinct("bucket").alias("active_buckets"),
        F.min(start).alias("first_ms"),
        F.max(start).alias("last_ms"),
        F.max("flow_end_milliseconds").alias("max_end_ms"),
    )


def sequence_attacks(events: DataFrame) -> DataFrame:
    """AG2: attack flows of each sequence by type."""
    return events.where("label = 1").groupBy(*KEYS, "attack").agg(F.count("*").alias("flows"))


def primary_attack(events: DataFrame) -> DataFrame:
    """AG1 with AG3: the type with most attack flows, ties by name; Benign without any.

    Totals are numbers of fixed width (occupied buckets are bits, of which a grid has at most MAX_BUCKETS), so that they
    are hashed in place; only attack flows are grouped by type and ordered by name.
    """
    start, bad = "flow_start_milliseconds", (F.col("label") == 1) & F.col("attack").isNotNull()
    words = range(-(-MAX_BUCKETS // 64))
    bit = lambda w: F.when(F.floor(F.col("bucket") / 64) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("bucket") - 64 * w))
    total = events.groupBy(*KEYS).agg(
        F.count("*").alias("flows"),
        F.sum(F.when(bad, 1).otherwise(0)).alias("attack_flows"),
        F.min(start).alias("first_ms"),
        F.max(start).alias("last_ms"),
        F.max("flow_end_milliseconds").alias("max_end_ms"),
        *(F.bit_or(bit(w)).alias(f"_b{w}") for w in words),
    )
    occupied = sum((F.coalesce(F.bit_count(f"_b{w}"), F.lit(0)) for w in words), F.lit(0)).cast("bigint")
    kinds = events.where(bad).groupBy(*KEYS, "attack").agg(F.count("*").alias("n"))
    best = kinds.groupBy(*KEYS).agg(F.min(F.struct((-F.col("n")).alias("n"), "attack"))["attack"].alias("_best"))
    same = [total[k].eqNullSafe(best[k]) for k in KEYS]
    return total.join(best, reduce(and_, same), "left").select(*(total[k] for k in KEYS), "flows", "attack_flows", occupied.alias("active_buckets"), "first_ms", "last_ms", "max_end_ms", F.coalesce("_best", F.lit("Benign")).alias("primary_attack"))


def dense_ids(sequences: DataFrame, order: list[str] | None = None, name: str = "sequence_id") -> DataFrame:
    """1..N in (source, window) order.

    Rows are dealt out by range, so that no task sees all of them.
    """
    return numbered(sequences, [], order or KEYS, name)


def join_sequences(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Events with the columns of their sequence."""
    new = [c for c in sequences.columns if c in KEYS or c not in events.columns]
    return events.join(sequences.select(new), KEYS)


def reconcile(flows: DataFrame, sequences: DataFrame, events: DataFrame) -> DataFrame:
    """SRC4: flows and attack flows before and after grouping, and whether they agree."""
    a = flows.agg(F.count("*").alias("raw_flows"), F.sum("label").alias("raw_attacks"))
    b = sequences.agg(F.sum("flows").alias("sequence_flows"), F.sum("attack_flows").alias("sequence_attacks"))
    c = events.agg(F.count("*").alias("event_flows"), F.sum("label").alias("event_attacks"))
    same = (F.col("raw_flows") == F.col("sequence_flows")) & (F.col("raw_flows") == F.col("event_flows")) & (F.col("raw_attacks") == F.col("sequence_attacks")) & (F.col("raw_attacks") == F.col("event_attacks"))
    return a.crossJoin(b).crossJoin(c).withColumn("agree", same)  # one row each


def split_composition(sequences: DataFrame) -> DataFrame:
    """AG19."""
    return sequences.groupBy("split").agg(F.count("*").alias("sequences"), F.sum((F.col("attack_flows") > 0).cast("bigint")).alias("positive_sequences"), F.sum("flows").alias("flows"), F.sum("attack_flows").alias("attack_flows"), F.countDistinct("source_ip").alias("sources"))


def window_class(flows: Column, attacks: Column) -> Column:
    """Attack only, benign only, or both."""
    return F.when(attacks == 0, "benign").when(attacks == flows, "attack").otherwise("hybrid")


def attack_inventory(events: DataFrame) -> DataFrame:
    """ED1 (meaning inferred from the column names of a result table): each type's flows, hosts, windows."""
    both = sequence_index(events).select(*KEYS, window_class(F.col("flows"), F.col("attack_flows")).alias("kind"))
    bad = events.where("label = 1")
    per = bad.groupBy("attack", *KEYS).agg(F.count("*").alias("n")).join(both, KEYS)
    dst = bad.select("attack", "ipv4_dst_addr").distinct().groupBy("attack").agg(F.count("ipv4_dst_addr").alias("destinations"))
    hybrid = F.sum((F.col("kind") == "hybrid").cast("bigint"))
    return per.groupBy("attack").agg(F.sum("n").alias("flows"), F.countDistinct("source_ip").alias("sources"), F.count("*").alias("windows"), hybrid.alias("hybrid_windows"), (hybrid / F.count("*")).alias("hybrid_share")).join(dst, "attack")


def daily_sources(events: DataFrame) -> DataFrame:
    """ED2 (inferred): by day, sources and flows and active buckets of either class."""
    day = F.col("flow_start_milliseconds") - F.pmod(F.col("flow_start_milliseconds"), F.lit(86_400_000))
    rows = events.withColumn("day_ms", day)
    buckets = rows.groupBy("day_ms", "source_ip", "window_start_ms", "bucket").agg(F.count("*").alias("n"), F.sum("label").alias("a"))
    return buckets.groupBy("day_ms").agg(F.countDistinct("source_ip").alias("sources"), F.sum("n").alias("flows"), F.sum("a").alias("attack_flows"), F.count("*").alias("buckets"), F.sum((F.col("a") > 0).cast("bigint")).alias("attack_buckets"))


def occupancy(sequences: DataFrame) -> DataFrame:
    """ED3 (inferred): sequences by class and active buckets, with the share inside the class."""
    rows = sequences.groupBy(window_class(F.col("flows"), F.col("attack_flows")).alias("kind"), "active_buckets").agg(F.count("*").alias("sequences"))
    return rows.withColumn("share", F.col("sequences") / F.sum("sequences").over(Window.partitionBy("kind")))


def window_scales(flows: DataFrame, seconds: list[int], buckets: int = 10) -> DataFrame:
    """ED4 (inferred): non-empty, attack and hybrid windows of several durations, in one pass."""
    rows = flows.select("ipv4_src_addr", "flow_start_milliseconds", "label", F.explode(F.array(*(F.lit(s) for s in seconds))).alias("seconds"))
    w = F.col("seconds") * 1000
    start = F.col("flow_start_milliseconds")
    at = rows.groupBy("seconds", "ipv4_src_addr", (start - F.pmod(start, w)).alias("window"), ((F.pmod(start, w) - F.pmod(F.pmod(start, w), w / buckets)) / (w / buckets)).cast("int").alias("bucket")).agg(F.count("*").alias("n"), F.sum("label").alias("a"))
    per = at.groupBy("seconds", "ipv4_src_addr", "window").agg(F.sum("n").alias("n"), F.sum("a").alias("a"), F.count("*").alias("active"))
    return per.groupBy("seconds").agg(F.count("*").alias("windows"), F.sum((F.col("a") > 0).cast("bigint")).alias("positive_windows"), F.sum(((F.col("a") > 0) & (F.col("a") < F.col("n"))).cast("bigint")).alias("hybrid_windows"), F.sum((F.col("active") == 1).cast("bigint")).alias("single_bucket_windows"), F.avg("n").alias("mean_flows"))


def attack_episodes(events: DataFrame, gap_ms: int = 300_000) -> DataFrame:
    """ED6 (inferred): runs of attack flows of one source and type without a gap over ``gap_ms``.

    The start before another is in the same bin of ``gap_ms`` or in the one before, else the gap is wider; so order
    inside a bin and the bins' last starts tell where episodes begin. Episodes are numbered over ranges of time.
    """
    who, start = ["source_ip", "attack"], "flow_start_milliseconds"
    starts = events.where("label = 1").groupBy(*who, F.col(start).alias("t")).agg(F.count("*").alias("n")).withColumn("bin", F.floor(F.col("t") / gap_ms))
    last = starts.groupBy(*who, (F.col("bin") + 1).alias("bin")).agg(F.max("t").alias("last"))
    rows = starts.join(last, [*who, "bin"], "left").withColumn("before", F.lag("t").over(Window.partitionBy(*who, "bin").orderBy("t")))
    begins = F.coalesce((F.col("t") - F.coalesce("before", "last") > gap_ms).cast("int"), F.lit(1))
    rows = running_sums(rows.select(*who, "t", "n", begins.alias("new")), who, ["t"], {"episode": F.col("new")})
    return rows.groupBy(*who, "episode").agg(F.sum("n").alias("flows"), F.min("t").alias("first_ms"), F.max("t").alias("last_ms"))


def error_concentration(errors: DataFrame, fractions: list[float], loss: str = "loss", key: str = "sample_id") -> DataFrame:
    """ED7: share of the total loss that the worst ceil(f n) rows hold.

    Losses are grouped before the running sums, so that the ordered table is one row for each value.
    """
    values = errors.groupBy(loss).agg(F.count("*").alias("c"))
    runs = running_sums(values, [], [F.desc(loss)], {"_to": F.col("c")}).withColumn("_from", F.col("_to") - F.col("c"))
    total = errors.agg(F.count("*").alias("n"), F.sum(loss).alias("total"))
    cuts = errors.sparkSession.createDataFrame([(float(f),) for f in fractions], "fraction double").crossJoin(total).withColumn("rows", F.ceil(F.col("fraction") * F.col("n")))
    held = runs.crossJoin(F.broadcast(cuts)).where("_from < rows")  # a row for each fraction
    taken = F.least(F.col("c"), F.col("rows") - F.col("_from"))
    return held.groupBy("fraction", "rows").agg((F.sum(taken * F.col(loss)) / F.first("total")).alias("share"))


def candidate_splits(sequences: DataFrame, seed: int = 1, day_ms: int = 86_400_000) -> DataFrame:
    """ED5 (inferred): attack types and sequences of each part under several ways to split.

    random: by sequence; chronological: by day order; shuffled_days and 15, 30, 60 minute blocks: by
    the seeded key of the block. Parts hold about 60, 20 and 20 %.
    """
    from flowlens.functions.scalars import seeded_key

    part = lambda x: F.when(x < 6, "train").when(x < 8, "validation").otherwise("test")
    start = F.col("window_start_ms")
    block = lambda ms: (start - F.pmod(start, F.lit(ms))) / ms
    days = sequences.agg(F.min(start).alias("lo"), F.max(start).alias("hi"))
    rows = sequences.crossJoin(F.broadcast(days))  # one row
    ways = F.create_map(
        F.lit("random"), part(seeded_key(seed, F.concat_ws("|", "source_ip", "window_start_ms")) % 10),
        F.lit("chronological"), part(F.floor((start - F.col("lo")) * 10 / (F.col("hi") - F.col("lo") + 1))),
        F.lit("shuffled_days"), part(seeded_key(seed, block(day_ms).cast("bigint")) % 10),
        *(x for m in (15, 30, 60) for x in (F.lit(f"block_{m}min"), part(seeded_key(seed, block(m * 60_000).cast("bigint")) % 10))),
    )
    rows = rows.select("primary_attack", "attack_flows", F.explode(ways).alias("way", "part"))
    return rows.groupBy("way", "part").agg(F.count("*").alias("sequences"), F.countDistinct(F.when(F.col("attack_flows") > 0, F.col("primary_attack"))).alias("attack_types"))
