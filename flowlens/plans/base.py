"""Views that many queries share, as DataFrames and as DuckDB common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions.grid import TemporalGrid
from flowlens.functions.scalars import seeded_key
from flowlens.operators import features as ft
from flowlens.operators import ordering
from flowlens.operators import sequences as sq
from flowlens.operators import split as sp
from flowlens.sources.flows import event_flows, view_sql
from flowlens.storage import discard, materialise

#: The driver's events are sparse: windows of a day in ten buckets, time blocks of two windows.
GRID = TemporalGrid(86_400, 8_640)
BLOCK = 2 * GRID.window_ms
EMBARGO = GRID.bucket_ms
ATTACK_TYPES = ("Type0", "Type1", "Type2", "Type3")

KEY = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"


def key_sql(text: str) -> str:
    """The seeded key of a text expression."""
    return KEY.format(text)


_PARTS = {
    "flows": view_sql(extra=True),
    "g": f"SELECT *, ipv4_src_addr AS source_ip, flow_start_milliseconds - flow_start_milliseconds % {GRID.window_ms} AS window_start_ms, CAST((flow_start_milliseconds % {GRID.window_ms}) // {GRID.bucket_ms} AS INTEGER) AS bucket FROM flows",
    "seq0": "SELECT source_ip, window_start_ms, count(*) AS flows, CAST(sum(label) AS BIGINT) AS attack_flows, count(DISTINCT bucket) AS active_buckets, min(flow_start_milliseconds) AS first_ms, max(flow_start_milliseconds) AS last_ms, max(flow_end_milliseconds) AS max_end_ms FROM g GROUP BY 1, 2",
    "att": "SELECT source_ip, window_start_ms, attack, count(*) AS flows FROM g WHERE label = 1 GROUP BY 1, 2, 3",
    "prim": "SELECT source_ip, window_start_ms, attack AS primary_attack FROM att QUALIFY row_number() OVER (PARTITION BY source_ip, window_start_ms ORDER BY flows DESC, attack) = 1",
    "seq": "SELECT s.*, coalesce(p.primary_attack, 'Benign') AS primary_attack FROM seq0 s LEFT JOIN prim p USING (source_ip, window_start_ms)",
    "ids": "SELECT *, row_number() OVER (ORDER BY source_ip, window_start_ms) AS sequence_id FROM seq",
    "fold": f"SELECT *, CASE WHEN k < 6 THEN 0 WHEN k < 8 THEN 1 ELSE 2 END AS fold FROM (SELECT *, {key_sql(f'{chr(39)}1:{chr(39)} || (window_start_ms - window_start_ms % {BLOCK})')} % 10 AS k FROM ids)",
    "bounds": "SELECT window_start_ms AS boundary_ms FROM (SELECT window_start_ms, fold, lag(fold) OVER (ORDER BY window_start_ms) AS pf FROM (SELECT DISTINCT window_start_ms, fold FROM fold)) WHERE pf <> fold",
    "kept": f"SELECT f.* EXCLUDE (fold, k), f.fold AS assigned, n.near + 2 * c.cross_ AS reason, CASE WHEN n.near + 2 * c.cross_ <> 0 THEN 3 ELSE f.fold END AS fold FROM fold f JOIN (SELECT source_ip, window_start_ms, CAST(EXISTS (SELECT 1 FROM bounds b WHERE b.boundary_ms > x.window_start_ms - {EMBARGO} AND b.boundary_ms < greatest(x.window_start_ms + {GRID.window_ms}, x.max_end_ms + 1) + {EMBARGO}) AS INTEGER) AS near FROM fold x) n USING (source_ip, window_start_ms) JOIN (SELECT source_ip, window_start_ms, CAST(EXISTS (SELECT 1 FROM (SELECT DISTINCT window_start_ms AS o, fold AS of_ FROM fold) o WHERE o.o > x.first_ms - {GRID.window_ms} AND o.o <= x.max_end_ms AND o.of_ <> x.fold) AS INTEGER) AS cross_ FROM fold x) c USING (source_ip, window_start_ms)",
    "runs": "SELECT * FROM (VALUES ('base', 1), ('base', 2), ('base', 3), ('alt', 1), ('alt', 2), ('alt', 3), ('fine', 1), ('fine', 2)) AS t(model, seed)",
    "pred": "SELECT model, seed, sequence_id AS sample_id, source_ip AS source_host, window_start_ms, flows, attack_flows, active_buckets, primary_attack, y, CASE WHEN model = 'fine' THEN CAST(h % 600000 + 400000 * y AS DOUBLE) / 1000000 ELSE CAST((60 * (h % 10000)) // 10000 + 40 * y AS DOUBLE) / 100 END AS score FROM (SELECT *, CASE WHEN attack_flows > 0 THEN 1 ELSE 0 END AS y, " + key_sql("model || ':' || seed || ':' || sequence_id") + " AS h FROM ids, runs)",
    "counts": "SELECT model, seed, score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS n FROM pred GROUP BY 1, 2, 3",
    "curve": "SELECT *, tp * 1.0 / positives AS tpr, fp * 1.0 / negatives AS fpr, tp * 1.0 / (tp + fp) AS precision FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model, seed) AS positives, sum(n) OVER (PARTITION BY model, seed) AS negatives FROM counts WINDOW w AS (PARTITION BY model, seed ORDER BY score DESC ROWS UNBOUNDED PRECEDING))",
    "points": "SELECT * FROM (VALUES ('fpr_1pct', 0.01), ('fpr_0.1pct', 0.001)) AS t(point, budget)",
    "thr": "SELECT model, seed, point, arg_max(score, tpr * 1000 + score) AS threshold FROM (SELECT c.*, point FROM curve c, points WHERE fpr <= budget) GROUP BY 1, 2, 3 HAVING max(tpr) > 0 UNION ALL SELECT model, seed, 'default_0.5', 0.5 FROM runs",
}


def curve_ctes(rows: str, tag: str) -> str:
    """CTEs c<tag>, curve<tag> and thr<tag> (with reject_all) of the score table ``rows``."""
    return (
        f"c{tag} AS (SELECT model, seed, score, CAST(sum(y) AS BIGINT) AS p, CAST(sum(1 - y) AS BIGINT) AS n FROM {rows} GROUP BY 1, 2, 3), "
        f"curve{tag} AS (SELECT *, tp * 1.0 / positives AS tpr, fp * 1.0 / negatives AS fpr, tp * 1.0 / (tp + fp) AS precision FROM (SELECT *, sum(p) OVER w AS tp, sum(n) OVER w AS fp, sum(p) OVER (PARTITION BY model, seed) AS positives, sum(n) OVER (PARTITION BY model, seed) AS negatives FROM c{tag} WINDOW w AS (PARTITION BY model, seed ORDER BY score DESC ROWS UNBOUNDED PRECEDING))), "
        f"top{tag} AS (SELECT model, seed, max(score) AS top FROM c{tag} GROUP BY 1, 2), "
        f"best{tag} AS (SELECT model, seed, point, arg_max(score, tpr * 1000 + score) AS score, max(tpr) AS tpr FROM curve{tag}, points WHERE fpr <= budget GROUP BY 1, 2, 3), "
        f"thr{tag} AS (SELECT t.model, t.seed, p.point, CASE WHEN coalesce(b.tpr, 0) = 0 THEN t.top + abs(t.top) * 2.220446049250313e-16 ELSE b.score END AS threshold, coalesce(b.tpr, 0) = 0 AS reject_all FROM top{tag} t CROSS JOIN points p LEFT JOIN best{tag} b ON b.model = t.model AND b.seed = t.seed AND b.point = p.point UNION ALL SELECT model, seed, 'default_0.5', 0.5, false FROM top{tag})"
    )


_NEEDS = {"g": ["flows"], "seq0": ["g"], "att": ["g"], "prim": ["att"], "seq": ["seq0", "prim"], "ids": ["seq"], "fold": ["ids"], "bounds": ["fold"], "kept": ["fold", "bounds"], "pred": ["ids", "runs"], "counts": ["pred"], "curve": ["counts"], "thr": ["curve", "points", "runs"]}


def with_ctes(body: str, *names: str) -> str:
    """``body`` after the common table expressions ``names`` and what they need."""
    order: list[str] = []

    def add(n: str) -> None:
        for m in _NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({_PARTS[n]})" if n not in ("runs", "points") else f"{n} AS ({_PARTS[n]})" for n in order)
    return f"WITH {ctes}{', ' if body.startswith('+') else ' '}{body.lstrip('+')}"


_SHARED: dict[tuple[str, str, str], DataFrame] = {}


def shared(f):
    """Keep a view for the queries of one session: computed once and written, until ``release``.

    It is written because plans over kept views that stand on each other hold the plans of all of them, once for each
    use, and the driver prints the whole with each step of a query.
    """

    def get(spark: SparkSession, sf: str) -> DataFrame:
        key = (spark.sparkContext.applicationId, sf, f.__name__)
        if key not in _SHARED:
            _SHARED[key] = materialise(f(spark, sf), f.__name__.strip("_"))
        return _SHARED[key]

    return get


def release() -> None:
    """Let go of the kept views and of what their operators keep."""
    while _SHARED:
        discard(_SHARED.popitem()[1])
    ordering.release()


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Every column is a short expression of one row, so that reading the table again costs less than writing all of them."""
    return sq.events_on_grid(event_flows(spark, sf, extra=True), GRID)


@shared
def sequences(spark: SparkSession, sf: str) -> DataFrame:
    return sq.primary_attack(events(spark, sf))


@shared
def with_ids(spark: SparkSession, sf: str) -> DataFrame:
    return sq.dense_ids(sequences(spark, sf))


def attacks(spark: SparkSession, sf: str) -> DataFrame:
    return sq.sequence_attacks(events(spark, sf))


@shared
def folded(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences with the label-free fold of their time block."""
    return sp.hash_folds(with_ids(spark, sf), 1, BLOCK)


@shared
def statistics(spark: SparkSession, sf: str) -> DataFrame:
    """The 82 features of every bucket, with the fold of its sequence."""
    return ft.bucket_stats(events(spark, sf), folded(spark, sf).select(*sq.KEYS, "fold"))


@shared
def purged(spark: SparkSession, sf: str) -> DataFrame:
    return sp.exclude_boundaries(folded(spark, sf), GRID.window_ms, EMBARGO, BLOCK)


@shared
def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """Scores of eight runs: whole-number draws, so that both engines agree. Ties occur, but hardly in the runs "fine"."""
    runs = spark.createDataFrame([(m, s) for m, n in (("base", 3), ("alt", 3), ("fine", 2)) for s in range(1, n + 1)], "model string, seed int")
    rows = with_ids(spark, sf).crossJoin(F.broadcast(runs)).withColumn("y", (F.col("attack_flows") > 0).cast("int"))  # eight rows
    text = F.concat_ws(":", "model", F.col("seed").cast("string"), F.col("sequence_id").cast("string"))
    draw = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("bigint")
    coarse = (F.floor(60 * (draw % 10000) / 10000) + 40 * F.col("y")).cast("double") / 100
    score = F.when(F.col("model") == "fine", (draw % 600_000 + 400_000 * F.col("y")).cast("double") / 1_000_000).otherwise(coarse)
    return rows.select("model", "seed", F.col("sequence_id").alias("sample_id"), F.col("source_ip").alias("source_host"), "window_start_ms", "flows", "attack_flows", "active_buckets", "primary_attack", "y", score.alias("score"))


def hits(spark: SparkSession, sf: str, model: str = "base", seed: int = 1, at: float = 0.7) -> DataFrame:
    """Positives of one run with whether a fixed threshold detects them."""
    return predictions(spark, sf).where((F.col("model") == model) & (F.col("seed") == seed) & (F.col("y") == 1)).withColumn("hit", F.col("score") >= at)


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/embeddings.parquet")


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, for comparison between engines; -0.0 becomes 0.0."""
    return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


