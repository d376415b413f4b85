"""Operator 12: hard negatives by blocks in Hilbert order, with zone maps.

Rows are quantised, ordered by (label, place on a Hilbert curve through the DIMS components that spread most, id), and
written as Parquet rows of at most BLOCK vectors of one label. Each carries its zone map: least and greatest value of
every component, and the least id. For an anchor ``a`` and a block's box, interval arithmetic bounds every score in the
block: each term ``a_d x_d`` lies between ``a_d lo_d`` and ``a_d hi_d``, and the sums of the lesser and of the greater
ends bound the inner product. A block is read for an anchor only if these bounds leave room for a row that counts:

1. Positives: of the anchor's label. The FIRST blocks with the greatest bounds give each anchor ``keep`` rows; the last
   of these is a threshold that all other blocks must be able to beat.
2. Negatives: of other labels. Each (anchor, positive) has a window of scores. Again FIRST blocks that reach a window give
   thresholds, and then all blocks are read whose bounds meet a window above its threshold.

Both results are exact; the boxes only save reads. Anchors go to blocks in groups: a task holds one block and at most
about GROUPS groups of GROUP anchors, or a page of about PAGE zone maps and as many anchors, whatever the label or copies
of one vector hold of the table. Copies lie side by side in id order, so that their least ids prune ties. A task returns
at most ``keep`` rows of a block for an anchor (or window), and none under the thresholds. On vectors in random
directions boxes prune little, so that the work is anchors times rows: a stated query set against all rows, in blocks.

Scores are whole numbers and exact: products are summed as doubles while they stay below 2**53, else as Python integers.

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part. Vectors of
unequal length count as padded with zeros; empty ones are zero vectors. Rows with the anchor's own id are no positives of
it. Rows that repeat an id count each: a repeated anchor's results are those of each of its rows, told apart by their
order. A score that no 64-bit integer holds is an error. Ties go to smaller ids, then to the block order. Other columns
are not read, whatever their names. Empty tables and anchors without positives give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import materialise

#: Rows of a block; anchors of a group; groups and zone maps that meet in a task, about.
BLOCK, GROUP, GROUPS, PAGE = 1024, 64, 64, 1024
#: Blocks a group of anchors reads first, for its thresholds.
FIRST = 2
#: Components and bits of each on the Hilbert curve: 63 bits in all.
DIMS, BITS = 9, 7

PACKED = "block bigint, label bigint, n int, least_id bigint, ids binary, rows binary, lo binary, hi binary"


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of each row of whole numbers below ``2**bits``.

    The transposed form of the index is made in place, bit by bit from the highest: where a bit is set the lower bits of
    the first axis are inverted, else they are exchanged with those of that axis; Gray coding follows.
    """
    x = points.astype(np.int64).copy()
    n, dims = x.shape
    if not dims:
        return np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        below = (1 << b) - 1
        for d in range(dims):
            is_set = (x[:, d] >> b) & 1 == 1
            swap = np.where(is_set, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(is_set, below, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flip = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flip[:, None]
    out = np.zeros(n, dtype=np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            out = (out << 1) | ((x[:, d] >> b) & 1)
    return out


def quantised(batch: pa.RecordBatch, column: str, dim: int) -> np.ndarray:
    """floor(256 x) of each vector as doubles, which hold them exactly; short vectors padded with zeros."""
    vectors = batch.column(column)
    out = np.zeros((len(vectors), dim))
    sizes = np.asarray(vectors.value_lengths())
    flat = vectors.flatten().to_numpy(zero_copy_only=False)
    out[np.arange(dim) < sizes[:, None]] = flat
    return np.floor(out * 256.0)


def usable(df: DataFrame, id_col: str, vector: str, label: Column) -> DataFrame:
    """(vec_id, label, v) of the rows that take part, vectors as doubles."""
    v = F.col(f"`{vector}`").cast("array<double>")
    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), label.cast("bigint").alias("label"), v.alias("v"))
    return rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))


def spread(rows: DataFrame) -> tuple[int, list[tuple[int, float, float]]]:
    """Components of a vector, and (component, least, greatest) of the DIMS that spread most, over all rows."""
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 0

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(dim), np.zeros(dim)
        lo, hi = np.full(dim, np.inf), np.full(dim, -np.inf)
        for batch in batches:
            q = quantised(batch, "v", dim)
            if len(q):
                n, total, square = n + len(q), total + q.sum(axis=0), square + (q * q).sum(axis=0)
                lo, hi = np.minimum(lo, q.min(axis=0)), np.maximum(hi, q.max(axis=0))
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim, dtype=np.int32)), pa.array(np.full(dim, float(n))), *map(pa.array, (total, square, lo, hi))], names=["d", "n", "total", "square", "lo", "hi"])

    per = rows.select("v").mapInArrow(part, "d int, n double, total double, square double, lo double, hi double")
    found = per.groupBy("d").agg(*(F.sum(c).alias(c) for c in ("n", "total", "square")), F.min("lo").alias("lo"), F.max("hi").alias("hi")).collect()  # a row for each component
    widest = sorted(found, key=lambda r: (-(r["square"] / r["n"] - (r["total"] / r["n"]) ** 2), r["d"]))[:DIMS]
    return dim, [(r["d"], r["lo"], r["hi"]) for r in widest]


def packed(rows: DataFrame, dim: int, axes: list[tuple[int, float, float]], size: int, name: str) -> DataFrame:
    """``rows`` in (label, Hilbert, id) order as written rows of at most ``size`` vectors of one label with their zone map."""
    lo, width = np.array([a[1] for a in axes]), np.array([max(a[2] - a[1], 1.0) for a in axes])
    picks = [a[0] for a in axes]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q = quantised(batch, "v", dim)
            cells = np.clip((q[:, picks] - lo) / width * (1 << BITS), 0, (1 << BITS) - 1) if picks else np.zeros((len(q), 0))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array(hilbert(cells)), pa.array([r.tobytes() for r in q], pa.binary())], names=["vec_id", "label", "place", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[int, bytes]] = []
        label = None

        def block() -> pa.RecordBatch:
            ids, q = np.array([h[0] for h in held], dtype=np.int64), np.frombuffer(b"".join(h[1] for h in held)).reshape(len(held), dim)
            row = [first + made, label, len(ids), int(ids.min()), ids.tobytes(), q.tobytes(), q.min(axis=0).tobytes(), q.max(axis=0).tobytes()]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for key, kind, q in zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "q")), strict=True):
                if held and (kind != label or len(held) == size):
                    yield block()
                    held, made = [], made + 1
                label = kind
                held.append((key, q))
        if held:
            yield block()

    order = ["label", "place", "vec_id"]
    placed = rows.mapInArrow(place, "vec_id bigint, label bigint, place bigint, q binary")
    return materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, PACKED), name)


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers."""
    most = np.abs(a).max(initial=0.0) * np.abs(b).max(initial=0.0) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in r] for r in x], dtype=object).reshape(x.shape)
    exact = whole(a) @ whole(b).T
    return exact.astype(np.int64)  # an OverflowError if no 64-bit integer holds it


def bounds(a: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest score that an anchor (row) can have inside a box (column), widened by what rounding may lose."""
    up, down = np.maximum(a, 0), np.minimum(a, 0)
    slack = 1e-12 * (np.abs(a) @ np.maximum(np.abs(lo), np.abs(hi)).T)
    return up @ lo.T + down @ hi.T - slack, up @ hi.T + down @ lo.T + slack


def _doubles(column: pa.ChunkedArray, rows: int) -> np.ndarray:
    whole = np.frombuffer(b"".join(column.to_pylist()))
    return whole.reshape(rows, len(whole) // max(rows, 1))


class Groups:
    """Groups of anchors that have met in a task: ids, vectors, and of each anchor its windows.

    A window is (least score, greatest score, threshold, id at the threshold): rows count that are inside and before
    (threshold, id) in the order. Positives have one window without ends.
    """

    def __init__(self, table: pa.Table) -> None:
        counts = table["n"].to_pylist()
        self.group = np.repeat(np.array(table["block"].to_pylist(), dtype=np.int64), counts)
        self.spot = np.concatenate([np.arange(n) for n in counts]) if counts else np.zeros(0, dtype=np.int64)
        self.label = np.repeat(np.array(table["label"].to_pylist(), dtype=np.int64), counts)
        self.ids = np.frombuffer(b"".join(table["ids"].to_pylist()), dtype=np.int64)
        self.q = _doubles(table["rows"], len(self.ids))
        self.windows = [w for ws in table["windows"].to_pylist() for w in ws]


INT_MIN, INT_MAX = -(1 << 63), (1 << 63) - 1
WINDOWS = "array<array<struct<least:bigint,most:bigint,beat:bigint,beat_id:bigint>>>"
HITS = "grp bigint, spot int, win int, anchor_id bigint, score bigint, vec_id bigint, src bigint, at int"


def _pages(df: DataFrame, key: str, per: int) -> tuple[DataFrame, int]:
    """``df`` with ``page``, of which each holds about ``per`` rows."""
    n = max(1, -(-df.count() // per))
    return df.withColumn("page", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def choose(groups: DataFrame, blocks: DataFrame, same: bool, first: int | None) -> DataFrame:
    """(grp, block): blocks that a group must read, by zone maps; with ``first`` only so many, those that reach highest."""
    zones, pages = _pages(blocks.select("block", "label", "least_id", "lo", "hi"), "block", PAGE)
    asked, chunks = _pages(groups, "block", GROUPS)
    left = zones.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumnRenamed("page", "chunk").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))

    def meet(zones: pa.Table, groups: pa.Table) -> pa.Table:
        g, n = Groups(groups), zones.num_rows
        out: list[tuple[int, int, float]] = []
        if n and len(g.ids):
            names, kinds, least = (np.array(zones[c].to_pylist(), dtype=np.int64) for c in ("block", "label", "least_id"))
            low, high = bounds(g.q, _doubles(zones["lo"], n), _doubles(zones["hi"], n))
            fits = (kinds == g.label[:, None]) if same else (kinds != g.label[:, None])
            wanted, reach = np.zeros_like(fits), np.full(fits.shape, -np.inf)
            for i, windows in enumerate(g.windows):
                for w in windows:
                    ok = (high[i] >= w["least"]) & (low[i] <= w["most"]) & ((high[i] > w["beat"]) | ((high[i] >= w["beat"]) & (least < w["beat_id"])))
                    wanted[i] |= ok
                    reach[i] = np.where(ok, np.maximum(reach[i], np.minimum(high[i], w["most"])), reach[i])
            wanted &= fits
            for k in np.unique(g.group):
                mine = g.group == k
                hit = wanted[mine].any(axis=0)
                best = np.where(wanted[mine], reach[mine], -np.inf).max(axis=0)
                picks = np.flatnonzero(hit)
                if first is not None:
                    picks = picks[np.lexsort((names[picks], -best[picks]))][:first]
                out += [(int(k), int(names[j]), float(best[j])) for j in picks]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["grp", "block", "reach"])

    found = left.groupBy("page", "chunk").cogroup(right.groupBy("page", "chunk")).applyInArrow(meet, "grp bigint, block bigint, reach double")
    if first is None:
        return found.select("grp", "block")
    place = F.row_number().over(Window.partitionBy("grp").orderBy(F.desc("reach"), "block"))
    return found.withColumn("r", place).where(F.col("r") <= first).select("grp", "block")


def read(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, keep: int, same: bool) -> DataFrame:
    """The first ``keep`` rows of each anchor's window, from the blocks of ``pairs``: (grp, spot, win) and the row."""
    asked, chunks = _pages(groups, "block", GROUPS)
    pairs = materialise(pairs.withColumn("chunk", F.pmod(F.xxhash64("grp"), F.lit(chunks)).cast("int")), "pairs")
    left = pairs.select("block", "chunk").distinct().join(blocks.select("block", "label", "n", "ids", "rows"), "block")
    met = pairs.select(F.col("grp").alias("block"), F.col("block").alias("src"), F.col("chunk").alias("part"))
    right = met.join(asked.drop("page"), "block")

    def meet(block: pa.Table, groups: pa.Table) -> pa.Table:
        g = Groups(groups)
        out: list[tuple] = []
        for i in range(block.num_rows):
            ids, kind, name = np.frombuffer(block["ids"][i].as_py(), dtype=np.int64), block["label"][i].as_py(), block["block"][i].as_py()
            found = scores(g.q, np.frombuffer(block["rows"][i].as_py()).reshape(len(ids), g.q.shape[1] if len(g.ids) else -1)) if len(g.ids) else np.zeros((0, len(ids)), dtype=np.int64)
            for a, windows in enumerate(g.windows):
                if (kind == g.label[a]) != same:
                    continue
                s = found[a]
                for w, win in enumerate(windows):
                    at = np.flatnonzero((s >= win["least"]) & (s <= win["most"]) & ((s > win["beat"]) | ((s == win["beat"]) & (ids <= win["beat_id"]))) & (not same or (ids != g.ids[a])))
                    at = at[np.lexsort((at, ids[at], -s[at]))][:keep] if len(at) > 1 else at
                    out += [(int(g.group[a]), int(g.spot[a]), w, int(g.ids[a]), int(s[j]), int(ids[j]), name, int(j)) for j in at]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=[c.split()[0] for c in HITS.split(", ")])

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("src", "part")).applyInArrow(meet, HITS)
    key = F.struct((-F.col("score")).alias("s"), "vec_id", "src", "at")
    ranked = found.withColumn("r", F.row_number().over(Window.partitionBy("grp", "spot", "win").orderBy(key)))
    return ranked.where(F.col("r") <= keep)


def with_windows(groups: DataFrame, windows: DataFrame) -> DataFrame:
    """``groups`` with the windows of each of its anchors, from (grp, spot, list of windows); none: no windows."""
    per = windows.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("spot", "list"))).alias("found"))  # at most GROUP anchors
    none = F.from_json(F.lit("[]"), WINDOWS[6:-1])
    spots = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.coalesce(F.try_element_at("found", i), none))
    joined = groups.drop("windows").join(per, groups["block"] == per["grp"], "left").drop("grp")
    return joined.withColumn("windows", F.when(F.col("found").isNull(), F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: none)).otherwise(spots)).drop("found")


def _raised(hits: DataFrame, keep: int) -> DataFrame:
    """(grp, spot, win, beat, beat_id): the last of ``keep`` rows found so far, where there are as many."""
    return hits.where(F.col("r") == keep).select("grp", "spot", "win", F.col("score").alias("beat"), F.col("vec_id").alias("beat_id"))


def _first_of(groups: DataFrame, windows: DataFrame, blocks: DataFrame, keep: int, same: bool, name: str) -> DataFrame:
    """The first ``keep`` rows of each window (grp, spot, win, least, most) over all blocks."""
    bare = windows.withColumns({"beat": F.lit(INT_MIN), "beat_id": F.lit(INT_MAX)})
    listed = lambda t: with_windows(groups, t.groupBy("grp", "spot").agg(F.transform(F.array_sort(F.collect_list(F.struct("win", "least", "most", "beat", "beat_id"))), lambda w: F.struct(w["least"].alias("least"), w["most"].alias("most"), w["beat"].alias("beat"), w["beat_id"].alias("beat_id"))).alias("list")))
    asked = materialise(listed(bare), f"{name}-asked")
    begun = materialise(read(choose(asked, blocks, same, FIRST), asked, blocks, keep, same), f"{name}-begun")
    raised = windows.join(_raised(begun, keep), ["grp", "spot", "win"], "left").withColumns({"beat": F.coalesce("beat", F.lit(INT_MIN)), "beat_id": F.coalesce("beat_id", F.lit(INT_MAX))})
    asked = materialise(listed(raised), f"{name}-raised")
    return materialise(read(choose(asked, blocks, same, None), asked, blocks, keep, same), name)


def hard_negatives(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", label: Column | str = "label", anchors: Column | None = None, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``anchors`` tells the anchor rows by ``vec_id`` (default: all). A negative's score is between ``least`` and ``most``
    percent of the positive's.
    """
    label = F.col(f"`{label}`") if isinstance(label, str) else label
    rows = materialise(usable(df, id_col, vector, label), "vectors")
    dim, axes = spread(rows)
    blocks = packed(rows, dim, axes, BLOCK, "blocks")
    groups = packed(rows.where(anchors) if anchors is not None else rows, dim, axes, GROUP, "anchors").drop("lo", "hi", "least_id")
    spots = groups.select(F.col("block").alias("grp"), F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("spot"))
    ends = spots.select("grp", "spot", F.lit(0).alias("win"), F.lit(INT_MIN).alias("least"), F.lit(INT_MAX).alias("most"))
    near = _first_of(groups, ends, blocks, positives, True, "positives").select("grp", "spot", (F.col("r") - 1).alias("win"), "anchor_id", F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    share = lambda p: F.col("positive_score").cast("decimal(20,0)") * p / 100
    ends = near.select("grp", "spot", "win", F.ceil(share(least)).cast("bigint").alias("least"), F.floor(share(most)).cast("bigint").alias("most")).where("least <= most")
    hard = _first_of(groups, ends, blocks, negatives, False, "negatives")
    found = hard.select("grp", "spot", "win", F.col("r").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(near, ["grp", "spot", "win"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def oracle() -> str:
    """DuckDB SQL of ``op12_hilbert_negatives``: all scores of all anchors."""
    return """
    WITH e AS MATERIALIZED (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
      FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))), true)),
    s AS MATERIALIZED (
      SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
    p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 100 * n.score BETWEEN 50 * p.positive_score AND 95 * p.positive_score
    WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
    QUALIFY row_number() OVER w <= 3
    """
