"""Nearest neighbours of a stated query set (J12): exact by pivot cells, approximate by random projections.

Pool vectors go to the nearest of a bounded sample of pivots and, within a cell, in the order of their distance to it, into
written blocks of at most BLOCK vectors. A block thus lies in a shell around its pivot, and the triangle inequality bounds
the distance of a query to everything in it; another bound comes from the pivot nearest to the query, as whatever is
in a cell is nearer to the cell's pivot. A group of queries first reads the FIRST blocks with the least bounds; the
k-th distance found there is a threshold, and then only blocks are read whose bound does not exceed it. The result
is exact. Groups of queries meet pages of the block directory, and single blocks, so that no side is ever whole in a task.
Of copies of one vector only the few that can be among the k are searched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import BucketedRandomProjectionLSH
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.storage import materialise

#: Pivots at most; vectors of a block; queries of a group; groups and directory rows that meet in a task, about.
PIVOTS, BLOCK, GROUP, GROUPS, PAGE = 512, 1024, 128, 32, 8192
#: Blocks that a query reads first, for its threshold.
FIRST = 2
PACKED = "block bigint, cell int, n int, lo double, hi double, ids binary, rows binary"
_KINDS = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary())


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b`` by a matrix product: exact but for rounding."""
    squares = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(squares, 0.0))


def _slack(a: np.ndarray, b: np.ndarray) -> float:
    """What rounding may add to a distance of ``_distances``: it is a root, so small ones are off most."""
    return 1e-6 * (1.0 + np.sqrt((a**2).sum(axis=1).max(initial=0.0)) + np.sqrt((b**2).sum(axis=1).max(initial=0.0)))


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64) if len(column) else np.zeros((0, 0))


def pivots_of(pool: DataFrame, block: int = BLOCK, most: int = PIVOTS) -> np.ndarray:
    """A sample by hash of about as many vectors as there will be blocks, ``most`` at most."""
    n = pool.count()
    wanted = min(most, max(1, -(-n // block)))
    share = min(1.0, 2.0 * wanted / max(1, n))
    rows = pool.where(F.pmod(F.xxhash64(F.lit(7), "id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1)).orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()
    return np.unique(np.array([r["v"] for r in rows], dtype=np.float64), axis=0) if rows else np.zeros((0, 0))


def packed(rows: DataFrame, pivots: np.ndarray, size: int, name: str) -> DataFrame:
    """(id, v) as written blocks of one cell in the order of the distance to its pivot."""

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"))
            if len(x):
                at = _distances(x, pivots).argmin(axis=1)
                away = np.sqrt(((x - pivots[at]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(at.astype(np.int32)), pa.array(away), pa.array([r.tobytes() for r in x], pa.binary())], names=["id", "cell", "away", "q"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, made = TaskContext.get().partitionId() << 32, 0
        held: list[tuple] = []

        def block() -> pa.RecordBatch:
            row = (first + made, held[0][0], len(held), held[0][1], held[-1][1], np.array([h[2] for h in held], dtype=np.int64).tobytes(), b"".join(h[3] for h in held))
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, _KINDS, strict=True)], names=[c.split()[0] for c in PACKED.split(", ")])

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("cell", "away", "id", "q")), strict=True):
                if held and (row[0] != held[0][0] or len(held) == size):
                    yield block()
                    held, made = [], made + 1
                held.append(row)
        if held:
            yield block()

    order = ["cell", "away", "id"]
    placed = rows.mapInArrow(assign, "id bigint, cell int, away double, q binary")
    return materialise(placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(pack, PACKED), name)


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of the blocks of a table."""
    ids = np.frombuffer(b"".join(table["ids"].to_pylist()), dtype=np.int64)
    flat = np.frombuffer(b"".join(table["rows"].to_pylist()))
    return ids, flat.reshape(len(ids), len(flat) // max(1, len(ids)))


def _paged(df: DataFrame, key: str, per: int) -> tuple[DataFrame, int]:
    n = max(1, -(-df.count() // per))
    return df.withColumn("page", F.pmod(F.xxhash64(key), F.lit(n)).cast("int")), n


def reachable(groups: DataFrame, blocks: DataFrame, pivots: np.ndarray, first: int | None) -> DataFrame:
    """(grp, block): blocks that may hold a neighbour of a query of the group nearer than its threshold.

    ``groups`` has ``within``, the threshold of each query (null: none). With ``first`` the blocks with the least bounds,
    so many for each query that are about the nearest to it.
    """
    directory, pages = _paged(blocks.select("block", "cell", "lo", "hi"), "block", PAGE)
    asked, chunks = _paged(groups, "block", GROUPS)
    left = directory.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    right = asked.withColumnRenamed("page", "chunk").withColumn("page", F.explode(F.sequence(F.lit(0), F.lit(pages - 1))))

    def meet(directory: pa.Table, groups: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if directory.num_rows and groups.num_rows:
            names, cells = np.array(directory["block"]), np.array(directory["cell"])
            lo, hi = np.array(directory["lo"]), np.array(directory["hi"])
            for g in range(groups.num_rows):
                one = groups.slice(g, 1)
                _, q = _vectors(one)
                d, slack = _distances(q, pivots), _slack(q, pivots)
                away = d[:, cells]
                bound = np.maximum(np.maximum(away - hi, lo - away), (away - d.min(axis=1)[:, None]) / 2) - 2 * slack
                if first is None:
                    within = np.array([np.inf if w is None else w for w in one["within"][0].as_py()])
                    picks = np.flatnonzero((bound <= within[:, None] * (1 + 1e-9)).any(axis=0))
                else:
                    nearest = np.argsort(bound, axis=1, kind="stable")[:, :first]
                    picks = np.unique(nearest)
                least = bound.min(axis=0)
                out += [(one["block"][0].as_py(), int(names[j]), float(least[j])) for j in picks]
        return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], names=["grp", "block", "bound"])

    found = left.groupBy("page", "chunk").cogroup(right.groupBy("page", "chunk")).applyInArrow(meet, "grp bigint, block bigint, bound double")
    return found.select("grp", "block")


HITS = "grp bigint, spot int, query_id bigint, neighbour_id bigint, distance double"


def nearest(pairs: DataFrame, groups: DataFrame, blocks: DataFrame, k: int, exclude_self: bool) -> DataFrame:
    """The k nearest of each query among the blocks of ``pairs``, with ``rank``; ties by id."""
    asked, chunks = _paged(groups, "block", GROUPS)
    pairs = materialise(pairs.withColumn("chunk", F.pmod(F.xxhash64("grp"), F.lit(chunks)).cast("int")), "pairs")
    left = pairs.select("block", "chunk").distinct().join(blocks.select("block", "ids", "rows"), "block")
    right = pairs.select(F.col("grp").alias("block"), F.col("block").alias("src"), F.col("chunk").alias("part")).join(asked.drop("page"), "block")

    def meet(block: pa.Table, groups: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if block.num_rows and groups.num_rows:
            ids, x = _vectors(block)
            for g in range(groups.num_rows):
                one = groups.slice(g, 1)
                qids, q = _vectors(one)
                rough, slack = _distances(q, x), _slack(q, x)
                for i, within in enumerate(one["within"][0].as_py()):
                    d = np.where(ids == qids[i], np.inf, rough[i]) if exclude_self else rough[i]
                    at = np.flatnonzero(np.isfinite(d) & (d <= np.inf if within is None else d <= within + slack))
                    if len(at) > k:
                        at = at[d[at] <= np.partition(d[at], k - 1)[k - 1] + 2 * slack]
                    exact = np.sqrt(((x[at] - q[i]) ** 2).sum(axis=1))
                    for j in np.lexsort((ids[at], exact))[:k]:
                        out.append((one["block"][0].as_py(), i, int(qids[i]), int(ids[at[j]]), float(exact[j])))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.float64())
        return pa.Table.from_arrays([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in HITS.split(", ")])

    found = left.groupBy("block", "chunk").cogroup(right.groupBy("src", "part")).applyInArrow(meet, HITS)
    place = F.row_number().over(Window.partitionBy("grp", "spot").orderBy("distance", "neighbour_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def thresholds(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``groups`` with the k-th distance of each query, null where fewer were found."""
    far = found.where(F.col("rank") == k).groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("spot", "distance"))).alias("far"))  # at most GROUP queries
    joined = groups.drop("within").join(far, groups["block"] == far["grp"], "left").drop("grp")
    spots = F.sequence(F.lit(0), F.col("n") - 1)
    return joined.withColumn("within", F.transform(spots, lambda i: F.try_element_at("far", i))).drop("far")


def prepared(queries: DataFrame, pool: DataFrame, id_col: str, vector: str, block: int = BLOCK) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """Groups of queries, blocks of the pool, and the pivots."""
    side = lambda t: t.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    pool = side(pool)
    pivots = pivots_of(pool, block)
    groups = packed(side(queries), pivots, GROUP, "queries").drop("lo", "hi", "cell") if len(pivots) else None
    return groups, packed(pool, pivots, block, "pool") if len(pivots) else None, pivots


def _searched(queries: DataFrame, pool: DataFrame, k: int, slice_rows: int) -> DataFrame | None:
    """(query_id, neighbour_id, distance): the k exact neighbours of each query; none without a pool."""
    groups, blocks, pivots = prepared(queries, pool, "id", "v", slice_rows)
    if groups is None:
        return None
    none = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.lit(None).cast("double"))
    asked = groups.withColumn("within", none)
    if blocks.count() > 4 * FIRST:  # else a threshold would save nothing
        begun = materialise(nearest(reachable(asked, blocks, pivots, FIRST), asked, blocks, k, False), "begun")
        asked = materialise(thresholds(groups, begun, k), "within")
    return nearest(reachable(asked, blocks, pivots, None), asked, blocks, k, False).select("query_id", "neighbour_id", "distance")


def knn(queries: DataFrame, pool: DataFrame, k: int, id_col: str, vector: str, exclude_self: bool = True, slice_rows: int = BLOCK) -> DataFrame:
    """(query_id, neighbour_id, distance, rank): the k exact Euclidean neighbours of each query, ties by id.

    Ids are unique in the pool. Of equal vectors only the least ids can be neighbours, one more than k if a query's own
    is left out, and equal queries have the same neighbours but for their own: so copies are neither searched nor asked
    twice. ``slice_rows``: vectors of a block.
    """
    number = lambda x: x.cast("double") + F.lit(0.0)  # noqa: E731  no -0.0
    side = lambda t: t.select(F.col(id_col).cast("bigint").alias("id"), F.transform(vector, number).alias("v"))
    most, place = k + int(exclude_self), F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = materialise(side(pool).withColumn("place", place).where(F.col("place") <= most).drop("place"), "uncopied")
    asked = materialise(side(queries).groupBy("v").agg(F.min("id").alias("id")), "asked")
    found = _searched(asked, few, most, slice_rows)
    if found is None:
        return queries.sparkSession.createDataFrame([], "query_id bigint, neighbour_id bigint, distance double, rank int")
    near = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("distance", "neighbour_id"))).alias("near"))  # at most k + 1
    near = asked.join(near, F.col("id") == F.col("query_id")).select("v", "near")
    own = F.filter("near", lambda x: x["neighbour_id"] != F.col("id")) if exclude_self else F.col("near")
    rows = side(queries).join(near, "v").select(F.col("id").alias("query_id"), F.posexplode(F.slice(own, 1, k)).alias("at", "x"))
    return rows.select("query_id", "x.neighbour_id", "x.distance", (F.col("at") + 1).alias("rank"))


def approximate_knn(queries: DataFrame, pool: DataFrame, k: int, id_col: str, vector: str, within: float, tables: int = 4, exclude_self: bool = True) -> DataFrame:
    """As ``knn``, of the pool vectors within a distance that share a bucket of a random projection with the query.

    Neighbours are missed where no projection puts them into one bucket; more tables and a larger distance miss fewer.
    """
    side = lambda t, n: t.select(F.col(id_col).cast("bigint").alias(n), array_to_vector(F.col(vector).cast("array<double>")).alias("v"))
    b = side(pool, "neighbour_id")
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=2 * within, numHashTables=tables, seed=1).fit(b)
    found = model.approxSimilarityJoin(side(queries, "query_id"), b, within, "distance").select("datasetA.query_id", "datasetB.neighbour_id", "distance")
    found = found.where("query_id <> neighbour_id") if exclude_self else found
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "neighbour_id"))).where(F.col("rank") <= k)
