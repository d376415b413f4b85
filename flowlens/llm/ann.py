"""Operator 2: approximate nearest neighbours by an inverted multi-index, for largest inner product.

Vectors are cut into two halves, each quantised by its own k-means centroids; a cell is a pair of
centroids. An inner product is the sum of those of the halves, so cells are visited best first by
the summed inner product of the query's halves with the centroids: a heap walks the sorted lists of
both halves until the cells visited hold the wanted share of all vectors, and at least k entries that are not
the query's own. All entries of those cells are then reranked by the exact inner product of the original vectors.

The centroids are fitted on a bounded sample (``sample`` rows, by hash of the id); every vector is
indexed. Unless it is given, the share is measured on that sample, too: the least part of the sample whose cells
hold ``target`` of the exact neighbours of ``probes`` sample vectors. Clustered vectors need a few hundredths, random
directions most of the table. A larger table has nearer neighbours, so that the measured share errs on the safe side.

Only centroids and cell sizes (at most ``centroids`` squared numbers) go to all tasks. Entries and queries meet by
the first half's centroid; entries of a centroid are cut into blocks of about ``block`` vectors, and all queries
into blocks of about ``query_block``, so that no group grows with the table; each returns at most k rows for a
query, and the k best of these are ranked by a window whose limit is applied before the shuffle.

Scores are correctly rounded sums of the products of the stored numbers in double precision, so that they
depend on neither batch nor order; where they overflow they are infinite, and a sum of both infinities counts as
minus infinity. Defined results: vectors that are null, empty, zero, or hold null
or non-finite components take no part, nor do those of another length than ``dim`` (default: the
commonest length; ties: the longest). Rows that repeat an id are separate entries and one query, that of
the smallest vector; none of them is its neighbour. A query with fewer than k candidates gets them all.
Ties go to the smaller id. Other columns are not read, whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import hash_sample, materialise

SCHEMA = "query_id bigint, rank int, vec_id bigint, score double"


def kmeans(points: np.ndarray, k: int, rounds: int = 12, seed: int = 2) -> np.ndarray:
    """Lloyd's centroids of a bounded sample; fewer where there are fewer distinct points."""
    distinct = np.unique(points, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]]
    for _ in range(rounds):
        nearest = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres)
    return centres


def visit(first: np.ndarray, second: np.ndarray, sizes: np.ndarray, wanted: int) -> list[tuple[int, int]]:
    """Cells in order of first[i] + second[j], the largest first, until they hold ``wanted`` entries."""
    a, b = np.argsort(-first, kind="stable"), np.argsort(-second, kind="stable")
    heap, seen, out, held = [(-(first[a[0]] + second[b[0]]), 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, i, j = heapq.heappop(heap)
        cell = (int(a[i]), int(b[j]))
        if sizes[cell]:
            out.append(cell)
            held += int(sizes[cell])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (-(first[a[x]] + second[b[y]]), x, y))
    return out


def usable(df: DataFrame, id_col: str, vector: str, dim: int | None) -> DataFrame:
    """(id, v): the vectors that take part."""
    v = F.col(f"`{vector}`")
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = df.where(v.isNotNull() & F.coalesce(good, F.lit(False)) & F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("id"), v.cast("array<double>").alias("v"))
    if dim is None:
        commonest = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
        dim = commonest["d"] if commonest else 0
    return rows.where(F.size("v") == dim)


def share_needed(drawn: np.ndarray, centres: list[np.ndarray], cut: int, half: int, k: int, target: float, probes: int) -> float:
    """Part of the sample whose cells, visited best first, hold ``target`` of the neighbours of ``probes`` sample vectors."""
    a, b = (_nearest(p, c) for p, c in zip((drawn[:, :cut], drawn[:, half:]), centres, strict=True))
    sizes = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    np.add.at(sizes, (a, b), 1)
    chosen = np.linspace(0, len(drawn) - 1, min(probes, len(drawn))).astype(int)
    at = []
    for q in chosen:
        scores = drawn @ drawn[q]
        scores[q] = -np.inf
        best = np.argsort(-scores, kind="stable")[: min(k, len(drawn) - 1)]
        cells = (centres[0] @ drawn[q, :cut])[:, None] + centres[1] @ drawn[q, half:]
        order = np.argsort(-cells, axis=None, kind="stable")
        held = np.empty(sizes.size, np.int64)
        held[order] = np.cumsum(sizes.ravel()[order])
        at.append(held[a[best] * sizes.shape[1] + b[best]])
    found = np.sort(np.concatenate(at)) if at else np.zeros(0)
    return float(found[min(len(found) - 1, math.ceil(target * len(found)))]) / len(drawn) if len(found) else 1.0


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T * 2 - (centres**2).sum(axis=1)).argmax(axis=1)


def _exact(q: np.ndarray, x: np.ndarray) -> float:
    products = (q * x).tolist()
    try:
        return math.fsum(products)
    except OverflowError:  # a partial sum leaves the range of doubles
        return math.fsum(p / 2**60 for p in products) * 2.0**60
    except ValueError:
        return -math.inf


def _best(ids: np.ndarray, vectors: np.ndarray, query: int, q: np.ndarray, scores: np.ndarray, k: int) -> list[tuple]:
    """The k best of one block for one query, by exact score and then id."""
    at = np.flatnonzero(ids != query)
    if len(at) > k:
        floor = np.partition(scores[at], -k)[-k]
        spare = 1e-9 * max(1.0, abs(floor)) + 1e-12 * np.linalg.norm(q) * np.abs(vectors).max()
        if np.isfinite(spare) and np.isfinite(scores[at]).all():
            at = at[scores[at] >= floor - spare]
    if len(at) > 4 * k:  # many equal vectors: of each the smallest ids suffice
        kept, held = [], Counter()
        for i in at[np.argsort(ids[at], kind="stable")]:
            key = vectors[i].tobytes()
            held[key] += 1
            if held[key] <= k:
                kept.append(i)
        at = np.array(kept)
    found = [(_exact(q, vectors[i]), int(ids[i])) for i in at]
    found.sort(key=lambda x: (-x[0], x[1]))
    return [(query, i, s) for s, i in found[:k]]


def search(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20, centroids: int = 16, share: float | None = None, target: float = 0.96, probes: int = 128, sample: int = 20_000, block: int = 8192, query_block: int = 2048, dim: int | None = None) -> DataFrame:
    """The k best candidates found for each vector whose id is divisible by ``every``.

    ``share`` is the part of all vectors that a query's cells must hold; 1 makes the search exact.
    """
    spark = df.sparkSession
    rows = materialise(usable(df, id_col, vector, dim), "vectors")
    total = rows.count()
    if not total:
        return spark.createDataFrame([], SCHEMA)
    drawn = np.array([r["v"] for r in hash_sample(rows, sample, "id").select("v").toLocalIterator()], np.float64)
    drawn = drawn / max(1.0, float(np.abs(drawn).max()) / 1e100)  # squares stay in range
    half = drawn.shape[1] // 2
    cut = max(half, 1)  # both halves need at least one component
    centres = [kmeans(drawn[:, :cut], centroids), kmeans(drawn[:, half:], centroids)]
    part = share_needed(drawn, centres, cut, half, k, target, probes) if share is None else share

    def cells(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                x = np.clip(np.stack(frame["v"].to_numpy()).astype(np.float64), -1e100, 1e100)
                yield pd.DataFrame({"a": _nearest(x[:, :cut], centres[0]), "b": _nearest(x[:, half:], centres[1]), "id": frame["id"], "v": frame["v"]})

    index = materialise(rows.mapInPandas(cells, "a int, b int, id bigint, v array<double>"), "index")
    sizes = np.zeros((len(centres[0]), len(centres[1])), np.int64)
    for r in index.groupBy("a", "b").count().toLocalIterator():
        sizes[r["a"], r["b"]] = r["count"]
    blocks = [max(1, -(-int(n) // block)) for n in sizes.sum(axis=1)]
    chosen = rows.where(F.pmod("id", F.lit(every)) == 0).groupBy("id").agg(F.min("v").alias("v"), F.count("*").alias("own"))
    chosen = materialise(chosen, "queries", done=(rows,))
    dealt = max(1, -(-chosen.count() // query_block))

    def probe(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for i, v, own in zip(frame["id"], frame["v"], frame["own"], strict=True):
                q = np.clip(np.asarray(v, np.float64), -1e100, 1e100)
                mine: dict[int, list[int]] = {}
                wanted = max(math.ceil(part * total), k + int(own))
                for a, b in visit(centres[0] @ q[:cut], centres[1] @ q[half:], sizes, wanted):
                    mine.setdefault(a, []).append(b)
                out += [(a, s, i, bs, v) for a, bs in mine.items() for s in range(blocks[a])]
            yield pd.DataFrame(out, columns=["a", "s", "id", "bs", "v"])

    block_of = F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(dealt)).cast("int").alias("t")
    asked = chosen.mapInPandas(probe, "a int, s int, id bigint, bs array<int>, v array<double>").select("*", block_of)
    cuts = F.array(*map(F.lit, blocks))
    held = index.withColumn("s", F.pmod(F.xxhash64("id"), F.element_at(cuts, F.col("a") + 1)).cast("int"))
    held = held.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(dealt - 1))))

    def rerank(queries: pd.DataFrame, entries: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(queries) and len(entries):
            entries = entries.sort_values(["b", "id"], kind="stable")
            ids, b = entries["id"].to_numpy(), entries["b"].to_numpy()
            x = np.stack(entries["v"].to_numpy()).astype(np.float64)
            for start in range(0, len(queries), 256):
                some = queries.iloc[start : start + 256]
                q = np.stack(some["v"].to_numpy()).astype(np.float64)
                with np.errstate(over="ignore", invalid="ignore"):
                    scores = q @ x.T
                    for n, (i, bs) in enumerate(zip(some["id"], some["bs"], strict=True)):
                        mine = np.flatnonzero(np.isin(b, bs))
                        if len(mine):
                            out += _best(ids[mine], x[mine], i, q[n], scores[n, mine], k)
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    near = asked.groupBy("a", "s", "t").cogroup(held.groupBy("a", "s", "t")).applyInPandas(rerank, "query_id bigint, vec_id bigint, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score")
    return ranked.where(F.col("rank") <= k)
