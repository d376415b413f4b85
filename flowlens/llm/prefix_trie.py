"""Operator 13: the prefix trie of conversations, from vertical bitmaps.

A node at depth d is a distinct sequence of d turns; its members are the conversations that start with it. Conversations
are numbered in id order and cut into shards of SHARD; turns are cut into bands of BAND places. A task holds one cell, a
shard's turns of one band, and indexes it vertically: for each (place, turn) the set of its conversations as a bitmap.
From a parent's bitmap, the turn that its first remaining conversation has next names a posting; the intersection of both
is a child, which leaves the parent's remainder. Going down depth first this way makes as many intersections as there are
nodes. Population counts, first members and the list of conversations that end at a node come from the bitmaps.

A node is known across cells by the sum of the digests of its (place, turn) pairs, in four lanes of 32 bits; so the
key of a band's first place is a running sum, and no conversation need be in one task whole. Cells give a row for each of
their nodes, with the interval of its subtree in depth-first order; rows of one node are summed over cells.

Sums over subtrees need each node once: a node belongs to the cell that holds its smallest member. Weights of owned
nodes are summed over depth-first intervals in each cell; what a conversation owns in later bands is added where it
leaves the band. Both are additive over shards. Digests of end lists are streamed over the shards' lists in id order, one
list of at most SHARD ids at a time.

Defined results: rows without a conversation id take no part. Null role or text is empty; turns are ordered by turn (null
first), then role and text, so that repeated rows are turns of their own. A conversation without turns is a member of
the root. Other columns are not read, whatever their names. No conversations: no nodes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise, spread_join
from flowlens.operators.ordering import numbered, running_sums

#: Conversations of a shard and places of a band.
SHARD, BAND = 2048, 32
ROOT = "0" * 32
LANES = ("a", "b", "c", "d")
#: Lanes of a node's key as one integer, each with 32 bits of room to add.
MASK = sum(0xFFFFFFFF << (64 * k) for k in range(4))
CELLS = "shard bigint, band int, pre int, post int, fp string, parent string, depth bigint, n bigint, conv_id bigint, chars bigint, ghost boolean, ends string"


def conversation_turns(df: DataFrame, id_col: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, pos, key, chars): places from 1, a digest of role and text, and the text's code points."""
    empty = lambda c: F.coalesce(F.col(f"`{c}`"), F.lit(""))
    rows = df.where(F.col(f"`{id_col}`").isNotNull()).select(F.col(f"`{id_col}`").cast("bigint").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), empty(role).alias("role"), empty(text).alias("text"))
    placed = numbered(rows, ["conv_id"], ["turn", "role", "text"], "pos")
    key = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    return placed.select("conv_id", "pos", key.alias("key"), F.length("text").cast("bigint").alias("chars"))


def members_of(turns: DataFrame) -> DataFrame:
    """(conv_id, n, i): turns of each conversation and its number in id order."""
    return numbered(turns.groupBy("conv_id").agg(F.max("pos").alias("n")), [], ["conv_id"], "i")


def with_shared_heads(turns: DataFrame, per: int = 100, longest: int = 5) -> tuple[DataFrame, DataFrame]:
    """Every conversation c rebuilt: first turns of conversation c - c % ``per``, then its own beyond as many.

    Their number is the unsigned CRC-32 of c in decimal, modulo ``longest`` + 1. Returns turns and members.
    """
    turns = materialise(turns, "turns")
    own = members_of(turns)
    heads = F.crc32(F.col("conv_id").cast("string")) % (longest + 1)
    asked = own.select("conv_id", "i", F.col("n").alias("had"), heads.alias("h"), (F.col("conv_id") - F.col("conv_id") % per).alias("base"))
    there = turns.where((F.col("conv_id") % per == 0) & (F.col("pos") <= longest)).select(F.col("conv_id").alias("base"), F.col("pos").alias("at"), "key", "chars")  # at most ``longest`` each
    counted = there.groupBy("base").agg(F.max("at").alias("n_base"))
    shift = F.least("h", F.coalesce("n_base", F.lit(0)))
    plan = materialise(asked.join(counted, "base", "left").select("conv_id", "i", "base", "h", shift.alias("shift"), (shift + F.greatest(F.col("had") - F.col("h"), F.lit(0))).alias("n")), "plan")
    first = plan.where("shift > 0").join(there, "base").where("at <= shift").select("i", "n", F.col("at").alias("pos"), "key", "chars")
    rest = spread_join(turns, plan, "conv_id").where("pos > h").select("i", "n", (F.col("pos") - F.col("h") + F.col("shift")).alias("pos"), "key", "chars")
    return materialise(first.unionByName(rest), "rebuilt"), plan.select("conv_id", "i", "n")


def _lanes(pos: Column, key: Column) -> dict[str, Column]:
    tag = F.md5(F.concat_ws(":", pos.cast("string"), key))
    return {n: F.conv(F.substring(tag, 8 * k + 1, 8), 16, 10).cast("bigint") for k, n in enumerate(LANES)}


def _hex(*lanes: str) -> Column:
    return F.concat(*(F.lpad(F.lower(F.hex(F.col(c) % (1 << 32))), 8, "0") for c in lanes))


def _wide(fp: str) -> int:
    return sum(int(fp[8 * k : 8 * k + 8], 16) << (64 * k) for k in range(4))


def _narrow(lanes: int) -> str:
    return "".join(f"{(lanes >> (64 * k)) & 0xFFFFFFFF:08x}" for k in range(4))


def _tag(pos: int, key: str) -> int:
    return _wide(hashlib.md5(f"{pos}:{key}".encode()).hexdigest())


def bits(bitmap: int) -> Iterator[int]:
    """Places of the set bits, ascending."""
    while bitmap:
        low = bitmap & -bitmap
        yield low.bit_length() - 1
        bitmap ^= low


def cell_nodes(starts: list[tuple[int, int, str]], turns: list[dict[int, tuple[str, int]]], start: int) -> Iterator[tuple]:
    """Nodes of a cell in depth-first order: (fp, parent, depth, members, first member, chars, ghost, ends).

    ``starts``: of each conversation (id, turns in all, key at place ``start``), in id order; ``turns``: of each, its
    (turn, code points) by place. The node at ``start`` is a ghost beyond the first band, as the band before has it.
    """
    postings: dict[tuple[int, str], int] = defaultdict(int)
    ending: dict[int, int] = defaultdict(int)
    classes: dict[str, int] = defaultdict(int)
    for b, (_, n, fp) in enumerate(starts):
        classes[fp] |= 1 << b
        ending[n] |= 1 << b
        for pos, (key, _) in turns[b].items():
            postings[pos, key] |= 1 << b
    stack = [(start, fp, None, 0, m) for fp, m in reversed(classes.items())]
    while stack:
        pos, fp, parent, chars, found = stack.pop()
        ghost = pos == start and start > 0
        ends = 0 if ghost else found & ending.get(pos, 0)
        first = (found & -found).bit_length() - 1
        yield fp, parent, pos, found.bit_count(), starts[first][0], chars, ghost, ",".join(str(starts[b][0]) for b in bits(ends)) if ends else None
        rest, lanes, below = found, _wide(fp), []
        while rest:
            b = (rest & -rest).bit_length() - 1
            turn = turns[b].get(pos + 1)
            if turn is None:  # it ends here, or goes on in the next band
                rest ^= 1 << b
                continue
            child = rest & postings[pos + 1, turn[0]]
            below.append((pos + 1, _narrow((lanes + _tag(pos + 1, turn[0])) & MASK), fp, turn[1], child))
            rest &= ~child
        stack += reversed(below)


def _cell(table: pa.Table, places: int) -> pa.Table:
    at: dict[int, int] = {}
    starts, shard, band = [], table["shard"][0].as_py(), table["band"][0].as_py()
    rows = [table[c].to_pylist() for c in ("i", "pos", "key", "chars", "conv_id", "n")]
    for i, _, fp, _, conv, n in sorted((r for r in zip(*rows, strict=True) if r[4] is not None), key=lambda r: r[0]):
        at[i] = len(starts)
        starts.append((conv, n, fp))
    turns: list[dict[int, tuple[str, int]]] = [{} for _ in starts]
    for i, pos, key, chars, conv, _ in zip(*rows, strict=True):
        if conv is None:
            turns[at[i]][pos] = (key, chars)
    found = list(cell_nodes(starts, turns, band * places))
    post, open_nodes = [0] * len(found), []
    for k, node in enumerate(found):
        while open_nodes and found[open_nodes[-1]][2] >= node[2]:
            post[open_nodes.pop()] = k
        open_nodes.append(k)
    for k in open_nodes:
        post[k] = len(found)
    columns = [[shard] * len(found), [band] * len(found), list(range(len(found))), post, *([f[j] for f in found] for j in range(8))]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string())
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=[c.split()[0] for c in CELLS.split(", ")])


def _subtrees(table: pa.Table) -> pa.Table:
    """Per node of a cell the sums of what the cell owns below it; rows without ``pre`` are weights of later bands."""
    cols = {c: table[c].to_pylist() for c in table.column_names}
    nodes = [k for k, p in enumerate(cols["pre"]) if p is not None]
    where = {cols["fp"][k]: cols["pre"][k] for k in nodes}
    conv = {cols["fp"][k]: cols["first"][k] for k in nodes}
    weights = np.zeros((2, len(nodes) + 1), dtype=np.int64)
    for k, fp in enumerate(cols["fp"]):
        weights[0, where[fp] + 1] += cols["leaves"][k]
        weights[1, where[fp] + 1] += cols["saved"][k]
    sums = weights.cumsum(axis=1)
    out = [(cols["fp"][k], *(int(s[cols["post"][k]] - s[cols["pre"][k]]) for s in sums), conv.get(cols["parent"][k])) for k in nodes if not cols["ghost"][k]]
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64())
    return pa.Table.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate(kinds)], names=["fp", "n_leaves", "saved_tokens", "parent_conv_id"])


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's end lists, which come in order, joined by commas."""
    current, digest = None, None
    for batch in batches:
        out = []
        for fp, ends in zip(batch.column("fp").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if fp != current:
                if current is not None:
                    out.append((current, digest.hexdigest()))
                current, digest = fp, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], pa.string()) for k in range(2)], names=["fp", "ends_sha256"])
    if current is not None:
        yield pa.RecordBatch.from_arrays([pa.array([current]), pa.array([digest.hexdigest()])], names=["fp", "ends_sha256"])


def prefix_trie(turns: DataFrame, members: DataFrame, conversations: int = SHARD, places: int = BAND) -> DataFrame:
    """One row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns``: (i, n, pos, key, chars), places from 1 without gaps; ``members``: (conv_id, i, n), numbered from 1 in
    id order. Both are written tables. A cell has ``conversations`` times ``places`` turns at most.
    """
    shard = F.floor((F.col("i") - 1) / conversations).alias("shard")
    band = F.floor((F.col("pos") - 1) / places).cast("int").alias("band")
    said = turns.select(shard, band, "i", "pos", "key", "chars", F.lit(None).cast("bigint").alias("conv_id"), F.lit(None).cast("bigint").alias("n"))
    begin = members.select(shard, F.lit(0).alias("band"), "i", F.lit(0).cast("bigint").alias("pos"), F.lit(ROOT).alias("key"), F.lit(0).cast("bigint").alias("chars"), "conv_id", "n")
    later = None
    if (members.agg(F.max("n")).first()[0] or 0) > places:
        # keys of places that begin a band, as running sums over the bands of long conversations
        sums = turns.where(F.col("n") > places).groupBy("i", band).agg(*(F.sum(c).alias(n) for n, c in _lanes(F.col("pos"), F.col("key")).items()))
        sums = running_sums(sums, ["i"], ["band"], {f"to_{n}": F.col(n) for n in LANES})
        long = members.where(F.col("n") > places)
        later = sums.join(long, "i").where(F.col("n") > (F.col("band") + 1) * places)
        later = materialise(later.select(shard, (F.col("band") + 1).alias("band"), "i", _hex(*(f"to_{n}" for n in LANES)).alias("key"), "conv_id", "n"), "starts")
        begin = begin.unionByName(later.select("shard", "band", "i", (F.col("band") * places).cast("bigint").alias("pos"), "key", F.lit(0).cast("bigint").alias("chars"), "conv_id", "n"))
    cells = materialise(said.unionByName(begin).groupBy("shard", "band").applyInArrow(lambda t: _cell(t, places), CELLS), "cells")

    nodes = cells.where("NOT ghost").groupBy("fp").agg(F.min("depth").alias("depth"), F.sum("n").alias("n_convs"), F.min("conv_id").alias("first"), F.max("chars").alias("last_chars"), F.min("parent").alias("above"))
    nodes = materialise(nodes, "nodes")
    children = nodes.where("above IS NOT NULL").groupBy(F.col("above").alias("fp")).agg(F.count("*").alias("n_children"))
    nodes = materialise(nodes.drop("above").join(children, "fp", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)).cast("bigint")), "nodes", done=(nodes,))

    own = ~F.col("ghost") & (F.col("conv_id") == F.col("first"))
    weight = lambda w: F.when(own, w).otherwise(0).cast("bigint")
    joined = spread_join(cells.drop("ends", "n", "depth"), nodes, "fp")
    local = joined.select("shard", "band", "pre", "post", "fp", "parent", "ghost", "first", F.when(own, F.col("conv_id")).alias("owner"), weight((F.col("n_children") == 0).cast("bigint")).alias("leaves"), weight((F.col("n_convs") - 1) * F.col("last_chars")).alias("saved"))
    local = materialise(local, "local")
    if later is not None:
        held = local.where("owner IS NOT NULL").groupBy(F.col("owner").alias("conv_id"), "band").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
        beyond = later.join(held, ["conv_id", "band"], "left").fillna(0, ["leaves", "saved"])
        beyond = running_sums(beyond, ["i"], [F.desc("band")], {"all_leaves": F.col("leaves"), "all_saved": F.col("saved")})
        none = lambda c, t: F.lit(None).cast(t).alias(c)
        extra = beyond.groupBy("shard", (F.col("band") - 1).alias("band"), F.col("key").alias("fp")).agg(F.sum("all_leaves").alias("leaves"), F.sum("all_saved").alias("saved"))
        extra = extra.select("shard", "band", none("pre", "int"), none("post", "int"), "fp", none("parent", "string"), F.lit(False).alias("ghost"), none("first", "bigint"), none("owner", "bigint"), "leaves", "saved")
        local = local.unionByName(extra)
    parts = local.drop("owner").groupBy("shard", "band").applyInArrow(_subtrees, "fp string, n_leaves bigint, saved_tokens bigint, parent_conv_id bigint")
    sums = parts.groupBy("fp").agg(F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("saved_tokens"), F.min("parent_conv_id").alias("parent_conv_id"))
    lists = cells.where("ends IS NOT NULL").select("fp", "shard", "ends").repartition("fp").sortWithinPartitions("fp", "shard")
    digests = lists.select("fp", "ends").mapInArrow(_digests, "fp string, ends_sha256 string")
    found = nodes.join(sums, "fp").join(digests, "fp", "left")
    return found.select(F.col("first").alias("conv_id"), "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def oracle() -> str:
    """DuckDB SQL of ``op13_prefix_trie``: whole paths, and every pair of a node and a node below it."""
    return """
    WITH t AS MATERIALIZED (
      SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
    crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS tab),
    ids AS MATERIALIZED (
      SELECT conv_id, n, conv_id - conv_id % 100 AS base, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda s: CAST(ascii(s) AS BIGINT))), lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
      FROM (SELECT conv_id, max(pos) AS n FROM t GROUP BY 1), crc),
    plan AS MATERIALIZED (SELECT i.conv_id, i.base, i.h, least(i.h, coalesce(b.n, 0)) AS shift, least(i.h, coalesce(b.n, 0)) + greatest(i.n - i.h, 0) AS n FROM ids i LEFT JOIN ids b ON b.conv_id = i.base),
    reb AS MATERIALIZED (
      SELECT p.conv_id, t.pos, t.role, t.text FROM plan p JOIN t ON t.conv_id = p.base AND t.pos <= p.shift
      UNION ALL SELECT p.conv_id, t.pos - p.h + p.shift, t.role, t.text FROM plan p JOIN t ON t.conv_id = p.conv_id AND t.pos > p.h),
    way AS MATERIALIZED (
      SELECT conv_id, pos AS depth, length(text) AS chars, sha256(string_agg(length(role) || ':' || role || length(text) || ':' || text, '' ORDER BY pos) OVER (PARTITION BY conv_id ORDER BY pos)) AS path FROM reb
      UNION ALL SELECT conv_id, 0, 0, '' FROM plan),
    up AS (SELECT *, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above FROM way),
    node AS MATERIALIZED (SELECT path, any_value(depth) AS depth, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars FROM up GROUP BY 1),
    kids AS (SELECT above AS path, count(*) AS n FROM node WHERE above IS NOT NULL GROUP BY 1),
    pairs AS (SELECT DISTINCT a.path AS top, b.path FROM way a JOIN way b ON a.conv_id = b.conv_id AND b.depth >= a.depth),
    sums AS (SELECT p.top AS path, count(*) FILTER (k.path IS NULL) AS n_leaves, CAST(sum((n.n_convs - 1) * n.chars) AS BIGINT) AS saved_tokens FROM pairs p JOIN node n ON n.path = p.path LEFT JOIN kids k ON k.path = p.path GROUP BY 1),
    stop AS (SELECT w.path, sha256(string_agg(CAST(w.conv_id AS VARCHAR), ',' ORDER BY w.conv_id)) AS ends FROM way w JOIN plan p ON p.conv_id = w.conv_id AND p.n = w.depth GROUP BY 1)
    SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, a.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, s.saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
    FROM node n JOIN sums s ON s.path = n.path LEFT JOIN node a ON a.path = n.above LEFT JOIN kids k ON k.path = n.path LEFT JOIN stop e ON e.path = n.path
    """
