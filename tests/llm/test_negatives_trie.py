"""Hard negatives and the prefix trie against plain Python over every row."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.llm import hard_negatives as hn
from flowlens.llm import prefix_trie as pt


def test_hilbert_curve():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        grid = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), axis=-1).reshape(-1, dims)
        at = hn.hilbert(grid, bits)
        assert sorted(at) == list(range(len(grid)))  # each cell once
        walk = grid[np.argsort(at)]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()  # neighbours on the curve touch
    assert hn.hilbert(np.zeros((2, 0))).tolist() == [0, 0]


def test_bounds_hold():
    draw = np.random.default_rng(1)
    a, x = draw.integers(-300, 300, (7, 6)).astype(float), draw.integers(-300, 300, (40, 6)).astype(float)
    low, high = hn.bounds(a, x.min(axis=0)[None], x.max(axis=0)[None])
    s = hn.scores(a, x)
    assert (low[:, 0] <= s.min(axis=1)).all() and (s.max(axis=1) <= high[:, 0]).all()


def test_scores_are_exact():
    big = np.array([[2.0**40 + 1, 3.0]])
    assert hn.scores(big, np.array([[2.0**20 + 1, 5.0]]))[0, 0] == (2**40 + 1) * (2**20 + 1) + 15
    with pytest.raises(OverflowError):
        hn.scores(big, big)


def plain_negatives(rows, anchor):
    floor = lambda v: [int(np.floor(256 * np.float64(x))) for x in v]
    kept = [(i, lab, floor(v)) for i, v, lab in rows if i is not None and lab is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: B905, E731
    out = []
    for i, lab, v in kept:
        if not anchor(i):
            continue
        same = sorted((-dot(v, w), j) for j, k, w in kept if k == lab and j != i)[:5]
        for s, j in same:
            near = sorted((-dot(v, w), m) for m, k, w in kept if k != lab and 50 * -s <= 100 * dot(v, w) <= 95 * -s)[:3]
            out += [(i, j, r + 1, m, -s, -t) for r, (t, m) in enumerate(near)]
    return sorted(out)


def vectors(seed, n, dim=6):
    draw = random.Random(seed)
    hot = [0.5] * dim
    out = []
    for i in range(n):
        v = list(hot) if i % 3 == 0 else [draw.gauss(0.2, 0.4) + (i % 5 == 0) for _ in range(dim)]
        out.append((i, [float(np.float32(x)) for x in v], draw.choice([0, 0, 0, 1, 2])))
    return out


@pytest.mark.parametrize("block", [4, 1024])
def test_hard_negatives(spark, monkeypatch, block):
    rows = vectors(block, 160)
    rows += [(900, None, 1), (901, [1.0, None], 1), (902, [float("nan")], 0), (903, [float("inf")] * 6, 0), (904, [0.3] * 6, None), (None, [0.3] * 6, 1), (905, [], 0), (910, [0.4, 0.2], 2), (7, [0.1] * 6, 1)]
    monkeypatch.setattr(hn, "BLOCK", block)
    monkeypatch.setattr(hn, "GROUP", min(block, 8))
    monkeypatch.setattr(hn, "GROUPS", 2)
    monkeypatch.setattr(hn, "PAGE", 5)
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").withColumn("Score", F.lit("mine")).withColumn("block", F.lit(1))
    got = hn.hard_negatives(table, anchors=F.col("vec_id") % 10 == 0)
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert sorted(tuple(r[c] for c in names) for r in got.collect()) == plain_negatives(rows, lambda i: i % 10 == 0)
    none = table.limit(0)
    assert block > 4 or hn.hard_negatives(none).count() == 0


def test_blocks_are_pruned(spark):
    draw = random.Random(3)
    centres = [[draw.gauss(0, 1) for _ in range(8)] for _ in range(40)]
    rows = [(i, [c + draw.gauss(0, 0.01) for c in centres[i % 40]], i % 4 % 2) for i in range(4000)]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    usable = hn.materialise(hn.usable(table, "vec_id", "embedding", F.col("label")), "t")
    dim, axes = hn.spread(usable)
    blocks = hn.packed(usable, dim, axes, 25, "b")
    groups = hn.packed(usable.where("vec_id = 0"), dim, axes, 64, "g")
    best = sorted((sum(x * y for x, y in zip(*([np.floor(256 * np.array(v)) for v in (rows[0][1], r[1])]), strict=True)) for r in rows[1:] if r[2] == 0), reverse=True)[4]
    window = groups.select(F.col("block").alias("grp"), F.lit(0).alias("spot"), F.array(F.struct(F.lit(hn.INT_MIN).alias("least"), F.lit(hn.INT_MAX).alias("most"), F.lit(int(best)).alias("beat"), F.lit(hn.INT_MAX).alias("beat_id"))).alias("list"))
    read = hn.choose(hn.with_windows(groups, window), blocks, True, None).count()
    assert 0 < read < 0.2 * blocks.where("label = 0").count()


def plain_trie(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [x[1:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - int(math.fmod(c, 100)), [])[:h] + turns[h:]  # the sign of c, as in SQL
    paths = {c: [tuple(t[:d]) for d in range(len(t) + 1)] for c, t in built.items()}
    members = defaultdict(list)
    for c in sorted(paths):
        for p in paths[c]:
            members[p].append(c)
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(r) == len(q) + 1 and r[: len(q)] == q for r in below)]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q)
        ends = ",".join(str(c) for c in cs if tuple(built[c]) == p)
        out.append((cs[0], len(p), members[p[:-1]][0] if p else -1, len(cs), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(df):
    return sorted(tuple(-1 if r[c] is None else r[c] for c in NAMES) for r in df.collect())


@pytest.mark.parametrize(("conversations", "places"), [(3, 2), (7, 3), (2048, 32)])
def test_prefix_trie(spark, conversations, places):
    draw = random.Random(places)
    rows = []
    for c in [*range(0, 130, 3), 100, 200, 201, 205, 299, 305]:
        for t in range(draw.choice([1, 2, 3, 6, 9, 12])):
            rows.append((c, t, draw.choice(["user", None]), draw.choice(["é", "ab", None, "same"])))
        if c % 4 == 0:
            rows += [(c, None, "user", "first"), (c, 1, "user", "ab"), (c, 1, "user", "ab")]
    rows += [(None, 0, "user", "x"), (-5, 0, "user", "y")]
    rows = [r for r in rows if r[0] != 0] + [(0, t, "system", "head") for t in range(5)]
    rows += [(c, t, "system", "head" if t < 9 else "tail") for c in range(400, 430) for t in range(10)]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("POS", F.lit(1)).withColumn("key", F.lit("k"))
    built = pt.with_shared_heads(pt.conversation_turns(table))
    got = trie_rows(pt.prefix_trie(*built, conversations, places))
    assert len(got) > 100 and got == plain_trie(rows)


def test_prefix_trie_of_nothing(spark):
    empty = spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")
    assert pt.prefix_trie(*pt.with_shared_heads(pt.conversation_turns(empty))).count() == 0
    assert list(pt.bits(0b1011)) == [0, 1, 3]
