"""The split against a plain loop over single sequences, written from the rules, with refusals."""

import bisect
import hashlib
import random

import pytest

from flowlens.operators import coverage as cv
from flowlens.operators import split as sp

WINDOW, BLOCK, EMBARGO = 100, 900, 50


def key(seed, value):
    return int(hashlib.md5(f"{seed}:{value}".encode()).hexdigest()[:12], 16)


class Plain:
    """Sequences as (source, start, first, max end, attack flows, {type: flows})."""

    def __init__(self, rows, seed):
        self.rows = sorted(rows)
        self.weight = {}
        for r in self.rows:
            b = r[1] - r[1] % BLOCK
            self.weight[b] = self.weight.get(b, 0) + 1
        order = sorted(self.weight, key=lambda b: (key(seed, b), b))
        self.rank = {b: i + 1 for i, b in enumerate(order)}
        n, run, sums = len(self.rows), 0, []
        for b in order:
            run += self.weight[b]
            sums.append(run)
        first = min(range(len(order) - 2), key=lambda i: (abs(sums[i] - 0.6 * n), i))
        second = min(range(first + 1, len(order) - 1), key=lambda i: (abs(sums[i] - 0.8 * n), i))
        self.prefer = {b: 0 if i <= first else 1 if i <= second else 2 for i, b in enumerate(order)}
        self.times = sorted({r[1] for r in self.rows})

    def purge(self, fold_of):
        fold = [fold_of[r[1] - r[1] % BLOCK] for r in self.rows]
        at = {r[1]: f for r, f in zip(self.rows, fold, strict=True)}
        edges = [b for a, b in zip(self.times, self.times[1:], strict=False) if at[a] != at[b]]
        out = []
        for r, f in zip(self.rows, fold, strict=True):
            end = max(r[1] + WINDOW, r[3] + 1)
            near = any(r[1] - EMBARGO < e < end + EMBARGO for e in edges)
            cross = any(r[2] - WINDOW < t <= r[3] and at[t] != f for t in self.times)
            out.append(3 if near or cross else f)
        return out

    def footprint(self, r):
        end = max(r[1] + WINDOW, r[3] + 1)
        lo = max(0, bisect.bisect_left(self.times, r[1] - EMBARGO) - 1)
        return {t - t % BLOCK for t in self.times[lo : bisect.bisect_left(self.times, end + EMBARGO)]}

    def split(self):
        kept0 = self.purge(self.prefer)
        now, taken, made = dict(self.prefer), {}, []

        def attempt(numbers, fold, purpose, score):
            ok = [i for i in numbers if all(taken.get(b, fold) == fold for b in self.footprint(self.rows[i]))]
            if not ok:
                return None
            i = min(ok, key=score)
            for b in self.footprint(self.rows[i]):
                taken[b] = now[b] = fold
            made.append((purpose, fold, self.rows[i][0], self.rows[i][1]))
            return i

        def own(i):
            return self.rank[self.rows[i][1] - self.rows[i][1] % BLOCK]

        def score(kind, fold):
            return lambda i: (kept0[i] != fold, -self.rows[i][5][kind], sum(self.weight[b] for b in self.footprint(self.rows[i]) if now[b] != fold), own(i), i)

        holders = {}
        for i, r in enumerate(self.rows):
            for kind in r[5]:
                holders.setdefault(kind, []).append(i)
        kinds = sorted(holders, key=lambda k: (len({self.rows[i][1] // BLOCK for i in holders[k]}), k))
        for k in kinds:
            if attempt(holders[k], 0, k, score(k, 0)) is None:
                raise ValueError(k)
        sources = set()
        for i in sorted((i for i, r in enumerate(self.rows) if r[4] == 0), key=lambda i: (kept0[i] != 0, own(i), i)):
            if len(sources) < 2 and self.rows[i][0] not in sources and attempt([i], 0, cv.BENIGN, lambda i: i) is not None:
                sources.add(self.rows[i][0])
        for n, k in enumerate(kinds):
            for fold in (1, 2) if n % 2 == 0 else (2, 1):
                if attempt(holders[k], fold, k, score(k, fold)) is None:
                    made.append((k, fold, None, None))
        total, target, best = len(self.rows), [0.6 * len(self.rows), 0.2 * len(self.rows), 0.2 * len(self.rows)], None
        for _ in range(4):
            fold_of, size = dict(taken), [sum(self.weight[b] for b, f in taken.items() if f == c) for c in range(3)]
            for b in sorted(set(self.weight) - set(taken), key=lambda b: (-self.weight[b], self.rank[b])):
                # the rule as it stands: least 2 (size - target) w + w^2
                f = min(range(3), key=lambda c: (2 * (size[c] - target[c]) * self.weight[b] + self.weight[b] ** 2, c))
                fold_of[b] = f
                size[f] += self.weight[b]
            kept = self.purge(fold_of)
            counts = [kept.count(c) for c in range(3)]
            error = sum((c / max(1, sum(counts)) - x) ** 2 for c, x in zip(counts, (0.6, 0.2, 0.2), strict=True))
            if best is None or error < best[0]:
                best = (error, kept)
            need = [x / max(c / max(1, s), 0.01) for x, c, s in zip((0.6, 0.2, 0.2), counts, size, strict=True)]
            target = [x / sum(need) * total for x in need]
        return made, {(r[0], r[1]): f for r, f in zip(self.rows, best[1], strict=True)}


def sequences_of(seed, blocks=24):
    draw = random.Random(seed)
    rows = []
    for host in "abcdef":
        for b in range(blocks):
            for start in range(b * BLOCK, (b + 1) * BLOCK, WINDOW):
                if draw.random() < 0.35:
                    first = start + draw.randrange(WINDOW)
                    kinds = {k: draw.randrange(1, 9) for k in ("T0", "T1", "T2") if host in "abc" and draw.random() < 0.12 * (1 + (k == "T0"))}
                    rows.append((host, start, first, first + draw.choice([5, 30, 150]), sum(kinds.values()), kinds))
    return rows


def frames(spark, rows):
    s = spark.createDataFrame([(r[0], r[1], r[2], r[3], r[4]) for r in rows], "source_ip string, window_start_ms bigint, first_ms bigint, max_end_ms bigint, attack_flows bigint")
    a = spark.createDataFrame([(r[0], r[1], k, n) for r in rows for k, n in r[5].items()], "source_ip string, window_start_ms bigint, attack string, flows bigint")
    return s, a


@pytest.mark.parametrize("seed", [1, 2])
def test_split_against_a_plain_loop(spark, seed):
    rows = sequences_of(seed)
    s, a = frames(spark, rows)
    made, folds = Plain(rows, seed).split()
    blocks = sp.initial_assignment(sp.time_blocks(s, BLOCK), seed)
    found = sp.reserve_coverage(s, a, blocks, WINDOW, BLOCK, EMBARGO, BLOCK)
    assert [(m["purpose"], m["fold"], m.get("source_ip"), m.get("window_start_ms")) for m in found.made] == made
    kept, notes = sp.balance(s, blocks, found.taken, WINDOW, BLOCK, EMBARGO, BLOCK)
    assert {(r["source_ip"], r["window_start_ms"]): r["fold"] for r in kept.collect()} == folds
    assert len(notes) == 4


def test_reservations_are_refused(spark):
    options = lambda rows: spark.createDataFrame(rows, "id bigint, purpose string, blocks array<bigint>, kept_fold int, support bigint, own_rank int, source_ip string, window_start_ms bigint")
    blocks = spark.createDataFrame([(b, 1, 0, b) for b in range(4)], "block_ms bigint, weight bigint, fold int, rank int")
    benign = [(8, None, [2], 0, 1, 1, "x", 0), (9, None, [2], 0, 1, 1, "y", 0)]
    two = [(0, "A", [0], 0, 5, 1, "a", 0), (1, "B", [0, 1], 0, 5, 1, "b", 0), (2, "A", [3], 1, 2, 2, "a", 9), (3, "A", [0], 0, 9, 3, "a", 5)]
    found = cv.reserve(options(two + benign), blocks, ["A", "B"])
    assert found.taken == {0: 0, 1: 0, 2: 0, 3: 1}
    assert [(m["purpose"], m["fold"], m.get("window_start_ms")) for m in found.made] == [("A", 0, 5), ("B", 0, 0), (cv.BENIGN, 0, 0), (cv.BENIGN, 0, 0), ("A", 1, 9), ("A", 2, None), ("B", 2, None), ("B", 1, None)]
    with pytest.raises(ValueError, match="two benign sources"):
        cv.reserve(options(two + benign[:1]), blocks, ["A", "B"])
    with pytest.raises(ValueError, match="no attack types"):
        cv.reserve(options(benign), blocks, [])
    with pytest.raises(ValueError, match="no training coverage for C"):
        cv.reserve(options(two + benign), blocks, ["A", "C"])


def test_blocks_are_dealt_where_most_is_lacking():
    weights = [(b, 5 + b % 3, b) for b in range(12)]
    dealt = cv.deal(weights, {0: 2}, [43.2, 14.4, 14.4])
    assert dealt[0] == 2 and [sum(w for b, w, _ in weights if dealt[b] == c) for c in range(3)] == [40, 16, 16]
    assert cv.corrected_targets((0.6, 0.2, 0.2), [60, 20, 20], [30, 20, 0], 100) == pytest.approx([1.2 / 21.4 * 100, 0.2 / 21.4 * 100, 20 / 21.4 * 100])
