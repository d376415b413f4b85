"""Personal data: patterns against plain regular expressions, the field against every segmentation, held-out spans."""

import hashlib
import itertools
import math
import random
import re
import time

from pyspark.sql import functions as F

from flowlens.llm import pii

PATTERNS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = []
    for kind, pattern in enumerate(PATTERNS):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            right = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(map(int, reversed(digits)))) % 10 == 0
            if (kind == 0) or (kind == 1 and all(int(p) <= 255 for p in m[0].split("."))) or (kind == 2 and 14 <= len(digits) <= 19 and right) or (kind == 3 and 10 <= len(digits) <= 15):
                out.append((kind, *m.span()))
    return sorted(out, key=lambda s: (s[1], s[0]))


def test_base_spans_are_those_of_the_patterns():
    draw = random.Random(1)
    found = 0
    for alphabet in ("a.@-b", "12.5 ", "0123456789 -", "+1 (2)-.3", "ä@a.b+1 2.3-4_%"):
        for _ in range(3000):
            text = "".join(draw.choice(alphabet) for _ in range(draw.randrange(60)))
            assert pii.base_spans(text) == plain_base(text), text
            found += len(pii.base_spans(text))
    assert found > 1000
    assert pii.base_spans("a@b.c_d@e.f") == plain_base("a@b.c_d@e.f")


def test_long_texts_take_linear_time():
    began = time.time()
    for text in ("1" * 2_000_000, "a" * 2_000_000, "a." * 500_000, "@a" * 300_000, "+1" * 300_000, "1.2." * 300_000, "(at)" * 50_000):
        pii.base_spans(text)
        list(pii.passages(text))
    assert time.time() - began < 20


def random_lattice(draw):
    n = draw.randrange(2, 7)
    spans = sorted({(i, draw.randrange(i + 1, n + 1), draw.randrange(4)) for i in [draw.randrange(n) for _ in range(6)]})
    score = [draw.gauss(0, 1.5) for _ in spans]
    after = {(a, b): draw.gauss(0, 1) for a in range(4) for b in range(4)}
    return spans, score, after


def all_segmentations(spans, score, after):
    for size in range(len(spans) + 1):
        for pick in itertools.combinations(range(len(spans)), size):
            order = sorted(pick, key=lambda c: spans[c][0])
            if all(spans[a][1] <= spans[b][0] for a, b in itertools.pairwise(order)):
                joins = [(spans[a][2], spans[b][2]) for a, b in itertools.pairwise(order) if spans[a][1] == spans[b][0]]
                yield order, joins, sum(score[c] for c in pick) + sum(after[j] for j in joins)


def test_field_against_every_segmentation():
    draw = random.Random(2)
    for _ in range(150):
        spans, score, after = random_lattice(draw)
        field = pii.Lattice(spans, score, lambda a, b, after=after: after[a, b])
        every = list(all_segmentations(spans, score, after))
        whole, p, pairs = field.marginals()
        total = sum(math.exp(s) for _, _, s in every)
        assert math.isclose(whole, math.log(total), abs_tol=1e-9)
        for c in range(len(spans)):
            assert math.isclose(p[c], sum(math.exp(s) for o, _, s in every if c in o) / total, abs_tol=1e-9)
        for j in after:
            assert math.isclose(pairs.get(j, 0.0), sum(js.count(j) * math.exp(s) for _, js, s in every) / total, abs_tol=1e-9)
        best = max(every, key=lambda e: e[2])
        assert field.best() == best[0]


def test_gradient_against_differences():
    text = "call +1 (017) 555-7713, 4539 1488 0343 6467 or a.b@c.example.com at 10.0.0.7 now"
    found = pii.candidates(text, 0, len(text))
    gold = {k for k, c in enumerate(found) if (c[2], c[4], c[5]) in pii.base_spans(text)}
    assert len(gold) == 4
    draw = random.Random(3)
    weights = {f: draw.gauss(0, 0.3) for c in found for f in c[3]}
    value, grad = pii.gradient(found, gold, weights)
    for f in list(weights)[:40]:
        up = pii.gradient(found, gold, {**weights, f: weights[f] + 1e-5})[0]
        assert math.isclose((up - value) / 1e-5, grad.get(f, 0.0), abs_tol=1e-3)


def card(draw):
    body = "".join(draw.choice("123456789") for _ in range(15))
    return next(body + d for d in "0123456789" if pii.luhn(body + d))


def datum(draw, kind):
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    return (lambda: f"n{digits(2)}.x@mail{digits(1)}.example.com", lambda: ".".join(str(draw.randrange(256)) for _ in range(4)), lambda: card(draw), lambda: f"+1 ({digits(3)}) {digits(3)}-{digits(4)}")[kind]()


def texts(seed, n):
    draw = random.Random(seed)
    word = lambda: draw.choice(["alpha", "or", "the", "beta,", "größe", "12", "3.5", "2024", "no.", "été"])
    out = []
    for i in range(n):
        words = [word() for _ in range(30)]
        if i % 6 < 4:
            words[draw.randrange(5, 25)] = datum(draw, i % 6)
        elif i % 6 == 4:
            words[9] = draw.choice(["order 55501234567", "2023-04-05", "1.2.3", "(12) 34-56", "999.1.1.1", "4539148803436468"])
        out.append((i, " ".join(words)))
    return out


def test_held_out_spans(spark):
    table = spark.createDataFrame(texts(1, 600) + [(900, None), (901, "")], "doc_id bigint, text string")
    weights = pii.train(table)
    hit = missed = false = 0
    draw = random.Random(9)
    for i, text in texts(2, 600):
        base = pii.base_spans(text)
        if not base:
            false += len(pii.added_spans(text, [], weights))
            continue
        assert pii.added_spans(text, base, weights) == []
        found = pii.added_spans(text, [], weights)  # what the field alone finds of the base spans
        kind, start, end = base[0]
        new = pii.rewritten(kind, text[start:end], draw.randrange(12))
        found_new = pii.added_spans(text[:start] + new + text[end:], [], weights)
        for ok in (base[0] in found, (kind, start, start + len(new)) in found_new):
            hit, missed = hit + ok, missed + (not ok)
        bad = pii.spoiled(kind, text[start:end], draw.randrange(12))
        if bad:
            false += len(pii.added_spans(text[:start] + bad + text[end:], [], weights))
    assert hit / (hit + missed) > 0.95 and false <= 6, (hit, missed, false)


def test_tables(spark):
    said = "x@y.example 10.1.2.3 +1 (017) 555-7713 " + card(random.Random(4))
    rows = [(1, None), (2, ""), (3, said), (3, said), (4, "ß" + said), (None, "a@b.cc")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("BASE", F.lit("mine")).withColumn("spans", F.lit(0))
    got = sorted((tuple(r) for r in pii.digest_columns(pii.find(table, pii.train(table))).collect()), key=str)
    assert len(got) == len(rows)
    for doc, *counts, digest, spans, added in got:
        text = next(t for i, t in rows if i == doc) or ""
        base = plain_base(text)
        want = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in base)
        assert counts == [sum(s[0] == k for s in base) for k in range(4)] and digest == hashlib.sha256(want.encode()).hexdigest()
        assert spans == want and added == 0
    empty = table.limit(0)
    assert pii.find(empty, pii.train(empty)).count() == 0


def test_many_spans_of_one_text():
    text = " ".join(f"a{i}@b.cc" for i in range(200))
    base = pii.base_spans(text)
    extra = [(3, a, b) for _, a, b in base[::7]] + [(3, len(text), len(text) + 2)]
    assert pii._apart(extra, base) == [(3, len(text), len(text) + 2)]
