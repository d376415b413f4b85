"""Operator 11: personal data by a semi-Markov conditional random field over whole spans.

Fixed patterns give the base spans: e-mail and IP addresses, card and phone numbers. The field adds what the patterns do
not reach: rewritten forms such as ``jane [at] mail [dot] example``, phone numbers without a plus, cards in dotted
groups. It scores whole candidate spans, not tokens: shape of the digit groups, check digit, number of parts, what stands
before and after. Weights are learnt here by maximum conditional likelihood from base spans, from their rewritten forms, which are
to be found, and from spoiled forms (a wrong check digit, a date, a part over 255), which are not.

Entities are bounded: at most TOKENS tokens and REACH / 2 characters, on one line, with gaps of one space. A dynamic
programme over the ends of candidates then chooses boundaries and types jointly: any token may be outside at no score, an
entity scores the sum of its features, and one that directly follows another a weight for the two types. As tokens
outside score nothing, text without a trigger (a digit, an at sign, "dot", "(at)") falls out of the lattice without loss,
and parts more than REACH characters from any trigger are never tokenised. The work is linear in the text and a task holds
one text at a time. A best-scoring span is added if its marginal probability is SURE or more and it overlaps no base span.

Fitting takes at most PER_KIND passages for each kind of base span and as many without one, by hash, at most one of a
kind from a text. Every whole text is searched, by patterns and field alike.

Defined results: null text counts as empty; a text without spans has empty lists. Repeated rows are searched each. A kind
that the sample does not hold is never added. Offsets are code points, the end exclusive. Other columns are not read,
whatever their names. An empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import hash_sample, materialise, text_or_empty

KINDS = ("email", "ip", "card", "phone")
EMAIL, IP, CARD, PHONE = range(4)
#: Tokens of an entity at most; characters from a trigger within which text is tokenised (an entity has half at most).
TOKENS, REACH = 24, 192
#: Passages of each kind for fitting; characters of one at most; rounds of the fit.
PER_KIND, PASSAGE, ROUNDS = 400, 700, 8
#: Least marginal probability of a span that is added.
SURE = 0.95

Span = tuple[int, int, int]  # kind, start, end

LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
DIGITS = re.compile(r"[0-9](?:[ -]?[0-9])++")
PLUS = re.compile(r"\+[0-9][ ().0-9-]*+")
NOT_DIGIT = re.compile("[^0-9]")


def luhn(digits: str) -> bool:
    """Whether the check digit is right."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def small(part: str) -> bool:
    """Whether a run of digits, of any length, is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[Span]:
    """Spans of the fixed patterns, leftmost and without overlap within a kind, in the order of start and kind.

    Each pattern is sought from its rare part (the at sign, the plus) or by whole runs, so that no text
    makes it step back: the time is linear.
    """
    out: list[Span] = []
    floor, at = 0, text.find("@")
    while at >= 0:
        start, found = at, DOMAIN.match(text, at)
        while found and start > floor and text[start - 1] in LOCAL:
            start -= 1
        if found and start < at:
            out.append((EMAIL, start, found.end()))
            floor = found.end()
        else:
            floor = at + 1
        at = text.find("@", floor)
    for m in DOTTED.finditer(text):
        parts, start = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            end = start + sum(map(len, parts[i : i + 4])) + 3
            if all(map(small, parts[i : i + 4])):
                out.append((IP, start, end))
            start = end + 1
    for m in DIGITS.finditer(text):
        digits = NOT_DIGIT.sub("", m[0]) if len(m[0]) >= 14 else ""
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((CARD, m.start(), m.end()))
    for m in PLUS.finditer(text):
        whole = m[0].rstrip(" ().-")
        if len(whole) >= 4 and 10 <= len(NOT_DIGIT.sub("", whole)) <= 15:
            out.append((PHONE, m.start(), m.start() + len(whole)))
    return sorted(out, key=lambda s: (s[1], s[0]))


# --- candidates and their features ---

TRIGGER = re.compile(r"[0-9@([dD](?:(?<=[0-9@])|(?<=[dD])[oO][tT]\b|(?<=[(\[]) ?[aA][tT] ?[)\]])")
TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\x00-\x7f]+|\S")
AT = re.compile(r" ?[(\[] ?at ?[)\]] ?| at |@", re.I)
DOT = re.compile(r" ?[(\[] ?(?:dot|\.) ?[)\]] ?| dot |\.", re.I)
FORMS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}"),
    re.compile(r"[0-9]+(?:[ .-]?[0-9]+)*"),
    re.compile(r"\+?\(?[0-9][ ().0-9-]*[0-9]"),
)
SEPARATED = re.compile(r"[A-Za-z0-9]+")


def passages(text: str, reach: int = REACH) -> Iterator[tuple[int, int]]:
    """(start, end) of the parts within ``reach`` of a trigger."""
    start = end = -1
    for m in TRIGGER.finditer(text):
        lo, hi = max(0, m.start() - reach), min(len(text), m.end() + reach)
        if lo > end:
            if end >= 0:
                yield start, end
            start = lo
        end = hi
    if end >= 0:
        yield start, end


def _around(text: str, i: int) -> str:
    if not 0 <= i < len(text):
        return "^"
    c = text[i]
    return "9" if "0" <= c <= "9" else "a" if c.isalpha() else "s" if c.isspace() else c


def _kinds(span: str) -> Iterator[tuple[int, str]]:
    """Kinds whose loose form a span has, with the span in plain spelling."""
    letters = any(c.isalpha() for c in span)
    plain = DOT.sub(".", span) if letters or "[" in span or "(.)" in span else span
    if letters or "@" in span:
        plain = AT.sub("@", plain)
        if plain.count("@") == 1 and FORMS[EMAIL].fullmatch(plain):
            yield EMAIL, plain
    if not any(c.isalpha() for c in plain):
        if plain.count(".") == 3 and FORMS[IP].fullmatch(plain):
            yield IP, plain
        n = sum("0" <= c <= "9" for c in plain)
        if not letters and 12 <= n <= 19 and FORMS[CARD].fullmatch(plain):
            yield CARD, plain
        if not letters and 7 <= n <= 15 and FORMS[PHONE].fullmatch(plain):
            yield PHONE, plain


def features(kind: int, plain: str, text: str, start: int, end: int) -> list[str]:
    """Features of a whole span."""
    out = ["any", f"before {_around(text, start - 1)}", f"before {_around(text, start - 2)}{_around(text, start - 1)}", f"after {_around(text, end)}", f"after {_around(text, end)}{_around(text, end + 1)}", f"rewritten {plain != text[start:end]}"]
    if kind == EMAIL:
        name, domain = plain.split("@")
        last = domain.rsplit(".", 1)[1]
        out += [f"labels {domain.count('.')}", f"last {last.isalpha()} {min(len(last), 8)}", f"name {min(len(name), 12) // 3}", f"name starts {_around(name, 0)}"]
    elif kind == IP:
        out += [f"parts {all(map(small, plain.split('.')))}"]
    else:
        digits = NOT_DIGIT.sub("", plain)
        groups = "-".join(str(len(g)) for g in SEPARATED.findall(plain))
        marks = "".join(sorted(set(NOT_DIGIT.findall(plain))))
        out += [f"digits {len(digits)}", f"groups {groups}", f"marks {marks}", f"starts {plain[0] if plain[0] in '+(' else 9}"]
        out += [f"check {luhn(digits)}"] if kind == CARD else []
    return [f"{KINDS[kind]} {f}" for f in out]


Candidate = tuple[int, int, int, list[str], int, int]  # first token, end token, kind, features, start, end


def candidates(text: str, start: int, end: int) -> list[Candidate]:
    """Spans of a passage that have the loose form of a kind. Their tokens are numbered within the passage."""
    tokens = [(m.start(), m.end()) for m in TOKEN.finditer(text, start, end)]
    out: list[Candidate] = []
    for i, (lo, _) in enumerate(tokens):
        first = text[lo]
        if not (first.isascii() and (first.isalnum() or first in "+(._%-")):
            continue
        digits, marked = 0, False
        for j in range(i, min(len(tokens), i + TOKENS)):
            a, b = tokens[j]
            if b - lo > REACH // 2 or j > i and (a - tokens[j - 1][1] > 1 or a > tokens[j - 1][1] and text[a - 1] != " "):
                break
            c = text[a]
            if not c.isascii():
                break
            word = c.isalpha()
            digits += b - a if "0" <= c <= "9" else 0
            marked = marked or c == "@" or word and text[a:b].lower() in ("at", "dot")
            if not word and not "0" <= c <= "9" or digits < 7 and not marked and (word or digits < 4):
                continue
            out += [(i, j + 1, kind, features(kind, plain, text, lo, b), lo, b) for kind, plain in _kinds(text[lo:b])]
    return out


# --- the field ---


def _lse(xs: Iterable[float]) -> float:
    xs = [x for x in xs if x > -math.inf]
    if not xs:
        return -math.inf
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


OUTSIDE = len(KINDS)


class Lattice:
    """Segmentations of a passage: candidates between break points, tokens outside in between."""

    def __init__(self, found: list[tuple[int, int, int]], score: list[float], follows: Callable[[int, int], float]):
        points = sorted({p for c in found for p in c[:2]})
        at = {p: b for b, p in enumerate(points)}
        self.n, self.score, self.follows = len(points), score, follows
        self.arcs = [(at[i], at[j], kind) for i, j, kind in found]
        self.ending: list[list[int]] = [[] for _ in points]
        for c, (_, b, _) in enumerate(self.arcs):
            self.ending[b].append(c)

    def _before(self, alpha: list[list[float]], b: int, kind: int) -> list[float]:
        return [alpha[b][k] + (self.follows(k, kind) if k != OUTSIDE else 0.0) for k in range(OUTSIDE + 1)]

    def forward(self, total: Callable[[Iterable[float]], float]) -> list[list[float]]:
        """By break point and last label the total (log of the sum, or best) over segmentations up to there."""
        alpha = [[-math.inf] * OUTSIDE + [0.0]]
        for b in range(self.n):
            if b:
                alpha.append([-math.inf] * OUTSIDE + [total(alpha[b - 1])])
            for kind in range(OUTSIDE):
                arcs = [c for c in self.ending[b] if self.arcs[c][2] == kind]
                if arcs:
                    alpha[b][kind] = total([total(self._before(alpha, self.arcs[c][0], kind)) + self.score[c] for c in arcs])
        return alpha

    def marginals(self) -> tuple[float, list[float], dict[tuple[int, int], float]]:
        """(log of the sum over all segmentations, probability of each candidate, expected successions of types)."""
        alpha = self.forward(_lse)
        whole = _lse(alpha[-1])
        beta = [[-math.inf] * (OUTSIDE + 1) for _ in range(self.n)]
        beta[-1] = [0.0] * (OUTSIDE + 1)
        starting: list[list[int]] = [[] for _ in range(self.n)]
        for c, (a, _, _) in enumerate(self.arcs):
            starting[a].append(c)
        for b in range(self.n - 2, -1, -1):
            for k in range(OUTSIDE + 1):
                go = [beta[b + 1][OUTSIDE]]
                for c in starting[b]:
                    _, e, kind = self.arcs[c]
                    go.append((self.follows(k, kind) if k != OUTSIDE else 0.0) + self.score[c] + beta[e][kind])
                beta[b][k] = _lse(go)
        found, pairs = [], defaultdict(float)
        for c, (a, b, kind) in enumerate(self.arcs):
            ways = [x + self.score[c] + beta[b][kind] - whole for x in self._before(alpha, a, kind)]
            found.append(sum(math.exp(w) for w in ways if w > -math.inf))
            for k, w in enumerate(ways[:OUTSIDE]):
                if w > -math.inf:
                    pairs[k, kind] += math.exp(w)
        return whole, found, pairs

    def best(self) -> list[int]:
        """Candidates of the best segmentation; where scores tie, that with tokens outside."""
        alpha = self.forward(max)
        out, b = [], self.n - 1
        label = max(range(OUTSIDE + 1), key=lambda k: (alpha[b][k], k))
        while True:
            if label == OUTSIDE:
                if b == 0:
                    return out[::-1]
                b -= 1
            else:
                arcs = [c for c in self.ending[b] if self.arcs[c][2] == label]
                c = max(arcs, key=lambda c: (max(self._before(alpha, self.arcs[c][0], label)) + self.score[c], -c))
                out.append(c)
                b = self.arcs[c][0]
                ways = self._before(alpha, b, label)
                label = max(range(OUTSIDE + 1), key=lambda k: (ways[k], k))
                continue
            label = max(range(OUTSIDE + 1), key=lambda k: (alpha[b][k], k))


def follow(a: int, b: int) -> str:
    """Feature of an entity directly after another."""
    return f"{KINDS[a]} then {KINDS[b]}"


Weights = dict[str, float]


def lattice(found: list[Candidate], weights: Weights) -> Lattice:
    return Lattice([c[:3] for c in found], [sum(weights.get(f, 0.0) for f in c[3]) for c in found], lambda a, b: weights.get(follow(a, b), 0.0))


def gradient(found: list[Candidate], gold: set[int], weights: Weights) -> tuple[float, Weights]:
    """Log-likelihood of the gold candidates and its gradient."""
    field = lattice(found, weights)
    whole, p, pairs = field.marginals()
    grad: Weights = defaultdict(float)
    value = -whole
    for c, (candidate, x) in enumerate(zip(found, p, strict=True)):
        step = (c in gold) - x
        value += field.score[c] * (c in gold)
        if abs(step) > 1e-9:
            for f in candidate[3]:
                grad[f] += step
    order = sorted(gold, key=lambda c: found[c][0])
    for a, b in zip(order, order[1:], strict=False):
        if found[a][1] == found[b][0]:
            pairs[found[a][2], found[b][2]] -= 1
            value += weights.get(follow(found[a][2], found[b][2]), 0.0)
    for (a, b), x in pairs.items():
        grad[follow(a, b)] -= x
    return value, grad


def fit(examples: list[tuple[str, list[Span]]], rounds: int = ROUNDS, rate: float = 0.5, decay: float = 1e-4) -> Weights:
    """Weights from (passage, its spans), by stochastic ascent with a step for each feature that falls with its use.

    Passages whose spans are no candidates, or overlap, teach nothing and are left out.
    """
    rows = []
    for text, spans in examples:
        found = candidates(text, 0, len(text))
        place = {(c[2], c[4], c[5]): k for k, c in enumerate(found)}
        gold = [place.get(s) for s in spans]
        ordered = sorted(spans, key=lambda s: s[1])
        if found and None not in gold and all(a[2] <= b[1] for a, b in zip(ordered, ordered[1:], strict=False)):
            rows.append((found, set(gold)))
    rows.sort(key=lambda r: zlib.crc32(repr(r[0][0][3:]).encode()))
    weights: Weights = defaultdict(float)
    used: Weights = defaultdict(float)
    for _ in range(rounds):
        for found, gold in rows:
            for f, g in gradient(found, gold, weights)[1].items():
                g -= decay * weights[f]
                used[f] += g * g
                weights[f] += rate * g / math.sqrt(1e-8 + used[f])
    return dict(weights)


def rewritten(kind: int, span: str, draw: int) -> str | None:
    """The same datum in a spelling that the patterns miss; ``draw`` chooses one."""
    if kind == EMAIL:
        at, dot = ((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), ("[at]", "."))[draw % 4]
        name, domain = span.split("@")
        return name.strip(".") + at + domain.replace(".", dot) if name.strip(".") else None
    if kind == IP:
        return span.replace(".", ("[.]", "(.)", " dot ")[draw % 3])
    digits = NOT_DIGIT.sub("", span)
    if kind == CARD:
        return ".".join(digits[i : i + 4] for i in range(0, len(digits), 4))
    local = digits[-10:]
    return (f"({local[:3]}) {local[3:6]}-{local[6:]}", f"{local[:3]}-{local[3:6]}-{local[6:]}", f"{local[:3]}.{local[3:6]}.{local[6:]}", f"{local[:3]} {local[3:6]} {local[6:]}")[draw % 4]


def spoiled(kind: int, span: str, draw: int) -> str | None:
    """Something alike that is no personal datum."""
    if kind == EMAIL:
        return None
    digits = NOT_DIGIT.sub("", span)
    if kind == IP:
        return ".".join((span.split(".")[:3] + [str(256 + draw % 700)])) if draw % 2 else ".".join(span.split(".")[:3])
    if kind == CARD:
        wrong = digits[:-1] + str((int(digits[-1]) + 1 + draw % 9) % 10)
        return ".".join(wrong[i : i + 4] for i in range(0, len(wrong), 4)) if draw % 2 else wrong
    two = f"{draw % 28 + 1:02d}"
    return (digits[:8], digits[:10], f"20{digits[:2]}-{draw % 12 + 1:02d}-{two}", f"{two}.{draw % 12 + 1:02d}.20{digits[:2]}", f"{digits[:3]}-{digits[3:7]}", f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}-{digits[-2:]}")[draw % 6]


def lessons(text: str, spans: list[Span]) -> Iterator[tuple[str, list[Span]]]:
    """A passage as it is, and with one span rewritten and one spoiled."""
    yield text, spans
    draw = zlib.crc32(text.encode())
    if not spans or any(a[2] > b[1] for a, b in zip(spans, spans[1:], strict=False)):
        return
    at = draw % len(spans)
    kind, start, end = spans[at]
    for other, stays in ((rewritten, True), (spoiled, False)):
        new = other(kind, text[start:end], draw >> 4)
        if new is not None:
            by = len(new) - (end - start)
            moved = [(k, a + by, b + by) if a >= end else (k, a, b) for k, a, b in spans[:at] + spans[at + 1 :]]
            said = text[:start] + new + text[end:]
            yield said, sorted(moved + ([(kind, start, start + len(new))] if stays else []), key=lambda s: s[1])


def added_spans(text: str, base: list[Span], weights: Weights, sure: float = SURE) -> list[Span]:
    """Spans of the best segmentations that are sure enough and overlap no base span."""
    out: list[Span] = []
    known = {f.split()[0] for f in weights}
    for start, end in passages(text):
        found = [c for c in candidates(text, start, end) if KINDS[c[2]] in known]
        if not found or not weights:
            continue
        field = lattice(found, weights)
        best = field.best()
        if best:
            p = field.marginals()[1]
            out += [(found[c][2], found[c][4], found[c][5]) for c in best if p[c] >= sure]
    ends = sorted(base, key=lambda s: s[1])
    return [s for s in out if not any(a < s[2] and s[1] < b for _, a, b in ends)] if len(ends) < 50 else _apart(out, ends)


def _apart(spans: list[Span], base: list[Span]) -> list[Span]:
    """``spans`` that overlap none of many base spans, in one pass over both in order of start."""
    out, at, reach = [], 0, -1
    for s in sorted(spans, key=lambda s: s[1]):
        while at < len(base) and base[at][1] < s[2]:
            reach, at = max(reach, base[at][2]), at + 1
        if reach <= s[1]:
            out.append(s)
    return out


# --- on tables ---

SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def sample(df: DataFrame, id_col: str, text: str, per_kind: int = PER_KIND) -> list[tuple[str, list[Span]]]:
    """A bounded sample of passages with their base spans: ``per_kind`` of each kind, and as many without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for said in batch.column(0).to_pylist():
                spans, least = base_spans(said), {}
                for start, end in passages(said):
                    if end - start > PASSAGE:
                        continue
                    inside = [(k, a - start, b - start) for k, a, b in spans if start <= a and b <= end]
                    part = said[start:end]
                    for kind in {k for k, _, _ in inside} or {OUTSIDE}:
                        least[kind] = min(least.get(kind, (1 << 32, "", [])), (zlib.crc32(part.encode()), part, inside))
                out += [{"label": kind, "part": part, "spans": [x for s in inside for x in s]} for kind, (_, part, inside) in least.items()]
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("label", pa.int32()), ("part", pa.string()), ("spans", pa.list_(pa.int32()))]))

    found = materialise(df.select(text_or_empty(f"`{text}`").alias("said")).mapInArrow(run, "label int, part string, spans array<int>"), "passages")
    picked: list[tuple[str, list[Span]]] = []
    for kind in range(OUTSIDE + 1):
        rows = hash_sample(found.where(F.col("label") == kind).distinct(), per_kind, "part").collect()  # at most ``per_kind``
        picked += [(r["part"], [tuple(r["spans"][i : i + 3]) for i in range(0, len(r["spans"]), 3)]) for r in rows]
    return picked


def train(df: DataFrame, id_col: str = "doc_id", text: str = "text", per_kind: int = PER_KIND) -> Weights:
    """Weights from a bounded sample of the table's own passages."""
    return fit([x for part, spans in sample(df, id_col, text, per_kind) for x in lessons(part, spans)])


def find(df: DataFrame, weights: Weights, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added) of every row: spans of the patterns, and those that the field adds, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both: tuple[list, list] = ([], [])
            for said in batch.column(1).to_pylist():
                base = base_spans(said)
                added = sorted(added_spans(said, base, weights), key=lambda s: (s[1], s[0]))
                for out, spans in zip(both, (base, added), strict=True):
                    out.append([{"kind": KINDS[k], "start": a, "end": b} for k, a, b in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, _SPAN) for x in both)], names=[id_col, "base", "added"])

    rows = df.select(F.col(f"`{id_col}`").cast("bigint").alias(id_col), text_or_empty(f"`{text}`").alias("said"))
    return rows.mapInArrow(run, f"`{id_col}` bigint, base {SPANS}, added {SPANS}")


def joined(spans: Column) -> Column:
    """kind:start:end of spans by start, then kind as listed, joined by commas."""
    place = lambda x: F.array_position(F.array(*map(F.lit, KINDS)), x["kind"])
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(x["start"].alias("start"), place(x).alias("place"), x["kind"].alias("kind"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def digest_columns(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts and digest of the base spans, and all spans, of each row of ``find``."""
    of_kind = lambda k: F.filter("base", lambda x: x["kind"] == k)
    counts = [F.size(of_kind(k)).cast("bigint").alias(f"n_{k}") for k in KINDS]
    return found.select(F.col(f"`{id_col}`").alias("doc_id"), *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "added")).alias("spans"), F.size("added").cast("bigint").alias("n_added"))
