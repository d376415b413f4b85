"""Operator 1: byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can never be merged, since every
merge result is itself a token. Such a pair is a certain cut: the two sides are encoded on their
own and their ids are concatenated, which equals the encoding of the whole. The text is first cut
at added tokens and by the vocabulary's pre-tokenisation pattern, then at the forced boundaries;
what is left are short byte strings that repeat a lot, so each task keeps their ids.

Defined results: a null text is encoded as the empty text (no ids, decoded to ``""``). Repeated
rows are encoded each on its own; texts are processed whole at any length. An input that has the
output columns already has them replaced; all other columns pass through. An empty table gives an
empty table.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The published pre-tokenisation of the byte-level vocabulary. Its white space is Unicode's, which
#: ``\s`` of this engine exceeds by the separators U+001C to U+001F.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"""
#: Bytes that each of a task's two tables of known pieces may take; a full one is emptied, which changes no result.
MEMO = 60_000_000
#: Fragments of more bytes are merged one by one, with a heap.
LONG = 64
NEVER = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in the vocabulary file.

    Printable bytes stand for themselves; the others follow from code point 256 on.
    """
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(hidden)}


def _room(pieces: Iterable[str | bytes]) -> int:
    """About the bytes that a table needs for pieces: each with its ids, of which it has no more than bytes."""
    return sum(200 + 9 * len(p) for p in pieces)


class Vocabulary:
    """Token bytes, merge ranks, and the byte pairs that occur inside tokens."""

    def __init__(self, text: str):
        spec = json.loads(text)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items()}
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        pairs = [(raw(a), raw(b)) for a, b in merges]
        self.joined = np.array([self.ids[a + b] for a, b in pairs] or [0], np.int64)  # by rank
        self.rank_of = {self.ids[a] << 32 | self.ids[b]: r for r, (a, b) in enumerate(pairs)}
        self.keys = np.array(sorted(self.rank_of) or [-1], np.int64)
        self.key_ranks = np.array([self.rank_of[k] for k in sorted(self.rank_of)] or [0], np.int64)
        self.byte_ids = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.added.items()}
        self.inside = {t[i : i + 2] for t in self.ids for i in range(len(t) - 1)}
        self.added_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.pieces = regex.compile(PATTERN).findall
        self.by_piece: dict[str, tuple[int, ...]] = {}
        self.by_fragment: dict[bytes, tuple[int, ...]] = {}
        self.piece_room = self.fragment_room = 0

    def fragments(self, piece: bytes) -> list[bytes]:
        """``piece`` cut at every forced boundary."""
        inside = self.inside
        cuts = [i for i in range(1, len(piece)) if piece[i - 1 : i + 1] not in inside]
        return [piece[a:b] for a, b in zip([0, *cuts], [*cuts, len(piece)], strict=True)] if cuts else [piece]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge ranks of id pairs; NEVER where there is none or an id is negative."""
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[at] == keys) & (left >= 0) & (right >= 0), self.key_ranks[at], NEVER)

    def merge_many(self, fragments: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of short fragments, all merged at once: one lowest-ranked pair of each in a round.

        Row by row it does what merging one fragment does: the adjacent pair of the lowest rank,
        the leftmost first, is joined until none is left.
        """
        n, width = len(fragments), max(map(len, fragments))
        sizes = np.fromiter(map(len, fragments), np.int64, n)
        raw = np.frombuffer(b"".join(f.ljust(width, b"\0") for f in fragments), np.uint8).reshape(n, width)
        column = np.arange(width)
        ids = np.full((n, width + 1), -1, np.int64)  # the last column stands for "no neighbour"
        ids[:, :width] = np.where(column < sizes[:, None], self.byte_ids[raw], -1)
        after = np.broadcast_to(np.minimum(column + 1, width), (n, width)).copy()
        before = np.broadcast_to(np.where(column, column - 1, width), (n, width)).copy()
        before = np.concatenate([before, np.full((n, 1), width)], axis=1)
        ranks = np.full((n, width + 1), NEVER, np.int64)
        ranks[:, : width - 1] = self._ranks(ids[:, : width - 1], ids[:, 1:width]) if width > 1 else NEVER
        rows = np.arange(n)
        while len(rows):
            at = ranks[rows].argmin(axis=1)
            best = ranks[rows, at]
            some = best < NEVER
            rows, at, best = rows[some], at[some], best[some]
            gone = after[rows, at]
            follow = after[rows, gone]
            lead = before[rows, at]
            joined = self.joined[best]
            ids[rows, at], ids[rows, gone] = joined, -1
            after[rows, at], before[rows, follow] = follow, at
            ranks[rows, gone] = NEVER
            ranks[rows, at] = self._ranks(joined, ids[rows, follow])
            ranks[rows, lead] = self._ranks(ids[rows, lead], joined)
            ranks[rows, width] = NEVER
        kept = ids >= 0
        flat, ends = ids[kept].tolist(), kept.sum(axis=1).cumsum().tolist()
        return [tuple(flat[a:b]) for a, b in zip([0, *ends], ends, strict=False)]

    def merge_long(self, fragment: bytes) -> tuple[int, ...]:
        """Ids of one long fragment, by a heap of pairs and links between neighbours."""
        ids = [int(self.byte_ids[b]) for b in fragment]
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        rank_of = self.rank_of.get
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := rank_of(a << 32 | b)) is not None]
        heapify(heap)
        while heap:
            rank, i, a, b = heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = int(self.joined[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rank_of(ids[x] << 32 | ids[y])) is not None:
                    heappush(heap, (r, x, ids[x], ids[y]))
        return tuple(i for i in ids if i >= 0)

    def learn(self, pieces: Iterable[str]) -> dict[str, tuple[int, ...]]:
        """Ids of pieces: each is cut at its forced boundaries, fragments are encoded on their own."""
        cut = {p: self.fragments(p.encode()) for p in pieces}
        new = list({f for fragments in cut.values() for f in fragments} - self.by_fragment.keys())
        if self.fragment_room > MEMO:
            self.by_fragment.clear()
            self.fragment_room = 0
            new = list({f for fragments in cut.values() for f in fragments})
        self.fragment_room += _room(new)
        new.sort(key=len)
        short = bisect_right(new, LONG, key=len)
        for start in range(0, short, 4096):  # fragments of like length together
            part = new[start : min(start + 4096, short)]
            self.by_fragment.update(zip(part, self.merge_many(part), strict=True))
        self.by_fragment.update((f, self.merge_long(f)) for f in new[short:])
        known = self.by_fragment
        return {p: known[f[0]] if len(f) == 1 else tuple(i for x in f for i in known[x]) for p, f in cut.items()}

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        """Ids of each text. Pieces not met before are learnt together."""
        split = [self.added_at.split(t) if self.added_at else [t] for t in texts]
        cut = [[p if p in self.added else self.pieces(p) for p in parts] for parts in split]
        new = {p for parts in cut for part in parts if not isinstance(part, str) for p in part} - self.by_piece.keys()
        if self.piece_room > MEMO:
            self.by_piece.clear()
            self.piece_room = 0
            new = {p for parts in cut for part in parts if not isinstance(part, str) for p in part}
        self.piece_room += _room(new)
        self.by_piece.update(self.learn(new))
        known = self.by_piece.__getitem__
        out = []
        for parts in cut:
            ids: list[int] = []
            for part in parts:
                if isinstance(part, str):
                    ids.append(self.added[part])
                else:
                    ids += chain.from_iterable(map(known, part))
            out.append(ids)
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_LOADED: dict[str, Vocabulary] = {}


def _loaded(text: str) -> Vocabulary:
    """One vocabulary for each worker process."""
    if text not in _LOADED:
        _LOADED[text] = Vocabulary(text)
    return _LOADED[text]


def _parts(values: pa.Array, rows: int = 512, size: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """(start, rows) of parts of a column, of at most ``size`` bytes or ids if more than one row."""
    sizes = (pc.binary_length(values) if pa.types.is_string(values.type) or pa.types.is_large_string(values.type) else pc.list_value_length(values)).fill_null(0).to_pylist()
    start = held = 0
    for i, n in enumerate(sizes):
        if i > start and (held + n > size or i - start == rows):
            yield start, i - start
            start, held = i, 0
        held += n
    if sizes:
        yield start, len(sizes) - start


def _mapped(df: DataFrame, vocabulary: str, source: str, added: list[T.StructField], f) -> DataFrame:
    """``df`` with the fields ``added``, made from column ``source`` by ``f(vocabulary, values)``."""
    names = {a.name.lower() for a in added}
    kept = [c for c in df.columns if c.lower() not in names]
    if source not in kept:
        raise ValueError(f"column {source!r} would be replaced by the output")
    with open(vocabulary, encoding="utf-8") as file:
        shared = df.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _loaded(shared.value)
        for batch in batches:
            at = batch.schema.names.index(source)
            for start, rows in _parts(batch.column(at)):
                part = batch.slice(start, rows)
                made = f(v, part.column(at))
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *(a.name for a in added)])

    frame = df.select(*(F.col(f"`{c}`") for c in kept))
    return frame.mapInArrow(run, T.StructType([*frame.schema.fields, *added]))


def _encoded(v: Vocabulary, texts: pa.Array) -> pa.Array:
    return _listed(v.encode_all([t or "" for t in texts.to_pylist()]))


def _listed(found: list[list[int]]) -> pa.Array:
    ends = np.cumsum([0, *map(len, found)])
    flat = np.fromiter(chain.from_iterable(found), np.int32, ends[-1])
    return pa.LargeListArray.from_arrays(ends, flat).cast(pa.list_(pa.int32()))


def encode(df: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``, the token ids of column ``text``; null text gives no ids."""
    return _mapped(df, vocabulary, text, [T.StructField(ids, T.ArrayType(T.IntegerType()))], lambda v, x: [_encoded(v, x)])


def decode(df: DataFrame, vocabulary: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``, the text of column ``ids``; a null list gives ``""``, an unknown id an error."""
    return _mapped(df, vocabulary, ids, [T.StructField(text, T.StringType())], lambda v, x: [pa.array([v.decode(i or []) for i in x.to_pylist()], pa.string())])


def round_trip(df: DataFrame, vocabulary: str, text: str = "text") -> DataFrame:
    """Add ``ids`` and ``decoded`` in one pass over the text."""

    def both(v: Vocabulary, texts: pa.Array) -> list[pa.Array]:
        found = v.encode_all([t or "" for t in texts.to_pylist()])
        return [_listed(found), pa.array([v.decode(i) for i in found], pa.string())]

    return _mapped(df, vocabulary, text, [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())], both)
