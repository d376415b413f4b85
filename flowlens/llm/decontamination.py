"""Operator 3: benchmark decontamination by latent semantic retrieval.

Columns of the TF-IDF matrix are the benchmark's words; its rows are the passages of all documents,
blocks of ``BLOCK`` words. A randomised SVD gives the latent space: with a random matrix W, the product
A'(A W) is summed over all passages in one distributed pass, and the Nystroem form of A'A yields the
leading right singular vectors from it. Windows of the documents and the items are projected, and
items whose cosine with a window reaches ``cosine`` are candidates. Each candidate is checked by the
longest common subsequence of words: the item is found at ``full`` of its words, or at ``part`` of
them if its answer, its last ``answer`` words, is there in full as well. Reordered words lower the
first measure, replaced words both, so that paraphrases pass only with the answer kept.

Frequencies and the factorisation cover every word and every passage of every document; nothing is sampled. A
window is only compared with an item if the region around it holds enough of the item's words for a match: its words
that are in at most COMMON of the passages are counted there, the others are taken as found. No match is lost by
that. Items are taken in
blocks of at most ``items`` with at most ``cells`` pairs of item and word, which bounds what is sent to all
tasks. Documents are read once for each block and kept as word numbers in the shared folder; nothing but sums is
shuffled, one table of them for each task that runs at once.

Items of fewer than ``short`` words are found only where all their words follow each other. Defined results: null
text counts as empty; items without words find nothing; rows with a null id
take part under that id. Repeated items are items of their own. Repeated documents are found each.
Result: (doc_id, item_id, start_word, end_word, lcs, answer_found, cosine), one row for each document
and item. Other columns are not read, whatever their names. Without documents or items there are no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import materialise, text_or_empty, unused

WORD = re.compile(r"\w+")
#: Words of a block; windows are so many blocks and move by so many. An item takes the least that holds it.
BLOCK = 8
SCALES = ((2, 1), (4, 1), (8, 2), (16, 4), (32, 8), (64, 16))
#: Words in a larger share of the passages bound no candidate; items that are searched together.
COMMON, GROUP = 0.01, 256
SCHEMA = "doc_id bigint, item_id bigint, start_word int, end_word int, lcs double, answer_found boolean, cosine double"


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def common_subsequence(item: list[int], words: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel over the item."""
    places: dict[int, int] = {}
    for i, w in enumerate(item):
        places[w] = places.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    row = full
    for w in words:
        m = places.get(w)
        if m:
            hit = row & m
            row = ((row + hit) | (row - hit)) & full
    return len(item) - row.bit_count()


def encoded(docs: DataFrame, numbers: dict[str, int], id_col: str, text: str) -> DataFrame:
    """(doc_id, words): each word's number among the benchmark's words, -1 for all others."""
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                made = [np.array([get(w, -1) for w in words_of(t)], np.int32) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.int32()))], names=["doc_id", "words"])

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, words array<int>")


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """(words of all rows, offsets)."""
    lists = batch.column(batch.schema.names.index("words"))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy()[offsets[0] : offsets[-1]], offsets - offsets[0]


def _first_blocks(offsets: np.ndarray) -> np.ndarray:
    """First block of each row, and the number of all: blocks never cross rows."""
    return np.concatenate([[0], np.cumsum(-(-np.diff(offsets) // BLOCK))])


def _blocks(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of the benchmark, their block, first block of each row)."""
    first = _first_blocks(offsets)
    at = np.flatnonzero(words >= 0)
    row = np.searchsorted(offsets, at, side="right") - 1
    return words[at], first[row] + (at - offsets[row]) // BLOCK, first


def _sums(values: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows of ``values`` by ascending group."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(groups):
        starts = np.flatnonzero(np.diff(groups, prepend=-1))
        out[groups[starts]] = np.add.reduceat(values, starts, axis=0)
    return out


def _parts(batch: pa.RecordBatch, rows: int = 256, words: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most so many rows, and words unless one row has more."""
    ends = batch.column(batch.schema.names.index("words")).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        most = int(np.searchsorted(ends, ends[start] + words, side="right")) - 1
        n = max(1, min(rows, most - start))
        yield batch.slice(start, n)
        start += n


def _block_sums(table: np.ndarray, w: np.ndarray, b: np.ndarray, n: int, words: int = 200_000) -> np.ndarray:
    """Sums of the words' rows of ``table`` by ascending block: the first words of all blocks, then the second ones, and so on."""
    out = np.zeros((n, table.shape[1]), table.dtype)
    place = np.arange(len(b)) - np.searchsorted(b, b)
    for k in range(BLOCK):
        at = np.flatnonzero(place == k)
        for s in range(0, len(at), words):
            part = at[s : s + words]
            out[b[part]] += table[w[part]]
    return out


def _word_sums(passages: np.ndarray, b: np.ndarray, w: np.ndarray, n: int, words: int = 200_000) -> np.ndarray:
    """Sums of the blocks' rows of ``passages`` by word; so many words at a time."""
    order = np.argsort(w, kind="stable")
    total = np.zeros((n, passages.shape[1]))
    for s in range(0, len(order), words):
        part = order[s : s + words]
        total += _sums(passages[b[part]], w[part], n)
    return total


def document_frequencies(rows: DataFrame, n_words: int) -> tuple[np.ndarray, int]:
    """(passages that hold each word, passages)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, blocks = np.zeros(n_words + 1, np.int64), 0
        for batch in (part for whole in batches for part in _parts(whole)):
            words, offsets = _flat(batch)
            first = _first_blocks(offsets)
            row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
            grid = np.full((int(first[-1]), BLOCK), -1, np.int32)
            place = np.arange(len(words)) - offsets[row]
            grid[first[row] + place // BLOCK, place % BLOCK] = words
            grid.sort(axis=1)
            new = np.ones(grid.shape, bool)
            new[:, 1:] = grid[:, 1:] != grid[:, :-1]
            total += np.bincount(grid[new] + 1, minlength=n_words + 1)
            blocks += len(grid)
        some = np.flatnonzero(total[1:])
        yield pa.RecordBatch.from_arrays([pa.array([*some, -1], pa.int64()), pa.array([*total[1:][some], blocks], pa.int64())], names=["w", "n"])

    out, passages = np.zeros(n_words, np.int64), 0
    for r in rows.select("words").mapInArrow(run, "w bigint, n bigint").groupBy("w").agg(F.sum("n").alias("n")).toLocalIterator():
        if r["w"] < 0:
            passages = r["n"]
        else:
            out[r["w"]] = r["n"]
    return out, passages


def latent_space(rows: DataFrame, idf: np.ndarray, rank: int, seed: int = 3) -> np.ndarray:
    """Leading right singular vectors of the passages' TF-IDF matrix, times idf: a row for each word."""
    n = len(idf)
    rank = min(rank, n)
    draw = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, rank)))[0]
    weighted = (draw * idf[:, None]).astype(np.float32)
    context = rows.sparkSession.sparkContext
    shared, per = context.broadcast(weighted), 256

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0 = shared.value
        total = np.zeros(w0.shape, np.float64)
        for batch in (part for whole in batches for part in _parts(whole)):
            words, offsets = _flat(batch)
            w, b, first = _blocks(words, offsets)
            passages = _block_sums(w0, w, b, int(first[-1]))
            total += _word_sums(passages, b, w, n)
        parts = [total[s : s + per].tobytes() for s in range(0, n, per)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "sums"])

    def add(group):
        out = group.iloc[:1].copy()
        out["sums"] = [np.sum([np.frombuffer(x) for x in group["sums"]], axis=0).tobytes()]
        return out

    # each task sends one table of words by rank, so that there are no more tasks than run at once in four waves
    parts = rows.select("words").coalesce(4 * context.defaultParallelism).mapInArrow(run, "part int, sums binary").groupBy("part").applyInPandas(add, "part int, sums binary").collect()
    product = np.concatenate([np.frombuffer(r["sums"]).reshape(-1, rank) for r in sorted(parts, key=lambda r: r["part"])]) * idf[:, None] if parts else np.zeros((n, rank))
    shift = 1e-7 * max(np.linalg.norm(product), 1e-30)
    shifted = product + shift * draw
    root = np.linalg.cholesky((draw.T @ shifted + shifted.T @ draw) / 2 + 1e-9 * shift * np.eye(rank))
    vectors = np.linalg.svd(np.linalg.solve(root, shifted.T).T, full_matrices=False)[0]
    return (vectors * idf[:, None]).astype(np.float32)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=-1, keepdims=True), 1e-12)


class Targets:
    """Items of one window scale: unit vectors, word numbers, and what bounds a common subsequence.

    ``scarce[w, i]`` tells that item i holds word w and that w is not ``common``. No common subsequence with a region
    is longer than the region's scarce words of the item and all common words of the item together.
    """

    def __init__(self, scale: int, chosen: list[int], items: list[tuple[int, list[int]]], space: np.ndarray, common: np.ndarray, part: float):
        self.size, self.step = SCALES[scale]
        self.chosen, n_words = chosen, len(space)
        # an item beyond the largest window is sought in a region as much longer
        width = self.size * BLOCK
        self.margin = max([BLOCK, width // 2, *(len(items[i][1]) for i in chosen if len(items[i][1]) > width)])
        self.scarce, self.needed = np.zeros((n_words, len(chosen)), np.uint8), np.zeros(len(chosen))
        for j, i in enumerate(chosen):
            mine = np.array(items[i][1])
            self.scarce[mine[~common[mine]], j] = 1
            self.needed[j] = part * len(mine) - common[mine].sum()
        self.told = self.scarce.any(axis=1)
        words = [items[i][1] for i in chosen]
        self.lengths = np.array([len(w) for w in words], np.int64)
        self.units = _unit(np.array([space[w].sum(axis=0) for w in words], np.float32)) if chosen else np.zeros((0, space.shape[1]), np.float32)
        self.member = np.zeros((len(chosen), n_words + 1), bool)  # the last column is for unknown words
        distinct = [sorted(set(w)) for w in words]
        width = max(map(len, distinct), default=0)
        self.distinct, self.times = np.full((len(chosen), width), -9, np.int32), np.zeros((len(chosen), width), np.int64)
        for i, (w, d) in enumerate(zip(words, distinct, strict=True)):
            self.member[i, d] = True
            self.distinct[i, : len(d)] = d
            self.times[i, : len(d)] = [w.count(x) for x in d]

    def promising(self, items: np.ndarray, regions: np.ndarray, part: float) -> np.ndarray:
        """Pairs whose common words, each as often as in both, could make up ``part`` of the item.

        No common subsequence is longer than that count, so no match is lost.
        """
        need = part * self.lengths[items]
        left = np.flatnonzero(self.member[items[:, None], regions].sum(axis=1) >= need)
        good = []
        for k in range(0, len(left), 512):
            at = left[k : k + 512]
            times = (regions[at][:, :, None] == self.distinct[items[at]][:, None, :]).sum(axis=1)
            good.append(at[np.minimum(times, self.times[items[at]]).sum(axis=1) >= need[at]])
        return np.concatenate(good) if good else left


def _runs(item: list[int], region: list[int]) -> bool:
    """Whether all words of a short item follow each other somewhere."""
    n = len(item)
    return any(region[i : i + n] == item for i in range(len(region) - n + 1))


def find(rows: DataFrame, items: list[tuple[int, list[int]]], space: np.ndarray, counts: np.ndarray, passages: int, cosine: float, full: float, part: float, answer: int, short: int) -> DataFrame:
    """Candidates by cosine and their checks, for one block of items."""
    fits = lambda words: next((s for s, (size, _) in enumerate(SCALES) if len(words) <= size * BLOCK), len(SCALES) - 1)
    groups: dict[int, list[int]] = {}
    for i, (_, words) in enumerate(items):
        groups.setdefault(fits(words), []).append(i)
    common = counts > COMMON * max(1, passages)
    targets = [Targets(s, chosen[k : k + GROUP], items, space, common, part) for s, chosen in sorted(groups.items()) for k in range(0, len(chosen), GROUP)]
    shared = rows.sparkSession.sparkContext.broadcast((items, space, targets))

    def candidates(words: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(row, item, first word, last word, cosine) of pairs that can pass the check."""
        _, space, targets = shared.value
        w, b, first = _blocks(words, offsets)
        n_blocks = int(first[-1])
        row_of = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
        low, high = first[row_of], first[row_of + 1]
        padded, sizes = np.append(words, -1), np.diff(offsets)
        found, live = [], np.zeros(n_blocks + 1, np.int64)
        for t in targets:
            held = np.zeros((n_blocks + 1, len(t.chosen)), np.int32)
            told = t.told[w]
            np.cumsum(_block_sums(t.scarce, w[told], b[told], n_blocks), axis=0, out=held[1:])
            start = np.flatnonzero((np.arange(n_blocks) - low) % t.step == 0)
            wide = -(-t.margin // BLOCK)
            for k in range(0, len(start), 8192):
                s = start[k : k + 8192]
                e = np.minimum(s + t.size, high[s])
                at, item = np.nonzero(held[np.minimum(e + wide, high[s])] - held[np.maximum(s - wide, low[s])] >= t.needed)
                found.append((t, s[at], e[at], item))
                np.add.at(live, s[at], 1)
                np.add.at(live, e[at], -1)
        used = np.cumsum(live)[b] > 0
        sums = np.zeros((n_blocks + 1, space.shape[1]))
        np.cumsum(_block_sums(space, w[used], b[used], n_blocks), axis=0, out=sums[1:])
        for t, start, end, item in found:
            for k in range(0, len(start), 65536):
                s, e, i = start[k : k + 65536], end[k : k + 65536], item[k : k + 65536]
                near = (_unit((sums[e] - sums[s]).astype(np.float32)) * t.units[i]).sum(axis=1)
                good = near >= cosine
                s, e, i, near = s[good], e[good], i[good], near[good]
                r = row_of[s]
                lo = np.maximum(0, (s - first[r]) * BLOCK - t.margin)
                hi = np.minimum(sizes[r], (e - first[r]) * BLOCK + t.margin)
                width = t.size * BLOCK + 2 * t.margin
                many = max(64, 1_000_000 // width)
                for j in range(0, len(s), many):
                    part_of = slice(j, j + many)
                    place = lo[part_of, None] + np.arange(width)
                    place = np.where(place < hi[part_of, None], offsets[r[part_of]][:, None] + place, len(words))
                    for g in t.promising(i[part_of], padded[place], part) + j:
                        yield int(r[g]), t.chosen[i[g]], int(lo[g]), int(hi[g]), float(near[g])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = shared.value[0]
        names = ["doc_id", "item_id", "start_word", "end_word", "lcs", "answer_found", "cosine"]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.bool_(), pa.float64()]
        for whole in batches:
            for batch in _parts(whole):
                words, offsets = _flat(batch)
                best: dict[tuple[int, int], tuple] = {}
                for r, item, lo, hi, near in candidates(words, offsets):
                    known = best.get((r, item))
                    if known is not None and known[0] >= 1.0:
                        continue
                    region = words[offsets[r] + lo : offsets[r] + hi].tolist()
                    target = items[item][1]
                    share = common_subsequence(target, region) / len(target)
                    if share < part or (known is not None and share <= known[0]) or (len(target) < short and not _runs(target, region)):
                        continue
                    last = target[-answer:]
                    there = common_subsequence(last, region) == len(last)
                    if share >= full or there:
                        best[r, item] = (share, lo, hi, there, near)
                ids = batch.column(0).to_pylist()
                out = [(ids[r], items[i][0], lo, hi, share, there, near) for (r, i), (share, lo, hi, there, near) in best.items()]
                columns = zip(*out, strict=True) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds, strict=True)], names=names)

    return rows.mapInArrow(run, SCHEMA)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", items: int = 5000, rank: int = 64, cosine: float = 0.4, full: float = 0.8, part: float = 0.6, answer: int = 8, short: int = 8, cells: int = 32_000_000) -> DataFrame:
    """Documents that hold items of the benchmark."""
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for block in _item_blocks(benchmark, items, cells):
        numbers = {w: i for i, w in enumerate(sorted({w for _, ws in block for w in ws}))}
        rows = materialise(encoded(docs, numbers, id_col, text), "encoded")
        counts, passages = document_frequencies(rows, len(numbers))
        numbered = [(i, [numbers[w] for w in ws]) for i, ws in block]
        idf = np.log((passages + 1) / (counts + 1)) + 1e-3
        space = latent_space(rows, idf, rank)
        out = out.union(find(rows, numbered, space, counts, passages, cosine, full, part, answer, short))
    return out


def _item_blocks(benchmark: DataFrame, items: int, cells: int) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words in blocks of bounded size; one block is held at a time."""
    block: list[tuple[int, list[str]]] = []
    words: set[str] = set()
    for r in benchmark.select("item_id", text_or_empty("text").alias("text")).orderBy("item_id", "text").toLocalIterator():
        if found := words_of(r["text"]):
            if block and (len(block) >= items or (len(block) + 1) * len(words | set(found)) > cells):
                yield block
                block, words = [], set()
            block.append((r["item_id"], found))
            words.update(found)
    if block:
        yield block


def without_matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The rows of ``docs`` whose document holds no item."""
    (hit,) = unused(docs.columns, "hit")
    found = matches(docs, benchmark, id_col, text, **settings).select(F.col("doc_id").alias(hit)).distinct()
    return docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(hit)), "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
