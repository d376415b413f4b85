"""Operator 9: SimHash fingerprints and covering locality-sensitive hashing.

Fingerprints take word shingles with repeats; each bit is the majority of the shingles' XXH64 bits.
Near fingerprints are found by covering masks: with a random map of the 64 bit positions to
vectors of radius + 1 bits, the mask of a nonzero vector v keeps the positions whose vector has an
odd inner product with v. At most ``radius`` differing positions leave some v orthogonal to them
all, so every pair within the radius agrees under some of the 2^(radius+1) - 1 masks: none is missed.

Equal fingerprints are one class from the start; tables hold each fingerprint once. A bucket of two
gives its pair at once. Larger buckets are cut into blocks by a hash of the fingerprint, block pairs
are separate groups, and each compares its members in memory and returns a spanning forest of its
links, not the links. So no bucket is gathered whole and no pairs are written out.

Defined results: null text counts as empty; a text without words has fingerprint zero and links like
any other. Rows repeated with one doc_id give a row each. Rows with a null id are linked like others, never dropped,
and never give a component its name, unless it has no other id. Other columns are not read, whatever their names.
Crowded fingerprints and buckets are dealt to several tasks where they are joined. An empty table gives no rows.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import CROWDED, LEAST, materialise, spread_join, text_or_empty, unused
from flowlens.llm.graph import connected_components

SEED = 42
#: Fingerprints of a bucket that one group compares at most; a block pair has twice as many.
BLOCK = 2048


def covering_masks(bits: int = 64, radius: int = 4, seed: int = 9) -> list[int]:
    """Masks under some of which any two words within ``radius`` bits agree."""
    draw = random.Random(seed)
    columns = [draw.randrange(1, 2 ** (radius + 1)) for _ in range(bits)]
    return [sum(1 << i for i, c in enumerate(columns) if (c & v).bit_count() % 2) for v in range(1, 2 ** (radius + 1))]


def fingerprint(text: str, width: int = 4) -> int:
    """Unsigned fingerprint of one text."""
    words = text.encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not words:
        return 0
    n = max(1, len(words) - width + 1)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, stops, strict=True)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for k in range(0, n, 65536):
        part = hashes[k : k + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def fingerprints(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4) -> DataFrame:
    """(id, fp): the fingerprint as a signed 64-bit number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(made, np.uint64).view(np.int64))], names=["id", "fp"])

    frame = df.select(F.col(f"`{id_col}`").alias("id"), text_or_empty(f"`{text}`").alias("text"))
    return frame.mapInArrow(run, frame.select("id", F.lit(0).cast("bigint").alias("fp")).schema)


def _forest(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what lies within the radius across two arrays, without needless ones."""
    nodes = np.unique(np.concatenate([left, right]))
    parent = list(range(len(nodes)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    at = np.searchsorted(nodes, right)
    for i, x in zip(np.searchsorted(nodes, left).tolist(), left, strict=True):
        for j in at[np.bitwise_count(right ^ x) <= radius].tolist():
            a, b = root(i), root(j)
            if a != b:
                parent[a] = b
                out.append((nodes[i], nodes[j]))
    return out


def near_links(prints: DataFrame, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(u, v): links among distinct fingerprints ``fp`` that join all within the radius.

    The links span every component; not each near pair is among them.
    """
    masks = covering_masks(64, radius)
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = F.array(*(F.struct(F.lit(i).alias("mask"), F.col("fp").bitwiseAND(F.lit(m)).alias("key")) for i, m in enumerate(signed)))
    entries = prints.select("fp", F.explode(keys).alias("e")).select("fp", "e.mask", "e.key")
    buckets = entries.groupBy("mask", "key").agg(F.count("*").alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v")).where("n > 1")
    buckets = materialise(buckets, "buckets")
    pairs = buckets.where("n = 2").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius).select("u", "v")
    blocks = F.ceil(F.col("n") / block).cast("int")
    sized = buckets.where("n > 2").select("mask", "key", "n", blocks.alias("blocks"))
    per = max(LEAST, buckets.agg(F.sum("n")).first()[0] or 0) // CROWDED + LEAST
    # fewer than CROWDED buckets are so large: they go to all tasks, so that none of them is one task's
    crowded, rest = F.broadcast(sized.where(F.col("n") > per).drop("n")), sized.where(F.col("n") <= per).drop("n")
    large = entries.join(crowded, ["mask", "key"]).unionByName(entries.join(rest, ["mask", "key"]))
    own = F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int")
    large = large.select("mask", "key", "fp", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    large = large.select("mask", "key", "fp", "own", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        fp = group["fp"].to_numpy()
        a, b = int(group["a"].iloc[0]), int(group["b"].iloc[0])
        own = group["own"].to_numpy()
        found = _forest(fp[own == a], fp[own == b], radius)
        return pd.DataFrame(found, columns=["u", "v"], dtype="int64")

    return pairs.union(large.groupBy("mask", "key", "a", "b").applyInPandas(compare, "u bigint, v bigint"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", width: int = 4, radius: int = 4, block: int = BLOCK) -> DataFrame:
    """(id, fp, component): each document with the smallest id that it reaches over links."""
    prints = materialise(fingerprints(df, id_col, text, width), "fingerprints")
    classes = materialise(prints.groupBy("fp").agg(F.min("id").alias("least")), "classes")
    parts = materialise(connected_components(near_links(classes.select("fp"), radius, block), "links"), "parts")
    named = classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("part"))
    smallest = named.groupBy("part").agg(F.min("least").alias("component"))
    labels = materialise(named.join(smallest, "part").select("fp", "component"), "labels")
    return spread_join(prints, labels, "fp").select("id", "fp", "component")


def keep_one(df: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``df`` without all but the first document of each component."""
    found = near_duplicates(df, id_col, text)
    (gone,) = unused(df.columns, "gone")
    drop = found.where("id <> component").select(F.col("id").alias(gone)).distinct()
    return df.join(drop, F.col(f"`{id_col}`") == F.col(gone), "left_anti").select(*(F.col(f"`{c}`") for c in df.columns))


def digest_columns(found: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id): fingerprints as 16 hex digits."""
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))
