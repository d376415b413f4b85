"""Reserving and dealing out time blocks (SPL6, SPL7), as rounds over a table of candidates and one of blocks.

A candidate is a sequence that could stand for a purpose (an attack type, or benign traffic) in a fold; to keep it, every
block of its footprint must be in that fold. Spark reduces the sequences to the best one of each purpose, footprint and
present fold, which loses nothing, as candidates of one footprint are open or closed together and move the same weight. A
round is one grouped minimum over these, against the blocks that earlier rounds have taken; only its winner comes to
the driver. So neither sequences nor footprints are collected, however many there are.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from flowlens.storage import materialise

TRAIN, HELD_OUT = 0, (1, 2)
BENIGN = "benign donor source"
_BEST = ("support", "own_rank", "source_ip", "window_start_ms")


def candidates(rows: DataFrame, attacks: DataFrame) -> DataFrame:
    """(id, purpose, blocks, kept_fold, support, own_rank, source_ip, window_start_ms), written.

    ``rows``: sequences with their footprint (blocks), the rank of their own block and the fold after purging (3: none).
    For benign traffic the two best sources of each footprint stay, as two are wanted.
    """
    keys = ["source_ip", "window_start_ms"]
    typed = rows.join(attacks.select(*keys, F.col("attack").alias("purpose"), F.col("flows").alias("support")), keys).withColumn("source", F.lit(""))
    benign = rows.where("attack_flows = 0").withColumns({"purpose": F.lit(None).cast("string"), "support": F.lit(1).cast("bigint"), "source": F.col("source_ip")})
    both = typed.select("purpose", "source", "blocks", F.col("fold").alias("kept_fold"), *_BEST).unionByName(benign.select("purpose", "source", "blocks", F.col("fold").alias("kept_fold"), *_BEST))
    order = F.struct((-F.col("support")).alias("less"), *(c for c in _BEST if c != "support"))
    best = both.groupBy("purpose", "source", "blocks", "kept_fold").agg(F.min_by(F.struct(*_BEST), order).alias("b")).select("purpose", "blocks", "kept_fold", "b.*")
    place = F.row_number().over(Window.partitionBy("purpose", "blocks", "kept_fold").orderBy("own_rank", "source_ip", "window_start_ms"))
    best = best.withColumn("r", F.when(F.col("purpose").isNull(), place).otherwise(1)).where("r <= 2").drop("r")
    return materialise(best.withColumn("id", F.monotonically_increasing_id()), "candidates")


@dataclass
class Reservations:
    """Blocks that are taken, and what for. ``blocks``: block_ms, weight, fold (the one preferred at first)."""

    options: DataFrame
    blocks: DataFrame
    taken: dict[int, int] = field(default_factory=dict)
    made: list[dict] = field(default_factory=list)

    def _best(self, among: DataFrame, fold: int, weigh: bool) -> Row | None:
        """The first open candidate: still in the fold, most support, least weight to move, then by block rank and key."""
        taken = self.blocks.sparkSession.createDataFrame(list(self.taken.items()), "block_ms bigint, held int")
        state = self.blocks.join(F.broadcast(taken), "block_ms", "left")  # a row for each block
        touched = among.select("id", F.explode("blocks").alias("block_ms")).join(state, "block_ms")
        foreign = F.coalesce("held", "fold") != fold
        per = touched.groupBy("id").agg(F.sum(F.when(foreign, F.col("weight")).otherwise(0)).alias("moved"), F.max(F.coalesce(F.col("held") != fold, F.lit(False))).alias("closed"))
        found = among.join(per.where("NOT closed"), "id")
        order = F.struct((F.col("kept_fold") != fold).alias("a"), (-F.col("support")).alias("b"), (F.col("moved") if weigh else F.lit(0)).alias("c"), "own_rank", "source_ip", "window_start_ms")
        return found.agg(F.min_by(F.struct("blocks", "source_ip", "window_start_ms"), order).alias("pick")).first()["pick"]

    def take(self, among: DataFrame, fold: int, purpose: str, weigh: bool = True) -> Row | None:
        """Reserve the best open candidate of ``among`` for ``fold``; nothing if none is open."""
        pick = self._best(among, fold, weigh)
        if pick is not None:
            self.taken.update(dict.fromkeys(pick["blocks"], fold))
            self.made.append({"purpose": purpose, "fold": fold, "source_ip": pick["source_ip"], "window_start_ms": pick["window_start_ms"], "blocks": list(pick["blocks"])})
        return pick

    def of(self, attack: str) -> DataFrame:
        return self.options.where(F.col("purpose") == attack)


def held_out_turns(attacks: list[str]) -> Iterator[tuple[str, int]]:
    """Every attack with both held-out folds; which comes first changes from one attack to the next."""
    for i, attack in enumerate(attacks):
        yield from ((attack, fold) for fold in (HELD_OUT if i % 2 == 0 else HELD_OUT[::-1]))


def reserve(options: DataFrame, blocks: DataFrame, rarest_first: list[str], benign_sources: int = 2) -> Reservations:
    """SPL6: training first, for every type in turn and then for benign sources, then the held-out folds.

    A type without an open training candidate is an error, as are too few benign sources; a held-out fold that stays
    without a type is noted as missing.
    """
    if not rarest_first:
        raise ValueError("no attack types")
    found = Reservations(options, materialise(blocks.select("block_ms", "weight", "fold"), "blocks"))
    for attack in rarest_first:
        if found.take(found.of(attack), TRAIN, attack) is None:
            raise ValueError(f"no training coverage for {attack}")
    benign = options.where("purpose IS NULL")
    if benign.select("source_ip").distinct().limit(benign_sources).count() < benign_sources:
        raise ValueError("fewer than two benign sources")
    for _ in range(benign_sources):
        pick = found.take(benign, TRAIN, BENIGN, weigh=False)
        if pick is None:
            break
        benign = benign.where(F.col("source_ip") != pick["source_ip"])
    for attack, fold in held_out_turns(rarest_first):
        if found.take(found.of(attack), fold, attack) is None:
            found.made.append({"purpose": attack, "fold": fold, "missing": True})
    return found


def deal(weights: list[tuple[int, int, int]], taken: dict[int, int], targets: list[float]) -> dict[int, int]:
    """SPL7: the fold of each block of (block, weight, rank): what is taken stays, the others go, the heaviest first.

    The squared distance to the targets falls most where the fold is furthest below its target, whatever the block's
    weight; so each block goes there. Runs over the table of time blocks.
    """
    lacking = list(targets)
    for block, weight, _ in weights:
        if block in taken:
            lacking[taken[block]] -= weight
    dealt = dict(taken)
    for block, weight, _ in sorted((w for w in weights if w[0] not in taken), key=lambda w: (-w[1], w[2])):
        fold = max(range(len(lacking)), key=lambda c: (lacking[c], -c))
        dealt[block] = fold
        lacking[fold] -= weight
    return dealt


def corrected_targets(ratios: tuple[float, ...], dealt: list[int], retained: list[int], total: int) -> list[float]:
    """SPL7: targets that would give the ratios after the purge, if each fold kept the share that it kept now (1 % at least)."""
    needed = [r / max(kept / max(1, n), 0.01) for r, kept, n in zip(ratios, retained, dealt, strict=True)]
    return [x / sum(needed) * total for x in needed]
