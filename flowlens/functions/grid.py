"""Time grid: epoch-aligned windows cut into equal buckets. Times are epoch milliseconds (long)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BUCKETS = 127


@dataclass(frozen=True)
class TemporalGrid:
    """Windows of ``sequence_seconds`` in buckets of ``bucket_seconds``."""

    sequence_seconds: int = 100
    bucket_seconds: int = 10

    def __post_init__(self):
        for value in (self.sequence_seconds, self.bucket_seconds):
            if isinstance(value, bool) or not isinstance(value, int) or value <= 0:
                raise ValueError("grid lengths are positive whole seconds")
        if self.sequence_seconds % self.bucket_seconds or self.buckets > MAX_BUCKETS:
            raise ValueError(f"buckets must divide the window, at most {MAX_BUCKETS} of them")

    @property
    def buckets(self) -> int:
        return self.sequence_seconds // self.bucket_seconds

    @property
    def window_ms(self) -> int:
        return self.sequence_seconds * 1000

    @property
    def bucket_ms(self) -> int:
        return self.bucket_seconds * 1000

    @property
    def name(self) -> str:
        return f"seq{self.sequence_seconds}_bucket{self.bucket_seconds}"


def div(a: Column | str, b: int) -> Column:
    """Whole part of a / b for a >= 0, without a detour through doubles of large numbers."""
    a = F.col(a) if isinstance(a, str) else a
    return ((a - F.pmod(a, F.lit(b))) / b).cast("bigint")


def assign_window(df: DataFrame, grid: TemporalGrid, start: str = "flow_start_milliseconds") -> DataFrame:
    """window_start_ms = floor(start / window) * window."""
    return df.withColumn("window_start_ms", F.col(start) - F.pmod(F.col(start), F.lit(grid.window_ms)))


def assign_bucket(df: DataFrame, grid: TemporalGrid, start: str = "flow_start_milliseconds") -> DataFrame:
    """Bucket number inside the window, 0 to T - 1."""
    local = F.col(start) - F.col("window_start_ms")
    return df.withColumn("bucket", div(local, grid.bucket_ms).cast("int"))


def on_grid(df: DataFrame, grid: TemporalGrid) -> DataFrame:
    """W1 and W2."""
    return assign_bucket(assign_window(df, grid), grid)


def geometries(cases: list[dict]) -> list[TemporalGrid]:
    """SRC5: grids of a configuration; unknown keys and repeated cases are errors."""
    found = []
    for case in cases:
        if set(case) != {"sequence_seconds", "bucket_seconds"}:
            raise ValueError(f"unexpected keys: {sorted(case)}")
        grid = TemporalGrid(**case)
        if grid in found:
            raise ValueError(f"repeated geometry {grid.name}")
        found.append(grid)
    if not found:
        raise ValueError("no geometry")
    return found
