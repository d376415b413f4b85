"""What several operators share: tables in the shared folder, joins with crowded keys, free names, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.storage import materialise  # noqa: F401  (the operators take it from here)

#: A key with more than one in CROWDED of a table's rows, and more than LEAST rows, is dealt to several tasks.
CROWDED, LEAST = 1024, 4096
#: Rows of a few numbers that are broadcast at most.
NARROW = 1_000_000


def narrow_join(many: DataFrame, one: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``many`` joined to ``one``, which has a row for each key and few, short columns.

    ``one`` is counted, so it should be a written table: up to NARROW rows it is broadcast, beyond that crowded keys
    of ``many`` are dealt to several tasks.
    """
    return many.join(F.broadcast(one), on, how) if one.count() <= NARROW else spread_join(many, one, on, how)


def spread_join(many: DataFrame, one: DataFrame, on: str | list[str], how: str = "inner", crowded: int = CROWDED, least: int = LEAST, counted: DataFrame | None = None) -> DataFrame:
    """``many`` joined to ``one``, which has a row for each key; any key may hold a large part of ``many``.

    Keys with more rows than both ``least`` and one in ``crowded`` of all are fewer than ``crowded``, so that
    their counts can be broadcast; their rows are dealt to several tasks and their row of ``one`` is repeated for each.
    ``many`` is read once more for the counts, so it should be a written table, or ``counted`` should be one that has as many
    rows of each key. Rows whose key is null
    match nothing. ``many`` has more columns than the keys; their hash deals the rows.
    """
    keys = [on] if isinstance(on, str) else list(on)
    n, salts, salt = unused([*many.columns, *one.columns], "n", "salts", "salt")
    counted = many if counted is None else counted
    total = counted.count()
    per = max(least, total // crowded)
    if total <= per:
        return many.join(one, keys, how)
    counts = counted.groupBy(*keys).agg(F.count("*").alias(n))
    large = counts.where((F.col(n) > per) & F.expr(" AND ".join(f"`{k}` IS NOT NULL" for k in keys)))
    rows = large.select(*keys, F.ceil(F.col(n) / per).cast("int").alias(salts)).collect()  # at most ``crowded``
    if not rows:
        return many.join(one, keys, how)
    table = F.broadcast(many.sparkSession.createDataFrame(rows, large.select(*keys, F.lit(0).alias(salts)).schema))
    dealt = many.join(table, keys, "left").withColumn(salt, F.when(F.col(salts).isNull(), 0).otherwise(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in many.columns if c not in keys)), F.col(salts))).cast("int"))
    copies = one.join(table, keys, "left").withColumn(salt, F.explode(F.sequence(F.lit(0), F.coalesce(F.col(salts), F.lit(1)) - 1)))
    return dealt.drop(salts).join(copies.drop(salts), [*keys, salt], how).drop(salt)


def unused(columns: list[str], *names: str) -> list[str]:
    """Names like ``names`` that no column has, in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str) -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def hash_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """At most ``n`` rows, chosen by a hash of ``keys``: a bounded sample that no order can steer.

    Rows are thinned to about 1.5 n by their hash before they are ranked, so that little more than the
    sample itself meets in one task.
    """
    share = min(1.0, 1.5 * n / max(1, df.count()))
    thinned = df.where(F.pmod(F.xxhash64(F.lit(1), *keys), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)) + 1))
    return thinned.orderBy(F.xxhash64(*keys), *keys).limit(n)
