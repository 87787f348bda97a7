"""Order statistics and ranks of groups of any size: by bins, so that no task sorts a group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bins are a 64th of a power of e wide, from a millionth on: 1.6 % of a value.
STEPS, FINEST = 64.0, 1e6


def _bin(value: Column) -> Column:
    """A bin that never falls as the value grows."""
    return F.signum(value).cast("int") * F.floor(F.log1p(F.abs(value) * FINEST) * STEPS).cast("int")


def _starts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, _bin, _n, _start): rows of each bin, and before it. A key has as many rows as bins, whatever its size."""
    counts = rows.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_start", F.coalesce(F.sum("_n").over(before), F.lit(0)))


def ranked(rows: DataFrame, value: str, rank: str, *keys: str) -> DataFrame:
    """Adds the rank, from 1, of each row's value among its keys'; equal values are ranked one after the other. Nulls must be gone."""
    binned = rows.withColumns({"_bin": _bin(F.col(value)), "_c": F.lit(1).cast("long")})
    within = F.row_number().over(Window.partitionBy(*keys, "_bin").orderBy(value))
    placed = binned.withColumn("_k", within).join(_starts(binned, list(keys)).drop("_n"), [*keys, "_bin"])
    return placed.withColumn(rank, F.col("_start") + F.col("_k")).drop("_bin", "_c", "_k", "_start")


def counted(rows: DataFrame, value: str, *keys: str) -> DataFrame:
    """(keys, value, _c): the distinct values of each key and how often they occur; nulls are left out. All that follows reads this one exchange."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))


def picked(values: DataFrame, value: str, ranks: DataFrame, *keys: str) -> DataFrame:
    """(keys, rank, value): the rank-th smallest of the counted values of each key, for the ranks (keys, rank) asked for.

    Equal values are one row with a count after the first, partial sum; then only the bins are ordered that hold a rank.
    """
    binned = values.withColumn("_bin", _bin(F.col(value)))
    hit = _starts(binned, list(keys)).join(ranks.distinct(), list(keys)).where("rank > _start and rank <= _start + _n").select(*keys, "_bin", "_start", "rank")
    inside = binned.join(hit.select(*keys, "_bin").distinct(), [*keys, "_bin"], "left_semi")
    upto = F.sum("_c").over(Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = inside.withColumn("_to", upto).join(hit, [*keys, "_bin"]).withColumn("_k", F.col("rank") - F.col("_start"))
    return placed.where("_k <= _to and _k > _to - _c").select(*keys, "rank", value)


def at_ranks(rows: DataFrame, value: str, ranks: DataFrame, *keys: str) -> DataFrame:
    return picked(counted(rows, value, *keys), value, ranks, *keys)


def medians(rows: DataFrame, value: str, name: str, *keys: str) -> DataFrame:
    """(keys, name): the median of each key; the mean of the two middle values where their number is even."""
    values = counted(rows, value, *keys)
    n = values.groupBy(*keys).agg(F.sum("_c").alias("_all"))
    middle = n.select(*keys, F.explode(F.array(F.expr("(_all + 1) div 2"), F.expr("_all div 2 + 1"))).alias("rank"))
    return picked(values, value, middle, *keys).groupBy(*keys).agg(F.avg(value).alias(name))


def others_ranks(rows: DataFrame, value: str, held: str, wanted: Column, *keys: str) -> DataFrame:
    """(keys, held, n, rank): where the wanted-th smallest value of all rows but the held one's stands among all rows of the keys.

    wanted: an expression of n, the number of other rows. No row is copied: of the held one's rows those count that stand before it.
    """
    all_ = rows.groupBy(*keys).agg(F.count("*").alias("_all"))
    own = rows.groupBy(*keys, held).agg(F.count("*").alias("_own")).join(all_, list(keys)).withColumn("n", F.col("_all") - F.col("_own"))
    own = own.withColumn("_p", wanted).select(*keys, held, "n", "_p")
    placed = ranked(rows.select(*keys, held, value), value, "_r", *keys)
    place = F.row_number().over(Window.partitionBy(*keys, held).orderBy("_r"))
    before = placed.withColumn("_j", place).join(own, [*keys, held]).where("_r - _j < _p").groupBy(*keys, held).agg(F.count("*").alias("_b"))
    return own.join(before, [*keys, held], "left").select(*keys, held, "n", (F.col("_p") + F.coalesce("_b", F.lit(0))).alias("rank"))
