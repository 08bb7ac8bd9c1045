"""Joins of points with the intervals around them, by dyadic blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of the smallest block.
UNIT = 32
#: Levels of blocks, each of two of the level below; more than a position has bits.
LEVELS = 63
BLOCK = "struct<level:int,at:bigint>"


def dyadic(low: Column, high: Column) -> Column:
    """The fewest dyadic blocks whose union is the whole numbers from ``low`` (0 or more) to ``high``: disjoint, at most two of a level.

    Block ``at`` of a level holds the numbers that are ``at`` when that many of their last bits are cut off. An interval of
    n numbers has at most 2 log2(n) + 2 blocks.
    """

    def block(level, at):
        return F.array(F.struct(level.cast("int").alias("level"), at.alias("at")))

    def step(s, level):
        left, right = (s.lo <= s.hi) & (s.lo % 2 == 1), (s.lo <= s.hi) & (s.hi % 2 == 0)
        # A left end that is odd and a right end that is even have no sibling inside.
        lo, hi = s.lo + F.when(left, 1).otherwise(0), s.hi - F.when(right, 1).otherwise(0)
        none = F.array().cast(f"array<{BLOCK}>")
        out = F.concat(s.out, F.when(left, block(level, s.lo)).otherwise(none), F.when(right, block(level, s.hi)).otherwise(none))
        up = lambda x: F.call_function("shiftright", x, F.lit(1))
        return F.when(s.lo <= s.hi, F.struct(up(lo).alias("lo"), up(hi).alias("hi"), out.alias("out"))).otherwise(s)

    begin = F.struct(low.cast("long").alias("lo"), high.cast("long").alias("hi"), F.array().cast(f"array<{BLOCK}>").alias("out"))
    levels = F.sequence(F.lit(0), F.least(F.lit(LEVELS), F.ceil(F.log2(high.cast("double") + 2)).cast("int")))
    return F.when(low == high, block(F.lit(0), low.cast("long"))).otherwise(F.aggregate(levels, begin, step, lambda s: s.out))


def stab(points: DataFrame, intervals: DataFrame, keys: list[str], point: str, low: str, high: str, unit: int = UNIT) -> DataFrame:
    """``points`` with the ``intervals`` of equal ``keys`` whose units from ``low`` to ``high`` hold that of ``point``.

    The caller compares the exact places. An interval is a row for each of its dyadic blocks, a point one for each level
    that intervals of its key have; they share at most one block, so a pair comes once, by an equi join. Intervals
    that end before they begin count as their beginning; places below 0 are 0.
    """
    unit_of = lambda c: F.floor(F.greatest(c, F.lit(0)) / unit).cast("long")
    cut = intervals.withColumn("block_", F.explode(dyadic(unit_of(F.col(low)), unit_of(F.greatest(low, high)))))
    cut = cut.select(*intervals.columns, F.col("block_.level").alias("level_"), F.col("block_.at").alias("at_"))
    levels = cut.groupBy(*keys).agg(F.collect_set("level_").alias("levels_"))
    up = points.join(levels, keys).withColumn("level_", F.explode("levels_"))
    up = up.withColumn("at_", F.call_function("shiftright", unit_of(F.col(point)), F.col("level_"))).drop("levels_")
    return up.join(cut, [*keys, "level_", "at_"]).drop("level_", "at_")
