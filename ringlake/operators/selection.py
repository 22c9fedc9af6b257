"""Exact medians by radix selection: counts move, values stay where they are."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ringlake.sources.scratch import checkpoint

#: Bits that a pass looks at: a key has 2^DIGIT counts at most.
DIGIT = 8
#: Once no key has more values left than this, those are sorted.
FEW = 64


def ordered_bits(v: Column) -> Column:
    """A long in the order of doubles: the bits of the absolute value, negative for negative values; 0 for both zeros.

    Built from exponent and fraction, which powers of two give without rounding. Null for
    null; NaN has no place in the order and is null too.
    """
    a = F.abs(v)
    two = lambda e: F.pow(F.lit(2.0), e)
    near = F.greatest(F.floor(F.log2(a)), F.lit(-1022))  # may be one off
    e = F.when(a < two(near), near - 1).when(a / two(near) >= 2, near + 1).otherwise(near)
    normal = F.call_function("shiftleft", (e + 1023).cast("long"), F.lit(52)) + ((a / two(e) - 1) * F.lit(float(1 << 52))).cast("long")
    small = (a / F.lit(2.0**-1074)).cast("long")
    bits = F.when(a == 0, F.lit(0).cast("long")).when(a == float("inf"), F.lit(0x7FF << 52)).when(a < 2.0**-1022, small).otherwise(normal)
    return F.when(~F.isnan(v), F.when(v < 0, -bits).otherwise(bits))


def radix_median(rows: DataFrame, keys: Sequence[str], value: str = "v", name: str = "median") -> DataFrame:
    """(keys, ``name``): the exact median of each key's values, the mean of the two middle ones where they are even in number; null as soon as a value is missing.

    A pass counts a key's values by the next DIGIT bits of their order and keeps the bucket
    that holds the middle rank; the least value of the next bucket is known then too, in
    case the upper middle is in that one. Counts are added up in tasks before they are
    shuffled; what is kept between passes is a row a key, which must be few enough to be
    broadcast (the pixels of one frame are). The passes end when no bucket has more than FEW
    values, or the bits do. ``rows`` are read once a pass and must repeat.
    """
    keys = list(keys)
    valued = rows.select(*keys, F.col(value).cast("double").alias("__v"), ordered_bits(F.col(value).cast("double")).alias("__o"))
    first, in_order = Window.partitionBy(*keys), Window.partitionBy(*keys).orderBy("__d")
    left, held, state = 64, valued, None
    while True:
        left -= DIGIT
        counts = held.groupBy(*keys, F.shiftright("__o", left).alias("__d")).agg(F.count("*").alias("__n"), F.min("__v").alias("__lo"))
        if state is None:
            size = F.sum("__n").over(first)
            counts = counts.select("*", F.floor((size - 1) / 2).alias("__rank"), (size % 2 == 0).alias("__even"), F.lit(None).cast("double").alias("__upper"), (F.count_if(F.col("__d").isNull()).over(first) == 0).alias("__whole"))
        else:
            counts = counts.join(F.broadcast(state.select(*keys, "__rank", "__even", "__upper", "__whole")), keys)
        below = F.coalesce(F.sum("__n").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        seen = counts.withColumns({"__below": below, "__next": F.lead("__lo").over(in_order)})
        here = seen.where("__whole AND __d IS NOT NULL AND __rank >= __below AND __rank < __below + __n")
        last = F.col("__even") & (F.col("__rank") == F.col("__below") + F.col("__n") - 1)
        state = checkpoint(here.select(*keys, "__d", "__n", "__lo", (F.col("__rank") - F.col("__below")).alias("__rank"), "__even", F.coalesce("__upper", F.when(last, F.col("__next"))).alias("__upper"), "__whole"))
        held = valued.join(F.broadcast(state.select(*keys, "__d")), keys).where(F.shiftright("__o", left) == F.col("__d")).drop("__d")
        if left == 0 or (state.agg(F.max("__n")).first()[0] or 0) <= FEW:
            break
    if left == 0:
        lower, upper, found = F.col("__lo"), F.coalesce("__upper", "__lo"), state
    else:
        lists = held.groupBy(*keys).agg(F.array_sort(F.collect_list("__v")).alias("__s")).join(F.broadcast(state), keys)
        at = lambda i: F.get("__s", (F.col("__rank") + i).cast("int"))
        lower, upper, found = at(0), F.coalesce("__upper", at(1)), lists
    medians = found.select(*keys, F.when(F.col("__even"), (lower + upper) / 2).otherwise(lower).alias(name))
    return rows.select(*keys).distinct().join(F.broadcast(medians), keys, "left")
