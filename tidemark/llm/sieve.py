"""A bitmap of fixed size that thins out a table before a join.

The bitmap holds one hashed bit for each key of the small side. It never grows, so
it can be a constant of the plan at any scale; where it is too full to help, the
join behind it just gets more rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 1 << 21


def sieve(keys: DataFrame, *names: str) -> Column:
    """Condition that holds for every row with a key of ``keys``, and for few others."""
    def bit(cols) -> Column:
        return F.pmod(F.xxhash64(*cols), F.lit(BITS))

    at = keys.select(bit([F.col(n) for n in names]).alias("p"))
    word = at.groupBy(F.floor(F.col("p") / 64).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(pmod(p, 64) as int))")).alias("b"))
    bitmap = [0] * (BITS // 64)
    for w, b in word.collect():  # at most BITS / 64 rows
        bitmap[w] = b
    words = F.split(F.lit(",".join(map(str, bitmap))), ",").cast("array<bigint>")
    p = bit([F.col(n) for n in names])
    return F.getbit(F.get(words, F.floor(p / 64).cast("int")), F.pmod(p, F.lit(64)).cast("int")) == 1
