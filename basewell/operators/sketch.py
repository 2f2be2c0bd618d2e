"""A Bloom filter of keys as a table of 64-bit words, which are merged by bit_or and of bounded size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of a filter: 16 MB as words, 32 MB where it is broadcast. Two hashes let 0.5 % of other keys pass for 2.4 million keys, 5 % for 8.5 million; more keys make it let more pass, not grow.
BITS, HASHES = 1 << 26, 2


def _places(key, bits: int) -> list[F.Column]:
    return [F.pmod(F.xxhash64(key, F.lit(i)), F.lit(bits)) for i in range(HASHES)]


def bloom(keys: DataFrame, key: str = "key", bits: int = BITS) -> DataFrame:
    """word, mask: the words of the filter that have a bit set; at most bits / 64 rows."""
    at = keys.select(F.explode(F.array(*_places(F.col(key), bits))).alias("at"))
    return at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("mask"))


def pruned(df: DataFrame, words: DataFrame, key: str = "key", bits: int = BITS) -> DataFrame:
    """The rows of df whose key may be in the filter: all that are, and few others. The filter is broadcast, so df is not moved."""
    for i, place in enumerate(_places(F.col(key), bits)):
        held = F.broadcast(words.select(F.col("word").alias(f"_w{i}"), F.col("mask").alias(f"_m{i}")))
        bit = F.call_function("shiftrightunsigned", F.col(f"_m{i}"), (place % 64).cast("int")).bitwiseAND(F.lit(1)) == 1
        df = df.join(held, (F.shiftright(place, 6) == F.col(f"_w{i}")) & bit, "left_semi")
    return df
