"""Bitmaps of a bounded size that tell which of many keys a set may hold.

A bitmap has some 8 bits for each key, and at most ``WORDS`` words of 64 bits (8 MB) however many keys there
are, so it may be broadcast. It lets through every key of the set, and others where bits coincide: an exact join
follows, so results do not depend on it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import few_tasks

WORDS = 1 << 20


class Bitmap(NamedTuple):
    rows: DataFrame  # __word, __bits
    words: int


def _word(key: str, words: int) -> Column:
    return F.expr(f"cast(pmod(xxhash64({key}), {words}) as int)")


def _bit(key: str) -> Column:
    return F.expr(f"shiftleft(1L, cast(pmod(shiftright(xxhash64({key}), 20), 64) as int))")


def bitmap(keys: DataFrame, key: str, count: int | None = None) -> Bitmap:
    """Of the keys, which are counted first where ``count`` does not tell how many they are: give a table, not a long plan."""
    count = keys.count() if count is None else count
    words = min(WORDS, max(1 << 10, 1 << int(count // 8).bit_length()))
    return Bitmap(few_tasks(keys.groupBy(_word(key, words).alias("__word")).agg(F.bit_or(_bit(key)).alias("__bits")), count), words)


def maybe(rows: DataFrame, key: str, bits: Bitmap) -> DataFrame:
    """``rows`` with ``__maybe``: whether the key may be in the set."""
    joined = rows.withColumn("__word", _word(key, bits.words)).join(F.broadcast(bits.rows), "__word", "left")
    return joined.withColumn("__maybe", F.coalesce(F.col("__bits").bitwiseAND(_bit(key)) != 0, F.lit(False))).drop("__word", "__bits")
