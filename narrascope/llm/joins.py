"""Joining a few columns to wide tables of texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from narrascope import runtime

#: Files of a staged table may be broadcast up to this size; beyond it the join is a shuffle.
BROADCAST_BYTES = 24 << 20


def join_sized(wide: DataFrame, staged: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """``wide`` joined with a staged table, which is sent to all executors only if its files are small."""
    small = F.broadcast(staged) if runtime.stored_bytes(staged) <= BROADCAST_BYTES else staged.hint("merge")
    return wide.join(small, on, how)


def join_dealt(wide: DataFrame, staged: DataFrame, on: str | list[str], by: str, parts: int = 64) -> DataFrame:
    """``wide`` left-joined with a staged table of one row a key, where one key may hold a large part of ``wide``.

    A small table is sent to all executors; of a large one each row goes to ``parts`` places, over which the rows of a
    key are dealt by ``by``.
    """
    if runtime.stored_bytes(staged) <= BROADCAST_BYTES:
        return wide.join(F.broadcast(staged), on, "left")
    many = staged.withColumn("_deal", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = [on] if isinstance(on, str) else on
    return wide.withColumn("_deal", F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")).join(many, [*keys, "_deal"], "left").drop("_deal")
