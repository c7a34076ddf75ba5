"""Stable ids: a prefix and the first hex digits of a sha256."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_id(prefix: str, basis: Column, n: int = 16) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(basis, 256), 1, n))


def entity_id(kind: Column, name: Column) -> Column:
    return stable_id("ent_", F.concat(F.lit("entity:"), kind, F.lit(":"), F.lower(name)))


def edge_id(source: Column, target: Column, kind: Column) -> Column:
    return stable_id("edge_", F.concat(F.lit("edge:"), source, F.lit(":"), target, F.lit(":"), kind))
