"""Equi-join of a large table with a table that has one row per key, safe for hot keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_HOT_KEYS = 1000


def join_lookup(big: DataFrame, lookup: DataFrame, key: str, hot_from: int, weight: str) -> DataFrame:
    """Inner join; keys whose ``weight`` in the lookup reaches ``hot_from`` rows are broadcast.

    ``weight`` counts the rows each key has in ``big``, so at most
    rows(big) / hot_from keys are hot. The caller sets ``hot_from`` to at least
    rows(big) / MAX_HOT_KEYS, which bounds the broadcast side.
    """
    hot = lookup.filter(F.col(weight) >= hot_from)
    cold = lookup.filter(F.col(weight) < hot_from)
    # the rows of hot keys leave before the shuffle
    rest = big.join(F.broadcast(hot.select(key)), key, "left_anti")
    return big.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))
