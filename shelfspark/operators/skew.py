"""Joins of many rows with a table of one row per key, where one key may hold a great part of the many."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from shelfspark.session import materialize


def join_hot(many: DataFrame, few: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """``many`` joined with ``few``, which is written first.

    AQE splits the tasks of a hot key of one side if the other side comes from its shuffle alone, which an aggregate in the same
    stage rules out; a table that is read does, and its size is known too, so that a small one is broadcast instead.
    """
    return many.join(materialize(few), on, how)
