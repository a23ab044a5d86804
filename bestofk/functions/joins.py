"""Joins on cell keys, where a null is a value like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_cells(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` in which null equals null; the keys come from ``left``.

    A key that does not apply to a hypothesis (stage, tau, length) is null by design.
    """
    if not keys:
        return left.join(right, F.lit(True), how)  # one cell: a single row on the right
    twin = {k: f"__right_{k}" for k in keys}
    renamed = right.withColumnsRenamed(twin)
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(t)) for k, t in twin.items()])
    joined = left.join(renamed, same, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*twin.values())
