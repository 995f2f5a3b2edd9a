"""Small DataFrame helpers shared by the text operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame

#: Whole texts that a Python worker gets at once; Spark's default of 10,000 takes tens of MB on both sides.
TEXTS_AT_ONCE = 1000


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as keep it from clashing with a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        found.append(name)
    return found


def rows(batches: Iterable[pd.DataFrame]) -> pd.DataFrame | None:
    """All rows of a partition as one frame, None if there is none. For partitions of bounded size."""
    parts = [b for b in batches if len(b)]
    return pd.concat(parts, ignore_index=True) if parts else None


def worker_memory(name: str) -> dict:
    """A dictionary that lives as long as the Python worker, which serves several tasks one after the other.

    Functions of this package reach the workers by value, their globals anew with every task, so it is kept with the
    interpreter's modules instead.
    """
    store = sys.modules.setdefault("ledgerpulse_worker_memory", types.ModuleType("ledgerpulse_worker_memory"))
    return store.__dict__.setdefault(name, {})
