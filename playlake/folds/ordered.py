"""Folding a table in order within keys, without holding a key's rows together.

Rows are dealt by key and sorted within partitions; each Python worker reads them in batches and keeps the
state of one key at a time. So memory is bounded by a batch, one step's rows and one state, however long a
key's history is, and a lost executor costs its partitions only.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from playlake.shipping import ship_package


class Fold(Protocol):
    """A state that takes the rows of one step after the other and returns rows."""

    def step(self, rows: pd.DataFrame) -> list[dict]: ...


def _steps(batches: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[tuple[tuple, pd.DataFrame]]:
    """Rows of equal values in `columns`, which are adjacent, also across batches."""
    rest: pd.DataFrame | None = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        groups = list(rows.groupby(columns, sort=False))
        for at, (key, group) in enumerate(groups):
            if at + 1 == len(groups):
                rest = group  # the next batch may go on with it
            else:
                yield key, group
    if rest is not None and len(rest):
        yield tuple(rest.iloc[0][columns]), rest


def fold_in_order(df: DataFrame, keys: list[str], order: str, schema: str, start: Callable[[], Fold]) -> DataFrame:
    """Rows that a fold returns for each key, given the key's rows step by step in ascending order."""
    ship_package(df.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, fold, out = None, start(), []
        for key, rows in _steps(batches, [*keys, order]):
            if key[:-1] != current:
                current, fold = key[:-1], start()
            named = dict(zip(keys, current, strict=True))
            out += [{**named, **r} for r in fold.step(rows)]
            if len(out) >= 10_000:
                yield pd.DataFrame(out)
                out = []
        if out:
            yield pd.DataFrame(out)

    names = [f.name for f in StructType.fromDDL(schema).fields]
    shaped = df.repartition(*keys).sortWithinPartitions(*keys, order)
    return shaped.mapInPandas(lambda b: (f[names] for f in run(b)), schema)


def fold_stream(stream: DataFrame, keys: list[str], order: str, schema: str, start: Callable[[], Fold]) -> DataFrame:
    """The same over a stream: a key's state lives in the state store between micro-batches.

    Steps must arrive in ascending order. A step that is late, or a second time, fails the batch before any state changes.
    """
    ship_package(stream.sparkSession)
    names = [f.name for f in StructType.fromDDL(schema).fields]

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, last = state.get if state.exists else (None, None)
        fold = start() if held is None else pickle.loads(held)  # written by this function alone
        rows = pd.concat(list(batches), ignore_index=True).sort_values(order, kind="stable")
        if last is not None and rows[order].min() <= last:
            raise ValueError(f"{order} must increase strictly within {keys}: {rows[order].min()} after {last}")
        out: list[dict] = []
        for _, step in rows.groupby(order, sort=True):
            out += [{**dict(zip(keys, key, strict=True)), **r} for r in fold.step(step)]
        state.update((pickle.dumps(fold), int(rows[order].max())))
        if out:
            yield pd.DataFrame(out)[names]

    return stream.groupBy(*keys).applyInPandasWithState(run, schema, "fold binary, last long", "append", GroupStateTimeout.NoTimeout)
