"""Running a state machine over each key's rows in order, in a batch or in a stream.

replay() sorts rows within partitions and passes over them batch by batch, keeping one key's state at a time, so a
key's length doesn't matter to memory. stream() keeps each key's state, pickled, in the state store; a batch of a
stream is sorted before use, and rows not newer than the last one are dropped (counted in the state).
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def replay(df: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """make() gives a machine with step(row) -> list of tuples (without the key) and end() -> the same; schema begins with the key."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, machine = None, None
        names = [c.split()[0].strip("`") for c in schema.split(",")]
        for pdf in batches:
            out = []
            for row in pdf.itertuples(index=False):
                k = getattr(row, key)
                if machine is None or k != now:
                    if machine is not None:
                        out += [(now, *r) for r in machine.end()]
                    now, machine = k, make()
                out += [(k, *r) for r in machine.step(row)]
            yield pd.DataFrame(out, columns=names)
        if machine is not None:
            yield pd.DataFrame([(now, *r) for r in machine.end()], columns=names)

    return df.repartition(key).sortWithinPartitions(key, *order).mapInPandas(run, schema)


def stream(df: DataFrame, key: str, order: list[str], make: Callable, schema: str) -> DataFrame:
    """The same machine over a stream; end() isn't called, as streams don't end."""
    names = [c.split()[0].strip("`") for c in schema.split(",")]

    def run(k, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last, machine = pickle.loads(state.get[0]) if state.exists else (None, make())
        pdf = pd.concat(list(batches)).sort_values(order)
        out = []
        for row in pdf.itertuples(index=False):
            at = tuple(getattr(row, c) for c in order)
            if last is not None and at <= last:
                continue
            last = at
            out += [(k[0], *r) for r in machine.step(row)]
        state.update((pickle.dumps((last, machine)),))
        yield pd.DataFrame(out, columns=names)

    return df.groupBy(key).applyInPandasWithState(run, schema, "blob binary", "append", GroupStateTimeout.NoTimeout)


class Machine:
    """A machine without anything to say at the end."""

    def step(self, row) -> list[tuple]:
        return []

    def end(self) -> list[tuple]:
        return []
