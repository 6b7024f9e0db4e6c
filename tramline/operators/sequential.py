"""Steps that depend on the frames before: a match's rows pass in order through one task, and only the step's own state is kept."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import groupby, islice

import pandas as pd
from pyspark.sql import DataFrame

CHUNK = 10_000


def in_order(df: DataFrame, order: list[str], columns: list[str], step: Callable[[object, Iterator[tuple]], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows that `step(match_id, rows)` yields for each match; `rows` are tuples of `columns`, by `order`.

    Rows are dealt by match, sorted on disk if need be, and streamed: no task holds a match, however long it is.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    floats = {c.split()[0]: "float64" for c in schema.split(", ") if c.endswith(" double")}

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for b in batches for row in zip(*(b[c].tolist() for c in ["match_id", *columns]), strict=True))
        out = (row for match, group in groupby(rows, key=lambda r: r[0]) for row in step(match, (r[1:] for r in group)))
        while part := list(islice(out, CHUNK)):
            yield pd.DataFrame(part, columns=names).astype(floats)

    dealt = df.select("match_id", *dict.fromkeys([*order, *columns])).repartition("match_id").sortWithinPartitions("match_id", *order)
    return dealt.mapInPandas(run, schema)
