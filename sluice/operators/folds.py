"""Ordered folds by key that no built-in function expresses: rows are dealt by key and sorted, and a map over Arrow
batches carries one key's accumulator from row to row, so no key's history is gathered in a row or in memory."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: From the accumulator (None at a key's first row) and a row's order and value to the accumulator and what to emit.
Step = Callable[[Any, Any, Any], tuple[Any, tuple | None]]


def fold(rows: DataFrame, key: str, order: str, value: str, step: Step, emitted: str, finish: Callable[[Any], tuple] | None = None) -> DataFrame:
    """Per key (null is one), what step emits at its rows in order and finish at its end: key and the columns of emitted
    (a DDL string)."""
    slim = rows.select(F.col(key), F.col(order).alias("o"), F.col(value).alias("v"))
    kind = next(f for f in slim.schema.fields if f.name == key).dataType.simpleString()
    names = [part.split()[0] for part in emitted.split(",")]

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: Any = None
        acc: Any = None
        began, schema = False, None

        def batch_of(keys: list, out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(list(c)) for c in zip(*out, strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(keys, schema.field(0).type), *columns], names=[key, *names])

        for batch in batches:
            schema = batch.schema
            keys, out = [], []
            for k, o, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not began or k != now:
                    if began and finish:
                        keys.append(now)
                        out.append(finish(acc))
                    now, acc, began = k, None, True
                acc, given = step(acc, o, v)
                if given is not None:
                    keys.append(k)
                    out.append(given)
            if out:
                yield batch_of(keys, out)
        if began and finish:
            yield batch_of([now], [finish(acc)])

    return slim.repartition(key).sortWithinPartitions(key, "o", "v").mapInArrow(folded, f"`{key}` {kind}, {emitted}")
