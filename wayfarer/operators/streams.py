"""Each user's rows in order, as a stream of Arrow batches in which one user follows another."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame


def changes(column: pa.Array) -> np.ndarray:
    """True where a value differs from the one before; null equals null. The first is True."""
    out = np.ones(len(column), bool)
    if len(column) > 1:
        a, b = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.not_equal(a, b)
        if differ.null_count:
            differ = pc.if_else(pc.is_null(differ), pc.not_equal(pc.is_null(a), pc.is_null(b)), differ)
        out[1:] = differ.to_numpy(zero_copy_only=False)
    return out


def joined(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    return parts[0] if len(parts) == 1 else pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def sorted_by_user(df: DataFrame, order: list[str | Column], user: str = "user_id") -> DataFrame:
    return df.repartition(user).sortWithinPartitions(user, *order)


def per_user(df: DataFrame, order: list[str | Column], kernel: Callable[[pa.RecordBatch, np.ndarray], pa.RecordBatch], schema: str, user: str = "user_id") -> DataFrame:
    """kernel gets the rows of some whole users, sorted, and where each user begins (and the last ends). Only the user that a batch
    of rows ends with is held until it is whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            begins = np.flatnonzero(changes(b.column(user)))
            if held and b.column(user)[0] == held[-1].column(user)[-1]:
                begins = begins[1:]
            if not len(begins):
                held.append(b)
                continue
            whole = joined([*held, b.slice(0, int(begins[-1]))])
            if whole.num_rows:
                yield kernel(whole, np.append(np.flatnonzero(changes(whole.column(user))), whole.num_rows))
            held = [b.slice(int(begins[-1]))]
        if held:
            whole = joined(held)
            yield kernel(whole, np.append(np.flatnonzero(changes(whole.column(user))), whole.num_rows))

    return sorted_by_user(df, order, user).mapInArrow(run, schema)
