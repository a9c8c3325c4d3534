"""Streaming over sorted partitions: whole groups out of Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, dict[str, list]]]:
    """(key, columns as lists) of each run of equal keys; a group may span batches."""
    current, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = {name: batch.column(name).to_pylist() for name in batch.schema.names}
        marks = list(zip(*[columns[k] for k in keys]))
        start = 0
        for i in range(1, len(marks) + 1):
            if i < len(marks) and marks[i] == marks[start]:
                continue
            part = {name: values[start:i] for name, values in columns.items()}
            if marks[start] == current:
                for name, values in part.items():
                    held[name] += values
            else:
                if held is not None:
                    yield current, held
                current, held = marks[start], part
            start = i
    if held is not None:
        yield current, held
