"""Running folds over whole logs in batch."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schema import BLOCKS, names
from ..streaming.folds import Block, Fold

_NAMES = names(BLOCKS)
_KINDS = [pa.string(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.map_(pa.string(), pa.string())]


def block_rows(log_id: str, fmt: str, blocks: list[Block]) -> list[tuple]:
    return [(log_id, emit, rank, fmt, kind, severity, header, body, context, list(attrs.items())) for emit, rank, kind, severity, header, body, context, attrs in blocks]


def table(rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(_NAMES), _KINDS)], names=_NAMES)


def fold_logs(lines: DataFrame, fmt: str, make: Callable[[], Fold]) -> DataFrame:
    """``lines`` -> blocks, one fold per log in the order of its lines. A log's lines go through one task, its blocks come out."""

    def run(key, batch):
        batch = batch.sort_by("line_no")
        fold, found = make(), []
        for line in batch.column("line").to_pylist():
            found += fold.feed(line)
        found += fold.close()
        return table(block_rows(key[0].as_py(), fmt, found))

    return lines.select("log_id", "line_no", "line").groupBy("log_id").applyInArrow(run, BLOCKS)
