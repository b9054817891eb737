"""Parsers on streams: a fold per log is kept as state, and blocks come out as lines complete them."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.projection import events_of
from ..schema import BLOCKS, names
from .folds import CustomFold, Fold, GenericFold, GotestFold, GotestsumFold, JestFold, PytestFold

FOLDS: dict[str, Callable[[], Fold]] = {"generic": GenericFold, "gotest": GotestFold, "gotestsum": GotestsumFold, "jest": JestFold, "pytest": PytestFold}


def fold_stream(lines: DataFrame, fmt: str, make: Callable[[], Fold] | None = None, idle: str | None = None) -> DataFrame:
    """``log_id, line_no, line`` as a stream -> events with ``emit`` and ``rank`` as a stream.

    A row whose line is null ends its log. With ``idle``, a log that gets no lines for so long, by the clock, ends too.
    Lines of a log must come in order from batch to batch; within a batch they are sorted. The token budget needs all
    events of a log and has no streaming form.
    """
    make = make or FOLDS[fmt]
    wait = 0 if idle is None else _millis(idle)

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold = pickle.loads(state.get[0]) if state.exists else make()
        found = []
        ended = state.hasTimedOut
        if not ended:
            rows = pd.concat(list(batches)).sort_values("line_no")
            for line in rows["line"]:
                if line is None:
                    ended = True
                    break
                found += fold.feed(line)
        if ended:
            found += fold.close()
            if state.exists:
                state.remove()
        else:
            state.update((pickle.dumps(fold),))
            if wait:
                state.setTimeoutDuration(wait)
        rows = [(key[0], emit, rank, fmt, kind, severity, header, body, context, attrs) for emit, rank, kind, severity, header, body, context, attrs in found]
        yield pd.DataFrame(rows, columns=names(BLOCKS))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if wait else GroupStateTimeout.NoTimeout
    blocks = lines.groupBy("log_id").applyInPandasWithState(run, BLOCKS, "fold binary", "append", timeout)
    return events_of(blocks, "custom" if isinstance(make(), CustomFold) else fmt)


def _millis(text: str) -> int:
    n, unit = text.split()
    return int(float(n) * {"second": 1000, "minute": 60_000, "hour": 3_600_000}[unit.rstrip("s")])
