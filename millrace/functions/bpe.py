"""Exact token counts for the budget, from a vocabulary file of ranks; the estimate needs none."""

from __future__ import annotations

import base64
from collections.abc import Callable

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

_encodings: dict[tuple[str, str], object] = {}


def _encoding(path: str, pattern: str):
    import tiktoken

    found = _encodings.get((path, pattern))
    if found is None:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        found = _encodings[path, pattern] = tiktoken.Encoding("given", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return found


def counter(path: str, pattern: str, shipped: bool = False) -> Callable[[Column], Column]:
    """A function of a column of texts, or of arrays of texts, that counts byte-pair tokens; null counts 0.

    ``path`` holds lines of a token in base 64 and its rank. It is there on every executor, or, if ``shipped``, a file
    given to ``SparkContext.addFile``, then its bare name.
    """

    @F.pandas_udf(LongType())
    def count(texts: pd.Series) -> pd.Series:
        encoding = _encoding(SparkFiles.get(path) if shipped else path, pattern)
        known: dict[str, int] = {}

        def one(text: str | None) -> int:
            if not text:
                return 0
            n = known.get(text)
            if n is None:
                n = known[text] = len(encoding.encode_ordinary(text))
            return n

        return texts.map(lambda t: 0 if t is None else one(t) if isinstance(t, str) else sum(map(one, t)))

    def column(text: Column) -> Column:
        return count(text)

    return column
