"""Token counts without token ids: pieces are counted once per distinct pre-token and joined to its frequencies.

A pre-token here is a run of text between ASCII white space; the vocabulary's own pre-tokenizer drops white space and
never joins text across it, so the pieces of a text are those of its pre-tokens. Each block of documents counts its
pre-tokens per document, has the pieces of the distinct ones counted, and sums frequency times pieces. The join is made
where the block is: pre-tokens are many and rarely shared, so moving them would cost several times the text.
"""

from __future__ import annotations

import collections

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import narrowed, pieces, raw, read_table

VOCABULARY = "word_bpe_49k.json"
LIMIT = 2048
#: Distinct pre-tokens that a worker remembers between blocks; beyond them it forgets all and goes on.
REMEMBERED = 400_000
#: Pre-tokens longer than this are counted anew each time instead of being remembered.
LONG = 64
BLOCK_ROWS = 500


class Counter:
    """Pieces per pre-token by the vocabulary's library, remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[bytes, int] = {}

    def pieces(self, new: list[bytes]) -> list[int]:
        return [len(e.ids) for e in self.tokenizer.encode_batch([w.decode() for w in new], add_special_tokens=False)]

    def count(self, texts: list[bytes | None]) -> list[int]:
        known = self.known
        if len(known) > REMEMBERED:
            known.clear()
        rows = [collections.Counter((t or b"").split()) for t in texts]
        new = list({w for r in rows for w in r if w not in known})
        short = [w for w in new if len(w) <= LONG]
        for at in range(0, len(short), 20_000):
            part = short[at : at + 20_000]
            known.update(zip(part, self.pieces(part)))
        long = {w: self.pieces([w])[0] for w in new if len(w) > LONG}
        if not long:
            return [sum(n * known[w] for w, n in r.items()) for r in rows]
        return [sum(n * (known[w] if len(w) <= LONG else long[w]) for w, n in r.items()) for r in rows]


_counters: dict[str, Counter] = {}


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: ``doc_id, n_bytes, n_tokens, over_limit``.

    Tokens are those the ``tokenizers`` library gives for the whole text with the vocabulary at ``path``, without added
    special tokens; strings of special tokens inside a text count as the library's default has it. Null and empty texts
    have none. The vocabulary must drop white space when it pre-tokenizes. Repeated rows are each counted; an empty
    table gives no rows; further columns are ignored.
    """
    path = path or public_tokenizers.path(VOCABULARY)
    docs = narrowed(docs, doc_id=id_col, text=text_col)

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        counter = _counters.setdefault(path, None) or Counter(path)
        _counters[path] = counter
        for b in pieces(batches, BLOCK_ROWS):
            texts = raw(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t or b"") for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
