"""Line deduplication by overlapping windows of three consecutive lines.

Windows are hashed inside each document with array functions; hashes that occur more than once in the corpus are found
by one aggregation, and every occurrence but the first, by document id and line, covers three lines. Covered lines are
merged per document and removed. Windows are judged on the input, so removing a line never makes or breaks a repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._base import narrowed, read_table

LINES = 3


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines: int = LINES) -> DataFrame:
    """One row per document: ``doc_id, n_lines, n_removed, kept``.

    Lines end at ``\\n``; ``kept`` is the text of the lines that stay, null if the text is null. Documents of fewer than
    ``lines`` lines have no window and stay whole; empty lines are lines. The first occurrence of a window is that of
    the smallest id, nulls first, then the smallest text, then the smallest line. Rows equal in id and text are one document, shown once
    for each row. An empty table gives no rows; further columns are ignored.
    """
    docs = narrowed(docs, doc_id=id_col, text=text_col)
    split = docs.withColumns({"h": F.xxhash64("text"), "lines": F.split("text", "\n")})
    windows = F.expr(
        f"transform(sequence(0, size(lines) - {lines}), i -> struct(i as line, xxhash64(slice(lines, i + 1, {lines})) as h1, xxhash64('w', slice(lines, i + 1, {lines})) as h2))"
    )
    found = split.where(F.size("lines") >= lines).select("doc_id", "h", F.explode(windows).alias("w")).select("doc_id", "h", "w.*")
    where = F.struct("doc_id", "h", "line")
    repeated = found.groupBy("h1", "h2").agg(F.min(where).alias("first"), F.max(where).alias("last")).where("first <> last")
    late = found.join(repeated.select("h1", "h2", "first"), ["h1", "h2"]).where(where != F.col("first"))
    covered = late.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.array_sort(F.collect_set("line")).alias("starts"))
    out = split.join(covered, F.col("doc_id").eqNullSafe(F.col("of")) & F.col("h").eqNullSafe(F.col("of_h")), "left").select("doc_id", "lines", "starts")
    # Windows have one length, so in order of their starts each line that stays lies between the end of one and the start of the next.
    between = f"transform(starts, (s, j) -> slice(lines, if(j = 0, 0, starts[greatest(j - 1, 0)] + {lines}) + 1, greatest(s - if(j = 0, 0, starts[greatest(j - 1, 0)] + {lines}), 0)))"
    rest = f"slice(lines, element_at(starts, -1) + {lines} + 1, size(lines))"
    out = out.withColumn("stay", F.when(F.col("starts").isNull(), F.col("lines")).otherwise(F.expr(f"concat(flatten({between}), {rest})")))
    n_lines, n_stay = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long") for c in ("lines", "stay"))
    return out.select("doc_id", n_lines.alias("n_lines"), (n_lines - n_stay).alias("n_removed"), F.array_join("stay", "\n").alias("kept"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = without_repeated_lines(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("kept", F.lit("")), 256).alias("kept_sha256"))


OP7_SQL = """
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents),
w AS (SELECT doc_id, i, array_to_string(l[i:i + 2], chr(10)) AS k FROM (SELECT doc_id, l, unnest(generate_series(1, len(l) - 2)) AS i FROM d WHERE len(l) >= 3)),
n AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM w),
g AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + 2)) AS i FROM n WHERE r > 1),
k AS (SELECT d.doc_id, string_agg(x.line, chr(10) ORDER BY x.i) AS kept, count(*) AS n_kept FROM (SELECT doc_id, unnest(l) AS line, unnest(generate_series(1, len(l))) AS i FROM d) x JOIN d ON d.doc_id = x.doc_id ANTI JOIN g ON g.doc_id = x.doc_id AND g.i = x.i GROUP BY d.doc_id)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l), 0) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
