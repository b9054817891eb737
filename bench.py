"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one line of JSON. Each runs once to warm up, then is timed."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from millrace import queries, queries_whole
from millrace.functions.text import estimate
from millrace.plans.engine import sift
from millrace.plans.options import SiftOptions
from millrace.sources.scratch import written

NAMES = [
    "tokens_documents", "document_lines", "anchors", "anchor_context", "custom_blocks", "gotestsum_blocks", "jest_blocks", "pytest_blocks", "gotest_json", "gotest_text", "dedupe_unbounded", "budget_greedy", "gha_strip",
    "compose_strip", "distill_app",
]


#: Copies of the log and of the texts for the figures in MB/s, so that they aren't those of fixed costs.
COPIES = 40


def _seconds(make) -> float:
    """The better of two runs."""
    times = []
    for _ in range(2):
        start = time.time()
        make().write.format("noop").mode("overwrite").save()
        times.append(time.time() - start)
    return min(times)


def large(spark: SparkSession, sf_dir: str) -> dict[str, float]:
    """MB/s over copies of the application log and of the documents."""
    copies = spark.range(COPIES).withColumnRenamed("id", "copy")
    lines = written(queries._sql(spark, sf_dir, queries.APP_LOG).crossJoin(copies).selectExpr("log_id || '-' || copy as log_id", "line_no", "line").repartition(16))
    texts = written(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").crossJoin(copies.where("copy < 8")).select("text").repartition(16))
    log_mb, text_mb = (float(d.selectExpr(f"sum(octet_length({c}) + 1) / 1e6 as mb").first().mb) for d, c in ((lines, "line"), (texts, "text")))
    distilled = _seconds(lambda: sift(lines, SiftOptions(format="generic", envelope="none", severity="warn", dedupe_window=1024)).summary)
    estimated = _seconds(lambda: texts.select(estimate(texts.text).alias("tokens")))
    return {"large_log_mb": round(log_mb, 1), "large_log_distill_mb_per_sec": round(log_mb / distilled, 1), "large_token_estimate_mb_per_sec": round(text_mb / estimated, 1)}


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g").config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    took: dict[str, float] = {}
    for name in NAMES:
        times = []
        for _ in range(3):
            start = time.time()
            queries.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.time() - start)
            if times[0] > 20:
                break
        took[name] = round(statistics.median(times[1:] or times), 3)
    text_mb = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("sum(octet_length(text)) / 1e6 as mb").first().mb
    log_mb = queries._sql(spark, sf_dir, queries.APP_LOG).selectExpr("sum(octet_length(line) + 1) / 1e6 as mb").first().mb
    out = {"metric": "total seconds of the headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir)}
    out |= {"token_estimate_mb_per_sec": round(float(text_mb) / took["tokens_documents"], 1), "distill_mb_per_sec": round(float(log_mb) / took["distill_app"], 2)}
    out |= large(spark, sf_dir)
    print(json.dumps(out))


if __name__ == "__main__":
    main()
