"""The pipeline against its stages' own results."""

import corpus_pipeline
from millrace.llm.decontaminate import contamination
from millrace.llm.mixing import mixture
from millrace.llm.near_dedup import near_duplicates
from millrace.llm.toxicity import toxicity

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("benchmark", "labels"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]
    kept = docs.join(toxicity(docs, labels).where("predicted = 0").select("doc_id"), "doc_id").select(docs.columns)
    kept = kept.join(near_duplicates(kept).where("kept").select("doc_id"), "doc_id").select(docs.columns)
    kept = kept.join(contamination(kept, bench).where("not contaminated").select("doc_id"), "doc_id").select(docs.columns)
    want = sorted(r.doc_id for r in mixture(kept).collect() for _ in range(r.copies))
    out = corpus_pipeline.run(spark, SF)
    got = out.collect()
    assert sorted(r.doc_id for r in got) == want and set(docs.columns) < set(out.columns)


ODD = ("row", "h", "bytes", "cell", "depth", "shard_id", "_h", "_bytes", "_cell", "_bad", "_gone", "a.b", "n_hit", "spans", "base", "draws", "rep", "component_id", "kept", "score", "key")


def odd(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, and columns with the names that operators use."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 27), (1, "one two three four five six", "en", "a", 27), (None, "one two three four five six", None, None, None), (2, None, "en", "a", None), (3, "", None, "b", 0),
            (4, long, "en", "b", len(long)), (5, long + " x", "en", None, 1), (None, None, None, None, None), (6, " \t\n", "de", "c", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.withColumns({c: F.lit(None).cast("string") if c == "kept" else F.lit(f"own {c}") for c in ODD})


def test_stages_take_odd_tables(spark, tmp_path):
    spark.createDataFrame([(1, 1, 0), (None, None, 1), (4, 0, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing like it at all"), (None, None), (2, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd(spark)
    own = [c for c in docs.columns if c not in ("shard_id", "depth")]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert set(docs.columns) <= set(out.columns), name
        got = out.select(*(f"`{c}`" for c in own)).collect()
        assert all(r[c] == (None if c == "kept" else f"own {c}") for r in got for c in ODD if c in own), name
        ids = sorted((r.doc_id or 0, r.text or "") for r in got)
        if name in ("toxicity", "decontamination", "sharding"):
            assert ids == sorted((r.doc_id or 0, r.text or "") for r in docs.collect()), name
        elif name == "near_dedup":
            assert [i for i, _ in ids] == [0, 0, 1, 1, 2, 3, 4, 6], name
        else:
            assert {i for i, _ in ids} >= {4, 5}, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
