"""The pipeline's stages on the driver's small table."""

from __future__ import annotations

import brute
import corpus_pipeline

from weftline.llm.common import written


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash_near_dedup", "mixing", "sentencepiece"]
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, written(stage(spark, docs, sf), f"test-{name}")
        seen[name] = (before, docs)
        assert name == "sentencepiece" or docs.columns == columns
    text = lambda df: {r["doc_id"]: r["text"] for r in df.collect()}
    before, after = (text(x) for x in seen["exact_dedup"])
    assert set(after) == {i for i, *_, kept, _ in brute.exact(list(before.items())) if kept}
    before, after = (text(x) for x in seen["simhash_near_dedup"])
    assert all(any(brute.jaccard(t, u) >= 0.8 for j, u in before.items() if j < i) for i, t in before.items() if i not in after)
    assert not any(brute.jaccard(t, u) >= 0.8 for i, t in after.items() for j, u in after.items() if j < i)
    assert all(r["lossless"] for r in docs.collect())
    assert corpus_pipeline.run(spark, sf).count() == docs.count()


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    labels = spark.createDataFrame([(7, 1, 0), (None, None, None), (19, 0, 1)], "doc_id long, quality int, toxic int")
    for name, table in (("odd", odd), ("empty", empty)):
        table.write.parquet(str(tmp_path / name / "documents.parquet"))
        labels.write.parquet(str(tmp_path / name / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(tmp_path / name))
        assert {"doc_id", "label", "pieces", "lossless"} <= set(found.columns)
        ids = {r["doc_id"] for r in found.collect()}
        assert ids == (set() if name == "empty" else ids) and 19 not in ids and (name == "empty" or {1, 7, 14, 15, None} <= ids and not {2, 3, 4, 5, 8, 20} & ids)
