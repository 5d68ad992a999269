"""Bespoke sources and archives on small files."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from weftline.operators import archives
from weftline.sources import documents, readers


def test_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("\n".join(f"line {i}" for i in range(5000)))
    (tmp_path / "b.txt").write_text("x\ny\n")
    (tmp_path / "e.txt").write_text("")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = documents.load_lines(spark, str(tmp_path / "a.txt"), 10, 4000).collect()
        assert sorted(r["lineno"] for r in got) == list(range(10, 4000)) and all(r["text"] == f"line {r['lineno']}" for r in got)
        both = documents.parallel_texts(spark, str(tmp_path / "a.txt"), str(tmp_path / "b.txt")).orderBy("lineno").collect()
        assert [tuple(r) for r in both] == [(0, "line 0", "x"), (1, "line 1", "y")]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert documents.load_lines(spark, str(tmp_path / "e.txt")).count() == 0


def test_layouts(spark, tmp_path):
    (tmp_path / "w.txt").write_text(" = One = \n text\n = Two = \n more\n")
    assert sorted(r["text"] for r in documents.headed_articles(spark, str(tmp_path / "w.txt")).collect()) == ["= One = \n text", "Two = \n more"]
    df = spark.createDataFrame([(1, "-- T\n-- By A B\n-- D\n-- U\nbody\n-- kept\n"), (2, "-- T\nno\n"), (3, ""), (4, None)], "id int, value string")
    rows = {r["id"]: r for r in documents.wire_report(df).collect()}
    assert tuple(rows[1])[1:] == ("T", "A B", "D", "U", "body\n-- kept") and (rows[2]["title"], rows[2]["author"], rows[2]["text"]) == ("T", "", "no")
    assert rows[3]["text"] == "" and rows[4]["text"] is None
    parts = documents.split_report(spark.createDataFrame([(7, "a\n\nb", "k")], "n int, text string, part_ string"), "n")
    assert [(r["doc_id"], r["text"]) for r in parts.collect()] == [("00007_000", "a"), ("00007_001", "b")]
    index = spark.createDataFrame([("10-K", 1), ("8-K", 1), ("10-K", 2), (None, None)], "form_type string, cik int")
    assert documents.filings_index(index, ["10-K"], index.where("cik = 2")).count() == 1 and documents.filings_index(index).count() == 4


def test_filing_sections(spark):
    text = "Item 1. Business\nItem 1A. Risks\nItem 15. Exhibits\n\nITEM 1. Business\nWe sell things. See Item 1A here.\nItem 1A. Risks\nMany risks.\nItem 15. Exhibits\nAll of them."
    df = spark.createDataFrame([(text,), ("",), (None,)], "t string")
    found = [r["s"] for r in df.select(documents.filing_sections(F.col("t")).alias("s")).collect()]
    assert found[0]["1"] == "ITEM 1. Business\nWe sell things. See Item 1A here." and found[0]["1A"] == "Item 1A. Risks\nMany risks." and found[0]["15"].endswith("All of them.")
    assert found[1] == {} and found[2] is None


def test_archives(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i} é\nline", "s") for i in range(25)] + [(99, None, "s"), (98, "", "s")], "id int, text string, src string")
    want = sorted(r["text"] for r in df.dropna().collect())
    for kind, parser in (("jsonl", "jsonlines"), ("dat", "dat"), ("json", "json")):
        path = str(tmp_path / kind)
        archives.save_archive(df, path, kind, meta=["src", "id"], per_frame=4)
        back = readers.load_archives(spark, path, parser, "text string, meta string", suffix=f".{kind}.zst")
        assert sorted(r["text"] for r in back.collect()) == want
    archives.save_archive(df.limit(0), str(tmp_path / "none"))
    with pytest.raises(ValueError):
        archives.save_archive(df, str(tmp_path / "x"), "pickle")
    archives.save_chunks(df, str(tmp_path / "c"), 10, "id")
    assert all(sum(1 for _ in p.open()) <= 20 for p in (tmp_path / "c").glob("part-*"))


def test_files_and_samples(spark, tmp_path):
    spark.range(40).repartition(4).write.parquet(str(tmp_path / "p"))
    df = spark.read.parquet(str(tmp_path / "p"))
    got = documents.sample_files(df, 2)
    assert got.columns == ["id"] and 0 < got.count() < 40 and documents.sample_files(df, 9).count() == 40
    assert documents.fetched(spark, str(tmp_path / "f"), lambda: spark.range(3)).count() == 3
    assert documents.fetched(spark, str(tmp_path / "f"), lambda: spark.range(5)).count() == 3
    assert documents.fetched(spark, str(tmp_path / "f"), lambda: spark.range(5), force=True).count() == 5
    (tmp_path / "j.jsonl").write_text('{"text": ["a", "b"], "meta": {"pile_set_name": "X"}}\n{"text": "c"}\n')
    assert sorted(map(tuple, documents.pile(spark, str(tmp_path / "j.jsonl")).collect())) == [("a\n\nb", "X"), ("c", "the_pile")]
    assert documents.pile(spark, str(tmp_path / "j.jsonl"), ["X"]).count() == 1
    assert documents.samples(spark, "minutes").count() == 5 and documents.samples(spark, "speeches").count() == 5
    with pytest.raises(KeyError):
        documents.samples(spark, "x")
