"""Core operators on small frames: nulls, ties, empty tables, options that are wrong, sources, sinks and streams."""

from __future__ import annotations

import gzip
import io
import json
import math
import random
import tarfile
import time
import zipfile
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import corpus
from weftline.functions import hangul
from weftline.functions import text as T
from weftline.operators import branching, dedup, joins, lexicons, metrics, ml, ngrams, relational, sampling, sentiment, sinks, subword, text
from weftline.plans.registry import Pipeline, names
from weftline.sources import readers
from weftline.streaming import windows as streams


def one(spark, expression, *values):
    df = spark.createDataFrame([tuple(values)], ", ".join(f"c{i} string" for i in range(len(values))))
    return df.select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


def test_entry_and_guard(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_pipeline_checks_names_and_options(spark):
    df = spark.createDataFrame([(1, " a "), (2, None)], "id int, text string")
    p = Pipeline([("fillna", {"columns": ["text"]}), ("normalize", {})])
    assert [r["text"] for r in p.run(df).collect()] == ["a", ""]
    assert [r["text"] for r in p.override(fillna={"fill_with": "x"}).run(lambda: df).collect()] == ["a", "x"]
    with pytest.raises(KeyError):
        Pipeline(["drop_duplßicates"])
    with pytest.raises(TypeError):
        Pipeline([("drop", {"columns": "x", "axix": 1})])
    with pytest.raises(TypeError):
        Pipeline(["melt"])
    assert len(names()) > 60


def test_normalisation(spark):
    n = lambda s: one(spark, T.normalize, s)
    assert n("“a” ‘b’ — c… d . . . e\tf  g\x07­ ″") == "\"a\" 'b' - c... d ... e f g ''"
    assert n("　x ") == "x" and n("") == "" and n(None) is None
    assert one(spark, T.repeat_normalize, "cooool aaa!!!") == "cool aa!!!"
    assert one(spark, lambda c: T.normalize(c, form="NFC"), "é &amp; b") == "é & b"
    with pytest.raises(KeyError):
        T.normalize(F.col("x"), ["quotez"])


def test_predicates(spark):
    assert one(spark, T.bracket_level, "((a]") == 1 and one(spark, T.is_punct, "") and one(spark, T.is_punct, "?!") and not one(spark, T.is_punct, "a")
    assert one(spark, T.is_ascii, "ab") and not one(spark, T.is_ascii, "é")
    assert [one(spark, T.like_url, x) for x in ("http://a.b/c", "www.x", "a.com", "a@b.com", "abc")] == [True, True, True, False, False]
    assert [one(spark, T.like_number, x) for x in ("1,000.5", "1/2", "Ten", "x1")] == [True, True, True, False]
    assert one(spark, T.word_shape, "Apple12345é") == "Xxxxxddddx" and one(spark, T.word_shape, "x" * 100) == "LONG"
    assert one(spark, T.best_substring_distance(), "abc", "xxabdxx") == 1
    assert spark.range(1).select(T.human_bytes(F.lit(9416000000)).alias("x")).first()["x"] == "8.77 GiB"


def test_korean(spark):
    assert hangul.compose(*hangul.decompose("값")) == "값" and hangul.decompose("a") is None
    assert one(spark, T.jamo, "값") == ["ㄱ", "ㅏ", "ㅄ"] and one(spark, T.compose_jamo, "ㄱ", "ㅏ", "ㅄ") == "값" and one(spark, T.compose_jamo, "ㄱ", "ㅏ", "") == "가"
    assert one(spark, T.has_final_consonant, "강") and not one(spark, T.has_final_consonant, "나")
    assert one(spark, T.hangul_only, "가 a나1!") == "가 나" and one(spark, lambda c: T.hangul_only(c, True, True), "가a1!") == "가a1"
    table = {"大": "대", "韓": "한", "民": "민", "女": "녀", "子": "자"}
    assert [hangul.initial_sound(*x) for x in (("녀",), ("냐",), ("니",), ("려",), ("래",), ("렉",), ("략",), ("렬", "나"), ("률", "백"), ("률", "선"), ("녀", "남"), ("가",), ("a",))] == ["여", "냐", "이", "여", "내", "렉", "약", "열", "률", "률", "녀", "가", "a"]
    assert hangul.read_hanja("大韓 女子", table) == "대한 여자" and hangul.read_hanja("大", table, "combination-text") == "大(대)"
    assert hangul.fix_laughter("핰ㅋㅋㅋㅋ") == "하ㅋㅋ"
    assert hangul.split_sentences("안녕하세요. 저는 “갑니다. 네” 라고 했다. Hello there. Bye") == ["안녕하세요.", "저는 “갑니다. 네” 라고 했다.", "Hello there.", "Bye"]
    assert len(hangul.codes("가나", 3)) == 9


def test_segment_and_chunk(spark):
    long = "This is a good sentence. Short. Another very fine sentence here."
    assert one(spark, T.segment, long + "\n \n\nA third paragraph sentence stands.") == "This is a good sentence.\nAnother very fine sentence here.\n\nA third paragraph sentence stands."
    assert one(spark, lambda c: T.segment(c, "always"), "one two three\nfour five six.") == "one two three four five six."
    assert one(spark, lambda c: T.chunk(c, 5), "aa\nbb\ncc\nlonger line\nd") == ["aa\nbb", "cc", "longer line", "d"] and one(spark, lambda c: T.chunk(c, 5), "") == []


def test_tokens(spark):
    assert one(spark, lambda c: T.pos_filter(T.words(c), ["N"], ["NNB"], ["것"]), "사람/NNG 것/NNG 수/NNB 가/VV odd a/b/c") == ["사람", "odd", "a/b/c"]
    df = spark.createDataFrame([(["new", "york", "is", "new"],)], "t array<string>")
    assert text.replace_sequences(df, "t", {"new york": "new_york", "new": "NEW"}).first()["t"] == ["new_york", "is", "NEW"]
    tags = spark.createDataFrame([(["a", "b", "c", "d"], ["PER", "PER", None, "LOC"])], "w array<string>, t array<string>")
    assert text.bio_labels(tags, "w", "t").first()["labels"] == ["B-PER", "I-PER", "O", "B-LOC"]
    assert text.speaker(spark.createDataFrame([("MR. SMITH. Hello",), ("Hello",)], "text string")).select("speaker").collect()[0][0] == "MR. SMITH"


def test_ngrams(spark):
    assert ngrams.skip_indices(3, 2, 1) == [(0,), (0, 1), (0, 2)]
    df = spark.createDataFrame([(1, "a b c a b".split()), (2, []), (3, None)], "id int, t array<string>")
    counts = ngrams.ngram_counts(df, "t", 2)
    assert {r["words"]: r["frequency"] for r in counts.collect()} == {"a": 2, "b": 2, "c": 1, "a;b": 2, "b;c": 1, "c;a": 1}
    skip = {r["words"]: r["frequency"] for r in ngrams.ngram_counts(df, "t", 2, max_skip=1).collect()}
    assert skip["a;c"] == 1 and skip["b;a"] == 1 and skip["a;b"] == 2
    be = {r["words"]: r for r in ngrams.branching_entropy(counts).collect()}
    assert be["a"]["rightside_entropy"] == 0.0 and be["b"]["rightside_entropy"] == 0.0 and be["b"]["leftside_entropy"] == 0.0
    npmi = ngrams.pmi_scores(counts, normalized=True).collect()
    assert all(-1.001 <= r["score"] <= 1.001 or r["score"] > 1 for r in npmi)
    scores = spark.createDataFrame([("a;b", 2.0), ("b;c", 3.0), ("a", 1.0), ("c", 0.5)], "words string, score double")
    hits = lambda policy: sorted((r["start"], r["words"]) for r in ngrams.find_ngrams(df, scores, "id", "t", 2, 0.5, policy).collect())
    assert hits("highest") == [(0, "a"), (1, "b;c"), (3, "a;b")] and hits("keep") == [(0, "a"), (0, "a;b"), (1, "b;c"), (2, "c"), (3, "a"), (3, "a;b")]


def test_sentiment(spark):
    lex = spark.createDataFrame([("good", 1, 0), ("bad", 0, 1)], "word string, positive long, negative long")
    df = spark.createDataFrame([(1, "good good bad day today"), (2, "good"), (3, None), (4, "")], "id int, text string")
    rows = {r["id"]: r for r in sentiment.score_polarity(sentiment.lexicon_features(df, lex, "id")).collect()}
    assert rows[1]["positive"] == 2 and rows[1]["polarity_label"] == "positive" and rows[2]["positive"] is None and rows[3]["num_tokens"] == 0
    edge = spark.createDataFrame([(0.2,), (-0.2,), (None,)], "p double")
    assert [tuple(r) for r in edge.select(sentiment.last_match(F.col("p"), sentiment.CLASSES), sentiment.first_match(F.col("p"), sentiment.CLASSES)).collect()] == [("positive", "neutral"), ("neutral", "negative"), (None, None)]
    groups = sentiment.aggregate_scores(spark.createDataFrame([("a", 0.5), ("a", -0.1), (None, 1.0)], "g string, polarity double"), "g", min_examples=2).collect()
    assert len(groups) == 1 and groups[0]["polarity"] is None


def test_joins(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q")], "k int, v string")
    assert joins.merge_dataframe(a, b, "k").count() == 1
    safe = joins.merge_dataframe(a, b, "k", null_safe=True)
    assert safe.columns == ["k", "v_x", "v_y"] and safe.count() == 2
    assert joins.merge_dataframe(a, b, left_on="k", right_on="k", how="left").count() == 2
    t = spark.createDataFrame([(i, i * 10) for i in range(20)], "id int, t int")
    s = spark.createDataFrame([(15, "a"), (15, "a"), (100, "b")], "t int, v string")
    got = {r["id"]: r["v"] for r in joins.asof_join(t, s, "t", ["v"]).collect()}
    assert got[1] is None and got[2] == "a" and got[10] == "a" and got[11] == "b"
    got = {r["id"]: r["v"] for r in joins.asof_join(t, s, "t", ["v"], direction="forward", strict=False).collect()}
    assert got[0] == "a" and got[2] == "b" and got[10] == "b" and got[11] is None
    got = {r["id"]: r["v"] for r in joins.asof_join(t, s, "t", ["v"], strict=False).collect()}
    assert got[10] == "b"
    assert joins.asof_join(t.limit(0), s, "t", ["v"]).count() == 0


def test_reshaping(spark):
    df = spark.createDataFrame([("a", "x", 1, 2), ("a", "y", 3, 4), ("b", "x", 5, 6)], "i string, c string, v int, w int")
    out = relational.pivot(df, "i", "c", ["v", "w"], fillna=0)
    assert sorted(out.columns) == ["i", "v_x", "v_y", "w_x", "w_y"] and {r["i"]: r["w_y"] for r in out.collect()} == {"a": 4, "b": 0}
    with pytest.raises(Exception, match="more than one row"):
        relational.pivot(df.unionAll(df), "i", "c", "v").collect()
    assert relational.aggregate_columns(spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int"), "k", {"v": "sum"}).collect()[0]["v"] == 2
    ids = relational.reset_index(spark.range(100).repartition(7), "id", "n").collect()
    assert all(r["n"] == r["id"] for r in ids)
    assert {r["part"]: r["count"] for r in sampling.split_dataframe(spark.range(11), 4, "id").groupBy("part").count().collect()} == {0: 3, 1: 3, 2: 3, 3: 2}
    assert sampling.split_sampling(spark.range(10), "id", 0.25).groupBy("split").count().where("split = 'test'").first()["count"] == 3
    with pytest.raises(KeyError):
        relational.drop(df, "zz", errors="raise")


def test_minhash_groups(spark):
    df = spark.createDataFrame(list(enumerate(["This is a sentence.", "This is another sentence.", "This is a question.", "hello world", None])), "id long, text string")
    got = {r["id"]: r["group"] for r in dedup.minhash_groups(df, "id", threshold=0.3, permutations=128, bands=64).collect()}
    assert got[0] == got[1] == 0 and got[3] == 3 and got[4] == 4
    chain = spark.createDataFrame([(i + 1, i) for i in range(40)], "a long, b long")
    assert {r["root"] for r in dedup.connected(chain).collect()} == {0}


def test_minhash_groups_of_a_family(spark):
    """Groups of edited copies equal those of all pairs at the threshold, in buckets of several blocks."""
    rng = random.Random(4)
    base = [rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(160)]
    texts = {}
    for i in range(300):
        chars = list(base)
        for at in rng.sample(range(160), rng.randrange(1, 8)):
            chars[at] = rng.choice("0123456789")
        texts[i] = "".join(chars)
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {r["id"]: r["group"] for r in dedup.minhash_groups(df, "id", threshold=0.8).collect()}
    sets = {i: {t[k : k + 5] for k in range(len(t) - 4)} for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        return i if root[i] == i else find(root[i])

    linked = [(i, j) for i in texts for j in range(i) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    for i, j in linked:
        p, q = sorted((find(i), find(j)))
        root[q] = p
    assert len(linked) > 1000 and got == {i: find(i) for i in texts}


def test_placed_ngrams_and_overlaps(spark):
    """Runs of rows give the n-grams that a plain loop gives; a long row's overlaps are settled as one after another would be, in time that does not grow with their square."""
    rng = random.Random(3)
    lists = [[rng.choice("abcd") for _ in range(rng.randrange(9))] for _ in range(50)] + [None, [], ["a", None, "b"]]
    table = pa.table({"id": list(range(len(lists))), "t": pa.array(lists, pa.list_(pa.string()))})
    patterns = [*ngrams._patterns(3), (0, 2), (0, 1, 3)]
    got = Counter((idx, texts[int(g)].as_py(), int(r), int(s)) for idx, texts, which, rows, starts in ngrams._grams(table, patterns) for g, r, s in zip(which, rows, starts, strict=True))
    want = Counter((idx, ";".join(t[s + k] for k in idx if t[s + k] is not None), r, s) for idx in patterns for r, t in enumerate(lists) if t for s in range(len(t) - idx[-1]))
    assert got == want
    for _ in range(50):
        n = rng.randrange(40)
        start, length = np.array([rng.randrange(30) for _ in range(n)], np.int64), np.array([rng.randrange(1, 4) for _ in range(n)], np.int64)
        kept: list[int] = []
        for i in range(n):
            if all(start[i] + length[i] <= start[k] or start[k] + length[k] <= start[i] for k in kept):
                kept.append(i)
        assert ngrams.best_apart(start, length).tolist() == kept
    df = spark.createDataFrame([(1, [f"w{i % 50}" for i in range(30_000)])], "id long, t array<string>")
    began = time.time()
    scores = ngrams.ngram_counts(df, "t", 2).withColumn("score", F.col("frequency").cast("double"))
    assert ngrams.find_ngrams(df, scores, "id", "t", 2, 1.0).count() == 15_000
    assert time.time() - began < 60


def test_ngram_counts_deal_words_before_adding(spark):
    """No task adds up the counts of a whole split: there is no aggregate before the shuffle by n-gram."""
    plan = ngrams.ngram_counts(spark.createDataFrame([(["a", "b"],)], "t array<string>"), "t", 2)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [words" in plan and plan.index("Aggregate") < plan.index("RepartitionByExpression") < plan.index("MapInArrow")


def test_pmi_scores_count_once(spark):
    """Scores read their counts from a table: the tokens are not cut and counted again for each side."""
    counts = ngrams.ngram_counts(spark.createDataFrame([(["a", "b", "a", "b"],)], "t array<string>"), "t", 2)
    for out in (ngrams.pmi_scores(counts), ngrams.cohesion_scores(counts), ngrams.branching_entropy(counts)):
        assert "MapInArrow" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_lexicon_words_go_before_the_shuffle(spark):
    df = spark.createDataFrame([(1, "good bad good other words here"), (2, "nothing of it at all now")], "id long, text string")
    lexicon = spark.createDataFrame([("good", 1, 0), ("bad", 0, 1), ("bad", 0, 2)], "word string, positive long, negative long")
    out = sentiment.lexicon_features(df, lexicon, "id")
    assert {tuple(r) for r in out.collect()} == {(1, 6, 2, 3), (2, 6, 0, 0)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan and "broadcast" in plan


def test_exact_sums(spark):
    """Cents add up whatever their order: a sum of doubles loses them."""
    rows = [("a", 0.1), ("a", 1e12), ("a", 0.2)] + [("a", 0.01)] * 1000
    out = relational.aggregate_columns(spark.createDataFrame(rows, "k string, v double"), "k", {"v": ["sum_exact"]}).first()
    assert str(out["v_sum_exact"]) == "1000000000010.300000"


def test_encode_hands_on_a_few_texts_at_a_time(spark):
    column = subword.encode(F.col("t"), lambda w: list(w))
    rows = [(i, None if i % 7 == 0 else "ab c" * (i % 3)) for i in range(500)]
    got = {r["i"]: r["p"] for r in spark.createDataFrame(rows, "i long, t string").select("i", column.alias("p")).collect()}
    assert got == {i: None if t is None else [c for w in t.split() for c in w] for i, t in rows}
    chunks = list(subword._pieces(list)(iter([pa.array([t for _, t in rows], pa.string())])))
    assert len(chunks) > 1 and max(map(len, chunks)) <= subword.ROWS


def test_archives_are_files_of_bounded_size_read_as_streams(spark, tmp_path, monkeypatch):
    from weftline.operators import archives

    monkeypatch.setattr(archives, "FRAME_BYTES", 1000)
    rows = spark.createDataFrame([(f"text {i} " + "x" * 300,) for i in range(200)], "text string").coalesce(1)
    for kind, parser in (("jsonl", "jsonlines"), ("dat", "dat")):
        path = str(tmp_path / kind)
        archives.save_archive(rows, path, kind)
        assert len(list((tmp_path / kind).glob("part-*"))) > 1
        back = readers.load_archives(spark, path, parser, suffix=f".{kind}.zst")
        assert sorted(r["text"] for r in back.collect()) == sorted(r["text"] for r in rows.collect())
    ((name, content),) = readers._unpacked(f"a.dat.zst", next((tmp_path / "dat").glob("part-*")).read_bytes())
    assert name == "a.dat" and isinstance(content, io.BufferedReader)


def test_group_texts_sends_slices(spark):
    df = spark.createDataFrame([(i, list(range(i * 10, i * 10 + i))) for i in range(30)] + [(40, None), (41, [])], "id long, ids array<int>").withColumn("k", F.lit(0))
    out = metrics.group_texts(df, "ids", "id", 7, by="k")
    flat = [x for i in range(30) for x in range(i * 10, i * 10 + i)]
    assert {r["block"]: r["ids"] for r in out.collect()} == {b: flat[b * 7 : b * 7 + 7] for b in range(len(flat) // 7)}
    assert "posexplode" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_minhash_groups_write_no_sets(spark):
    """What is written in between stays near the size of the texts: sets of hashes, eight bytes a character, are not."""
    from pathlib import Path

    from weftline.plans import tables

    rng = random.Random(8)
    texts = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=6000)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1000 + i, t[:3000] + "#" + t[3000:]) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(texts)]
    folder = Path(tables.shared_dir(spark))
    used = lambda: sum(p.stat().st_size for p in folder.rglob("*.parquet"))
    before = used()
    got = {r["id"]: r["group"] for r in dedup.minhash_groups(spark.createDataFrame(rows, "id long, text string"), "id", threshold=0.8).collect()}
    assert got == {i: i % 1000 for i, _ in rows}
    assert used() - before < 2.5 * sum(len(t) for _, t in rows)


def test_signatures_rule_out_no_similar_pair():
    rng = np.random.Generator(np.random.PCG64(5))
    for n in (1, 3, 40, 700, 5000):
        x = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        for share in (0.0, 0.05, 0.1, 0.11, 0.2, 0.5):
            y = np.unique(np.concatenate([x[int(len(x) * share) :], rng.integers(0, 2**64, int(len(x) * share), dtype=np.uint64)]))
            both = len(np.intersect1d(x, y))
            similar = both >= 0.8 * (len(x) + len(y) - both)
            can = dedup._signature_pair(dedup.signature(x), dedup.signature(y), 0.8)
            block = dedup._signature_block(pa.table({"root": [1, 2], "set": pa.array([dedup.signature(x), dedup.signature(y)], pa.binary())}), 0.8, False)
            assert (can or not similar) and block == (([0], [1]) if can else ([], [])) and not (share == 0.5 and n > 40 and can)


def test_banding():
    for threshold in (0.3, 0.5, 0.8, 0.95):
        bands, rows = dedup.banding(threshold, 128)
        assert 1 - (1 - threshold**rows) ** bands >= 0.999 and bands * rows <= 128
    assert dedup.char_hashes("", 5).tolist() != dedup.char_hashes("a", 5).tolist() and len(dedup.char_hashes("abcdabcda", 5)) == 4


def test_metrics(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), (None, "a")], "t string, p string")
    m = metrics.classification_metrics(df, "t", "p").first()
    assert m["accuracy"] == pytest.approx(2 / 3) and m["precision"] == pytest.approx((2 * 1.0 + 0.5) / 3) and m["n"] == 3
    pair = spark.createDataFrame([(["a", "b", "b"], ["b", "b", "c"])], "x array<string>, y array<string>")
    assert pair.select(metrics.token_f1(F.col("x"), F.col("y"))).first()[0] == pytest.approx(4 / 6)
    votes = spark.createDataFrame([(1, "u", "x"), (1, "v", "x"), (1, "w", "y"), (2, "u", "y"), (2, "v", "y"), (3, "w", None)], "i int, a string, l string")
    assert {r["i"]: r["l"] for r in metrics.label_model(votes, "i", "a", "l", 3).collect()} == {1: "x", 2: "y"}
    probs = spark.createDataFrame([("a", 0.9, 0.1), ("a", 0.2, 0.8), ("b", 0.3, 0.7)], "l string, a double, b double")
    assert [r["suggested"] for r in metrics.label_errors(probs, "l", ["a", "b"]).collect()] == ["b"]
    words = spark.createDataFrame([("king", [1.0, 1.0]), ("man", [1.0, 0.0]), ("woman", [0.0, 1.0]), ("queen", [0.1, 2.0]), ("x", [1.0, -1.0])], "word string, vector array<double>")
    assert metrics.analogy(words, "man", "king", "woman", n=1).first()["word"] == "queen"


def test_subword(spark):
    counts = {"low": 5, "lower": 2, "newest": 6, "widest": 3}
    merges = subword.train_bpe(dict(counts), 4)
    assert merges[:2] == [("e", "s"), ("es", "t")]
    assert subword.decode_bpe(subword.bpe_word("lowest", {p: i for i, p in enumerate(merges)})) == "lowest"
    v = set(subword.train_wordpiece(counts, 5))
    assert "".join(p.removeprefix("##") for p in subword.wordpiece_word("lower", v)) == "lower" and subword.wordpiece_word("zebra", v) == ["[UNK]"]
    model = subword.train_unigram(counts, 15)
    assert len(model) <= 15 and "".join(subword.unigram_word("newest", model)) == "newest"
    assert subword.digamma([1.0])[0] == pytest.approx(-0.5772156649, abs=1e-8)
    assert subword.unigram_word("zz", model, low=subword.unknown_weight(model)) == subword.unigram_word("zz", model) == ["z", "z"]
    ids = spark.createDataFrame([([1, 2, 3],), ([],)], "x array<int>")
    assert [r[0] for r in ids.select(subword.padded(F.col("x"), 2)).collect()] == [[1, 2], [0, 0]]


def test_models(spark):
    rows = [(i, float(i % 2), float(i % 3), "y" if i % 2 else "n") for i in range(40)]
    df = spark.createDataFrame(rows, "id long, a double, b double, l string").withColumn("label", F.when(F.col("l") == "y", 1).otherwise(0))
    from pyspark.ml.classification import LogisticRegression

    data = ml.assembled(df, ["a", "b"], "label")
    score, _ = ml.search(data, [(LogisticRegression(maxIter=5), {"regParam": [0.0, 0.1]})], 2)
    assert score > 0.99
    words = spark.createDataFrame([(["a", "b", "c"] * 4,), (["d", "e", "f"] * 4,)] * 10, "t array<string>")
    vectors = ml.word_vectors(words, "t", 4, 1)
    assert vectors.count() == 6 and len(ml.reduced(vectors, "vector").first()["components"]) == 2


def test_sources(spark, tmp_path):
    jsonl = b'{"text": ["a", "b"], "meta": {"s": 1}}\nbad\n{"text": "c"}\n'
    with tarfile.open(tmp_path / "x.tar.gz", "w:gz") as t:
        info = tarfile.TarInfo("in.jsonl.gz")
        packed = gzip.compress(jsonl)
        info.size = len(packed)
        t.addfile(info, io.BytesIO(packed))
    import zstandard

    with zipfile.ZipFile(tmp_path / "y.zip", "w") as z:
        z.writestr("z.jsonl.zst", zstandard.ZstdCompressor().compress(jsonl))
    got = readers.load_archives(spark, str(tmp_path), "jsonlines", "text string, meta string").collect()
    assert sorted(r["text"] for r in got) == ["a\n\nb", "a\n\nb", "c", "c"]
    assert list(readers.PARSERS["email"]("x", b"Subject: hi\nFrom: a@b\n\nbody\n"))[0]["subject"] == "hi"
    assert readers.html_text("<title>T</title><script>x</script><p>a <b>b</b></p>c") == "T\na b\nc"
    redif = list(readers.PARSERS["redif"]("x", b"Template-Type: A 1\nTitle: long\n  title\n# no\nTemplate-Type: B\nTitle: t\n"))
    assert json.loads(redif[0]["text"])["title"] == ["long title"] and len(redif) == 2
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "list.txt").write_text("a/N x\n# c\n\nb # d\na/N\n")
    assert sorted(r["word"] for r in readers.load_wordlist(spark, str(tmp_path / "w"), "/").collect()) == ["a", "b"]
    (tmp_path / "t.csv").write_text("a,b\n1,2020-01-02\n2,bad\n")
    df = readers.load_dataframe(spark, str(tmp_path / "t.csv"), dtype={"a": "int"}, parse_dates={"b": "yyyy-MM-dd"}, rename={"a": "n"}, constants={"src": "t"}, query="n > 0")
    assert df.columns == ["n", "b", "src"] and df.where("b is null").count() == 1
    xml = tmp_path / "p.xml"
    xml.write_text("<S><PubmedArticle><MedlineCitation><PMID>7</PMID><Article><ArticleTitle>T</ArticleTitle><Abstract><AbstractText>x</AbstractText><AbstractText>y</AbstractText></Abstract></Article></MedlineCitation></PubmedArticle></S>")
    assert tuple(readers.pubmed(spark, str(xml)).first()) == ("7", "T", "x\ny")


def test_sinks_and_corpus(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "train"), (2, "b", "dev"), (3, None, "train")], "id int, text string, split string")
    sinks.save_as_text(df, str(tmp_path / "t"), separator="\n--\n", order_by="id")
    assert "".join(p.read_text() for p in sorted((tmp_path / "t").glob("part-*"))) == "a\n--\nb\n--\n"
    assert sinks.save_metadata(df, str(tmp_path / "m"), ["id", "split"], ["id", "text"]).columns == ["id", "text"]
    sinks.save_shards(df.dropna(), str(tmp_path / "s"), 2, "id", copies=2)
    assert spark.read.text(str(tmp_path / "s")).count() == 4
    meta = spark.createDataFrame([(1, "2020-01-01")], "id int, date string")
    c = corpus.Corpus("c", df, metadata=meta).timestamped("date", "yyyy-MM-dd")
    assert c.data.where("timestamp is not null").count() == 1 and c.splits() == ["dev", "train"] and c["dev"].count() == 1
    c.save(str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "c" / "data")).count() == 3
    assert corpus.concatenated([c, corpus.Corpus("d", df)]).data.where("corpus = 'd'").count() == 3


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "ab"[i % 2]) for i in range(30)] + [(3, "2024-01-01 00:03:00", "b")]
    spark.createDataFrame(rows, "id int, ts string, g string").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    schema = "id int, ts timestamp, g string"
    for name, f in {"w": lambda s: streams.windowed_counts(s, "ts", "g", value="id"), "s": lambda s: streams.sessions(s, "ts", "g", "5 minutes"), "d": lambda s: streams.deduplicated(s, "ts", ["id"])}.items():
        streams.drain(f(streams.ingest(spark, str(tmp_path / "in"), schema)), str(tmp_path / name), str(tmp_path / f"ck-{name}"))
    assert spark.read.parquet(str(tmp_path / "d")).count() == 30
    w = spark.read.parquet(str(tmp_path / "w"))
    assert w.where("start = '2024-01-01 00:00:00' and g = 'b'").first()["n"] == 6


def test_predict_step(spark):
    from pyspark.ml.feature import Binarizer

    from weftline.operators import ml

    df = spark.createDataFrame([(1, 0.2), (2, 0.9)], "id int, x double")
    out = ml.predict(df, Binarizer(threshold=0.5, inputCol="x", outputCol="y"), rename={"y": "label"})
    assert out.columns == ["id", "x", "label"] and [r["label"] for r in out.orderBy("id").collect()] == [0.0, 1.0]
    with pytest.raises(KeyError):
        ml.predict(df, lambda d: d, columns=["absent"])


def _branching_by_hand(counts, word, threshold, longest=20, least=2):
    """Pieces of one word, by listing all substrings."""
    n = Counter()
    for w, k in counts.items():
        m = f"▁{w}▁"
        for i in range(len(m)):
            for j in range(i + 1, min(len(m), i + longest) + 1):
                n[m[i:j]] += k
    n = {p: k for p, k in n.items() if k >= least}
    dg = lambda x: float(subword.digamma([float(x)])[0])

    def entropy(p, side):
        if p not in n:
            return None
        reach = {q for q in n if side(q, p)}
        ends = [q for q in reach if not any(len(r) == len(q) + 1 and side(r, q) for r in reach)]
        t = dg(sum(n[q] for q in ends) + n[p])
        return round(-sum(math.exp(dg(n[q]) - t) * (dg(n[q]) - t) for q in ends), 10)

    size = len(word)
    f = {i: entropy("▁" + word[:i], str.startswith) for i in range(1, size + 1)}
    b = {i: entropy(word[i:] + "▁", str.endswith) for i in range(1, size)}
    c = {i: math.exp((dg(n[word[:i]]) - dg(n[word[0]])) / (i - 1)) for i in range(2, size + 1) if word[:i] in n}
    step = lambda t, x, y: round(t[x] - t[y], 9) if t.get(x) and t.get(y) else 0
    cuts = [0]
    for i in range(2, size):
        spike = step(b, i, i + 1) > 0 > step(b, i - 1, i) if i < size - 1 else step(f, i, i - 1) > 0 > step(f, i + 1, i)
        if spike or (threshold is not None and step(c, i + 1, i) < threshold):
            cuts.append(i)
    return [("" if s else "▁") + word[s:e] for s, e in zip(cuts, [*cuts[1:], size], strict=True)]


def test_branching(spark):
    draw = random.Random(5)
    counts = Counter(draw.choice(["invest", "compan", "market", "lower", "new"]) + draw.choice(["", "ment", "ing", "ed", "ies", "ity", "s"]) for _ in range(300))
    counts |= {"x" * 45: 3, "a": 1, "zzz": 1}
    words = spark.createDataFrame([*counts.items(), ("", 4)], "word string, n long")
    for threshold in (0.0, None):
        found = branching.branching_segments(words, branching.piece_counts(words), cohesion_threshold=threshold)
        assert {r["word"]: r["pieces"] for r in found.collect()} == {w: _branching_by_hand(counts, w, threshold) for w in counts}
    texts = spark.createDataFrame([(1, "new  newed"), (2, None), (3, "")], "i int, text string")
    got = branching.branching_tokens(texts, "i", trained=branching.piece_counts(words)).collect()
    assert sorted((r["i"], r["place"], "".join(r["pieces"])) for r in got) == [(1, 0, "▁new"), (1, 1, "▁newed")]
    assert branching.branching_tokens(texts.limit(0), "i").count() == 0


def test_range_join_bins(spark):
    draw = random.Random(3)
    ranges = [(a, a + draw.randrange(0, 40), f"v{i}") for i in range(300) for a in [draw.randrange(0, 500)]] + [(5, None, "open"), (None, 9, "none")]
    points = [(i, draw.choice([None, 7, draw.randrange(-5, 560)])) for i in range(400)]
    df, table = spark.createDataFrame(points, "i int, x int"), spark.createDataFrame(ranges, "s int, e int, v string")

    def by_hand(x):
        fits = [] if x is None else sorted((s, e, v) for s, e, v in ranges if s is not None and e is not None and s < x < e)
        return fits[0][2] if fits else "other"

    for bins in (1, 7, 200):
        got = joins.range_join(df, table, "x", "s", "e", "v", "other", bins=bins).collect()
        assert sorted((r["i"], r["v"]) for r in got) == [(i, by_hand(x)) for i, x in points]
    text = joins.range_join(df.select("i", F.col("x").cast("string").alias("x")), table.selectExpr("cast(s as string) s", "cast(e as string) e", "v"), "x", "s", "e", "v")
    assert text.count() == len(points)
    days = table.selectExpr("date_add(date'2020-01-01', s) s", "date_add(date'2020-01-01', e) e", "v")
    got = joins.range_join(df.selectExpr("i", "timestamp(date_add(date'2020-01-01', x)) x"), days, "x", "s", "e", "v", "other").collect()
    assert sorted((r["i"], r["v"]) for r in got) == [(i, by_hand(x)) for i, x in points]
    assert {r["v"] for r in joins.range_join(df, table.limit(0), "x", "s", "e", "v").collect()} == {None}


def test_lexicons(spark):
    table = spark.createDataFrame([("GAIN", 0, 2009, 0), ("Loss", 2009, 0, 0), ("loss", 0, 0, 7), ("may", 0, 0, 2009), (None, 1, 1, 1)], "Word string, Negative int, Positive int, Uncertainty int")
    cut = lexicons.Lexicon("Word", ("Negative", "Positive", "Uncertainty"), lowercase=True, scores=lexicons.LM.scores)
    rows = [(1, "a Gain is a gain and may be".split()), (2, "loss gain loss is all there is".split()), (3, "gain loss".split()), (4, []), (5, None), (6, "no word of it is in here".split())]
    df = spark.createDataFrame(rows, "i int, t array<string>")
    assert {(r["i"], r["words"], r["count"], r["Uncertainty"]) for r in lexicons.lexicon_entries(df, table, cut, "i", "t").collect()} == {
        (1, "gain", 2, 0), (1, "may", 1, 2009), (2, "loss", 2, 7), (2, "gain", 1, 0), (3, "gain", 1, 0), (3, "loss", 1, 7)}
    got = {r["i"]: (r["num_tokens"], r["polarity"], r["polarity_label"], r["uncertainty"]) for r in lexicons.lexicon_scores(df, table, cut, "i", "t", ("polarity", "uncertainty")).collect()}
    assert got[1] == (8, pytest.approx(2 / (2 + 1e-6)), "positive", pytest.approx(1 / 8 + 1e-6))
    assert got[2] == (7, pytest.approx(-1 / (3 + 1e-6)), "negative", pytest.approx(2 / 7 + 1e-6))
    assert got[3] == (2, None, None, None) and got[4] == got[5] == (0, None, None, None) and got[6] == (7, None, None, None)
    assert lexicons.lexicon_scores(df.limit(0), table, cut, "i", "t").count() == 0
    assert lexicons.HIV4.features is None and len(lexicons.LM.features) == 8


@pytest.mark.parametrize("policy", ["longest", "shortest", "highest", "highest_abs", "keep"])
def test_lexicon_overlaps(spark, policy):
    """Against all pairs of hits, listed by hand."""
    draw = random.Random(11)
    entries = {tuple(draw.choice("abcd") for _ in range(draw.choice([1, 2, 2, 3]))): draw.choice([-3, -1, 1, 2, 4]) for _ in range(30)}
    table = spark.createDataFrame([(";".join(g), s) for g, s in entries.items()], "word string, s int")
    spec = lexicons.Lexicon("word", ("s",), "s", max_n=3, max_window=4, max_skip=1, overlaps=policy)
    texts = {i: [draw.choice("abcd") for _ in range(draw.choice([0, 1, 5, 9]))] for i in range(12)}
    want = Counter()
    for i, words in texts.items():
        hits = []
        for idx in ngrams.skip_indices(4, 3, 1):
            for start in range(len(words) - idx[-1]):
                gram = tuple(words[start + k] for k in idx)
                if gram in entries:
                    hits.append((gram, {start + k for k in idx}, entries[gram]))
        if policy != "keep":
            beats = {
                "longest": lambda a, b: (len(b[0]), b[0]) > (len(a[0]), a[0]),
                "shortest": lambda a, b: (-len(b[0]), abs(b[2])) > (-len(a[0]), abs(a[2])),
                "highest": lambda a, b: (b[2], -len(b[0]), b[0]) > (a[2], -len(a[0]), a[0]),
                "highest_abs": lambda a, b: (abs(b[2]), -len(b[0]), b[0]) > (abs(a[2]), -len(a[0]), a[0]),
            }[policy]
            many = [h for h in hits if len(h[0]) > 1]
            kept = [a for a in many if not any(a[0] != b[0] and a[1] & b[1] and beats(a, b) for b in many)]
            hits = kept + [h for h in hits if len(h[0]) == 1 and not any(h[1] & k[1] for k in kept)]
        want.update((i, ";".join(h[0])) for h in hits)
    df = spark.createDataFrame(list(texts.items()), "i int, t array<string>")
    assert {(r["i"], r["words"]): r["count"] for r in lexicons.lexicon_entries(df, table, spec, "i", "t").collect()} == dict(want)


def test_lexicon_tags(spark):
    """Several tokens need a noun; surfaces match without tags and delimiters."""
    table = spark.createDataFrame([("금리/NNG;인상/NNG", 1.0, "hawkish"), ("투기/NNG", 0.5, "hawkish"), ("하/XSV;어야/EC", 1.0, "none")], "word string, polarity double, label string")
    spec = lexicons.Lexicon(**{**{f: getattr(lexicons.MPKO, f) for f in lexicons.Lexicon.__dataclass_fields__}, "features": ("label", "polarity")})
    df = spark.createDataFrame([(1, ["투기/NNG", "를/JKO", "금리/NNP", "인상/NNG", "하/XSV", "어야/EC"])], "i int, t array<string>")
    assert sorted(r["words"] for r in lexicons.lexicon_entries(df, table, spec, "i", "t").collect()) == ["금리/NNP;인상/NNG", "투기/NNG"]


@pytest.mark.parametrize("kind", ["bpe", "wordpiece"])
def test_merges_by_hand(kind):
    """Training against counting everything again before each merge."""
    draw = random.Random(2)
    counts = {"".join(draw.choice("abcd") for _ in range(draw.randrange(1, 9))): draw.randrange(1, 9) for _ in range(120)}
    mark = "" if kind == "bpe" else "##"
    words = {w: [w[0], *(mark + c for c in w[1:])] + (["</w>"] if kind == "bpe" else []) for w in counts}
    letters, merges = {p for w in words.values() for p in w}, []
    for _ in range(40):
        one, two = Counter(), Counter()
        for w, parts in words.items():
            for p in parts:
                one[p] += counts[w]
            for a, b in zip(parts, parts[1:], strict=False):
                two[a, b] += counts[w]
        a, b = min(two, key=lambda p: (-two[p] if kind == "bpe" else -two[p] / (one[p[0]] * one[p[1]]), p))
        merges.append((a, b))
        for parts in words.values():
            i = 0
            while i + 1 < len(parts):
                if parts[i : i + 2] == [a, b]:
                    parts[i : i + 2] = [a + b.removeprefix("##")]
                i += 1
    if kind == "bpe":
        assert subword.train_bpe(counts, 40) == merges
    else:
        assert subword.train_wordpiece(counts, 40) == sorted(letters | {a + b.removeprefix("##") for a, b in merges})
