"""The operators against brute force on a whole small table and on a table of odd rows."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import exact, language, mixing, near, pieces, secrets, simhash, substrings, tokens, topk, toxicity
from weftline.llm.queries import tokenizer_path


def rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def unique(df):
    """Rows with an id of their own."""
    return df.where("doc_id is not null").dropDuplicates(["doc_id"])


def test_exact_dedup(small, odd, empty):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for df in (small, unique(odd)):
        assert set(rows(exact.dedup(df, shard_keys=50), *columns)) == brute.exact(pairs(df))
    found = rows(exact.dedup(odd), *columns)
    assert len(found) == odd.count() and [r[2] for r in found if r[0] == 15] == [2, 2]
    assert exact.dedup(empty).count() == 0
    kept = exact.keep_first(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 1, 6, *range(7, 10), 10, 11, 12, 13, 14, 15, 16, 17, 18, 19]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100, 20_000])
def test_binary_fuse_filter(n):
    keys = np.random.Generator(np.random.PCG64(n)).integers(0, 2**64, 2 * n, dtype=np.uint64)
    held = exact.build_filter(keys[:n])
    assert exact.may_hold(keys[:n], *held).all()
    assert n < 100 or exact.may_hold(keys[n:], *held).mean() < 0.03


def test_topk(spark, empty, monkeypatch):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(13)]) for i in range(600)] + [(700, None), (800, [1.0, None]), (900, [float("nan")] * 3), (None, [1.0]), (1000, []), (1100, [0.5])]
    data += [(2000 + i, data[5][1]) for i in range(20)]
    df = spark.createDataFrame([(*d, "x") for d in data], "vec_id long, embedding array<float>, score string")
    real = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    found = topk.search(df, F.col("vec_id") % 100 == 0, block=64, query_block=4)
    assert set(rows(found, "query_id", "rank", "vec_id", "score")) == brute.topk(real)
    monkeypatch.setattr(topk, "BROADCAST", -1)
    joined = topk.search(df, F.col("vec_id") % 100 == 0, block=64, query_block=4)
    assert set(rows(joined, "query_id", "rank", "vec_id", "score")) == brute.topk(real)
    assert topk.search(df.limit(0), F.lit(True)).count() == 0


def test_segment_bounds_hold():
    rng = np.random.default_rng(1)
    q, x = np.floor(1024 * rng.normal(size=(5, 64))), np.floor(1024 * rng.normal(size=(50, 64)))
    fine = [topk.bound(topk.Level(q, s), topk.Level(x, s), 1e-3) for s in topk.SEGMENTS]
    assert (fine[1] >= q @ x.T).all() and (fine[0] >= fine[1] - 1).all()


def test_mixing(small, odd, empty):
    for df in (small, odd):
        docs = rows(df, "doc_id", "text", "source")
        want = brute.mix_targets(docs)
        found = mixing.mix(df).withColumn("row", F.monotonically_increasing_id()).orderBy("row").collect()
        assert len(found) == len(docs)
        source = {i: s for i, _, s in docs}
        taken = Counter()
        for r in found:
            taken[source[r["doc_id"]]] += r["taken"]
            assert 0 <= r["taken"] <= 2 * r["size"] and 0 <= r["position"] <= 1
            assert r["source_size"] == want[source[r["doc_id"]]][0] and r["target"] == pytest.approx(want[source[r["doc_id"]]][1])
        assert all(abs(taken[s] - t) <= 1 for s, (_, t) in want.items())
        assert [r["position"] for r in found] == sorted(r["position"] for r in found)
    assert mixing.mix(empty).count() == 0
    assert sorted(map(tuple, mixing.mix(small).collect())) == sorted(map(tuple, mixing.mix(small).collect()))
    mixed = mixing.apply(small)
    assert mixed.columns == small.columns
    words = dict(rows(mixed.groupBy("source").agg(F.sum(F.size(F.split(F.trim("text"), r"\s+"))).alias("n")), "source", "n"))
    for s, (_, t) in brute.mix_targets(rows(small, "doc_id", "text", "source")).items():
        assert abs(words[s] - t) <= 1
    assert mixing.apply(odd).columns == odd.columns and mixing.apply(empty).count() == 0


def test_schedule_inverse(spark):
    for knots in mixing.SCHEDULES:
        shares = spark.range(0, 101).select(mixing._inverse(knots, F.col("id") / 100).alias("t")).collect()
        for i, r in enumerate(shares):
            xs = np.linspace(0, r["t"], 2001)
            whole = np.linspace(0, 1, 2001)
            area = lambda x: np.trapezoid(np.interp(x, *zip(*knots, strict=True)), x)
            assert area(xs) / area(whole) == pytest.approx(i / 100, abs=1e-5)


def test_substrings(small, odd, empty):
    for df in (small, unique(odd)):
        assert set(rows(substrings.dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256")) == brute.substrings(pairs(df))
    assert substrings.dedup(odd).count() == odd.count() and substrings.dedup(empty).count() == 0
    cleaned = substrings.clean(odd)
    assert cleaned.columns == odd.columns
    assert {i: hashlib.sha256(" ".join(brute.WORD.findall(t or "")).encode()).hexdigest() for i, t in pairs(unique(cleaned))} == {i: h for i, _, _, h in brute.substrings(pairs(unique(odd)))}
    assert dict(rows(substrings.longest(unique(odd)), "doc_id", "repeated"))[8] == 3200


def test_substrings_by_shuffle(odd, monkeypatch):
    monkeypatch.setattr(substrings, "BROADCAST", -1)
    df = unique(odd)
    assert set(rows(substrings.dedup(df), "doc_id", "n_words", "n_removed", "kept_sha256")) == brute.substrings(pairs(df))


def test_words_and_orders_built_to_collide(spark):
    """Thue-Morse words, and Thue-Morse orders of two words, have equal hashes where hashes are sums of powers."""

    def morse(n, one, two):
        return [two if k.bit_count() & 1 else one for k in range(n)]

    head = [f"w{i}" for i in range(49)]
    docs = [(1, " ".join([*head, "".join(morse(1024, "a", "b"))])), (2, " ".join([*head, "".join(morse(1024, "b", "a"))])), (3, " ".join(morse(4096, "x", "y"))), (4, " ".join(morse(4096, "y", "x")))]
    found = substrings.dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    assert set(rows(found, "doc_id", "n_words", "n_removed", "kept_sha256")) == brute.substrings(docs)


def test_longest_repeat(spark):
    rng = random.Random(3)
    prose = [rng.choice("abcdefghij") + str(rng.randrange(50)) for _ in range(3000)]
    docs = [(1, " ".join(prose)), (2, " ".join(prose[700:1350])), (3, " ".join(prose[:60])), (4, " ".join(prose[100:149])), (5, None), (6, " ".join(prose[700:1350])), (7, " ".join(prose[100:150] + prose[200:320]))]
    found = dict(rows(substrings.longest(spark.createDataFrame(docs, "doc_id long, text string")), "doc_id", "repeated"))
    assert found == {2: 400, 3: 50, 6: 400, 7: 100}


def test_levels_and_window_hashes():
    assert substrings.levels(50) == [13, 25, 50] and substrings.levels(2) == [1, 2] and substrings.levels(13) == [7, 13]
    import pyarrow as pa

    first, second = (h[:, 0] for h in substrings.hashed(pa.array(["a b c d e a b c", " b  c\td e\n"])))
    for n in (1, 2, 3, 4):
        assert (substrings.windows(first, n)[1] == substrings.windows(second, n)[0]) and len(set(substrings.windows(first, n).tolist())) == min(5, 9 - n)


def test_toxicity(spark, small, odd, empty):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    scored = toxicity.score_all(docs, labels).join(labels, "doc_id").where("held_out").collect()
    toxic = [r for r in scored if r["toxic"] == 1]
    assert sum(r["predicted"] for r in toxic) >= 0.7 * len(toxic)
    assert sum(r["predicted"] for r in scored if r["toxic"] == 0) <= 0.03 * len(scored)
    none = labels.limit(0)
    found = {r["doc_id"]: r for r in toxicity.score_all(odd, none).collect()}
    assert found[19]["predicted"] == 1 and found[4]["score"] == 0.0 and found[5]["score"] == 0.0
    assert toxicity.score_all(odd, none).count() == odd.count() and toxicity.score_all(empty, labels).count() == 0
    nulls = spark.createDataFrame([(1, None, None), (None, 1, 1), (2, 1, 0), (2, 1, 1)], "doc_id long, quality int, toxic int")
    assert toxicity.score_all(odd, nulls).count() == odd.count()
    assert toxicity.reject(odd, none).columns == odd.columns and toxicity.reject(odd, none).where("doc_id = 19").count() == 0
    assert toxicity.reject(odd, none).count() == odd.count() - 1


def test_grammar_composes_patterns():
    g = toxicity.seeded(stems={"lowei": 0.9})
    kinds = lambda t: [k for c in g.matches(t) for k, _ in c]
    assert kinds("you are a moron") == ["targeted"] and kinds("a moron sees you") == ["targeted"] and kinds("what a moron") == ["plain"]
    assert kinds("he is not a moron") == ["negated"] and kinds("they said: x. they said moron") == ["reported"]
    assert kinds("a moron, an idiot") == ["stacked", "stacked"] and kinds("a moron or some such kind of idiot") == ["plain", "plain"]
    assert g.score("the circus clown smiled") < 0.7 and g.score("trash day is tuesday") < 0.7 and g.score("you clown") >= 0.7 and g.score("i will hurt you") >= 0.7
    assert kinds("i will kill you") == ["threat"] and kinds("kill the lights") == [] and kinds("moronic") == [] and kinds("loweischaft!") == ["plain"]
    assert g.score("he is not a moron") < g.score("you moron") and g.score("you moron. you idiot") > g.score("you moron")


def test_grammar_against_definitions():
    """Every pattern by looking at all words around a match."""
    g, rng, reach = toxicity.seeded(stems={"lowei": 0.9}), random.Random(4), toxicity.REACH
    pool = ["moron", "idiot", "loweixx", "kill", "you", "not", "said", "will"] + ["word"] * 6

    def brute_kinds(words):
        insult = [w in ("moron", "idiot", "loweixx") for w in words]
        for i, w in enumerate(words):
            before, around = words[max(0, i - reach) : i], words[max(0, i - reach) : i] + words[i + 1 : i + 1 + reach]
            if insult[i] or (w == "kill" and "will" in before):
                beside = any(insult[j] for j in range(max(0, i - reach), min(len(words), i + reach + 1)) if j != i)
                yield "negated" if "not" in before else "reported" if "said" in words[:i] else "threat" if not insult[i] else "targeted" if "you" in around else "stacked" if beside else "plain"

    for _ in range(3000):
        words = [rng.choice(pool) for _ in range(rng.randrange(14))]
        assert [k for k, _ in g.clause(words)] == list(brute_kinds(words))
    text = "A moron. You idiot! Someone said moron; kill it"
    score = 1 - (1 - 0.9 * 0.5) * (1 - 0.9) * (1 - 0.9 * 0.45)
    assert g.score(text) == pytest.approx(score)


def test_secrets(small, odd, empty):
    for df in (small, unique(odd)):
        want = {(i, *brute.secrets(t)[:4]) for i, t in pairs(df)}
        found = secrets.scan(df)
        assert set(rows(found, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) == want
        spans = dict(rows(found, "doc_id", "spans"))
        assert all(set(brute.secrets(t)[4]) <= set(filter(None, spans[i].split(","))) for i, t in pairs(df))
    assert secrets.scan(odd).count() == odd.count() and secrets.scan(empty).count() == 0
    assert dict(rows(secrets.scan(odd), "doc_id", "spans"))[16] == "vendor:0:26,vendor:31:48"


def test_copied_candidates_are_not_added(spark):
    text = "see ghp_abcdefghij0123456789AB"
    df = spark.createDataFrame([(i, text, f"s{i}") for i in range(5)] + [(9, "ghp_zzzzzzzzzz0123456789AB", "s1")], "doc_id long, text string, source string")
    assert {i: s for i, s in rows(secrets.scan(df), "doc_id", "spans") if s} == {9: "vendor:0:26"}


def test_copied_within_one_owner_and_late_classes(spark):
    """One owner's token in many repositories is an example; repeated rows are one repository; long runs are tested to their end."""
    text, live, late = "see ghp_abcdefghij0123456789AB", "ghp_zzzzzzzzzz0123456789AB", "z" * 120 + "B1"
    data = [(i, text, "s") for i in range(30)] + [(99, live, "s")] * 30 + [(100, late, "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    assert {i: s for i, s in rows(secrets.scan(df), "doc_id", "spans") if s} == {99: "vendor:0:26", 100: "mixed:0:122"}


def test_simhash(small, odd, empty):
    for df in (small, unique(odd)):
        prints = {i: brute.fingerprint(t) for i, t in pairs(df)}
        want = brute.components(prints)
        assert set(rows(simhash.groups(df), "doc_id", "fingerprint", "component_id")) == {(i, f"{p:016x}", want[i]) for i, p in prints.items()}
    assert simhash.groups(odd).count() == odd.count() and simhash.groups(empty).count() == 0


@pytest.mark.parametrize(("radius", "listed"), [(4, 4096), (4, 3), (3, 2)])
def test_links_connect_every_close_pair(spark, radius, listed):
    rng = random.Random(radius)
    near_ = {0, 2**63, 2**64 - 1}
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            x ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, radius + 2)))
            near_.add(x)
    prints = {x: x for x in near_}
    nodes = spark.createDataFrame([(x - 2**64 if x >> 63 else x,) for x in near_], "fp long")
    edges = simhash.links(nodes, radius, listed)
    assert edges.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) > radius).count() == 0
    root = dict(rows(simhash.components(edges), "node", "root"))
    want = brute.components(prints, radius)
    one = {x: root.get(x - 2**64 if x >> 63 else x, x - 2**64 if x >> 63 else x) for x in near_}
    assert len({(want[x], one[x]) for x in near_}) == len(set(want.values())) == len(set(one.values()))


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i + 1, i) for i in range(100)] + [(205, 200), (207, 205)], "a long, b long")
    assert dict(rows(simhash.components(edges), "node", "root")) == {i: 0 for i in range(1, 101)} | {205: 200, 207: 200}


def test_token_files(small, odd, empty):
    from tokenizers import Tokenizer

    path = tokenizer_path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    for df in (small, unique(odd)):
        assert set(rows(tokens.positions(df, path), "doc_id", "start", "n_tokens", "ids_crc32")) == brute.tokens(pairs(df), library)
    assert tokens.positions(odd, path).count() == odd.count() and tokens.positions(empty, path).count() == 0


SPECIAL = ["<|EndOfText|>", "a <|ENDOFTEXT|> b", "x<|endoftext|>y <|startoftext|>", "<|STARTOFTEXT|> The <|endoftext|>", "<|endof text|>", "H\u0331 T\u0308 W\u030a Y\u030a J\u030c \u212a \u0130I", "\u1e96 \u0391\u03a3 \u00c9t\u00e9 A\u030a", "it's WE'LL\u3000x\u00a0y\u2028z \x1c\x85", "don't STOP!!! 12,5 \U0001f600\ufe0f"]


def test_ids_equal_the_library(spark):
    from pathlib import Path

    import pyarrow as pa
    from tokenizers import Tokenizer

    rng = random.Random(9)
    texts = [*SPECIAL, None, "", " "] + ["".join(rng.choice("aAhHéÉ\u0331\u0308 '\n<|>eEnNdDoOfFtTxX.9") for _ in range(40)) for _ in range(300)]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        spec = Path(tokenizer_path(name)).read_text(encoding="utf-8")
        library, encoder = Tokenizer.from_str(spec), tokens.Encoder(spec)
        ids, ends = encoder.texts(pa.array(texts))
        assert [p.tolist() for p in np.split(ids, ends[:-1])] == [library.encode(t or "", add_special_tokens=False).ids for t in texts]
    path = tokenizer_path("word_bpe_49k.json")
    df = spark.createDataFrame(list(enumerate(SPECIAL)), "doc_id long, text string")
    assert set(rows(tokens.positions(df, path), "doc_id", "start", "n_tokens", "ids_crc32")) == brute.tokens(pairs(df), Tokenizer.from_file(path))


def test_lookup_opens_only_the_frames_asked_for(spark, small, monkeypatch):
    from tokenizers import Tokenizer

    from weftline.llm.common import new_path

    path, where = tokenizer_path("word_bpe_49k.json"), new_path(spark, "lookup")
    tokens.write(small, path, where)
    library, texts = Tokenizer.from_file(path), dict(pairs(small))
    wanted = spark.createDataFrame([(3,), (77,), (150,), (150,), (999_999,), (None,)], "doc_id long")
    assert dict(rows(tokens.lookup(spark, where, wanted), "doc_id", "ids")) == {i: [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2] for i in (3, 77, 150)}
    assert tokens.lookup(spark, where, wanted.where("doc_id = 999999")).count() == 0


def test_file_reads_single_documents_and_finds_damage(monkeypatch):
    monkeypatch.setattr(tokens, "FRAME", 64)
    maker, docs = tokens.FileMaker(), [np.arange(n, dtype=np.uint32) for n in (0, 3, 5, 100, 1)]
    for i, ids in enumerate(docs):
        maker.add(i if i else None, ids)
    data = maker.done() + tokens.MAGIC
    reader = tokens.FileReader(data)
    assert [reader.document(i) for i in (4, 0, 3, 1, 2)] == [docs[i].tobytes() for i in (4, 0, 3, 1, 2)]
    import zstandard

    assert zstandard.ZstdDecompressor().decompressobj().decompress(data[: int(reader.starts[1])]) == reader.frame(0)
    broken = bytearray(data)
    broken[int(reader.starts[1]) - 1] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        tokens.FileReader(bytes(broken)).frame(0)


def test_language(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language.identify(docs).join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in found) >= 0.98 * len(found)
    found = {r["doc_id"]: r for r in language.identify(odd).collect()}
    assert [found[i]["lang_pred"] for i in (4, 5, 6, 18)] == ["und"] * 4 and found[7]["lang_pred"] == "en"
    assert language.identify(odd).count() == odd.count() and language.identify(empty).count() == 0
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in language.identify(unlabelled).collect()} == {"und"}


def test_language_of_long_runs(spark):
    """Languages whose training runs all exceed 40 letters are learnt, and a run is scored to its end."""
    rng = random.Random(6)
    run = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    data = [(2 * i + k, run("あいうえお" if k else "กขคงจ", 60), "ja" if k else "th") for i in range(60) for k in (0, 1)]
    model = language.fit(spark.createDataFrame(data, "doc_id long, text string, lang string"), F.lit(True))
    assert model["langs"] == ["ja", "th"] and all({x for k in model["grams"][n][0] for x in k} >= set("あกจ") for n in language.GRAMS)
    docs = [(1, run("กขคงจ", 100)), (2, run("あいうえお", 100)), (3, run("あいうえお", 250) + run("กขคงจ", 900)), (4, run("กขคงจ", 250) + run("あいうえお", 900))]
    found = dict(rows(language.predict(spark.createDataFrame(docs, "doc_id long, text string"), model), "doc_id", "lang_pred"))
    assert found == {1: "th", 2: "ja", 3: "th", 4: "ja"}
    assert language.Scorer(model).chunks([docs[2][1]])[1][0] == 115


def test_language_scores_by_definition(spark):
    """Posteriors of short texts by counting words and n-grams in plain Python."""
    import math

    train = [(1, "the cat the dog", "en"), (2, "der hund die katze der", "de"), (3, "a cat", "en")]
    model = language.fit(spark.createDataFrame(train, "doc_id long, text string, lang string"), F.lit(True))
    langs = ["de", "en"]
    words = {x: Counter(w for _, t, lang in train if lang == x for w in t.split()) for x in langs}
    grams = {n: {x: Counter() for x in langs} for n in language.GRAMS}
    for x in langs:
        for w, c in words[x].items():
            p = f" {w} "
            for n in language.GRAMS:
                for i in range(max(1, len(p) - n + 1)):
                    grams[n][x][p[i : i + n]] += c

    def log(table, key, x):
        keys = set().union(*table.values())
        return math.log(table[x][key] + 0.5) - math.log(sum(table[x].values()) + 0.5 * len(keys) + 1)

    def score(text, x):
        total = 0.0
        for w in text.split():
            if any(w in words[y] for y in langs):
                total += log(words, w, x)
                continue
            p = f" {w} "
            for n in language.GRAMS:
                own = [p[i : i + n] for i in range(max(1, len(p) - n + 1))]
                hits = [g for g in own if any(g in grams[n][y] for y in langs)]
                if hits and 2 * len(hits) >= len(own):
                    total += sum(log(grams[n], g, x) for g in hits) / len(hits)
                    break
        return total

    texts = ["the cat", "der", "cats", "hunde", "katzen dogs", "zzz", "thedog der", "xyzw cat"]
    found = dict(rows(language.predict(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), model).selectExpr("doc_id", "struct(lang_pred, score) AS x"), "doc_id", "x"))
    for i, t in enumerate(texts):
        s = [score(t, x) for x in langs]
        best = s.index(max(s))
        assert found[i]["lang_pred"] == langs[best] and found[i]["score"] == pytest.approx(1 / sum(math.exp(v - s[best]) for v in s), abs=1e-4)


def test_pieces_round_trip(small, odd, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    for df in (small, odd):
        found = pieces.encode(df, path).collect()
        assert len(found) == df.count() and all(r["lossless"] for r in found)
    assert pieces.encode(odd, path).columns[:3] == ["doc_id", "lang", "source"] and pieces.encode(empty, path).count() == 0
    again = pieces.encode(small.repartition(7), path)
    assert dict(rows(again, "doc_id", "ids_crc32")) == dict(rows(pieces.encode(small, path), "doc_id", "ids_crc32"))


def test_pieces_follow_the_posterior():
    import math

    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    v, model = pieces.vocabulary(path), sentencepiece.SentencePieceProcessor(model_file=path)
    table = dict(zip(v["pieces"], v["weights"], strict=True))

    def ways(x):
        if not x:
            yield (), 0.0
        for n in range(1, len(x) + 1):
            if x[:n] in table:
                for rest, w in ways(x[n:]):
                    yield (x[:n], *rest), w + table[x[:n]]

    weights = {p: math.exp(w) for p, w in ways("▁there")}
    n = 20_000
    ids, stops = pieces.Sampler(v, 1.0, 1).texts(["there"] * n, list(range(n)))
    got = Counter(tuple(model.id_to_piece(int(i)) for i in ids[a:b]) for a, b in zip(np.concatenate([[0], stops]), stops, strict=False))
    assert all(abs(got[p] / n - w / sum(weights.values())) < 0.015 for p, w in weights.items())
    best, stops = pieces.Sampler(v, float("inf"), 1).texts(["there"], [0])
    assert tuple(model.id_to_piece(int(i)) for i in best) == max(weights, key=weights.get)


def test_near_duplicates(spark, odd, empty):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    texts = dict(pairs(docs))
    spoken = {i: t for i, t in texts.items() if t and t.split()}
    kept = {i for i, _ in pairs(near.keep_one(docs))}
    ids = sorted(spoken)
    root = {i: i for i in ids}

    def find(i):
        return i if root[i] == i else find(root[i])

    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if brute.jaccard(spoken[a], spoken[b]) >= 0.8:
                p, q = sorted((find(a), find(b)))
                root[q] = p
    assert kept == {i for i in texts if find(i) == i or i not in spoken} if len(spoken) == len(texts) else kept >= {i for i in ids if find(i) == i}
    assert near.keep_one(odd).columns == odd.columns and near.keep_one(empty).count() == 0
    assert {4, 5, 6, 7} <= {i for i, _ in pairs(near.keep_one(odd))} and 8 not in {i for i, _ in pairs(near.keep_one(odd))}


def test_near_duplicates_of_a_family(spark):
    """Every pair of edited copies that shares a band at the similarity is in one group."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9999)}" for _ in range(150)]
    texts = {}
    for i in range(400):
        words = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            words[at] = f"e{i}x{at}"
        texts[i] = " ".join(words)
    found = dict(rows(near.groups(spark.createDataFrame(list(texts.items()), "doc_id long, text string")), "doc_id", "group_id"))
    sets = {i: near.shingles(t, 5) for i, t in texts.items()}
    keys = {i: near.bands(x) for i, x in sets.items()}
    linked = 0
    for i in texts:
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if (keys[i] == keys[j]).any() and both >= 0.8 * (len(sets[i]) + len(sets[j]) - both):
                linked += 1
                assert found.get(i, i) == found.get(j, j)
    assert linked > 1000


def test_many_secrets_in_one_text(spark):
    rng = random.Random(12)
    text = "é".join("".join(rng.choice("0123456789abcdef") for _ in range(rng.randrange(20, 40))) for _ in range(3000))
    found = secrets.scan(spark.createDataFrame([(1, text, "s")], "doc_id long, text string, source string")).first()
    assert (found["n_assign"], found["n_access"], found["n_hex"], found["base_sha256"]) == brute.secrets(text)[:4]


def test_schedules_weigh_in(spark, small):
    """A schedule of three times the integral triples its sources' weight."""
    flat, high = ((0.0, 1.0), (1.0, 1.0)), ((0.0, 3.0), (1.0, 3.0))
    docs = rows(small, "doc_id", "text", "source")
    found = {r["doc_id"]: r["target"] for r in mixing.mix(small, weights=(1, 1), schedules=(high, flat)).collect()}
    want = brute.mix_targets(docs, weights=(3, 1))
    assert all(found[i] == pytest.approx(want[s][1]) for i, _, s in docs)


def test_batch_larger_than_the_snapshot(small):
    columns = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")
    for part in (F.col("doc_id") < 3, F.lit(False), F.lit(True)):
        assert set(rows(exact.dedup(small, in_snapshot=part, shard_keys=20), *columns)) == brute.exact(pairs(small))


def test_clashing_names(spark, odd):
    """Columns named as the operators' own helpers are kept."""
    names = ["__id", "__digest", "__kept", "__mix", "__row", "size", "words", "bucket", "copy", "alive", "fp"]
    wide = odd.select("*", *[F.lit("mine").alias(n) for n in names])
    none = spark.createDataFrame([], "doc_id long, toxic int")
    for found in (exact.keep_first(wide), near.keep_one(wide), substrings.clean(wide), mixing.apply(wide), toxicity.reject(wide, none)):
        assert found.columns == wide.columns and {r["__id"] for r in found.collect()} == {"mine"}
    assert {"__id", "size"} <= set(pieces.encode(wide, tokenizer_path("piece_bpe_32k.model")).columns)
    for found in (exact.dedup(wide), substrings.dedup(wide), mixing.mix(wide), secrets.scan(wide), simhash.groups(wide), language.identify(wide)):
        assert found.count() == wide.count()


def test_near_duplicates_of_templates(spark):
    """Families of one template: variants too far apart to link, each with a near copy; kept ids equal those of all pairs."""
    rng = random.Random(21)
    texts: dict[int, str] = {}
    for family in range(2):
        base = [f"t{family}w{k}" for k in range(300)]
        for _ in range(300):
            words = list(base)
            for at in rng.sample(range(300), rng.randrange(8, 20)):
                words[at] = f"v{rng.randrange(10**6)}"
            copy = list(words)
            for at in rng.sample(range(300), 5):
                copy[at] = f"c{rng.randrange(10**6)}"
            for x in (words, copy):
                texts[len(texts)] = " ".join(x)
    sets = [near.shingles(texts[i], 5) for i in texts]
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = counts[at] > 1
    held = np.zeros((len(sets), int((counts > 1).sum())), np.float32)
    held[owner[shared], (np.cumsum(counts > 1) - 1)[at[shared]]] = 1
    both, size = held @ held.T, np.array([len(x) for x in sets])
    root = list(range(len(sets)))

    def find(i):
        return i if root[i] == i else find(root[i])

    linked = np.argwhere(np.triu(both >= 0.8 * (size[:, None] + size[None, :] - both), 1))
    for i, j in linked.tolist():
        p, q = sorted((find(i), find(j)))
        root[q] = p
    assert len(linked) > 500
    kept = {r["doc_id"] for r in near.keep_one(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert kept == {i for i in texts if find(i) == i}


def test_pieces_of_several_words_by_enumeration():
    """Samples of a text with a literal word mark and a character without a piece against all segmentations of its words."""
    import math

    v = pieces.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    table = {p: (i, w) for p, i, w in zip(v["pieces"], v["ids"], v["weights"], strict=True)}
    least = min(v["weights"]) - 5.0
    spelt = lambda c: tuple(v["bytes"][b] for b in ("▁" if c == "\ud800" else c).encode())

    def ways(x):
        if not x:
            yield (), 0.0
        for n in range(1, len(x) + 1):
            if x[:n] in table:
                edge = ((table[x[:n]][0],), table[x[:n]][1])
            elif n == 1:
                edge = (spelt(x[0]), least)
            else:
                continue
            for rest, w in ways(x[n:]):
                yield edge[0] + rest, w + edge[1]

    text, n = "so▁ \U0001f9ffto", 20_000
    want = Counter({(): 1.0})
    for word in text.replace("▁", "\ud800").split(" "):
        found = Counter()
        for ids, w in ways("▁" + word):
            found[ids] += math.exp(w)
        total = sum(found.values())
        want = Counter({a + b: p * q / total for a, p in want.items() for b, q in found.items()})
    ids, stops = pieces.Sampler(v, 1.0, 3).texts([text] * n, list(range(n)))
    got = Counter(tuple(ids[a:b].tolist()) for a, b in zip(np.concatenate([[0], stops]), stops, strict=False))
    assert set(got) <= set(want) and all(abs(got[k] / n - p) < 0.015 for k, p in want.items())
    assert pieces.Decoder(v).text(ids[: stops[0]]).decode() == text
