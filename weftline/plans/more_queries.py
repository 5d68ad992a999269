"""Named queries of sources, sinks, archives, streams, text functions and small operators; what is written is read again."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import archives, joins, metrics, ngrams, relational, sampling, sentiment, sinks, text
from weftline.plans.catalog import query, table
from weftline.plans.core_queries import _COUNTS, _r, _tokens
from weftline.plans.tables import new_path
from weftline.sources import documents, readers
from weftline.streaming import windows as streams

# Sinks and sources.


@query("s01_load_csv", "SELECT c_custkey AS k, c_acctbal, 'csv' AS origin FROM customer WHERE c_acctbal > 0")
def s01(spark, d):
    path = new_path(spark, "csv")
    sinks.save_dataframe(table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal"), path, "csv")
    return readers.load_dataframe(spark, path, "csv", columns=["c_custkey", "c_acctbal"], dtype={"c_custkey": "long", "c_acctbal": "double"}, rename={"c_custkey": "k"}, query="c_acctbal > 0", constants={"origin": "csv"})


@query("p39_p40_save_load", "SELECT o_orderkey, o_orderstatus FROM orders")
def p39(spark, d):
    path = new_path(spark, "orders")
    sinks.save_dataframe(table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), path, partition_by=["o_orderstatus"])
    return readers.load_dataframe(spark, path, "parquet", columns=["o_orderkey", "o_orderstatus"])


@query("p42_save_as_json", "SELECT doc_id, md5(text) AS h FROM documents")
def p42(spark, d):
    path = new_path(spark, "json")
    sinks.save_as_json(table(spark, d, "documents").select("doc_id", "text"), path)
    return readers.load_dataframe(spark, path, "json").select("doc_id", F.md5("text").alias("h"))


@query("p34_save_as_text", "SELECT p_name AS value, count(*) AS n FROM part WHERE p_name IS NOT NULL GROUP BY 1")
def p34(spark, d):
    path = new_path(spark, "text")
    sinks.save_as_text(table(spark, d, "part"), path, "p_name")
    return spark.read.text(path).groupBy("value").agg(F.count(F.lit(1)).alias("n"))


@query("p38_save_metadata", "SELECT m.doc_id, m.lang, m.source, strlen(t.text) AS bytes FROM documents m JOIN documents t USING (doc_id)")
def p38(spark, d):
    path = new_path(spark, "metadata")
    texts = sinks.save_metadata(table(spark, d, "documents"), path, ["doc_id", "lang", "source"], ["doc_id", "text"])
    return joins.merge_metadata(readers.load_dataframe(spark, path), texts.select("doc_id", F.octet_length("text").alias("bytes")), "doc_id")


@query("k04_save_splits", """WITH r AS (SELECT c_custkey, row_number() OVER (ORDER BY md5('1|' || cast(c_custkey AS VARCHAR)), c_custkey) - 1 AS rk, count(*) OVER () AS n FROM customer)
    SELECT c_custkey, CASE WHEN rk < ceil(n * 0.1) THEN 'test' ELSE 'train' END AS split FROM r""")
def k04(spark, d):
    path = new_path(spark, "splits")
    sinks.save_splits(sampling.split_sampling(table(spark, d, "customer").select("c_custkey"), "c_custkey", 0.1), path)
    return readers.load_dataframe(spark, path, "parquet", columns=["c_custkey", "split"])


@query("k05_save_shards", """WITH r AS (SELECT p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS rk, count(*) OVER () AS n FROM part)
    SELECT CAST(floor(rk / ceil(n / 4)) AS INTEGER) AS shard, p_name AS value, count(*) AS n FROM r GROUP BY 1, 2""")
def k05(spark, d):
    path = new_path(spark, "shards")
    sinks.save_shards(table(spark, d, "part").select("p_partkey", "p_name"), path, 4, "p_partkey", "p_name")
    return spark.read.text(path).groupBy("shard", "value").agg(F.count(F.lit(1)).alias("n"))


@query("k06_save_chunks", "SELECT p_name AS value, count(*) AS n, true AS small FROM part WHERE p_name IS NOT NULL GROUP BY 1")
def k06(spark, d):
    path = new_path(spark, "chunks")
    archives.save_chunks(table(spark, d, "part"), path, 300, "p_partkey", "p_name")
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"))
    sizes = rows.groupBy("file").agg((F.count(F.lit(1)) <= 300).alias("small"))
    return rows.join(sizes, "file").groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.bool_and("small").alias("small"))


def _archived(name: str, kind: str, parser: str):
    @query(name, "SELECT md5(text) AS h, count(*) AS n FROM documents WHERE text IS NOT NULL GROUP BY 1")
    def run(spark, d):
        path = new_path(spark, kind)
        archives.save_archive(table(spark, d, "documents").select("doc_id", "text"), path, kind)
        back = readers.load_archives(spark, path, parser, suffix=f".{kind}.zst")
        return back.groupBy(F.md5("text").alias("h")).agg(F.count(F.lit(1)).alias("n"))

    return run


_archived("k01_jsonl_archive", "jsonl", "jsonlines")
_archived("k02_dat_archive", "dat", "dat")
_archived("k03_json_archive", "json", "json")


@query("s09_load_lines", "SELECT r_regionkey AS lineno, r_name AS text FROM region ORDER BY r_regionkey LIMIT 3 OFFSET 1")
def s09(spark, d):
    path = new_path(spark, "lines")
    sinks.save_as_text(table(spark, d, "region").coalesce(1), path, "r_name", order_by="r_regionkey")
    return documents.load_lines(spark, path, 1, 4).select("lineno", "text")


@query("s09_parallel_texts", "SELECT r_regionkey AS lineno, r_name AS source, lower(r_name) AS target FROM region")
def s09b(spark, d):
    one, two = new_path(spark, "source"), new_path(spark, "target")
    rows = table(spark, d, "region").select("r_regionkey", "r_name", F.lower("r_name").alias("low")).coalesce(1)
    sinks.save_as_text(rows, one, "r_name", order_by="r_regionkey")
    sinks.save_as_text(rows, two, "low", order_by="r_regionkey")
    return documents.parallel_texts(spark, one, two)


@query("s08_load_wordlist", "SELECT DISTINCT lower(str_split(p_name, ' ')[1]) AS word FROM part")
def s08(spark, d):
    path = new_path(spark, "words")
    lines = table(spark, d, "part").select(F.concat("p_name", F.lit(" # a comment")).alias("line"))
    sinks.save_as_text(lines, path, "line")
    return readers.load_wordlist(spark, path, lowercase=True)


@query("s21_plaintext_lines", r"SELECT doc_id, i - 1 AS lineno, md5(parts[i]) AS h FROM (SELECT doc_id, str_split_regex(text, '\r?\n') AS parts, unnest(range(1, len(str_split_regex(text, '\r?\n')) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def s21(spark, d):
    rows = readers.plaintext(table(spark, d, "documents").select("doc_id", "text"), "text", by_line=True)
    return rows.select("doc_id", F.col("lineno").cast("long").alias("lineno"), F.md5("text").alias("h"))


@query("s34_s35_annotations", "SELECT doc_id AS id, cast(toxic AS VARCHAR) AS label FROM labels WHERE toxic IS NOT NULL")
def s34(spark, d):
    path = new_path(spark, "tasks")
    tasks = readers.nested_annotations(table(spark, d, "labels").where("toxic is not null").withColumn("text", F.lit("t")), "doc_id", "text", "toxic")
    sinks.save_as_text(tasks, path, "value")
    schema = "id long, data struct<text string>, predictions array<struct<completed_by long, result array<struct<value struct<choices array<string>>>>>>"
    back = spark.read.schema(schema).json(path)
    return readers.annotations(back, "predictions").select("id", "label")


# Streams: all that is there, once. A pattern names the table, as a stream takes a folder or a pattern but no single file.


def _drained(spark, stream, name: str, mode: str = "append"):
    path = new_path(spark, name)
    streams.drain(stream, path, new_path(spark, f"{name}-progress"), mode)
    return spark.read.schema(stream.schema).parquet(path)


def _events(spark, d):
    return streams.ingest(spark, f"{d}/[e]vents.parquet", table(spark, d, "events").schema)


@query("r01_stream_ingest", "SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase'")
def r01(spark, d):
    return _drained(spark, _events(spark, d).where("event_type = 'purchase'").select("event_id", "user_id", "value"), "ingested")


@query("r02_stream_text", r"""SELECT doc_id, md5(list_aggregate(list_filter(str_split_regex(lower(text), '\s+'), lambda w: w <> ''), 'string_agg', ' ')) AS h FROM documents WHERE strlen(text) BETWEEN 100 AND 5000""")
def r02(spark, d):
    docs = streams.ingest(spark, f"{d}/[d]ocuments.parquet", table(spark, d, "documents").schema)
    kept = relational.filter_length(docs.select("doc_id", "text"), "text", 100, 5000)
    return _drained(spark, kept.select("doc_id", F.md5(F.array_join(T.words(F.lower("text")), " ")).alias("h")), "texts")


_CLOSED = "(SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"


@query("r03_stream_tumbling", f"SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 10 MINUTE, ts) + INTERVAL 10 MINUTE <= {_CLOSED}")
def r03(spark, d):
    out = _drained(spark, streams.windowed_counts(_events(spark, d), "ts", "event_type"), "tumbling")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("r03_stream_sliding", f"""WITH w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - INTERVAL 5 MINUTE * k AS start, event_type FROM events, (VALUES (0), (1)) AS v(k))
    SELECT start, event_type, count(*) AS n FROM w GROUP BY 1, 2 HAVING start + INTERVAL 10 MINUTE <= {_CLOSED}""")
def r03b(spark, d):
    out = _drained(spark, streams.windowed_counts(_events(spark, d), "ts", "event_type", slide="5 minutes"), "sliding")
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("r03_stream_sessions", f"""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k HAVING max(ts) + INTERVAL 30 MINUTE <= {_CLOSED}""")
def r03c(spark, d):
    out = _drained(spark, streams.sessions(_events(spark, d), "ts", "user_id"), "sessions")
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("r04_stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def r04(spark, d):
    return _drained(spark, streams.deduplicated(_events(spark, d), "ts", ["user_id", "event_type"], "3650 days").select("user_id", "event_type"), "once")


# Text functions.

_PROBE = "a\x01\x08\x0e\x10\x1bb‐‑⁃‒–—―−－⁻­₋c‘’‚‛՚Ꞌꞌ＇`´′‵“”„‟″‶‴‷⁗«d⁄∕／e˜⁓∼∽∿〜～f\x0b\x0c\x85g"


def _sql_chars(chars: str) -> str:
    return "concat(" + ", ".join(f"chr({ord(c)})" for c in chars) + ")"


_PROBE_SQL = f"concat(coalesce(lang, ''), {_sql_chars(_PROBE)})"


@query("t02_t09_characters", f"""WITH p AS (SELECT doc_id, {_PROBE_SQL} AS c FROM documents)
    SELECT doc_id, md5(translate(c, {_sql_chars(chr(1) + chr(8) + chr(14) + chr(27))}, '')) AS control,
    md5(replace(translate(c, {_sql_chars("‐‑⁃‒–—―−－⁻")}, '----------'), chr(173), '')) AS hyphens,
    md5(replace(replace(replace(replace(replace(translate(translate(c, {_sql_chars("‘’‚‛՚Ꞌꞌ＇`´′‵")}, repeat(chr(39), 12)), {_sql_chars("“”„‟")}, repeat(chr(34), 4)), '″', repeat(chr(39), 2)), '‶', repeat(chr(39), 2)), '‴', repeat(chr(39), 3)), '‷', repeat(chr(39), 3)), '⁗', repeat(chr(39), 4))) AS quotes,
    md5(translate(c, {_sql_chars("⁄∕")}, '//')) AS slashes, md5(translate(c, {_sql_chars("˜⁓∼∽∿〜～")}, '~~~~~~~')) AS tildes,
    md5(translate(c, {_sql_chars(chr(11) + chr(12) + chr(133))}, '   ')) AS spaces FROM p""")
def t02(spark, d):
    c = F.concat(F.coalesce("lang", F.lit("")), F.lit(_PROBE))
    steps = {"control": T.remove_control_chars, "hyphens": T.fix_hyphens, "quotes": T.uncurl_quotes, "slashes": T.fix_slashes, "tildes": T.fix_tildes, "spaces": T.fix_whitespaces}
    return table(spark, d, "documents").select("doc_id", *[F.md5(f(c)).alias(n) for n, f in steps.items()])


@query("t16_is_punct", r"SELECT w, count(*) AS n FROM (SELECT unnest(str_split_regex(text, '\s+')) AS w FROM documents) WHERE regexp_full_match(w, '\pP*') GROUP BY w")
def t16(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    return w.where(T.is_punct(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("t17_like_url", r"""WITH w AS (SELECT url AS w FROM pages UNION ALL SELECT unnest(str_split_regex(text, '\s+')) FROM documents)
    SELECT w, count(*) AS n FROM w WHERE (regexp_matches(w, '^(https?://|www\.)') AND strpos(w, '://') + 2 < length(w)) OR (regexp_matches(w, '\.(com|org|edu|gov|net|mil|int|info|io|co|kr|de|fr|es|uk|us|jp|cn|eu)$') AND strpos(w, '@') = 0 AND strpos(w, '/') = 0 AND w NOT LIKE '.__' AND w NOT LIKE '.___' AND w NOT LIKE '.____') GROUP BY w""")
def t17(spark, d):
    w = table(spark, d, "pages").select(F.col("url").alias("w")).unionAll(table(spark, d, "documents").select(F.explode(F.split("text", r"\s+"))))
    return w.where(T.like_url(F.col("w"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("t19_word_shape", r"""WITH w AS (SELECT unnest(str_split_regex(text, '[^a-zA-Z0-9]+')) AS w FROM documents), s AS (SELECT w, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(w, '[A-Z]', chr(1), 'g'), '[a-z]', 'x', 'g'), '[0-9]', 'd', 'g'), chr(1), 'X', 'g'), 'X{5,}', 'XXXX', 'g'), 'x{5,}', 'xxxx', 'g') AS s FROM w)
    SELECT CASE WHEN length(w) >= 100 THEN 'LONG' ELSE regexp_replace(s, 'd{5,}', 'dddd', 'g') END AS shape, count(*) AS n FROM s GROUP BY 1""")
def t19(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\P{Alnum}+")).alias("w"))  # ASCII letters and digits, one table look-up each
    # A word's shape is made once; the number of parts is given, as few bytes of words are much work.
    counted = w.groupBy("w").agg(F.count(F.lit(1)).alias("n")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "w")
    return counted.groupBy(T.word_shape(F.col("w")).alias("shape")).agg(F.sum("n").alias("n"))


@query("t29_more_lengths", r"SELECT doc_id, len(list_filter(str_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS len_segments, strlen(regexp_replace(text, '\s', '', 'g')) AS len_wospc FROM documents")
def t29(spark, d):
    return table(spark, d, "documents").select("doc_id", *[T.LENGTHS[n](F.col("text")).cast("long").alias(n) for n in ("len_segments", "len_wospc")])


@query("t30_human_bytes", "SELECT doc_id, CASE WHEN strlen(text) >= 1024 THEN printf('%.2f KiB', strlen(text) / 1024) ELSE strlen(text) || ' bytes' END AS human FROM documents WHERE strlen(text) < 1048576")
def t30(spark, d):
    n = F.octet_length("text").cast("long")
    return table(spark, d, "documents").where(n < 1048576).select("doc_id", T.human_bytes(n).alias("human"))


@query("t31_speaker", r"SELECT c_custkey, CASE WHEN c_custkey < 700 THEN 'MR. ' || upper(c_mktsegment) END AS speaker FROM customer")
def t31(spark, d):
    said = F.when(F.col("c_custkey") < 700, F.concat(F.lit(" MR. "), F.upper("c_mktsegment"), F.lit(". Well, yes."))).otherwise(F.concat(F.lit("Mr. "), F.col("c_name")))
    return text.speaker(table(spark, d, "customer").withColumn("text", said)).select("c_custkey", "speaker")


@query("t32_bio_labels", """WITH t AS (SELECT conv_id, turn, role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM conversations)
    SELECT conv_id, string_agg(CASE WHEN role = 'user' THEN 'O' WHEN role IS NOT DISTINCT FROM before THEN 'I-' || role ELSE 'B-' || role END, ' ' ORDER BY turn) AS labels FROM t GROUP BY conv_id""")
def t32(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.when(F.col("role") != "user", F.col("role")).alias("role"))))
    rows = table(spark, d, "conversations").groupBy("conv_id").agg(F.transform(turns, lambda x: x["role"]).alias("tags"))
    return text.bio_labels(rows, "tags", "tags").select("conv_id", F.array_join("labels", " ").alias("labels"))


@query("t33_replace_sequences", """SELECT p_partkey, replace(replace(' ' || replace(p_name, ' ', '  ') || ' ', ' ' || w[1] || '  ' || w[2] || ' ', ' both '), '  ', ' ') AS joined FROM (SELECT p_partkey, p_name, (SELECT str_split(min(p_name), ' ') FROM part) AS w FROM part)""")
def t33(spark, d):
    first = table(spark, d, "part").agg(F.min("p_name").alias("n")).first()["n"].split(" ")
    rows = table(spark, d, "part").select("p_partkey", F.split("p_name", " ").alias("t"))
    out = text.replace_sequences(rows, "t", {" ".join(first[:2]): "both"})
    return out.select("p_partkey", F.concat(F.lit(" "), F.array_join("t", " "), F.lit(" ")).alias("joined"))


@query("p24_extract_tokens", """SELECT l_orderkey, l_linenumber, trim(CASE WHEN l_returnflag <> 'R' THEN 'ship' ELSE '' END || ' ' || CASE WHEN l_linestatus <> 'R' THEN 'line' ELSE '' END) AS text FROM lineitem""")
def p24(spark, d):
    tagged = F.concat(F.lit("ship/"), F.col("l_returnflag"), F.lit(" line/"), F.col("l_linestatus"))
    return text.extract_tokens(table(spark, d, "lineitem").withColumn("text", tagged), exclude=["R"]).select("l_orderkey", "l_linenumber", "text")


@query("n05_filter_stopwords", r"""SELECT conv_id, turn, array_to_string(list_transform(str_split_regex(text, '\r?\n'), lambda l: array_to_string(list_filter(str_split_regex(l, '\s+'), lambda w: w <> '' AND lower(w) NOT IN ('the', 'a', 'is')), ' ')), chr(10)) AS text FROM conversations""")
def n05(spark, d):
    return text.filter_stopwords(table(spark, d, "conversations").select("conv_id", "turn", "text"), ["the", "a", "is"])


@query("g04_keep_language", "SELECT doc_id FROM documents WHERE lang IS NULL OR lang IN ('en', 'de')")
def g04(spark, d):
    return text.keep_language(table(spark, d, "documents").select("doc_id", "lang"), ["en", "de"]).select("doc_id")


@query("h14_slice_between", "SELECT p_partkey, CASE WHEN strpos(p_name || ' END tail', ' END') > 0 THEN p_name END AS section FROM part WHERE starts_with(p_type, 'STANDARD')")
def h14(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.concat_ws(" ", F.lit("head"), F.when(F.col("p_type").startswith("STANDARD"), F.lit("BEGIN")), "p_name", F.lit("END tail")).alias("text"))
    marks = spark.createDataFrame([("BEGIN ", " END")], "begin string, end string")
    return text.slice_between(rows, marks).select("p_partkey", F.replace("section", F.lit("BEGIN "), F.lit("")).alias("section"))


@query("h12_repeated_sentences", "SELECT o_orderkey, o_orderpriority || chr(10) || o_orderstatus || chr(10) || chr(10) || o_orderpriority AS text FROM orders")
def h12(spark, d):
    lines = F.concat_ws("\n", "o_orderpriority", "o_orderstatus", "o_orderpriority", F.lit(""), "o_orderpriority")
    return text.repeated_sentences(table(spark, d, "orders").select("o_orderkey", lines.alias("text")))


# N-grams, scores, labels.


@query("n10_skipgrams", r"""WITH w AS (SELECT list_filter(str_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS t FROM documents),
    g AS (SELECT unnest(t) AS words, 1 AS length FROM w UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ';' || t[i+1])), 2 FROM w UNION ALL SELECT unnest(list_transform(range(1, len(t) - 1), lambda i: t[i] || ';' || t[i+2])), 2 FROM w)
    SELECT words, length, count(*) AS frequency FROM g GROUP BY words, length HAVING count(*) >= 5""")
def n10(spark, d):
    return ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5, max_skip=1)


@query("n13_npmi", f"""WITH {_COUNTS}, k AS (SELECT sum(frequency)::DOUBLE AS t FROM c) SELECT g.words, round(ln(g.frequency * k.t / (a.frequency::DOUBLE * b.frequency)) / -ln(g.frequency / k.t), 6) AS score
    FROM c g JOIN c a ON a.words = str_split(g.words, ';')[1] JOIN c b ON b.words = str_split(g.words, ';')[2] CROSS JOIN k WHERE g.length = 2""")
def n13(spark, d):
    scores = ngrams.pmi_scores(ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5), normalized=True, combine="top3")
    return scores.select("words", _r(F.col("score")).alias("score"))


@query("n16_n20_export", f"WITH {_COUNTS} SELECT words, frequency FROM c WHERE length = 2 AND frequency > 40")
def n16(spark, d):
    counts = ngrams.prune_vocab(ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5), 20)
    return ngrams.export_ngrams(counts.withColumn("score", F.col("frequency")), 40).select("words", "frequency")


@query("e05_article_scores", """SELECT user_id, count(value) AS num_examples, round(avg(value - 50), 9) AS mean, round(median(value - 50), 9) AS median, round(sum(value - 50), 4) AS "sum",
    round((sum(CASE WHEN value - 50 > 0.1 THEN 1 ELSE 0 END) - sum(CASE WHEN value - 50 < -0.1 THEN 1 ELSE 0 END)) / count(value), 9) AS diffusion FROM events GROUP BY user_id""")
def e05(spark, d):
    out = sentiment.article_scores(table(spark, d, "events").withColumn("polarity", F.col("value") - 50), "user_id")
    return out.select("user_id", "num_examples", *[_r(F.col(c), 9).alias(c) for c in ("mean", "median", "diffusion")], F.round("sum", 4).alias("sum"))


@query("e07_labels", """WITH s AS (SELECT event_type, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END) AS n FROM events GROUP BY 1), r AS (SELECT event_type, (p - n) / (p + n + 1e-6) AS v FROM s)
    SELECT event_type, round(v, 6) AS polarity, CASE WHEN v BETWEEN -1 AND -0.2 THEN 'negative' WHEN v BETWEEN -0.2 AND 0.2 THEN 'neutral' WHEN v BETWEEN 0.2 AND 1 THEN 'positive' END AS label FROM r""")
def e07(spark, d):
    out = sentiment.aggregate_scores(table(spark, d, "events").withColumn("s", F.col("value") - 50), "event_type", "s")
    return out.select("event_type", _r(F.col("polarity")).alias("polarity"), "label")


@query("m08_confusion", "SELECT quality AS truth, toxic AS predicted, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2")
def m08(spark, d):
    return metrics.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("m10_token_f1", """WITH c AS (SELECT conv_id, turn, str_split(text, ' ') AS x, str_split(lead(text) OVER (PARTITION BY conv_id ORDER BY turn), ' ') AS y FROM conversations)
    SELECT conv_id, turn, round(2 * list_sum(list_transform(list_distinct(x), lambda t: least(len(list_filter(x, lambda a: a = t)), len(list_filter(y, lambda b: b = t))))) / (len(x) + len(y)), 6) AS f1 FROM c WHERE x IS NOT NULL AND y IS NOT NULL""")
def m10(spark, d):
    from pyspark.sql import Window

    rows = table(spark, d, "conversations").select("conv_id", "turn", F.split("text", " ").alias("x"), F.split(F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")), " ").alias("y"))
    return rows.where("x is not null and y is not null").select("conv_id", "turn", _r(metrics.token_f1(F.col("x"), F.col("y"))).alias("f1"))


# Helpers.


@query("h02_to_datetime", "SELECT o_orderkey, o_orderdate::TIMESTAMP AS at FROM orders")
def h02(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "dd/MM/yyyy").alias("at"))
    return relational.to_datetime(rows, {"at": "dd/MM/yyyy"}).select("o_orderkey", F.col("at").cast("timestamp_ntz").alias("at"))


@query("h03_h05_h25_ids", "SELECT l_orderkey || '_' || l_linenumber AS id, l_quantity AS quantity, l_tax AS quantity_tax, 'tpch' AS corpus, 'train' AS split FROM lineitem")
def h03(spark, d):
    rows = relational.combine_ids(table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]).select("id", F.col("l_quantity").alias("value"), F.col("l_tax").alias("tax"))
    return relational.append_constant(relational.prefix_values(rows, "quantity", "value", ["tax"]), corpus="tpch", split="train")


@query("j09_lookup", "SELECT o_orderkey, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def j09(spark, d):
    names = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    return joins.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), names, "o_custkey", "c_name").select("o_orderkey", "c_name")


@query("p26_general_function", "SELECT doc_id, CASE WHEN lang = 'en' THEN 'english' ELSE lang END AS lang, n_chars::DOUBLE AS n_chars FROM documents WHERE lang IS NOT NULL AND n_chars IS NOT NULL")
def p26(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang", "n_chars")
    rows = relational.general_function(rows, "dropna", subset=["lang", "n_chars"])
    rows = relational.general_function(rows, "replace", to_replace={"en": "english"}, subset=["lang"])
    return relational.general_function(rows, "astype", types={"n_chars": "double"})


@query("o08_shuffle", "SELECT o_orderkey, row_number() OVER (ORDER BY md5('1|' || cast(o_orderkey AS VARCHAR)), o_orderkey) - 1 AS place FROM orders")
def o08(spark, d):
    path = new_path(spark, "shuffled")
    sampling.shuffle(table(spark, d, "orders").select("o_orderkey"), "o_orderkey").coalesce(1).write.parquet(path)
    back = spark.read.parquet(path).select("o_orderkey", F.monotonically_increasing_id().alias("at"))
    return relational.reset_index(back, "at", "place").select("o_orderkey", "place")


@query("p20_predict", """SELECT doc_id, CASE WHEN len(ws) >= 5 THEN p END AS positive_words FROM (SELECT doc_id, list_filter(str_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws, coalesce(len(list_filter(str_split_regex(lower(text), '\\s+'), lambda w: w IN ('the', 'and'))), 0) AS p FROM documents)""")
def p20(spark, d):
    from weftline.plans.registry import Pipeline

    words = spark.createDataFrame([("the", 1, 0), ("and", 1, 0)], "word string, positive long, negative long")
    model = lambda df: df.join(sentiment.lexicon_features(df, words, "doc_id"), "doc_id")
    steps = [("predict", {"model": model, "columns": ["positive"], "rename": {"positive": "positive_words"}})]
    return Pipeline(steps).run(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "positive_words")


@query("n17_placed_ngrams", f"""WITH {_COUNTS}, k AS (SELECT count(*) AS k FROM c),
    s AS (SELECT g.words, g.frequency::DOUBLE / (a.frequency::DOUBLE * b.frequency::DOUBLE) * k.k AS score FROM c g JOIN c a ON a.words = str_split(g.words, ';')[1] JOIN c b ON b.words = str_split(g.words, ';')[2] CROSS JOIN k WHERE g.length = 2),
    d AS (SELECT doc_id, list_filter(str_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS t FROM documents),
    p AS (SELECT doc_id, unnest(list_transform(range(1, len(t)), lambda i: {{'start': i - 1, 'words': t[i] || ';' || t[i+1]}})) AS x FROM d)
    SELECT doc_id, p.x.words AS words, p.x.start AS start, 2 AS length FROM p JOIN s ON s.words = p.x.words WHERE s.score >= 2.0""")
def n17(spark, d):
    tokens = _tokens(spark, d)
    scores = ngrams.pmi_scores(ngrams.ngram_counts(tokens, "tokens", 2, 5))
    return ngrams.find_ngrams(tokens, scores, "doc_id", "tokens", 2, 2.0, overlaps="keep").select("doc_id", "words", "start", "length")


@query("t11_quotes_parentheses", "SELECT doc_id, replace('[a] {b} \"c\" ' || coalesce(lang, ''), chr(34), chr(39)) AS quotes FROM documents")
def t11(spark, d):
    c = F.concat(F.lit('[a] {b} "c" '), F.coalesce("lang", F.lit("")))
    return table(spark, d, "documents").select("doc_id", T.single_quotes_only(c).alias("quotes"))


@query("o01_sort_o06_distinct", "SELECT c_nationkey, c_mktsegment FROM customer GROUP BY 1, 2")
def o01(spark, d):
    return table(spark, d, "customer").select("c_nationkey", "c_mktsegment").distinct().orderBy("c_nationkey", "c_mktsegment")


# Lexicons, curves, vocabularies.

_LM_ROWS = (("THE", 1, 0, 0), ("Of", 0, 2009, 0), ("and", 2009, 0, 2011), ("with", 0, 0, 2009), ("was", 0, 1, 0))


def _lm(spark):
    from weftline.operators import lexicons

    cut = lexicons.Lexicon("Word", ("Positive", "Negative", "Uncertainty"), "Negative", lowercase=True, scores=lexicons.LM.scores)
    return spark.createDataFrame(_LM_ROWS, "Word string, Positive int, Negative int, Uncertainty int"), cut


_LM_SQL = """lex(w, p, n, u) AS (VALUES ('the', 1, 0, 0), ('of', 0, 2009, 0), ('and', 2009, 0, 2011), ('with', 0, 0, 2009), ('was', 0, 1, 0)),
    t AS (SELECT doc_id, list_filter(str_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '') AS ws FROM documents), x AS (SELECT doc_id, unnest(ws) AS w FROM t)"""


@query("e08_lexicon_entries", f"WITH {_LM_SQL} SELECT doc_id, w AS words, count(*) AS count, any_value(p)::INTEGER AS positive, any_value(u)::INTEGER AS uncertainty FROM x JOIN lex USING (w) GROUP BY doc_id, w")
def e08(spark, d):
    from weftline.operators import lexicons

    rows, spec = _lm(spark)
    return lexicons.lexicon_entries(_tokens(spark, d), rows, spec, "doc_id", "tokens").select("doc_id", "words", "count", F.col("Positive").alias("positive"), F.col("Uncertainty").alias("uncertainty"))


@query("e03_declared_scores", f"""WITH {_LM_SQL}, s AS (SELECT doc_id, sum((p > 0)::INT) AS p, sum((n > 0)::INT) AS n, sum((u > 0)::INT) AS u FROM x JOIN lex USING (w) GROUP BY doc_id),
    v AS (SELECT t.doc_id, coalesce(len(ws), 0) AS num_tokens, CASE WHEN len(ws) > 5 THEN (p - n) / (p + n + 1e-6) END AS pol, CASE WHEN len(ws) > 5 THEN u / len(ws) + 1e-6 END AS unc FROM t LEFT JOIN s USING (doc_id))
    SELECT doc_id, num_tokens, round(pol, 6) AS polarity, round(unc, 6) AS uncertainty, CASE WHEN pol BETWEEN 0.2 AND 1 THEN 'positive' WHEN pol BETWEEN -0.2 AND 0.2 THEN 'neutral' WHEN pol BETWEEN -1 AND -0.2 THEN 'negative' END AS polarity_label FROM v""")
def e03_declared(spark, d):
    from weftline.operators import lexicons

    rows, spec = _lm(spark)
    out = lexicons.lexicon_scores(_tokens(spark, d), rows, spec, "doc_id", "tokens", ("polarity", "uncertainty"))
    return out.select("doc_id", F.col("num_tokens").cast("long").alias("num_tokens"), _r(F.col("polarity")).alias("polarity"), _r(F.col("uncertainty")).alias("uncertainty"), "polarity_label")
