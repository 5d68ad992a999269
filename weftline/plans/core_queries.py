"""Named queries of the core operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.operators import dedup, joins, metrics, ngrams, relational, sampling, sentiment, text, windows
from weftline.plans.catalog import query, table
from weftline.plans.registry import Pipeline


@query(
    "flagship_corpus_profile",
    """
    WITH kept AS (
      SELECT doc_id, text, lang FROM (
        SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS lang,
               row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id) AS rn
        FROM documents WHERE strlen(coalesce(text, '')) >= 30)
      WHERE rn = 1)
    SELECT lang, count(*) AS n_docs, sum(strlen(text)) AS sum_bytes, median(strlen(text)) AS median_bytes,
           count(l.doc_id) AS n_labelled, sum(coalesce(l.toxic, 0)) AS n_toxic
    FROM kept LEFT JOIN labels l USING (doc_id) GROUP BY lang
    """,
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Load, fill nulls, keep texts of 30 bytes or more, drop repeated texts, join labels, roll up by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").fillna("", ["text", "lang"])
    docs = docs.where(F.octet_length("text") >= 30).select("doc_id", "lang", F.octet_length("text").alias("bytes"), F.sha2("text", 256).alias("digest"))
    kept = relational.drop_duplicates(docs, "digest", "doc_id").drop("digest")
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id"), F.col("doc_id").alias("labelled"), "toxic")
    return kept.join(labels, "doc_id", "left").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_docs"),
        F.sum("bytes").alias("sum_bytes"),
        F.median("bytes").alias("median_bytes"),
        F.count("labelled").alias("n_labelled"),
        F.sum(F.coalesce("toxic", F.lit(0))).alias("n_toxic"),
    )


def _r(c, n: int = 6):
    return F.round(c, n)


# Pipelines, projection, filters.

@query("p01_pipeline", "SELECT lang, count(*) AS n, sum(strlen(text)) AS bytes FROM (SELECT lang, coalesce(text,'') AS text FROM documents) WHERE strlen(text) BETWEEN 100 AND 5000 GROUP BY lang")
def p01(spark, d):
    steps = [("fillna", {"columns": ["text"]}), ("filter_length", {"min_length": 100, "max_length": 5000}), ("eval_columns", {"expressions": {"b": "octet_length(text)"}})]
    return Pipeline(steps).run(table(spark, d, "documents")).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum("b").alias("bytes"))


@query("p03_split_column", "SELECT p_partkey, str_split(p_name,' ')[1] AS first_word, str_split(p_name,' ')[2] AS second_word FROM part")
def p03(spark, d):
    return relational.split_column(table(spark, d, "part"), "p_name", ["first_word", "second_word"], expand=True).select("p_partkey", "first_word", "second_word")


@query("p04_eval_columns", "SELECT l_orderkey, l_linenumber, l_extendedprice*(1-l_discount) AS net, l_extendedprice*(1-l_discount)*(1+l_tax) AS gross FROM lineitem")
def p04(spark, d):
    out = relational.eval_columns(table(spark, d, "lineitem"), ["net = l_extendedprice * (1 - l_discount)", "gross = net * (1 + l_tax)"])
    return out.select("l_orderkey", "l_linenumber", "net", "gross")


@query("p05_combine_columns", "SELECT c_custkey, concat(coalesce(c_name,''),' | ',coalesce(c_mktsegment,''),' | ',coalesce(cast(c_nationkey AS VARCHAR),'')) AS combined FROM customer")
def p05(spark, d):
    return relational.combine_columns(table(spark, d, "customer"), ["c_name", "c_mktsegment", "c_nationkey"], "combined", " | ").select("c_custkey", "combined")


@query("p06_drop", "SELECT r_regionkey FROM region")
def p06(spark, d):
    return relational.drop(table(spark, d, "region"), ["r_name", "absent"])


@query("p07_melt", "SELECT s_suppkey, 's_acctbal' AS variable, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'key' , cast(s_nationkey AS DOUBLE) FROM supplier")
def p07(spark, d):
    df = table(spark, d, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").cast("double").alias("key"))
    return relational.melt(df, ["s_suppkey"])


@query("p09_pivot", """SELECT l_returnflag, sum(CASE WHEN l_linestatus='F' THEN l_quantity END) AS qty_F, sum(CASE WHEN l_linestatus='O' THEN l_quantity END) AS qty_O FROM lineitem GROUP BY l_returnflag""")
def p09(spark, d):
    df = table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty"))
    return relational.pivot(df, "l_returnflag", "l_linestatus", "qty", labels=["F", "O"])


@query("p10_split_sampling", """
    WITH r AS (SELECT c_custkey, c_mktsegment, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1|' || cast(c_custkey AS VARCHAR)), c_custkey) - 1 AS rk, count(*) OVER (PARTITION BY c_mktsegment) AS n FROM customer),
    t AS (SELECT *, ceil(n * 0.2) AS te FROM r)
    SELECT c_custkey, c_mktsegment, CASE WHEN rk < te THEN 'test' WHEN rk < te + ceil((n - te) * 0.25) THEN 'dev' ELSE 'train' END AS split FROM t""")
def p10(spark, d):
    df = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return sampling.split_sampling(df, "c_custkey", 0.2, 0.25, "c_mktsegment").select("c_custkey", "c_mktsegment", "split")


@query("p11_top_values", """
    WITH s AS (SELECT o_custkey, o_orderpriority, sum(o_totalprice) AS v FROM orders GROUP BY 1,2), p AS (SELECT *, v / sum(v) OVER (PARTITION BY o_custkey) AS share FROM s),
    r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY share DESC, o_orderpriority) AS rk FROM p)
    SELECT p.o_custkey, p.o_orderpriority, t.top_values FROM p JOIN (SELECT o_custkey, string_agg(o_orderpriority || '[' || cast(cast(round(share*100) AS BIGINT) AS VARCHAR) || '%]', ', ' ORDER BY rk) AS top_values FROM r WHERE rk <= 2 GROUP BY 1) t USING (o_custkey)""")
def p11(spark, d):
    s = table(spark, d, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.sum("o_totalprice").alias("v"))
    s = s.withColumn("share", F.col("v") / F.sum("v").over(Window.partitionBy("o_custkey")))
    return relational.top_values(s, "o_custkey", "o_orderpriority", "share", 2).select("o_custkey", "o_orderpriority", "top_values")


@query("p12_subset", "SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5) UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey DESC LIMIT 5) UNION ALL SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY md5('1|' || cast(o_orderkey AS VARCHAR)), o_orderkey LIMIT 7)")
def p12(spark, d):
    return sampling.subset(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 5, 5, 7)


@query("p13_sampling_by_group", "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY md5('1|' || cast(c_custkey AS VARCHAR)), c_custkey) AS r FROM customer) WHERE r <= 10")
def p13(spark, d):
    return sampling.sampling(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), "c_custkey", n=10, groupby="c_mktsegment")


@query("p14_aggregate_columns", "SELECT o_orderstatus, sum(o_totalprice)::DECIMAL(38,2)::VARCHAR AS total, max(o_totalprice) AS o_totalprice_max, median(o_totalprice) AS o_totalprice_median, count(DISTINCT o_custkey) AS o_custkey_nunique FROM orders GROUP BY 1")
def p14(spark, d):
    out = relational.aggregate_columns(table(spark, d, "orders"), "o_orderstatus", {"o_totalprice": ["sum_exact", "max", "median"], "o_custkey": ["nunique"]})
    return out.select("o_orderstatus", F.col("o_totalprice_sum_exact").cast("decimal(38,2)").cast("string").alias("total"), "o_totalprice_max", "o_totalprice_median", "o_custkey_nunique")


@query("p14_join_text", "SELECT conv_id, string_agg(coalesce(text,''), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def p14b(spark, d):
    return relational.aggregate_columns(table(spark, d, "conversations"), "conv_id", onto="text", order_by="turn")


@query("p15_explode_splits", "SELECT doc_id, i - 1 AS seq, parts[i] AS text FROM (SELECT doc_id, str_split(text, chr(10)) AS parts, unnest(range(1, len(str_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)")
def p15(spark, d):
    return relational.explode_splits(table(spark, d, "documents").select("doc_id", "text").dropna(), "doc_id", separator="\n")


@query("p16_rename", "SELECT n_nationkey AS id, n_name AS name, n_regionkey FROM nation")
def p16(spark, d):
    return relational.rename_columns(table(spark, d, "nation"), {"n_nationkey": "id", "n_name": "name", "absent": "x"})


@query("p17_reset_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS id FROM orders")
def p17(spark, d):
    return relational.reset_index(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "id")


@query("p19_fillna", "SELECT doc_id, coalesce(lang, '?') AS lang FROM documents")
def p19(spark, d):
    return relational.fillna(table(spark, d, "documents").select("doc_id", "lang"), "?", ["lang"])


@query("p27_replace_regex", "SELECT doc_id, trim(regexp_replace(trim(regexp_replace(lang, '^e(.)$', 'E\\1', 'g')), 's', 'S', 'g')) AS lang FROM documents")
def p27(spark, d):
    return relational.replace_regex(table(spark, d, "documents").select("doc_id", "lang"), "lang", {r"^e(.)$": r"E\1", "s": "S"})


@query("p28_remove_startswith", "SELECT p_partkey, CASE WHEN starts_with(lower(p_type),'st') THEN trim(substr(p_type,3)) ELSE p_type END AS p_type FROM part")
def p28(spark, d):
    return relational.remove_startswith(table(spark, d, "part").select("p_partkey", "p_type"), "p_type", ["st"])


@query("p29_filter_length", "SELECT doc_id, strlen(text) AS text_num_bytes FROM documents WHERE strlen(text) BETWEEN 200 AND 2000")
def p29(spark, d):
    return relational.filter_length(table(spark, d, "documents"), "text", 200, 2000, keep_length=True).select("doc_id", "text_num_bytes")


@query("p30_filter_query", "SELECT o_orderkey FROM orders WHERE o_totalprice > 100000 AND o_orderpriority IN ('1-URGENT','2-HIGH')")
def p30(spark, d):
    return relational.filter_query(table(spark, d, "orders"), ["o_totalprice > 100000", "o_orderpriority IN ('1-URGENT','2-HIGH')"]).select("o_orderkey")


@query("p31_drop_duplicates", "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY text ORDER BY doc_id) AS r FROM documents) WHERE r = 1")
def p31(spark, d):
    return relational.drop_duplicates(table(spark, d, "documents").select("doc_id", F.md5("text").alias("h")), "h", "doc_id").select("doc_id")


@query("p35_split_dataframe", "SELECT s_suppkey, ntile(3) OVER (ORDER BY s_suppkey) - 1 AS part FROM supplier")
def p35(spark, d):
    return sampling.split_dataframe(table(spark, d, "supplier").select("s_suppkey"), 3, "s_suppkey")


@query("p36_concat", "SELECT c_custkey AS k, 'customer' AS src, c_acctbal AS bal, NULL::INTEGER AS n FROM customer UNION ALL SELECT s_suppkey, 'supplier', s_acctbal, s_nationkey FROM supplier")
def p36(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"), F.col("s_nationkey").alias("n"))
    return relational.concat_dataframes(c, {"supplier": s}, key="src", name="customer")


@query("p41_summary_stats", """SELECT lang, 0 AS is_total, count(*) AS num_examples, sum(strlen(text)) AS total, median(strlen(text)) AS median, max(strlen(text)) AS max, min(strlen(text)) AS min FROM documents GROUP BY lang
    UNION ALL SELECT NULL, 1, count(*), sum(strlen(text)), median(strlen(text)), max(strlen(text)), min(strlen(text)) FROM documents""")
def p41(spark, d):
    return relational.summary_stats(table(spark, d, "documents"), by="lang").withColumn("is_total", F.col("is_total").cast("int"))


# Joins.

@query("j01_merge", "SELECT n_name, count(*) AS n FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def j01(spark, d):
    return joins.merge_dataframe(table(spark, d, "supplier"), table(spark, d, "nation"), left_on="s_nationkey", right_on="n_nationkey").groupBy("n_name").agg(F.count(F.lit(1)).alias("n"))


@query("j02_metadata", "SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id)")
def j02(spark, d):
    return joins.merge_metadata(table(spark, d, "documents").select("doc_id", "lang"), table(spark, d, "labels"), "doc_id")


@query("j06_asof_backward", """SELECT o.o_orderkey, (SELECT max(s.o_orderdate) FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderdate < o.o_orderdate) AS o_orderdate_asof FROM orders o""")
def j06(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.asof_join(o, o.select("o_custkey", "o_orderdate"), "o_orderdate", [], "o_custkey").select("o_orderkey", "o_orderdate_asof")


@query("j06_asof_offset_global", """SELECT e.event_id, (SELECT max(s.ts) FROM events s WHERE s.event_type = 'purchase' AND s.ts < e.ts - INTERVAL 1 HOUR) AS ts_asof FROM events e""")
def j06b(spark, d):
    e = table(spark, d, "events").select("event_id", "event_type", "ts")
    return joins.asof_join(e.select("event_id", "ts"), e.where("event_type = 'purchase'").select("ts"), "ts", [], offset="1 HOUR").select("event_id", "ts_asof")


@query("j08_asof_forward", """SELECT o.o_orderkey, (SELECT min(s.o_orderdate) FROM orders s WHERE s.o_custkey = o.o_custkey AND s.o_orderdate > o.o_orderdate + INTERVAL 2 DAY) AS o_orderdate_asof FROM orders o""")
def j08(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return joins.asof_join(o, o.select("o_custkey", "o_orderdate"), "o_orderdate", [], "o_custkey", "forward", offset="2 DAYS").select("o_orderkey", "o_orderdate_asof")


@query("j10_upsert", "SELECT coalesce(a.k, b.k) AS k, coalesce(a.bal, b.bal) AS bal FROM (SELECT s_suppkey AS k, s_acctbal AS bal FROM supplier) a FULL JOIN (SELECT c_custkey AS k, c_acctbal AS bal FROM customer) b ON a.k = b.k")
def j10(spark, d):
    a = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_acctbal").alias("bal"))
    return joins.upsert(a, table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("bal")), "k")


@query("j11_anti_join", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def j11(spark, d):
    return joins.anti_join(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("j12_apply_fixes", "SELECT d.doc_id, CASE WHEN l.toxic = 0 THEN 'clean' ELSE d.lang END AS lang FROM documents d LEFT JOIN labels l USING (doc_id) WHERE l.toxic IS NULL OR l.toxic <> 1")
def j12(spark, d):
    fixes = table(spark, d, "labels").select("doc_id", F.lit("clean").alias("annotation"), F.when(F.col("toxic") == 1, "Discarded").otherwise("Validated").alias("status"))
    return joins.apply_fixes(table(spark, d, "documents").select("doc_id", "lang"), fixes, "doc_id", "lang")


@query("j15_semi_join", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def j15(spark, d):
    return joins.semi_join(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query("j16_range_join", """SELECT p_partkey, coalesce((SELECT min(r_name) FROM region WHERE r_regionkey * 10 < p_size AND r_regionkey * 10 + 9 > p_size), 'other') AS r_name FROM part""")
def j16(spark, d):
    r = table(spark, d, "region").select((F.col("r_regionkey") * 10).alias("lo"), (F.col("r_regionkey") * 10 + 9).alias("hi"), "r_name")
    return joins.range_join(table(spark, d, "part").select("p_partkey", "p_size"), r, "p_size", "lo", "hi", "r_name", "other").select("p_partkey", "r_name")


# Aggregation, windows, sets.

@query("a06_share_of_total", "SELECT lang, count(*) AS n, round(count(*) / sum(count(*)) OVER () * 100, 6) AS percent FROM documents GROUP BY lang")
def a06(spark, d):
    return relational.share_of_total(table(spark, d, "documents"), "lang").withColumn("percent", _r(F.col("percent")))


@query("a08_word_counts", "SELECT word, count(*) AS n FROM (SELECT unnest(str_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) WHERE word <> '' GROUP BY word HAVING count(*) >= 20")
def a08(spark, d):
    words = F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word")
    return table(spark, d, "documents").select(words).where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where("n >= 20")


@query("a09_make_table", """SELECT c_mktsegment, c_nationkey, sum(c_custkey)::BIGINT AS bytes, grouping_id(c_mktsegment, c_nationkey) AS level FROM customer GROUP BY GROUPING SETS ((c_mktsegment, c_nationkey), (c_mktsegment), ())""")
def a09(spark, d):
    return relational.make_table(table(spark, d, "customer"), "c_mktsegment", "c_nationkey", "c_custkey").select("c_mktsegment", "c_nationkey", "bytes", "level")


@query("a10_label_matrix", "SELECT conv_id, min(CASE WHEN role='user' THEN turn END) AS \"user\", min(CASE WHEN role='assistant' THEN turn END) AS assistant FROM conversations GROUP BY conv_id")
def a10(spark, d):
    return metrics.label_matrix(table(spark, d, "conversations"), "conv_id", "role", "turn", ["user", "assistant"])


@query("w01_cumcount", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS cumcount FROM orders")
def w01(spark, d):
    return windows.cumcount(table(spark, d, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "cumcount")


@query("w02_head_per_group", "SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 2")
def w02(spark, d):
    return windows.head_per_group(table(spark, d, "orders"), "o_custkey", [F.desc("o_totalprice"), "o_orderkey"], 2).select("o_custkey", "o_orderkey")


@query("w03_cumsum", "SELECT event_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS purchases FROM events")
def w03(spark, d):
    return windows.cumsum(table(spark, d, "events"), "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END", "user_id", ["ts", "event_id"], "purchases").select("event_id", "purchases")


@query("w04_decision", "SELECT event_id, CAST(sign(lead(value,3) OVER w - lag(value,1) OVER w) AS INTEGER) AS decision FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def w04(spark, d):
    return windows.decision(table(spark, d, "events"), "value", "user_id", ["ts", "event_id"]).select("event_id", "decision")


@query("w05_rolling", "SELECT event_id, CASE WHEN count(value) OVER w = 4 THEN round(avg(value) OVER w, 6) END AS mean4 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS 3 PRECEDING)")
def w05(spark, d):
    return windows.rolling(table(spark, d, "events"), "value", 4, "user_id", ["ts", "event_id"], "mean4").select("event_id", _r(F.col("mean4")).alias("mean4"))


@query("w06_argmax", "SELECT o_custkey, arg_max(o_orderkey, o_totalprice) AS o_orderkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_custkey")
def w06(spark, d):
    return windows.argmax_per_group(table(spark, d, "orders"), "o_custkey", "o_totalprice", ["o_orderkey"])


@query("w08_kfold", "SELECT c_custkey, ntile(5) OVER (ORDER BY md5('1|' || cast(c_custkey AS VARCHAR)), c_custkey) - 1 AS fold FROM customer")
def w08(spark, d):
    return sampling.kfold(table(spark, d, "customer").select("c_custkey"), 5, "c_custkey")


@query("o04_union_common", "SELECT doc_id FROM documents UNION ALL SELECT doc_id FROM labels")
def o04(spark, d):
    return relational.union_common(table(spark, d, "documents"), [table(spark, d, "labels")])


@query("o07_intersect_except", "(SELECT s_nationkey AS k, 'both' AS side FROM supplier INTERSECT SELECT c_nationkey, 'both' FROM customer) UNION ALL (SELECT c_nationkey, 'customer' FROM customer EXCEPT SELECT s_nationkey, 'customer' FROM supplier)")
def o07(spark, d):
    s, c = table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), table(spark, d, "customer").select(F.col("c_nationkey").alias("k"))
    return relational.intersect(s, c).withColumn("side", F.lit("both")).unionAll(relational.except_(c, s).withColumn("side", F.lit("customer")))


@query("o09_percent_slice", "SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) WHERE r > CAST(floor(n * 90 / 100) AS BIGINT)")
def o09(spark, d):
    return sampling.percent_slice(table(spark, d, "orders").select("o_orderkey"), "o_orderkey", 90, tail=True)


# Text.

@query("t13_normalize", r"""SELECT doc_id, md5(trim(regexp_replace(replace(replace(replace(text, '…', '...'), ' . . . ', ' ... '), chr(9), '    '), ' +', ' ', 'g'), ' ' || chr(10) || chr(13) || chr(9))) AS h FROM documents""")
def t13(spark, d):
    return text.normalize(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", F.md5("text").alias("h"))


@query("t14_levenshtein", "SELECT a.n_name AS a, b.n_name AS b, levenshtein(a.n_name, b.n_name) AS dist FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def t14(spark, d):
    a, b = table(spark, d, "nation").alias("a"), table(spark, d, "nation").alias("b")
    j = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return j.select(F.col("a.n_name").alias("a"), F.col("b.n_name").alias("b"), T.levenshtein(F.col("a.n_name"), F.col("b.n_name")).cast("long").alias("dist"))


@query("t15_t16_predicates", r"""SELECT doc_id, (length(text) - length(translate(text, '([{', '')) - length(text) + length(translate(text, ')]}', ''))) AS level, regexp_full_match(text, '[\x00-\x7F]*') AS is_ascii FROM documents""")
def t15(spark, d):
    return table(spark, d, "documents").select("doc_id", T.bracket_level(F.col("text")).cast("long").alias("level"), T.is_ascii(F.regexp_replace("text", "\n", " ")).alias("is_ascii"))


@query("t17_t18_urls_numbers", r"""SELECT w, count(*) AS n FROM (SELECT unnest(str_split_regex(text, '\s+')) AS w FROM documents) WHERE regexp_full_match(replace(replace(w, ',', ''), '.', ''), '[0-9]+(/[0-9]+)?') GROUP BY w""")
def t18(spark, d):
    w = table(spark, d, "documents").select(F.explode(F.split("text", r"\s+")).alias("w"))
    return w.where(T.like_number(F.col("w")) & F.rlike("w", F.lit("[0-9]"))).groupBy("w").agg(F.count(F.lit(1)).alias("n"))


@query("t28_stopwords", "SELECT doc_id, len(list_filter(str_split_regex(trim(lower(text), ' ' || chr(10)), '\\s+'), lambda w: w <> '' AND w NOT IN ('the','of','and','to'))) AS n FROM documents")
def t28(spark, d):
    kept = T.drop_stopwords(T.words(F.lower("text")), ["the", "of", "and", "to"])
    return table(spark, d, "documents").select("doc_id", F.size(kept).cast("long").alias("n"))


@query("t29_lengths", "SELECT doc_id, strlen(text) AS len_bytes, length(text) AS len_chars, len(list_filter(str_split_regex(text, '\\s+'), lambda w: w <> '')) AS len_words, len(list_filter(str_split(text, chr(10)), lambda w: trim(w) <> '')) AS len_sents FROM documents")
def t29(spark, d):
    return table(spark, d, "documents").select("doc_id", *[T.LENGTHS[n](F.col("text")).cast("long").alias(n) for n in ("len_bytes", "len_chars", "len_words", "len_sents")])


@query("g01_segment", None)
def g01(spark, d):
    return text.segment(table(spark, d, "documents").select("doc_id", "text"), merge_lines="auto")


@query("g06_chunk", None)
def g06(spark, d):
    return text.chunk(table(spark, d, "documents").select("doc_id", "text"), size=500)


@query("n02_tokenize", "SELECT doc_id, md5(array_to_string(list_transform(str_split(lower(text), chr(10)), lambda l: array_to_string(list_filter(str_split_regex(l, '\\s+'), lambda w: w <> ''), ' ')), chr(10))) AS h FROM documents")
def n02(spark, d):
    return text.tokenize(table(spark, d, "documents").select("doc_id", "text"), lowercase=True).select("doc_id", F.md5("text").alias("h"))


_WORDS = "list_filter(str_split_regex(lower(text), '[^a-z]+'), lambda w: w <> '')"


def _tokens(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_remove(F.split(F.lower("text"), "[^a-z]+"), "").alias("tokens"))


_COUNTS = f"""w AS (SELECT {_WORDS} AS t FROM documents), g AS (SELECT unnest(list_transform(range(1, len(t) + 1), lambda i: t[i])) AS words, 1 AS length FROM w
    UNION ALL SELECT unnest(list_transform(range(1, len(t)), lambda i: t[i] || ';' || t[i+1])), 2 FROM w),
    c AS MATERIALIZED (SELECT words, length, count(*) AS frequency FROM g GROUP BY words, length HAVING count(*) >= 5)"""


@query("n12_ngram_counts", f"WITH {_COUNTS} SELECT words, length, frequency FROM c")
def n12(spark, d):
    return ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5)


@query("n13_pmi", f"""WITH {_COUNTS}, k AS (SELECT count(*) AS k FROM c) SELECT g.words, g.length, g.frequency, round(g.frequency::DOUBLE / (a.frequency::DOUBLE * b.frequency::DOUBLE) * k.k, 6) AS score
    FROM c g JOIN c a ON a.words = str_split(g.words, ';')[1] JOIN c b ON b.words = str_split(g.words, ';')[2] CROSS JOIN k WHERE g.length = 2""")
def n13(spark, d):
    return ngrams.pmi_scores(ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5)).withColumn("score", _r(F.col("score")))


@query("n14_cohesion", f"""WITH {_COUNTS} SELECT g.words, g.frequency / a.frequency AS cohesion_forward, g.frequency / b.frequency AS cohesion_backward FROM c g LEFT JOIN c a ON a.words = str_split(g.words, ';')[1] LEFT JOIN c b ON b.words = str_split(g.words, ';')[2] WHERE g.length = 2""")
def n14(spark, d):
    return ngrams.cohesion_scores(ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5)).select("words", "cohesion_forward", "cohesion_backward")


@query("n15_branching_entropy", f"""WITH {_COUNTS}, r AS (SELECT str_split(words, ';')[1] AS words, sum(frequency) AS s, sum(frequency * ln(frequency)) AS e FROM c WHERE length = 2 GROUP BY 1),
    l AS (SELECT str_split(words, ';')[2] AS words, sum(frequency) AS s, sum(frequency * ln(frequency)) AS e FROM c WHERE length = 2 GROUP BY 1)
    SELECT c.words, round(coalesce(ln(l.s) - l.e / l.s, 0), 5) AS leftside_entropy, round(coalesce(ln(r.s) - r.e / r.s, 0), 5) AS rightside_entropy FROM c LEFT JOIN r USING (words) LEFT JOIN l USING (words) WHERE r.words IS NOT NULL OR l.words IS NOT NULL""")
def n15(spark, d):
    out = ngrams.branching_entropy(ngrams.ngram_counts(_tokens(spark, d), "tokens", 2, 5))
    return out.select("words", _r(F.col("leftside_entropy"), 5).alias("leftside_entropy"), _r(F.col("rightside_entropy"), 5).alias("rightside_entropy"))


@query("n17_find_ngrams", None)
def n17(spark, d):
    t = _tokens(spark, d)
    return ngrams.find_ngrams(t, ngrams.pmi_scores(ngrams.ngram_counts(t, "tokens", 2, 5)), "doc_id", "tokens", 2, 2.0)


_LEXICON = [("the", 1, 0), ("of", 0, 1), ("and", 1, 0), ("with", 0, 1), ("was", 0, 1)]


@query("e03_lexicon_polarity", """WITH lex(word, positive, negative) AS (VALUES ('the',1,0),('of',0,1),('and',1,0),('with',0,1),('was',0,1)),
    t AS (SELECT doc_id, list_filter(str_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS ws FROM documents),
    s AS (SELECT t.doc_id, sum(positive) AS p, sum(negative) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM t) t JOIN lex USING (word) GROUP BY 1),
    j AS (SELECT t.doc_id, len(ws) AS num_tokens, CASE WHEN len(ws) >= 5 THEN coalesce(p, 0) END::BIGINT AS positive, CASE WHEN len(ws) >= 5 THEN coalesce(n, 0) END::BIGINT AS negative FROM t LEFT JOIN s USING (doc_id))
    SELECT doc_id, num_tokens, positive, negative, round((positive - negative) / (positive + negative + 1e-6), 6) AS polarity,
    CASE WHEN (positive - negative) / (positive + negative + 1e-6) BETWEEN 0.2 AND 1 THEN 'positive' WHEN (positive - negative) / (positive + negative + 1e-6) BETWEEN -0.2 AND 0.2 THEN 'neutral' WHEN (positive - negative) / (positive + negative + 1e-6) BETWEEN -1 AND -0.2 THEN 'negative' END AS polarity_label FROM j""")
def e03(spark, d):
    lex = spark.createDataFrame(_LEXICON, "word string, positive long, negative long")
    out = sentiment.score_polarity(sentiment.lexicon_features(table(spark, d, "documents"), lex, "doc_id"))
    return out.withColumn("polarity", _r(F.col("polarity"))).withColumn("num_tokens", F.col("num_tokens").cast("long"))


@query("e07_aggregate_scores", """SELECT event_type, count(value) AS num_examples, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS num_positive, sum(CASE WHEN value < 50 THEN 1 ELSE 0 END)::BIGINT AS num_negative FROM events GROUP BY event_type""")
def e07(spark, d):
    df = table(spark, d, "events").withColumn("s", F.col("value") - 50)
    return sentiment.aggregate_scores(df, "event_type", "s").select("event_type", "num_examples", "num_positive", "num_negative")


@query("d01_minhash_groups", """
    WITH RECURSIVE s AS MATERIALIZED (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(length(text) - 4, 1) + 1), lambda i: substr(text, i, 5)))) AS g FROM documents WHERE text IS NOT NULL),
    f AS (SELECT g, count(*) AS df FROM s GROUP BY g),
    r AS (SELECT doc_id, s.g, row_number() OVER (PARTITION BY doc_id ORDER BY df, s.g) AS k, count(*) OVER (PARTITION BY doc_id) AS n FROM s JOIN f USING (g)),
    p AS MATERIALIZED (SELECT * FROM r WHERE k <= n - ceil(0.8 * n) + 1),
    c AS MATERIALIZED (SELECT DISTINCT a.doc_id AS a, b.doc_id AS b, a.n AS n, b.n AS m FROM p a JOIN p b ON a.g = b.g AND a.doc_id > b.doc_id WHERE least(a.n, b.n) >= 0.8 * greatest(a.n, b.n)),
    j AS MATERIALIZED (SELECT c.a, c.b FROM c JOIN s x ON x.doc_id = c.a JOIN s y ON y.doc_id = c.b AND y.g = x.g GROUP BY c.a, c.b, c.n, c.m HAVING count(*) >= 0.8 * (c.n + c.m - count(*))),
    e AS MATERIALIZED (SELECT a, b FROM j UNION ALL SELECT b, a FROM j),
    w(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.a, w.root FROM w JOIN e ON e.b = w.doc_id)
    SELECT doc_id, min(root) AS "group" FROM w GROUP BY doc_id""")
def d01(spark, d):
    return dedup.minhash_groups(table(spark, d, "documents"), "doc_id", threshold=0.8)


@query("d03_shared_substrings", "SELECT md5(substring) AS h, count(DISTINCT item_id) AS n_docs FROM (SELECT item_id, unnest(list_transform(range(1, length(text) - 18), lambda i: substr(text, i, 20))) AS substring FROM benchmark WHERE length(text) >= 20) GROUP BY substring HAVING count(DISTINCT item_id) >= 2")
def d03(spark, d):
    return dedup.shared_substrings(table(spark, d, "benchmark"), "item_id").select(F.md5("substring").alias("h"), "n_docs")


# Labels and metrics.

@query("m07_label_codes", "SELECT doc_id, lang, code FROM documents LEFT JOIN (SELECT lang, row_number() OVER (ORDER BY lang) - 1 AS code FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)) USING (lang)")
def m07(spark, d):
    return metrics.label_codes(table(spark, d, "documents").select("doc_id", "lang"), "lang").withColumn("code", F.col("code").cast("long"))


@query("m08_metrics", """WITH c AS (SELECT cast(quality AS VARCHAR) AS t, cast(1 - toxic AS VARCHAR) AS p FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL), l AS (SELECT DISTINCT t AS label FROM c UNION SELECT DISTINCT p FROM c),
    e AS (SELECT label, (SELECT count(*) FROM c WHERE t = label) AS s, (SELECT count(*) FROM c WHERE p = label) AS g, (SELECT count(*) FROM c WHERE t = label AND p = label) AS h FROM l),
    f AS (SELECT s, h, CASE WHEN g = 0 THEN 0 ELSE h / g END AS p, CASE WHEN s = 0 THEN 0 ELSE h / s END AS r FROM e)
    SELECT round(sum(h) / sum(s), 6) AS accuracy, round(sum(p * s) / sum(s), 6) AS precision, round(sum(r * s) / sum(s), 6) AS recall, round(sum(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END * s) / sum(s), 6) AS f1, sum(s)::BIGINT AS n FROM f""")
def m08(spark, d):
    out = metrics.classification_metrics(table(spark, d, "labels").withColumn("p", 1 - F.col("toxic")), "quality", "p")
    return out.select(*[_r(F.col(c)).alias(c) for c in ("accuracy", "precision", "recall", "f1")], "n")


@query("m10_correlations", """WITH r AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), a AS (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2 AS rx, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2 AS ry FROM r)
    SELECT round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM a""")
def m10(spark, d):
    out = metrics.correlations(table(spark, d, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select(_r(F.col("pearson")).alias("pearson"), _r(F.col("spearman")).alias("spearman"))


@query("m06_majority_vote", "SELECT source, lang, votes FROM (SELECT source, lang, count(*) AS votes, row_number() OVER (PARTITION BY source ORDER BY count(*) DESC, lang) AS r FROM documents WHERE lang IS NOT NULL GROUP BY source, lang) WHERE r = 1")
def m06(spark, d):
    return metrics.majority_vote(table(spark, d, "documents"), "source", "lang")


@query("m01_group_texts", None)
def m01(spark, d):
    t = _tokens(spark, d).select("doc_id", F.transform("tokens", lambda w: F.pmod(F.xxhash64(w), F.lit(30000)).cast("int")).alias("ids"))
    return metrics.group_texts(t, "ids", "doc_id", 128)


@query("s18_json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def s18(spark, d):
    from weftline.sources.readers import json_document

    return table(spark, d, "events").select("event_id", *json_document(F.col("props"), {"k": "k"}))


@query("s20_html_text", None)
def s20(spark, d):
    from weftline.sources.readers import html_column

    return table(spark, d, "pages").select("page_id", html_column(F.col("html")).alias("text"))


@query("r03_event_windows", "SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def r03(spark, d):
    w = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "10 minutes"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


# Subword vocabularies, topics, vectors, Korean text.

@query("b01_bpe", None)
def b01(spark, d):
    from weftline.operators import subword

    df = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    ranks = {p: i for i, p in enumerate(subword.train_bpe(subword.word_counts(df), 200))}
    return df.select("doc_id", F.size(subword.encode(F.col("text"), lambda w: subword.bpe_word(w, ranks))).alias("n_pieces"))


@query("b03_wordpiece", None)
def b03(spark, d):
    from weftline.operators import subword

    df = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    vocabulary = set(subword.train_wordpiece(subword.word_counts(df), 200))
    return df.select("doc_id", F.size(subword.encode(F.col("text"), lambda w: subword.wordpiece_word(w, vocabulary))).alias("n_pieces"))


@query("b04_unigram", None)
def b04(spark, d):
    from weftline.operators import subword

    df = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    model = subword.train_unigram(subword.word_counts(df), 2000)
    low = subword.unknown_weight(model)
    return df.select("doc_id", F.size(subword.encode(F.col("text"), lambda w: subword.unigram_word(w, model, low=low))).alias("n_pieces"))


@query("b06_branching", None)
def b06(spark, d):
    from weftline.operators import branching

    df = table(spark, d, "documents").select("doc_id", F.lower("text").alias("text"))
    return branching.branching_tokens(df, "doc_id").groupBy("doc_id").agg(F.sum(F.size("pieces")).alias("n_pieces"))


@query("g09_sentences", None)
def g09(spark, d):
    from weftline.functions import hangul

    return table(spark, d, "documents").select("doc_id", F.posexplode(hangul.sentences_column(F.col("text"))).alias("n", "sentence"))


@query("m03_topics", None)
def m03(spark, d):
    from weftline.operators import ml

    docs = ml.topic_tokens(_tokens(spark, d), "tokens")
    model = ml.TopicModel().fit(docs, "tokens")
    return metrics.topic_coherence(docs, model.words(5), "doc_id", "tokens")


@query("m05_embedding_neighbours", """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT e FROM v WHERE vec_id = 0)
    SELECT v.vec_id, round(list_inner_product(v.e, q.e) / (sqrt(list_inner_product(v.e, v.e)) * sqrt(list_inner_product(q.e, q.e))), 6) AS cosine FROM v CROSS JOIN q WHERE v.vec_id <> 0 ORDER BY cosine DESC, vec_id LIMIT 20""")
def m05(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "embedding")
    one = v.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return v.where("vec_id <> 0").crossJoin(F.broadcast(one)).select("vec_id", _r(metrics.cosine(F.col("embedding"), F.col("q"))).alias("cosine")).orderBy(F.desc("cosine"), "vec_id").limit(20)


@query("m14_impulse_response", None)
def m14(spark, d):
    from weftline.operators import ml

    daily = table(spark, d, "events").groupBy(F.to_date("ts").alias("day"), F.hour("ts").alias("hour")).agg(F.avg("value").alias("a"), F.count(F.lit(1)).cast("double").alias("b"))
    return ml.impulse_response(daily.withColumn("o", F.concat_ws("-", F.col("day").cast("string"), F.lpad(F.col("hour").cast("string"), 2, "0"))), ["a", "b"], "o", 2, 5)


@query("decontaminate_benchmark", """WITH d AS (SELECT doc_id, list_filter(str_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS t FROM documents),
    b AS (SELECT list_filter(str_split_regex(lower(text), '\\s+'), lambda w: w <> '') AS t FROM benchmark),
    r AS MATERIALIZED (SELECT DISTINCT unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i+7], chr(1)))) AS run FROM b),
    g AS (SELECT doc_id, unnest(list_transform(range(1, len(t) - 6), lambda i: array_to_string(t[i:i+7], chr(1)))) AS run FROM d),
    h AS (SELECT DISTINCT doc_id FROM g JOIN r USING (run))
    SELECT doc_id, doc_id IN (SELECT doc_id FROM h) AS overlap FROM documents""")
def decontaminate(spark, d):
    tokens = lambda df, i: df.select(i, F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "").alias("tokens"))
    return dedup.decontaminate(tokens(table(spark, d, "documents"), "doc_id"), tokens(table(spark, d, "benchmark"), "item_id"), "tokens", "tokens", 8).select("doc_id", "overlap")
