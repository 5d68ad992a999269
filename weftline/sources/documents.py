"""Documents out of bespoke layouts: numbered lines, parallel texts, headed articles, wire reports, filings, reports in parts."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as T
from weftline.sources.readers import load_archives


def load_lines(spark: SparkSession, path: str, start: int = 0, stop: int | None = None) -> DataFrame:
    """(file, lineno, text): lines start to stop (from 0, stop not included) of every file.

    A file is read in Spark's blocks; blocks' line counts give each its offset, so no task holds a whole file.
    """
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("text")).withColumn("at", F.monotonically_increasing_id())
    sizes = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    inside = F.row_number().over(Window.partitionBy("file", "block").orderBy("at")) - 1
    numbered = rows.withColumn("inside", inside).join(before, ["file", "block"]).select("file", (F.col("before") + F.col("inside")).alias("lineno"), "text")
    kept = F.col("lineno") >= start
    return numbered.where(kept if stop is None else kept & (F.col("lineno") < stop))


def parallel_texts(spark: SparkSession, source: str, target: str) -> DataFrame:
    """(lineno, source, target) of two files with a line for each other's line; lines that only one has are left out."""
    a, b = (load_lines(spark, p).select("lineno", F.col("text").alias(n)) for p, n in ((source, "source"), (target, "target")))
    return a.join(b, "lineno")


def headed_articles(spark: SparkSession, path: str, mark: str = "\n =") -> DataFrame:
    """(text): a row for each article of files in which a line that starts with " =" opens one; the reader splits, so files may be of any size."""
    return spark.read.option("lineSep", mark).text(path).select(T.stripped(F.col("value")).alias("text")).where("text <> ''")


def wire_report(df: DataFrame, content: str = "value") -> DataFrame:
    """title, author, date, url and text: the first four lines are these where they start with "-- ", else they belong to the text."""
    lines = F.split(content, "\n", -1)
    head = lambda i: F.get(lines, F.lit(i))
    marked = lambda i: F.coalesce(head(i).startswith("-- "), F.lit(False))
    value = lambda i: F.when(marked(i), T.stripped(F.replace(head(i), F.lit("-- "), F.lit("")))).otherwise("")
    body = F.filter(lines, lambda x, i: (i >= 4) | ~x.startswith("-- "))
    rest = [c for c in df.columns if c != content]
    author = T.stripped(F.replace(value(1), F.lit("By "), F.lit("")))
    return df.select(*rest, value(0).alias("title"), author.alias("author"), value(2).alias("date"), value(3).alias("url"), T.stripped(F.array_join(body, "\n")).alias("text"))


def filings_index(df: DataFrame, forms: Sequence[str] | None = None, companies: DataFrame | None = None, form: str = "form_type", company: str = "cik") -> DataFrame:
    """Rows of an index of filings: of some forms, of the companies listed in a table."""
    rows = df if forms is None else df.where(F.col(form).isin(list(forms)))
    return rows if companies is None else rows.join(companies.select(company), company, "left_semi")


#: Items of an annual report in the order in which they stand.
ITEMS = ("1", "1A", "1B", "2", "3", "4", "5", "6", "7", "7A", "8", "9", "9A", "9B", "10", "11", "12", "13", "14", "15")


def sections_of(text: str, items: Sequence[str] = ITEMS) -> dict[str, str]:
    """The section of each item: of all stretches from one of its headings to the next heading of a later item, the longest that begins
    after the section before. A table of contents gives short stretches and so loses. The last item goes on to the text's end."""
    place = {x.upper(): k for k, x in enumerate(items)}
    names = "|".join(sorted(map(re.escape, place), key=len, reverse=True))
    heads = [(m.start(), place[m[1].upper()]) for m in re.finditer(rf"^[ \t]*item[ \t]*({names})(?![0-9a-z])", text, re.IGNORECASE | re.MULTILINE)]
    out, floor = {}, 0
    for k, name in enumerate(items):
        best = (0, 0)
        for n, (at, item) in enumerate(heads):
            if item == k and at >= floor:
                end = next((p for p, other in heads[n + 1 :] if other > k), len(text) if k == len(items) - 1 else at)
                best = max(best, (at, end), key=lambda s: s[1] - s[0])
        if best[1] > best[0]:
            out[name] = text[best[0] : best[1]].strip()
            floor = best[1]
    return out


def filing_sections(c: Column, items: Sequence[str] = ITEMS) -> Column:
    """A map of items to their sections, in Arrow batches; null stays null."""

    @F.pandas_udf("map<string,string>")
    def apply(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else sections_of(t, items))

    return apply(c)


def pile(spark: SparkSession, path: str, subsets: Sequence[str] | None = None, default: str = "the_pile") -> DataFrame:
    """(text, subset) of JSON Lines archives whose metadata name a document's subset."""
    rows = load_archives(spark, path, "jsonlines", "text string, meta string")
    rows = rows.select("text", F.coalesce(F.get_json_object("meta", "$.pile_set_name"), F.lit(default)).alias("subset"))
    return rows.where(F.col("subset").isin(list(subsets))) if subsets else rows


def split_report(df: DataFrame, number: str, text: str = "text", separator: str = "\n\n", form: str = "%05d_%03d") -> DataFrame:
    """A row for each part of a report, its doc_id made of the report's number and the part's."""
    parts = F.posexplode(F.split(F.col(text), T.quoted(separator), -1)).alias("part", "__text")
    rows = df.select(*[c for c in df.columns if c != text], parts)
    return rows.withColumn("doc_id", F.format_string(form, F.col(number), F.col("part"))).withColumnRenamed("__text", text)


def sample_files(df: DataFrame, n: int, seed: int = 1) -> DataFrame:
    """All rows of n whole files, chosen by hash; df is read from files and not yet transformed."""
    rows = df.withColumn("__file", F.col("_metadata.file_path"))
    order = F.md5(F.concat(F.lit(f"{seed}|"), F.element_at(F.split("__file", "/"), -1)).cast("binary"))
    files = rows.select("__file").distinct().orderBy(order, "__file").limit(n)
    return rows.join(files, "__file", "left_semi").drop("__file")


def fetched(spark: SparkSession, path: str, build: Callable[[], DataFrame], force: bool = False) -> DataFrame:
    """What build gives, written at path the first time and only read afterwards."""
    build().write.mode("overwrite" if force else "ignore").parquet(path)
    return spark.read.parquet(path)


def samples(spark: SparkSession, name: str) -> DataFrame:
    """Small built-in tables of sections of minutes: `minutes` (id, filename, mdate, rdate, section, text) or `speeches` (date, speaker, title, text, content_type)."""
    if name == "minutes":
        rows = [(i, "minutes_a", "2020-01-09 10:00:00", "2020-01-23 16:00:00", s, t) for i, (s, t) in enumerate([("opening", "위원회가 열렸다."), ("economy", "성장세가 이어졌다. 물가는 안정되었다."), ("markets", "금리는 내렸다."), ("views", "위원들은 의견을 나누었다."), ("decision", "기준금리를 유지하였다.")])]
        return spark.createDataFrame(rows, "id long, filename string, mdate string, rdate string, section string, text string")
    if name == "speeches":
        rows = [(f"2020-0{i + 1}-15", s, f"Meeting {i + 1}", t, "minutes") for i, (s, t) in enumerate([("Chair A", "Growth went on at a moderate pace."), ("Chair A", "Prices were stable.\nWages rose."), ("Chair B", "Markets were calm."), ("Chair B", "The outlook is uncertain."), ("Chair B", "Rates stay where they are.")])]
        return spark.createDataFrame(rows, "date string, speaker string, title string, text string, content_type string")
    raise KeyError(f"no sample table {name}")
