"""A training-data pipeline over `documents` in five stages, each an operator of weftline.llm.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next one's docs. All but the last return the columns of documents.

Defined cases: null, empty and blank texts are not toxic; of all of them one stays (they are equal without white space), which
has no near copies, takes no words in the mixture and so ends there; rows with a null doc_id go through like others; of rows alike in
doc_id and text one stays; an empty table gives an empty result with the same columns; extra columns are kept to the end. A document that
the mixture takes in several passes is a row for each, with one and the same sampled segmentation, as pieces are keyed by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import exact, mixing, near, pieces, toxicity
from weftline.llm.common import new_path, scope
from weftline.llm.queries import tokenizer_path


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is 0.7 or more go."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal without white space one stays."""
    return exact.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a similarity of 0.8 or more in five-word shingles the smallest id stays."""
    return near.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are taken to their target weights, whole passes and one cut document each, in training order."""
    return mixing.apply(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become sampled pieces, with the hash of what decoding gives back."""
    return pieces.encode(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: No SQL expresses a learned filter or sampled pieces; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = new_path(spark, f"pipeline-{name}")
        with scope(spark):  # a stage's own tables go once its result is written
            docs_after = stage(spark, docs, sf_dir)
            docs_after.write.option("compression", "zstd").parquet(path)
        docs = spark.read.schema(docs_after.schema).parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
