"""Models on top of pyspark.ml: topics, word vectors, cross-validation, model search, impulse responses."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import LDA
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, CountVectorizer, VectorAssembler, Word2Vec
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.operators.sampling import kfold
from weftline.plans.registry import op
from weftline.plans.tables import written



def topic_tokens(df: DataFrame, tokens: str, stopwords: Sequence[str] = (), min_chars: int = 2, min_words: int = 6) -> DataFrame:
    """Documents of at least min_words words that are long enough and no stop words."""
    stop = F.array(*[F.lit(w) for w in stopwords]).cast("array<string>")
    kept = F.filter(tokens, lambda w: (F.length(w) >= min_chars) & ~F.array_contains(stop, w))
    return df.withColumn(tokens, kept).where(F.size(tokens) >= min_words)


class TopicModel:
    """LDA over token arrays."""

    def __init__(self, k: int = 10, max_vocabulary: int = 20_000, iterations: int = 20, seed: int = 1):
        self.lda = LDA(k=k, maxIter=iterations, seed=seed, featuresCol="__counts")
        self.size, self.k = max_vocabulary, k

    def fit(self, df: DataFrame, tokens: str) -> TopicModel:
        self.tokens = tokens
        self.counts = CountVectorizer(inputCol=tokens, outputCol="__counts", vocabSize=self.size, minDF=2).fit(df)
        # Written: every iteration reads its documents again, which would cut and count all texts each time.
        self.model = self.lda.fit(written(self.counts.transform(df).select("__counts"), "topic-counts"))
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        """Columns topic0 ... of each document's shares, and topic, the largest."""
        out = self.model.transform(self.counts.transform(df)).withColumn("__t", vector_to_array("topicDistribution"))
        shares = {f"topic{i}": F.col("__t")[i] for i in range(self.k)}
        return out.withColumns(shares).withColumn("topic", F.array_position("__t", F.array_max("__t")) - 1).drop("__t", "__counts", "topicDistribution")

    def words(self, n: int = 10) -> DataFrame:
        """(topic, rank, word, weight)."""
        found, vocabulary = self.model.describeTopics(n), self.counts.vocabulary
        rows = [(t["topic"], rank, vocabulary[i], w) for t in found.collect() for rank, (i, w) in enumerate(zip(t["termIndices"], t["termWeights"], strict=True))]
        return found.sparkSession.createDataFrame(rows, "topic int, rank int, word string, weight double")

    def log_likelihood_per_word(self, df: DataFrame) -> float:
        counted = self.counts.transform(df)
        words = counted.select(F.sum(F.aggregate(vector_to_array("__counts"), F.lit(0.0), lambda a, x: a + x)).alias("n")).first()["n"]
        return self.model.logLikelihood(counted) / words


def word_vectors(df: DataFrame, tokens: str, size: int = 50, min_count: int = 5, seed: int = 1) -> DataFrame:
    """(word, vector array<double>)."""
    model = Word2Vec(vectorSize=size, minCount=min_count, inputCol=tokens, outputCol="__v", seed=seed, numPartitions=max(1, df.rdd.getNumPartitions())).fit(df)
    return model.getVectors().select("word", vector_to_array("vector").alias("vector"))


def reduced(df: DataFrame, vector: str, k: int = 2) -> DataFrame:
    """The first k principal components of an array column, in the column `components`."""
    from pyspark.ml.functions import array_to_vector

    rows = df.withColumn("__v", array_to_vector(F.col(vector).cast("array<double>")))
    return PCA(k=k, inputCol="__v", outputCol="__p").fit(rows).transform(rows).withColumn("components", vector_to_array("__p")).drop("__v", "__p")


def assembled(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """(features vector, label) of complete rows."""
    return VectorAssembler(inputCols=list(features), outputCol="features").transform(df.dropna(subset=[*features, label])).select("features", F.col(label).cast("double").alias("label"))


def search(df: DataFrame, estimators: Sequence[tuple], folds: int = 3, metric: str = "f1", seed: int = 1):
    """The best fitted model over (estimator, {parameter name: values}) pairs by cross-validation; (score, model)."""
    evaluator = MulticlassClassificationEvaluator(metricName=metric)
    best = None
    for estimator, grid in estimators:
        builder = ParamGridBuilder()
        for name, values in grid.items():
            builder = builder.addGrid(estimator.getParam(name), list(values))
        fitted = CrossValidator(estimator=estimator, estimatorParamMaps=builder.build(), evaluator=evaluator, numFolds=folds, seed=seed, parallelism=2).fit(df)
        score = max(fitted.avgMetrics)
        if best is None or score > best[0]:
            best = (score, fitted.bestModel)
    return best


def cross_predictions(df: DataFrame, estimator, key: str, folds: int = 5, seed: int = 1) -> DataFrame:
    """Every row predicted by a model that was fitted without its fold."""
    parts = kfold(df, folds, key, seed)
    out = None
    for k in range(folds):
        found = estimator.fit(parts.where(F.col("fold") != k)).transform(parts.where(F.col("fold") == k))
        out = found if out is None else out.unionByName(found)
    return out


def impulse_response(series: DataFrame, columns: Sequence[str], order_by: str, lags: int = 4, horizon: int = 12, shock: int = 0, by: str | None = None) -> DataFrame:
    """(group, step, variable, response) of a vector autoregression by least squares and a Cholesky shock; a group's series is gathered, one small series a task."""
    names = list(columns)

    def run(key, frame):
        import pandas as pd

        x = frame.sort_values(order_by)[names].to_numpy(float)
        n, k = x.shape
        if n <= lags * k + lags + 1:
            return pd.DataFrame({"group": [], "step": [], "variable": [], "response": []})
        z = np.hstack([np.ones((n - lags, 1)), *[x[lags - i : n - i] for i in range(1, lags + 1)]])
        beta = np.linalg.lstsq(z, x[lags:], rcond=None)[0]
        errors = x[lags:] - z @ beta
        impact = np.linalg.cholesky(errors.T @ errors / (n - lags - z.shape[1]))[:, shock]
        a = [beta[1 + i * k : 1 + (i + 1) * k].T for i in range(lags)]
        path = [impact]
        for _ in range(horizon):
            path.append(sum(a[i] @ path[-1 - i] for i in range(min(lags, len(path)))))
        return pd.DataFrame([(str(key[0]), s, v, float(r)) for s, p in enumerate(path) for v, r in zip(names, p, strict=True)], columns=["group", "step", "variable", "response"])

    rows = series.dropna(subset=names).withColumn("__g", F.col(by).cast("string") if by else F.lit("all"))
    return rows.select("__g", order_by, *names).groupBy("__g").applyInPandas(run, "group string, step int, variable string, response double")


@op("predict")
def predict(df: DataFrame, model, columns: Sequence[str] | None = None, rename: dict[str, str] | None = None) -> DataFrame:
    """df with a model's predictions: a fitted model's `transform`, or a function of a DataFrame; of its new columns those named (default: all), renamed.

    Columns that df has already stay df's own; a name that the model does not give is refused.
    """
    found = model.transform(df) if hasattr(model, "transform") else model(df)
    new = [c for c in found.columns if c not in df.columns]
    missing = sorted(set(columns or ()) - set(new))
    if missing:
        raise KeyError(f"the model gives no {', '.join(missing)}")
    names = rename or {}
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c in found.columns], *[F.col(f"`{c}`").alias(names.get(c, c)) for c in (columns or new)])
