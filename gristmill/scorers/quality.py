"""A learned quality score: hashed words and pairs of words, logistic regression."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, NGram, RegexTokenizer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T
from gristmill.operators import measures


def labels(table: DataFrame, low: int = 1, high: int = 3, limit: int = 20_000) -> DataFrame:
    """``rec_id, label`` of clear labels, at most ``limit`` of them, by hash."""
    l = table.where("llm_score IS NOT NULL").groupBy("rec_id").agg(F.max("llm_score").alias("s"))  # noqa: E741
    return l.where((F.col("s") >= high) | (F.col("s") <= low)).select("rec_id", (F.col("s") >= high).cast("double").alias("label")).orderBy(measures.hash_order(44, "rec_id"), "rec_id").limit(limit)


def train(labelled: DataFrame, text_col: str = "text", features: int = 1 << 14) -> PipelineModel:
    """Fits the model on whole texts, as they are scored."""
    stages = [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+"), NGram(n=2, inputCol="_w", outputCol="_g"),
        HashingTF(inputCol="_w", outputCol="_f1", numFeatures=features, binary=True), HashingTF(inputCol="_g", outputCol="_f2", numFeatures=features, binary=True),
        VectorAssembler(inputCols=["_f1", "_f2"], outputCol="features"), LogisticRegression(regParam=0.01, maxIter=30),
    ]
    return Pipeline(stages=stages).fit(labelled.withColumn("_t", T.text_of(F.col(text_col))))


def score(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    rows = df.withColumn("_t", T.text_of(F.col(text_col)))
    return model.transform(rows).withColumn("score", vector_to_array("probability")[1])
