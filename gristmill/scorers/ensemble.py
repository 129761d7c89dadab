"""Learned classifiers over words: weighted pairs of words with a logistic regression, and a second one for evaluation only."""
from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, HashingTF, NGram, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions import text as T

#: The words and pairs that are kept, and the least number of texts that one must stand in.
VOCABULARY, MIN_DOCS = 10_000, 3


def _tokens(out: str) -> list:
    return [
        RegexTokenizer(inputCol="_t", outputCol="_w", pattern=r"\W+", minTokenLength=2), NGram(n=2, inputCol="_w", outputCol="_g"),
        SQLTransformer(statement=f"SELECT *, concat(_w, _g) AS {out} FROM __THIS__"),
    ]


class Weighted:
    """Counts of words and pairs as ``(1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)``, at length 1, and a logistic regression over them.

    The inverse frequencies, one number for each of VOCABULARY terms, are folded into the
    coefficients' features by scaling, which a fitted vector of that bounded size holds.
    """

    def __init__(self, counts: PipelineModel, idf: list[float], model):
        self.counts, self.idf, self.model = counts, idf, model

    @staticmethod
    def _weighted(df: DataFrame, idf: list[float]) -> DataFrame:
        from pyspark.ml.linalg import SparseVector, VectorUDT

        shared = df.sparkSession.sparkContext.broadcast(idf)  # VOCABULARY numbers

        @F.udf(VectorUDT())
        def scaled(v):
            import math

            vals = [(1 + math.log(x)) * shared.value[i] for i, x in zip(v.indices, v.values)]
            norm = math.sqrt(sum(x * x for x in vals)) or 1.0
            return SparseVector(v.size, v.indices, [x / norm for x in vals])

        return df.withColumn("features", scaled("_c"))

    @classmethod
    def fit(cls, labelled: DataFrame, text_col: str = "text") -> "Weighted":
        """Fits on ``label`` and whole texts of ``labelled``."""
        rows = labelled.withColumn("_t", T.text_of(F.col(text_col)))
        counts = Pipeline(stages=[*_tokens("_all"), CountVectorizer(inputCol="_all", outputCol="_c", vocabSize=VOCABULARY, minDF=MIN_DOCS)]).fit(rows)
        counted = counts.transform(rows).select("label", "_c")
        n = counted.count()
        from pyspark.ml.stat import Summarizer

        df = counted.select(Summarizer.numNonZeros(F.col("_c")).alias("d")).first()["d"].toArray()
        import numpy as np

        idf = (np.log((1 + n) / (1 + df)) + 1).tolist()
        model = LogisticRegression(regParam=1.0 / max(n, 1), maxIter=200, standardization=False).fit(cls._weighted(counted, idf).select("label", "features"))
        return cls(counts, idf, model)

    def score(self, df: DataFrame, text_col: str = "text") -> DataFrame:
        rows = self._weighted(self.counts.transform(df.withColumn("_t", T.text_of(F.col(text_col)))), self.idf)
        out = self.model.transform(rows).withColumn("score", vector_to_array("probability")[1])
        return out.select(*df.columns, "score")


def evaluation_classifier(labelled: DataFrame, text_col: str = "text", features: int = 1 << 15) -> PipelineModel:
    """A classifier that never filters: words, pairs and triples, hashed, with another regularisation; to be trained on positives that no filter saw."""
    stages = [
        *_tokens("_wg"), NGram(n=3, inputCol="_w", outputCol="_h"), SQLTransformer(statement="SELECT *, concat(_wg, _h) AS _all FROM __THIS__"), HashingTF(inputCol="_all", outputCol="_f", numFeatures=features),
        Normalizer(inputCol="_f", outputCol="features"), LogisticRegression(regParam=0.001, maxIter=50),
    ]
    return Pipeline(stages=stages).fit(labelled.withColumn("_t", T.text_of(F.col(text_col))))


def evaluation_scores(model: PipelineModel, df: DataFrame, text_col: str = "text") -> DataFrame:
    return model.transform(df.withColumn("_t", T.text_of(F.col(text_col)))).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score")
