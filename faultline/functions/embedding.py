"""Default text embedder: hashed term counts, inverse document frequency, unit length.

A term's bucket comes from its md5, so that any engine can compute the same vectors. `pyspark.ml` does the work on the JVM. Any other embedder can take its place: an object with
`transform(df, text_col, out_col)`, for instance around a pandas UDF of a sentence model.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import IDF, CountVectorizerModel, Normalizer, RegexTokenizer, SQLTransformer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 256


def vector_text(vector: Column | str) -> Column:
    """A vector as text, in hundred-thousandths."""
    return F.array_join(F.transform(vector, lambda x: F.round(x.cast("double") * 100000).cast("bigint").cast("string")), ",")


class TermEmbedder:
    """Fitted embedder; the term weights are frozen so later texts land in the same space."""

    def __init__(self, model: PipelineModel):
        self.model = model

    @staticmethod
    def fit(df: DataFrame, text_col: str, dimensions: int = DIMENSIONS) -> "TermEmbedder":
        bucket = f"CAST(CAST(conv(substring(md5(w), 1, 8), 16, 10) AS BIGINT) % {dimensions} AS STRING)"
        stages = [
            RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}_]+"),
            SQLTransformer(statement=f"SELECT *, transform(_words, w -> {bucket}) AS _buckets FROM __THIS__"),
            CountVectorizerModel.from_vocabulary([str(i) for i in range(dimensions)], inputCol="_buckets", outputCol="_tf"),
            IDF(inputCol="_tf", outputCol="_idf"),
            Normalizer(inputCol="_idf", outputCol="_unit"),
        ]
        return TermEmbedder(Pipeline(stages=stages).fit(df.select(F.coalesce(text_col, F.lit("")).alias("_text"))))

    def transform(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        done = self.model.transform(df.withColumn("_text", F.coalesce(text_col, F.lit(""))))
        return done.withColumn(out_col, vector_to_array("_unit", "float32")).drop("_text", "_words", "_buckets", "_tf", "_idf", "_unit")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    @staticmethod
    def load(path: str) -> "TermEmbedder":
        return TermEmbedder(PipelineModel.load(path))


class CallableEmbedder:
    """Embedder around a function from a batch of texts to a batch of vectors."""

    def __init__(self, encode: Callable[[list[str]], list]):
        self.encode = encode

    def transform(self, df: DataFrame, text_col: str, out_col: str) -> DataFrame:
        encode = self.encode

        @F.pandas_udf("array<float>")
        def vectors(texts: pd.Series) -> pd.Series:
            return pd.Series([[float(x) for x in v] for v in encode(texts.fillna("").tolist())])

        return df.withColumn(out_col, vectors(F.col(text_col)))
