"""A user's model as a function over batches of texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def score_pairs(pairs: DataFrame, score: Callable[[list[str], list[str]], list[float]], batch: int = 10) -> DataFrame:
    """``pairs`` (query_id, chunk_id, query, content) with rerank_score; ``score`` gets up to ``batch`` pairs at once."""

    def run(frames):
        for frame in frames:
            values = [v for i in range(0, len(frame), batch) for v in score(frame["query"].iloc[i : i + batch].tolist(), frame["content"].iloc[i : i + batch].tolist())]
            yield frame[["query_id", "chunk_id"]].assign(rerank_score=values)

    types = dict(pairs.dtypes)
    return pairs.mapInPandas(run, f"query_id {types['query_id']}, chunk_id {types['chunk_id']}, rerank_score double")


def embed(texts: DataFrame, model: Callable[[list[str]], list[list[float]]], key: str, column: str, batch: int = 10) -> DataFrame:
    """(key, vector) of the texts; ``model`` gets up to ``batch`` texts at once."""

    def run(frames):
        for frame in frames:
            vectors = [v for i in range(0, len(frame), batch) for v in model(frame[column].iloc[i : i + batch].tolist())]
            yield frame[[key]].assign(vector=vectors)

    return texts.select(key, F.coalesce(column, F.lit("")).alias(column)).mapInPandas(run, f"{key} {dict(texts.dtypes)[key]}, vector array<double>")
