"""Exact vector search of a stated query set."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, functions as F

from heddle.operators.ranking import top_k
from heddle.sources.files import scratch

QUERY_BLOCK = 4096


def search(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, within: str | None = None) -> DataFrame:
    """(query_id, key, score, rank): the k rows of largest dot product for each query, itself left out.

    With ``within`` the k best of each of its values, which is added. A block of
    queries is sent with the tasks; a task multiplies a batch by it and keeps
    the k best of each query, ties by key. Null vectors match nothing. Scores
    have six decimals. Where one block is not enough, each is a job of its own
    that adds to a table in the shared folder, so that the driver never holds
    more than QUERY_BLOCK vectors.
    """
    spark = queries.sparkSession
    extra = [within] if within else []
    fields = f"query_id {dict(queries.dtypes)[key]}, `{key}` {dict(rows.dtypes)[key]}, score double" + "".join(f", `{c}` {dict(rows.dtypes)[c]}" for c in extra)
    group = ["query_id", *extra]
    out: str | None = None
    held: list[Row] = []
    for r in queries.filter(F.col(vector).isNotNull()).select(key, vector).toLocalIterator():
        if len(held) == QUERY_BLOCK:
            out = out or scratch(spark, "search")
            _block(held, rows, key, vector, k, extra, fields).write.mode("append").parquet(out)
            held = []
        held.append(r)
    if not held:
        return spark.createDataFrame([], fields + ", rank int")
    found = _block(held, rows, key, vector, k, extra, fields)
    if out:
        found.write.mode("append").parquet(out)
        found = spark.read.schema(found.schema).parquet(out)
    return top_k(found, group, "score", key, k)


def _block(held: list[Row], rows: DataFrame, key: str, vector: str, k: int, extra: list[str], fields: str) -> DataFrame:
    ids = np.array([r[0] for r in held])
    matrix = np.array([r[1] for r in held], np.float64)

    def best(own: np.ndarray, vectors: np.ndarray) -> pd.DataFrame:
        scores = np.round(matrix @ vectors.T, 6)
        scores[ids[:, None] == own[None, :]] = -np.inf
        if scores.shape[1] > k:
            least = np.partition(scores, scores.shape[1] - k, axis=1)[:, -k]
            q, o = np.nonzero(scores >= least[:, None])  # k of each query, and what ties with the last
        else:
            q, o = (x.ravel() for x in np.indices(scores.shape))
        found = pd.DataFrame({"query_id": ids[q], key: own[o], "score": scores[q, o]})
        found = found[found.score > -np.inf].sort_values(["query_id", "score", key], ascending=[True, False, True])
        return found.groupby("query_id").head(k)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[b[vector].notna()]
            if b.empty:
                continue
            for value, part in b.groupby(extra[0]) if extra else [(None, b)]:
                found = best(part[key].to_numpy(), np.stack(part[vector].to_numpy()).astype(np.float64))
                yield found.assign(**{extra[0]: value}) if extra else found

    return rows.select(key, vector, *extra).mapInPandas(run, fields)
