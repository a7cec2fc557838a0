"""Token budget per source, language and category (problem 2).

Each chunk is counted once. Two counts come out: ``n_tokens``, exact under the
existing tokenizer, and ``n_tokens_unigram``, the best-path length under its
vocabulary read as a unigram vocabulary (double-array trie, count-only Viterbi
per normalised segment). The tokenizers at hand are all of the BPE kind, so
the second count estimates the first; for a unigram tokenizer it is the count.

Scale. Counting is a map over Arrow batches; the slices are partial sums, so a
source with a third of all rows is summed in every task before the shuffle.

Cases. Null and empty texts count as chunks of 0 tokens. The language is the
text's own where script or frequent words tell, else the label; null where
neither does. Keys are clean; null keys form slices of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from heddle.llm.common import clean_key, clean_language, delivered_once, table
from heddle.llm.languages import detect
from heddle.llm.tokens import FOLDER, PIECES, DoubleArray, UnigramCounter, model_bytes, piece_counter, unigram_vocabulary  # noqa: F401


def count_tokens(df: DataFrame, text: str = "text", label: str = "lang", keep: tuple[str, ...] = (), folder: str = FOLDER, name: str = PIECES) -> DataFrame:
    """Kept columns, the language, n_tokens and n_tokens_unigram of each row."""
    model = model_bytes(name, folder)
    pieces = UnigramCounter(*unigram_vocabulary(model))
    types = dict(df.dtypes)
    schema = "".join(f"`{c}` {types[c]}, " for c in keep) + "language string, n_chars long, n_tokens long, n_tokens_unigram long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exact = piece_counter(model)
        for b in batches:
            texts = [t or "" for t in b["__text"]]
            out = b[list(keep)].copy()
            out["language"] = [detect(t, x) for t, x in zip(texts, b["__label"])]
            out["n_chars"] = [len(t) for t in texts]
            out["n_tokens"] = np.array(exact(texts), np.int64)
            out["n_tokens_unigram"] = pieces(texts)
            yield out

    return df.select(*keep, F.col(text).alias("__text"), clean_language(label).alias("__label")).mapInPandas(run, schema)


def p2_token_budget(spark: SparkSession, d: str) -> DataFrame:
    chunks = delivered_once(table(spark, d, "book_chunks").select("chunk_id", clean_key("source_id").alias("source_id"), "lang", "category", "text"), "chunk_id", ["source_id", "lang", "category", "text"])
    counted = count_tokens(chunks, keep=("source_id", "category"))
    return counted.groupBy("source_id", F.col("language").alias("lang"), "category").agg(
        F.count("*").alias("n_chunks"), F.sum("n_chars").alias("n_chars"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_tokens_unigram").alias("n_tokens_unigram")
    )


QUERIES = {"p2_token_budget": p2_token_budget}
