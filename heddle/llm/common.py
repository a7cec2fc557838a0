"""What the text operators share."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from heddle.operators.references import clean_key
from heddle.session import settle, table

__all__ = ["clean_key", "settle", "table", "clean_language", "delivered_once", "even"]

LANGUAGES = {  # fixed values: ISO 639-2 codes of the six languages
    "tha": "th", "eng": "en", "fra": "fr", "fre": "fr", "deu": "de", "ger": "de", "zho": "zh", "chi": "zh", "jpn": "ja",
}


def clean_language(column: Column | str) -> Column:
    """Two-letter language of codes such as ``th-TH``, ``en_US``, ``deu``, ``ZH``; null stays null."""
    c = F.col(column) if isinstance(column, str) else column
    head = F.lower(F.regexp_extract(c, r"^\s*([A-Za-z]+)", 1))
    named = F.coalesce(*[F.when(head == k, F.lit(v)) for k, v in LANGUAGES.items()], head)
    return F.when(head != "", named)


def delivered_once(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per clean key. Rows delivered again agree; should they not, the largest value of a struct of all wins.

    A partial aggregate, so that many deliveries of one key shrink before the shuffle.
    """
    k = clean_key(key)
    rest = [c for c in columns if c != key]
    return (
        df.select(k.alias(key), F.struct(*rest).alias("__r"))
        .filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.max("__r").alias("__r"))
        .select(key, *[F.col("__r")[c].alias(c) for c in rest])
    )


def even(df: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """Spread rows over all cores before Python work of uneven size."""
    return df.repartition((spark or df.sparkSession).sparkContext.defaultParallelism * 4)


def frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        if len(b):
            yield b
