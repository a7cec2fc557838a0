"""Per-document text quality statistics (problem 10).

``document_statistics`` computes the statistics of every text. ``tail_table``
gives every value of every statistic its exact rank within its language and
within all languages, as the share of distinct texts with a value at least (at
most) as large: values are counted, the distinct ones sorted by range
partitions, and running counts become ranks once each partition's offset is
added. ``outlier_scores`` adds the surprise -ln(tail) of all statistics, of the
language or of all together, whichever is more, in two rounds: first against
all distinct texts, then against those that were calm (at most CALM) in the
first, so that junk does not hide behind other junk, nor copies behind copies.

A document is found if it is an outlier (score at least OUTLIER) and, checked
exactly, at most half of its visible characters stand in prose.

Scale. One map over the texts; everything after it works on a narrow table of
numbers written once. Statistics have four decimals, so a language has a
bounded number of distinct values per statistic, however many documents there
are; counting before sorting also means that a value which a third of all
documents share is one row. The table of tails is bounded by languages x
statistics x values, is checked against MAX_TABLE, and is joined instead of
shipped beyond it.

Cases. Null and empty texts hold no prose: their ratios are 1 and they are
reported. Ties share a tail. A language is the text's own, else the label. A
text that occurs many times counts once as reference; every document is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from heddle.llm.common import clean_language, settle, table
from heddle.llm.languages import detect
from heddle.llm.prose import STATISTICS, statistics

KNOWN = ("th", "en", "fr", "de", "zh", "ja")
ALL = "*"  # all languages together
MAX_TABLE = 2_000_000
FLOOR = 1e-4  # a tail counts as no rarer, however many documents there are
CALM, OUTLIER = 8.0, 18.0


def document_statistics(df: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(key, language, same, n_words, the STATISTICS); equal texts agree in ``same``."""
    names = ("n_words", *STATISTICS)
    schema = f"`{key}` {dict(df.dtypes)[key]}, language string, same long, " + ", ".join(f"{s} double" for s in names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [statistics(t) for t in b["__text"]]
            lang = [detect(t, x) for t, x in zip(b["__text"], b["__label"])]
            out = pd.DataFrame({key: b[key], "language": [x if x in KNOWN else "other" for x in lang], "same": b["__same"]})
            for s in names:
                out[s] = [r[s] for r in rows]
            yield out

    return df.select(key, F.col(text).alias("__text"), clean_language(label).alias("__label"), F.xxhash64(text).alias("__same")).mapInPandas(run, schema)


def _long(df: DataFrame, names: tuple[str, ...], *keep: str | Column) -> DataFrame:
    return df.select(*keep, F.explode(F.map_from_arrays(F.array(*[F.lit(n) for n in names]), F.array(*names))).alias("statistic", "value"))


def tail_table(stats: DataFrame, names: tuple[str, ...] = STATISTICS, weight: str | None = None) -> DataFrame:
    """(language, statistic, value, n, at_most, at_least): exact shares of the language's rows, or of their weights (0 or 1)."""
    one = F.lit(1) if weight is None else F.col(weight)
    counted = _long(stats, names, "language", one.alias("__w")).groupBy("language", "statistic", "value").agg(F.sum("__w").cast("long").alias("n"))
    place = ["language", "statistic", "value"]
    parts = max(4, int(stats.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(counted.repartitionByRange(parts, *place).sortWithinPartitions(*place).withColumn("part", F.spark_partition_id()))
    group = ["language", "statistic"]
    inside = F.sum("n").over(W.partitionBy("part", *group).orderBy("value").rowsBetween(W.unboundedPreceding, 0))
    sums = ranged.groupBy("part", *group).agg(F.sum("n").alias("part_n"))
    before = W.partitionBy(*group).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("part", *group, F.coalesce(F.sum("part_n").over(before), F.lit(0)).alias("offset"), F.sum("part_n").over(W.partitionBy(*group)).alias("total"))
    ranks = ranged.withColumn("inside", inside).join(F.broadcast(offsets), ["part", *group])  # at most partitions + groups rows
    upto = F.col("inside") + F.col("offset")
    share = lambda n: F.when(F.col("total") > 0, n / F.col("total")).otherwise(F.lit(1.0))
    return ranks.select(*place, "n", share(upto).alias("at_most"), share(F.col("total") - upto + F.col("n")).alias("at_least"))


def _score(rows: DataFrame, tails: DataFrame, names: tuple[str, ...], key: str) -> DataFrame:
    """``rows`` with ``score``: the larger of the sums of surprises in the language and in ALL."""
    two = F.least(F.lit(1.0), 2 * F.least("at_most", "at_least"))
    tail = F.greatest(F.lit(FLOOR), F.when(F.col("statistic") == "mean_word_length", two).otherwise(F.col("at_least")))
    lookup = settle(tails.select("language", "statistic", "value", (-F.log(tail)).alias("surprise")))
    if lookup.count() <= MAX_TABLE:
        arrays = {g: (v["value"].to_numpy(), v["surprise"].to_numpy()) for g, v in lookup.toPandas().sort_values("value").groupby(["language", "statistic"])}

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            def of(b: pd.DataFrame, lang: str) -> np.ndarray:
                total = np.zeros(len(b))
                for s in names:
                    values, surprises = arrays[(lang, s)]
                    total += surprises[np.searchsorted(values, b[s].to_numpy())]
                return total

            for b in batches:
                score = of(b, ALL) if len(b) else np.zeros(0)
                for lang, at in b.groupby("language").indices.items():
                    score[at] = np.maximum(score[at], of(b.iloc[at], lang))
                yield b.assign(score=np.round(score, 6))

        return rows.mapInPandas(run, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes) + ", score double")
    long = _long(rows.withColumn("language", F.explode(F.array("language", F.lit(ALL)))), names, key, "language")
    scores = long.join(lookup, ["language", "statistic", "value"]).groupBy(key, "language").agg(F.sum("surprise").alias("s")).groupBy(key).agg(F.round(F.max("s"), 6).alias("score"))
    return rows.join(scores, key)


def outlier_scores(stats: DataFrame, key: str = "doc_id", names: tuple[str, ...] = STATISTICS) -> DataFrame:
    """The statistics with ``score``, of all rows, against the calm distinct texts; two-sided for mean_word_length."""
    both = F.explode(F.array("language", F.lit(ALL))).alias("language")
    texts = stats.groupBy("language", "same").agg(F.first(F.struct(*names)).alias("r")).select("language", F.xxhash64("same", "language").alias("same"), "r.*")  # equal texts have equal statistics
    texts = settle(texts)
    first = _score(texts, tail_table(texts.select(both, *names), names), names, "same")
    calm = settle(first.withColumn("calm", (F.col("score") <= CALM).cast("int")).drop("score"))
    return _score(stats, tail_table(calm.select(both, *names, "calm"), names, "calm"), names, key)


def _scored(spark: SparkSession, d: str) -> DataFrame:
    return outlier_scores(settle(document_statistics(table(spark, d, "documents").select("doc_id", "text", "lang"))))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are outliers and hold no prose for their greater part, the most unusual first."""
    return _scored(spark, d).filter(f"score >= {OUTLIER} and no_prose_share >= 0.5").orderBy(F.desc("score"), "doc_id").select("doc_id")


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    return _scored(spark, d).drop("same")


QUERIES = {"p10_found": p10_found, "p10_statistics": p10_statistics}
