"""Lexical search: terms, BM25 statistics and scores of a stated query set.

Only terms that some query has leave a row of the corpus: each row's terms are
exploded against the queries' terms, which are broadcast while they are few,
and counted per row. What is shuffled is the hits, not the corpus. Scores are
added up where a row's hits are: the queries' terms go to them, never the hits
to the driver, whatever their Parquet files shrink to.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from heddle.session import observed, settle, small

MOST_TERMS = 200_000  # terms of the queries that are sent to every task; beyond it they are joined


def terms_of(c: Column) -> Column:
    """Lower-case words of spaced scripts, and three-letter pieces of the rest."""
    t = F.lower(c)
    words = F.regexp_extract_all(t, F.lit(r"([a-zà-ÿ0-9]+)"), F.lit(1))
    rest = F.regexp_replace(t, r"[a-zà-ÿ0-9\s\p{P}\p{S}]+", "")
    # a look-ahead finds overlapping pieces in one pass; a lambda over positions would evaluate ``rest`` for each
    pieces = F.regexp_extract_all(rest, F.lit(r"(?s)(?=(...))"), F.lit(1))
    return F.concat(words, pieces)


class Hits(NamedTuple):
    """Terms that rows share with queries: ``met`` (key, term, size, tf), ``asked`` (query, term), rows and their mean size."""

    met: DataFrame
    asked: DataFrame
    n: int
    mean_size: float
    key: str
    query: str


def hits(queries: DataFrame, query: str, query_text: str, df: DataFrame, key: str, text: str) -> Hits:
    """One pass over the texts: hits are counted and written, rows and sizes observed on the way. Texts without a term are left out."""
    asked = queries.select(query, F.explode(F.array_distinct(terms_of(F.col(query_text)))).alias("term"))
    wanted = small(asked.select("term").distinct(), MOST_TERMS)
    rows = df.filter(F.col(text).isNotNull()).select(key, terms_of(F.col(text)).alias("terms")).withColumn("size", F.size("terms")).filter("size > 0")
    rows, seen = observed(rows, n=F.count(F.lit(1)), total=F.sum("size"))
    met = rows.select(key, "size", F.explode("terms").alias("term")).join(wanted, "term", "left_semi").groupBy(key, "term", "size").agg(F.count("*").alias("tf"))
    met = settle(met)
    taken = seen()
    n, total = taken["n"] or 0, taken["total"] or 0
    return Hits(met, asked, n, total / n if n else 0.0, key, query)


def idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def term_frequencies(df: DataFrame, key: str, text: str) -> DataFrame:
    """(term, df) of a whole corpus: terms are made distinct within the row, then counted."""
    rows = df.filter(F.col(text).isNotNull()).select(F.explode(F.array_distinct(terms_of(F.col(text)))).alias("term"))
    return rows.groupBy("term").agg(F.count("*").alias("df"))


def _met_queries(h: Hits, asked: DataFrame) -> DataFrame:
    """Hits with the rows of ``asked`` (query, term, ...) of their terms.

    While ``asked`` is small it is sent to the hits, which lie by key: what is
    summed by query and key needs no further shuffle. The hits themselves must
    not be broadcast, though their files may seem small enough.
    """
    return h.met.repartition(h.key).hint("merge").join(small(settle(asked), MOST_TERMS), "term")


def _bm25_part(h: Hits, k1: float, b: float) -> Column:
    return idf(F.lit(h.n), F.col("df")) * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("size") / F.lit(h.mean_size)))


def _frequencies(h: Hits) -> DataFrame:
    """(term, df) of the queries' terms."""
    return h.met.groupBy("term").agg(F.count("*").alias("df"))


def bm25(h: Hits, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score) of all rows that share a term with a query."""
    met = _met_queries(h, h.asked.join(_frequencies(h), "term"))
    return met.groupBy(h.query, h.key).agg(F.round(F.sum(_bm25_part(h, k1, b)), 6).alias("score"))


def scores(h: Hits, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """(query, key, score, overlap): what ``bm25`` and ``overlaps`` give, whose rows are the same, in one pass over the hits."""
    n = h.asked.groupBy(h.query).agg(F.count("*").alias("n"))
    met = _met_queries(h, h.asked.join(_frequencies(h), "term").join(n, h.query))
    both = met.groupBy(h.query, h.key, "n").agg(F.round(F.sum(_bm25_part(h, k1, b)), 6).alias("score"), F.count("*").alias("hits"))
    return both.select(h.query, h.key, "score", F.round(F.col("hits") / F.col("n"), 6).alias("overlap"))


def self_scores(h: Hits, k1: float = 1.5) -> DataFrame:
    """(query, best): the score of a text of mean size that holds each of the query's terms once, to scale scores by."""
    known = h.asked.join(_frequencies(h), "term", "left").fillna(0, ["df"])
    return known.groupBy(h.query).agg(F.round(F.sum(idf(F.lit(h.n), F.col("df"))), 6).alias("best"))


def overlaps(h: Hits) -> DataFrame:
    """(query, key, score): the share of a query's distinct terms that a row has; only rows with a term in common."""
    n = h.asked.groupBy(h.query).agg(F.count("*").alias("n"))
    met = _met_queries(h, h.asked.join(n, h.query)).groupBy(h.query, h.key, "n").agg(F.count("*").alias("hits"))
    return met.select(h.query, h.key, F.round(F.col("hits") / F.col("n"), 6).alias("score"))
