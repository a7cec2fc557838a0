"""Ranks, fusion, caps, packing and ranking metrics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from heddle.session import settle, small

MOST_OFFSETS = 1_000_000  # rows of offsets (partitions and groups) that are sent to every task; beyond it they are joined


def rank_by(df: DataFrame, group: Sequence[str], score: str, key: str, name: str = "rank") -> DataFrame:
    """1-based rank by falling score, then key."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*group).orderBy(F.desc(score), key)))


def top_k(df: DataFrame, group: Sequence[str], score: str, key: str, k: int, name: str = "rank") -> DataFrame:
    """Spark keeps k rows per group and task before the shuffle (WindowGroupLimit), so a hot group stays small."""
    return rank_by(df, group, score, key, name).filter(F.col(name) <= k)


def rank_all(df: DataFrame, group: Sequence[str], score: str, key: str, name: str = "rank") -> DataFrame:
    """The ranks of ``rank_by`` for complete lists: a group is ranked in range partitions, each offset by the rows before it."""
    place = [*group, F.desc(score), key]
    parts = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(df.repartitionByRange(parts, *place).sortWithinPartitions(*place).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *group).agg(F.count("*").alias("__n"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__part", *group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))  # at most partitions + groups rows
    inside = F.row_number().over(W.partitionBy("__part", *group).orderBy(F.desc(score), key))
    ranks = ranged.withColumn(name, inside).join(small(offsets, MOST_OFFSETS), ["__part", *group])
    return ranks.withColumn(name, (F.col(name) + F.col("__before")).cast("int")).select(*df.columns, name)


def min_max(df: DataFrame, group: Sequence[str], score: str, name: str) -> DataFrame:
    """Scores scaled to 0..1 within the group; 0.5 where all are equal. Bounds come from a partial aggregate, not a window."""
    bounds = df.groupBy(*group).agg(F.min(score).alias("__lo"), F.max(score).alias("__hi"))
    scaled = F.when(F.col("__hi") > F.col("__lo"), (F.col(score) - F.col("__lo")) / (F.col("__hi") - F.col("__lo"))).otherwise(F.lit(0.5))
    return df.join(bounds, list(group)).withColumn(name, scaled).drop("__lo", "__hi")


def reciprocal_rank_fusion(a: DataFrame, b: DataFrame, group: Sequence[str], key: str, k: int = 60) -> DataFrame:
    """(group, key, score): 1/(k+rank) of both systems; what one lacks has the rank after the last of the union.

    Inputs carry ``rank``.
    """
    both = a.select(*group, key, F.col("rank").alias("ra")).join(b.select(*group, key, F.col("rank").alias("rb")), [*group, key], "full_outer")
    worst = both.groupBy(*group).agg((F.count("*") + 1).alias("worst"))
    part = [1 / (k + F.coalesce(F.col(r), F.col("worst"))) for r in ("ra", "rb")]
    return both.join(worst, list(group)).select(*group, key, (part[0] + part[1]).alias("score"))


def weighted_reciprocal_ranks(lists: Sequence[DataFrame], weights: Sequence[float], group: Sequence[str], key: str, k: int, constant: int = 60) -> DataFrame:
    """(group, key, score, rank): the k largest sums of weight / (constant + rank), five places.

    A list that lacks a key adds nothing. Ties keep the order in which the keys
    were first seen, list after list. The lists carry ``rank``.
    """
    parts = [x.select(*group, key, F.lit(n).alias("__l"), "rank", (w / (constant + F.col("rank"))).alias("__s")) for n, (x, w) in enumerate(zip(lists, weights))]
    both = reduce(DataFrame.unionByName, parts)
    fused = both.groupBy(*group, key).agg(F.round(F.sum("__s"), 5).alias("score"), F.min(F.struct("__l", "rank")).alias("__first"))
    place = F.row_number().over(W.partitionBy(*group).orderBy(F.desc("score"), "__first"))
    return fused.withColumn("rank", place).filter(F.col("rank") <= k).drop("__first")


def weighted_fusion(a: DataFrame, b: DataFrame, group: Sequence[str], key: str, alpha: float) -> DataFrame:
    """alpha x scaled score of a + (1 - alpha) x scaled score of b; a missing one counts 0. Inputs carry ``score``."""
    x = min_max(a.select(*group, key, "score"), group, "score", "sa").drop("score")
    y = min_max(b.select(*group, key, "score"), group, "score", "sb").drop("score")
    fused = alpha * F.coalesce("sa", F.lit(0.0)) + (1 - alpha) * F.coalesce("sb", F.lit(0.0))
    return x.join(y, [*group, key], "full_outer").select(*group, key, fused.alias("score"))


def cap_per_source(df: DataFrame, group: Sequence[str], source: str, order: Sequence[Column], cap: int) -> DataFrame:
    return df.withColumn("__n", F.row_number().over(W.partitionBy(*group, source).orderBy(*order))).filter(F.col("__n") <= cap).drop("__n")


def cap_with_refill(df: DataFrame, group: Sequence[str], source: str, rank: str, cap: int, k: int) -> DataFrame:
    """k rows per group: at most ``cap`` of a source while others last, the rest refilled in order of rank; adds ``pos``.

    The refill comes from the first k of the group: of those, all that are not
    among the first ``cap`` of their source suffice. Both parts are limits, which
    Spark applies before the shuffle.
    """
    n = F.row_number().over(W.partitionBy(*group, source).orderBy(rank))
    early = df.withColumn("__n", n).filter(F.col("__n") <= cap)
    first = df.withColumn("__k", F.row_number().over(W.partitionBy(*group).orderBy(rank))).filter(F.col("__k") <= k).drop("__k")
    late = first.withColumn("__n", n).filter(F.col("__n") > cap)
    pos = F.row_number().over(W.partitionBy(*group).orderBy(F.col("__n") > cap, rank))
    return early.unionByName(late).withColumn("pos", pos).filter(F.col("pos") <= k).drop("__n")


def greedy_budget(items: Column, budget: int) -> Column:
    """Items (structs with ``id`` and ``cost``) taken in order as long as they fit: one too large is skipped, later ones may fit."""
    empty = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("kept"))

    def take(acc: Column, x: Column) -> Column:
        fits = acc["used"] + x["cost"] <= budget
        return F.when(fits, F.struct((acc["used"] + x["cost"]).alias("used"), F.concat(acc["kept"], F.array(x["id"])).alias("kept"))).otherwise(acc)

    return F.aggregate(items, empty, take, lambda acc: acc["kept"])


def order_statistics(df: DataFrame, group: Sequence[str], value: str, wanted: DataFrame) -> DataFrame:
    """(group, pos, value): the values at the positions that ``wanted`` (group, pos from 1) asks for.

    Equal values are counted first, the distinct ones sorted in range partitions,
    and running counts become positions by the offset of each partition: no
    group is sorted in one task.
    """
    per = df.groupBy(*group, value).agg(F.count("*").alias("__n"))
    parts = max(4, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    ranged = settle(per.repartitionByRange(parts, *group, value).sortWithinPartitions(*group, value).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part", *group).agg(F.sum("__n").alias("__m"))
    before = W.partitionBy(*group).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sums.select("__part", *group, F.coalesce(F.sum("__m").over(before), F.lit(0)).alias("__before"))  # at most partitions + groups rows
    inside = F.sum("__n").over(W.partitionBy("__part", *group).orderBy(value).rowsBetween(W.unboundedPreceding, 0))
    upto = ranged.withColumn("__upto", inside).join(small(offsets, MOST_OFFSETS), ["__part", *group]).withColumn("__upto", F.col("__upto") + F.col("__before"))
    met = upto.join(small(wanted, 100_000), list(group)).filter("pos > __upto - __n and pos <= __upto")
    return met.select(*group, "pos", value)


def ranking_metrics(ranked: DataFrame, relevant: DataFrame, query: str, key: str, k: int, excluded: DataFrame | None = None) -> DataFrame:
    """Per query: precision (hits/k), recall (hits/relevant), MRR, nDCG and violations (excluded in the top k / k), four places.

    ``ranked`` has ``rank``. Queries without relevant rows are left out; a query
    whose list is empty scores 0.
    """
    gold = relevant.select(query, key).distinct()
    n = gold.groupBy(query).agg(F.count("*").alias("n_rel"))
    top = ranked.filter(F.col("rank") <= k).select(query, key, "rank")
    hits = top.join(gold, [query, key]).groupBy(query).agg(F.count("*").alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_rel")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    out = n.join(hits, query, "left").select(
        query,
        F.round(F.coalesce("hits", F.lit(0)) / k, 4).alias("p_at_k"),
        F.round(F.coalesce("hits", F.lit(0)) / F.col("n_rel"), 4).alias("r_at_k"),
        F.round(F.coalesce(1 / F.col("first"), F.lit(0.0)), 4).alias("mrr"),
        F.round(F.coalesce("dcg", F.lit(0.0)) / ideal, 4).alias("ndcg"),
    )
    if excluded is None:
        return out
    bad = top.join(excluded.select(query, key).distinct(), [query, key]).groupBy(query).agg(F.count("*").alias("bad"))
    return out.join(bad, query, "left").withColumn("violation", F.round(F.coalesce("bad", F.lit(0)) / k, 4)).drop("bad")


def auroc(df: DataFrame, score: str, label: str) -> DataFrame:
    """Mann-Whitney with ties 0.5, from counts per distinct score; null labels and scores are left out, null without both classes.

    The running count over distinct scores is done on range partitions with their offsets.
    """
    per = df.filter(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum(1 - F.col(label).cast("long")).alias("neg"))
    ranged = per.repartitionByRange("s").sortWithinPartitions("s").withColumn("part", F.spark_partition_id())
    offsets = ranged.groupBy("part").agg(F.sum("neg").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("n")
    inside = F.coalesce(F.sum("neg").over(W.partitionBy("part").orderBy("s").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    below = ranged.withColumn("inside", inside).join(F.broadcast(offsets), "part")  # one row per partition
    wins = F.sum(F.col("pos") * (F.col("inside") + F.col("before") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return below.agg(F.round(F.when(pairs > 0, wins / pairs), 6).alias("auroc"), F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
