"""Filling containers of fixed capacity (problem 8).

Best-fit decreasing over all documents at once: documents by falling size, each
into the tightest open container that holds it. The state of that rule is how
many open containers have each remaining capacity, at most capacity + 1 numbers
whatever the data, in a segment tree that finds the tightest fit in
log(capacity) steps. As documents of one size are alike, the plan is made on
the counts of sizes: a run of equal documents goes into a run of containers of
equal room in one step. The result is exactly that of placing them one by one.

Scale. Tokens are counted once, in a map, and written to the shared folder with
a document's place among those of its size. Places are counted within
(size, salt), so a size that a third of all documents have is no single task;
the offsets of the salts are one number for each of capacity x SALTS cells. The
plan's runs are bounded by the capacity, not the data; they are joined to the
documents by (size, place).

Cases. Documents above the capacity fill whole containers; only their last part
is packed with others. Documents without tokens (null, empty) need no room:
container null. Equal sizes are ordered by salt and doc_id. An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from heddle.llm.common import settle, table
from heddle.llm.tokens import FOLDER, PIECES, model_bytes, piece_counter

CAPACITY, SALTS = 2048, 64


class RoomTree:
    """Segment tree over remaining capacities: the smallest room >= s that is open."""

    def __init__(self, capacity: int):
        self.leaves = 1
        while self.leaves <= capacity:
            self.leaves *= 2
        self.open = np.zeros(2 * self.leaves, np.int64)  # containers open below each node

    def add(self, room: int, count: int) -> None:
        i = room + self.leaves
        while i:
            self.open[i] += count
            i //= 2

    def tightest(self, size: int) -> int:
        """-1 where none is open."""
        i = size + self.leaves
        if self.open[i]:
            return size
        while i > 1:  # up to the first right sibling with something open, then down its left edge
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.leaves:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.leaves
            i //= 2
        return -1


def best_fit_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Runs (size, first place, places, first container, documents per container).

    Place p of a size goes to container first + (p - first place) // per.
    Containers are numbered from 0 in order of opening.
    """
    tree = RoomTree(capacity)
    rooms: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # runs (first container, containers)
    plan, opened = [], 0
    for size in sorted(counts, reverse=True):
        left, place = counts[size], 0
        while left:
            room = tree.tightest(size)
            if room < 0:
                room, fresh = capacity, -(-left // (capacity // size))
                first, n = opened, fresh
                opened += fresh
            else:
                first, n = rooms[room].pop()
                tree.add(room, -n)
            per = room // size  # the container just used stays the tightest until the size no longer fits
            full = min(n, left // per)
            if full:
                plan.append((size, place, full * per, first, per))
                place, left = place + full * per, left - full * per
                rooms[room - per * size].append((first, full))
                tree.add(room - per * size, full)
            if left and full < n:
                plan.append((size, place, left, first + full, left))
                rooms[room - left * size].append((first + full, 1))
                tree.add(room - left * size, 1)
                full, left = full + 1, 0
            if full < n:
                rooms[room].append((first + full, n - full))
                tree.add(room, n - full)
    return plan


def token_sizes(df: DataFrame, key: str, text: str, folder: str = FOLDER, name: str = PIECES) -> DataFrame:
    """(key, n_tokens) under an existing tokenizer; null texts have 0."""
    model = model_bytes(name, folder)
    schema = f"`{key}` {dict(df.dtypes)[key]}, n_tokens long"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = piece_counter(model)
        for b in batches:
            yield pd.DataFrame({key: b[key], "n_tokens": np.array(count([t or "" for t in b["__text"]]), np.int64)})

    return df.select(key, F.col(text).alias("__text")).mapInPandas(run, schema)


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """(key, part, n_tokens, container): one row per document, or per part of one above the capacity.

    ``container`` is null for size 0. Whole containers filled by oversized
    documents are numbered after the packed ones.
    """
    spark = sizes.sparkSession
    cap = F.lit(capacity).cast("long")
    n = F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0))
    rows = sizes.select(F.col(key).alias("k"), n.alias("total")).withColumn("whole", F.expr(f"total div {capacity}")).withColumn("rest", F.col("total") % cap)
    rows = rows.withColumn("salt", F.pmod(F.xxhash64("k"), F.lit(SALTS)).cast("int"))
    order = W.partitionBy("rest", "salt").orderBy("k", "total")
    placed = settle(rows.withColumn("rank", F.row_number().over(order).cast("long") - 1))
    cells = placed.groupBy("rest", "salt").agg(F.count("*").alias("n"), F.sum("whole").alias("whole")).toPandas()  # at most capacity x SALTS rows
    cells = cells.sort_values(["rest", "salt"], ignore_index=True)
    cells["offset"] = (cells.groupby("rest")["n"].cumsum() - cells["n"]).astype("int64")
    counts = {int(s): int(c) for s, c in cells.groupby("rest")["n"].sum().items() if s > 0}
    plan = best_fit_plan(counts, capacity)
    n_packed = 1 + max((f + -(-p // per) - 1 for _, _, p, f, per in plan), default=-1)
    offsets = spark.createDataFrame(cells[["rest", "salt", "offset"]].astype("int64"), "rest long, salt int, offset long")
    steps = pd.DataFrame(plan, columns=["rest", "from", "places", "first", "per"])
    # runs of one size lie side by side; a document finds its run in the array of its size
    lists = steps.groupby("rest").agg(list).reset_index() if len(steps) else pd.DataFrame({c: [] for c in steps.columns})
    runs = spark.createDataFrame(lists.values.tolist(), "rest long, `from` array<long>, places array<long>, first array<long>, per array<long>")
    at = placed.join(F.broadcast(offsets), ["rest", "salt"]).withColumn("place", F.col("rank") + F.col("offset"))
    at = at.join(F.broadcast(runs), "rest", "left")
    # `from` rises, so the run is the last that begins at or before the place; its number is worked out once a row
    at = at.withColumn("run", F.expr("size(filter(`from`, x -> x <= place))"))
    packed = F.when(F.col("rest") > 0, F.element_at("first", F.col("run")) + F.expr("(place - element_at(`from`, run)) div element_at(per, run)"))
    last = at.select("k", F.col("whole").cast("int").alias("part"), F.col("rest").alias("n_tokens"), packed.alias("container")).filter("n_tokens > 0 or part = 0")
    # whole containers: numbered by salt, key within the salt
    base = cells.groupby("salt")["whole"].sum().astype("int64").sort_index()
    starts = spark.createDataFrame([(int(s), int(o)) for s, o in (base.cumsum() - base).items()], "salt int, start long")
    big = placed.filter("whole > 0").withColumn("before", F.sum("whole").over(W.partitionBy("salt").orderBy("k", "total", "rank").rowsBetween(W.unboundedPreceding, -1)))
    big = big.join(F.broadcast(starts), "salt").select("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("p"), (F.coalesce("before", F.lit(0)) + F.col("start")).alias("b"))
    filled = big.select("k", F.col("p").cast("int").alias("part"), cap.alias("n_tokens"), (F.col("b") + F.col("p") + n_packed).alias("container"))
    return last.unionByName(filled).withColumnRenamed("k", key)


def p8_containers(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "text")
    return pack(token_sizes(docs, "doc_id", "text"), "doc_id", "n_tokens")


def p8_space(spark: SparkSession, d: str) -> DataFrame:
    """How many containers there are, how full they are, and the share of space that stays unused."""
    full = p8_containers(spark, d).filter("container is not null").groupBy("container").agg(F.sum("n_tokens").alias("n"))
    room = F.count("*") * CAPACITY
    return full.agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest"), F.round(1 - F.sum("n") / room, 6).alias("unused_share"))


QUERIES = {"p8_containers": p8_containers, "p8_space": p8_space}
