"""Order statistics, blocks of vector search, hits, fused ranks, clauses and seeded draws: brute force, ties, nulls, empty tables."""

import random
from collections import Counter

from pyspark.sql import functions as F

from heddle.operators import lexical, ranking, vectors
from heddle.plans import answers, state
from heddle.session import small


def test_order_statistics_with_ties_and_a_hot_group(spark):
    r = random.Random(4)
    data = [("hot" if r.random() < 0.8 else "cold", float(r.randint(0, 9))) for _ in range(500)]
    df = spark.createDataFrame(data, "g string, v double")
    want = spark.createDataFrame([("hot", 1), ("hot", 200), ("cold", 7), ("cold", 10_000), ("none", 1)], "g string, pos long")
    got = {(x.g, x.pos): x.v for x in ranking.order_statistics(df, ["g"], "v", want).collect()}
    by = {g: sorted(v for k, v in data if k == g) for g in ("hot", "cold")}
    assert got == {("hot", 1): by["hot"][0], ("hot", 200): by["hot"][199], ("cold", 7): by["cold"][6]}
    assert ranking.order_statistics(df.limit(0), ["g"], "v", want).count() == 0


def test_vector_search_in_blocks_and_within_groups(spark, monkeypatch):
    r = random.Random(6)
    data = [(i, [round(r.random(), 1) for _ in range(3)], i % 3) for i in range(50)] + [(77, None, 1)]
    df = spark.createDataFrame(data, "id long, v array<float>, g int")
    q = df.filter("id % 10 = 0")
    one = {tuple(x) for x in vectors.search(q, df, "id", "v", 4).collect()}
    monkeypatch.setattr(vectors, "QUERY_BLOCK", 2)
    assert {tuple(x) for x in vectors.search(q, df, "id", "v", 4).collect()} == one and len(one) == 20
    vs = {i: [float(x) for x in row.v] for i, row in ((x.id, x) for x in df.filter("v is not null").collect())}
    got = {(x.query_id, x.g): x.id for x in vectors.search(q, df, "id", "v", 1, within="g").collect()}
    for (a, g), b in got.items():
        score = lambda j: round(sum(x * y for x, y in zip(vs[a], vs[j])), 6)
        assert b == min((j for j in vs if j % 3 == g and j != a), key=lambda j: (-score(j), j))
    assert vectors.search(q.limit(0), df, "id", "v", 2).count() == 0 == vectors.search(q, df.limit(0), "id", "v", 2).count()


def test_hits_of_nulls_and_empty_tables(spark):
    docs = spark.createDataFrame([("a", "red fish", 1), ("b", None, 2), ("c", "", 3), ("c", "red red", 4)], "tf string, text string, size int")
    asked = spark.createDataFrame([("q", "red wine"), ("r", None)], "qid string, question string")
    h = lexical.hits(asked, "qid", "question", docs.withColumnRenamed("tf", "id").drop("size"), "id", "text")
    assert h.n == 2 and h.mean_size == 2.0
    assert {(x.qid, x.id): x.score for x in lexical.overlaps(h).collect()} == {("q", "a"): 0.5, ("q", "c"): 0.5}
    none = lexical.hits(asked, "qid", "question", docs.withColumnRenamed("tf", "id").limit(0), "id", "text")
    assert none.n == 0 and lexical.bm25(none).count() == 0


def test_weighted_ranks_keep_the_order_of_first_sight(spark):
    a = spark.createDataFrame([("q", "x", 1), ("q", "y", 2)], "q string, k string, rank int")
    b = spark.createDataFrame([("q", "z", 1), ("q", "y", 1)], "q string, k string, rank int")
    got = [(x.k, x["rank"]) for x in ranking.weighted_reciprocal_ranks([a, b], [1.0, 1.0], ["q"], "k", 3).orderBy("rank").collect()]
    assert got == [("y", 1), ("x", 2), ("z", 3)]


def test_clauses_and_echoes(spark):
    text = "one two three " * 9
    df = spark.createDataFrame([(text,), ("short",), ("",), (None,)], "t string")
    got = [r.c for r in df.select(answers.clauses(F.col("t")).alias("c")).collect()]
    assert " ".join(got[0]) == text.strip() and all(len(c) >= answers.LEAST for c in got[0]) and got[1] == ["short"] and got[2] == [] and not got[3]
    assert answers.echo("is it good to write first", "it is good to write first") and not answers.echo("how many", "how many: 433 people")


def test_draws_are_uniform_and_repeatable(spark):
    df = spark.range(4000).select(state.categorical(state.uniform(F.col("id"), 1), [("a", 0.5), ("b", 0.3), ("c", 0.2)]).alias("v"))
    n = Counter(r.v for r in df.collect())
    assert n == Counter(r.v for r in df.repartition(3).collect())
    assert abs(n["a"] - 2000) < 150 and abs(n["b"] - 1200) < 150 and abs(n["c"] - 800) < 150


def test_broadcast_only_what_is_small(spark):
    assert "broadcast" in small(spark.range(3), 3)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in small(spark.range(4), 3)._jdf.queryExecution().logical().toString().lower()
