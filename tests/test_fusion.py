"""Fusion, refill and margin over complete lists against brute force."""

from collections import defaultdict

import pytest

from heddle.operators import ranking
from heddle.plans import knowledge, more


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("fusion"))
    chunks = [(f"h{i:03d}", "hot", "patience letters garden " + "filler " * (i % 3)) for i in range(80)]
    chunks += [(f"m{i:03d}", f"s{i}", "patience " + "other words stand here " * (2 + i)) for i in range(12)]
    chunks += [(f"z{i:03d}", "copies", "garden garden garden garden") for i in range(30)]
    chunks += [(f"x{i:03d}", "rest", "nothing of it") for i in range(40)]
    spark.createDataFrame(chunks, "chunk_id string, source_id string, text string").write.parquet(f"{d}/book_chunks.parquet")
    spark.createDataFrame([("q1", "patience letters garden"), ("q2", "garden of patience"), ("q3", "patience patience")], "qid string, question string").write.parquet(f"{d}/rag_questions.parquet")
    lists = []
    for f in (knowledge._bm25, knowledge._overlaps):
        scores = defaultdict(dict)
        for r in f(spark, d).collect():
            scores[r.qid][r.chunk_id] = r.score
        lists.append(scores)
    return d, lists[0], lists[1], {c: s for c, s, _ in chunks}


def ordered(scores):
    return sorted(scores, key=lambda i: (-scores[i], i))


def best(fused):
    return [(i, round(fused[i], 6)) for i in ordered(fused)[:10]]


def got(df, *columns):
    out = defaultdict(list)
    for r in df.collect():
        out[r.qid].append(tuple(r[c] for c in columns))
    return {q: sorted(v) for q, v in out.items()}


def test_ranks_of_complete_lists(spark, tables):
    d, a, _, _ = tables
    ranks = got(ranking.rank_all(knowledge._bm25(spark, d), ["qid"], "score", "chunk_id"), "rank", "chunk_id")
    assert ranks == {q: [(k, i) for k, i in enumerate(ordered(s), 1)] for q, s in a.items()}


def test_reciprocal_fusion(spark, tables):
    d, a, b, _ = tables
    want = {}
    for q in a:
        ids = a[q].keys() | b[q].keys()
        ra, rb = ({i: k for k, i in enumerate(ordered(s[q]), 1)} for s in (a, b))
        want[q] = best({i: 1 / (60 + ra.get(i, len(ids) + 1)) + 1 / (60 + rb.get(i, len(ids) + 1)) for i in ids})
    assert got(knowledge.win02_reciprocal_fusion(spark, d), "rank", "chunk_id", "score") == {q: [(k, *x) for k, x in enumerate(v, 1)] for q, v in want.items()}


def test_weighted_fusion(spark, tables):
    d, a, b, _ = tables
    scale = lambda s: {i: (v - min(s.values())) / (max(s.values()) - min(s.values())) if max(s.values()) > min(s.values()) else 0.5 for i, v in s.items()}
    want = {}
    for q in a:
        x, y = scale(a[q]), scale(b[q])
        want[q] = best({i: 0.3 * x.get(i, 0.0) + 0.7 * y.get(i, 0.0) for i in x.keys() | y.keys()})
    rows = got(knowledge.agg01_weighted_fusion(spark, d), "rank", "chunk_id", "score")
    assert {q: [x[1] for x in v] for q, v in rows.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(abs(x[2] - w) < 2e-6 for q in want for x, (_, w) in zip(rows[q], want[q]))


def test_refill_takes_other_sources_while_they_last(spark, tables):
    d, a, _, source = tables
    want = {}
    for q, s in a.items():
        taken, late, per = [], [], defaultdict(int)
        for k, i in enumerate(ordered(s), 1):
            (taken if per[source[i]] < 2 else late).append((k, i))
            per[source[i]] += 1
        want[q] = [(p, k, i) for p, (k, i) in enumerate((taken + late)[:8], 1)]
    assert got(knowledge.win05_deferred_refill(spark, d), "pos", "rank", "chunk_id") == want
    few = spark.createDataFrame([("q", f"i{k}", "s", k) for k in range(1, 20)], "q string, id string, src string, rank int")
    assert [r.id for r in ranking.cap_with_refill(few, ["q"], "src", "rank", 2, 5).orderBy("pos").collect()] == ["i1", "i2", "i3", "i4", "i5"]


def test_all_near_the_best(spark, tables):
    d, a, _, _ = tables
    want = {q: sorted((i, v) for i, v in s.items() if v >= max(s.values()) * 0.92) for q, s in a.items()}
    assert any(len(v) > 10 for v in want.values())
    assert got(more.win22_near_best(spark, d), "chunk_id", "score") == want
