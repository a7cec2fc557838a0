"""Scores of both searches in one pass; the hits stay in the tasks."""

import pytest

from heddle.operators import lexical
from heddle.plans import answers, further, knowledge

TWO_LISTS = {"win03_weighted_fusion": knowledge, "agg43_reranked_pool": further, "set04_context_dedupe": answers, "set12_disagreement": knowledge, "jn34_reused_scores": further}


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("hits"))
    chunks = [(f"c{i:03d}", "s", " ".join(["patience", "letters", "garden", "rain"][: 1 + i % 4]) + " word" * (i % 5)) for i in range(60)]
    spark.createDataFrame(chunks, "chunk_id string, source_id string, text string").write.parquet(f"{d}/book_chunks.parquet")
    asked = [("q1", "patience letters garden", ["garden"]), ("q2", "rain rain in the garden", ["rain", "letters"])]
    spark.createDataFrame(asked, "qid string, question string, expected_keywords array<string>").write.parquet(f"{d}/rag_questions.parquet")
    return d


@pytest.mark.parametrize("name", TWO_LISTS)
def test_hits_are_not_broadcast(spark, tables, name):
    """The hits stand left in their joins. Their files shrink so far that a broadcast seems cheap, and fills the driver."""
    df = getattr(TWO_LISTS[name], name)(spark, tables)
    assert "BuildLeft" not in df._jdf.queryExecution().sparkPlan().toString()
    assert df.count() > 0


@pytest.mark.parametrize("name", ["bm25", "overlaps", "scores"])
def test_terms_go_to_the_hits(spark, tables, name):
    df = getattr(lexical, name)(knowledge._hits(spark, tables))
    assert "BuildLeft" not in df._jdf.queryExecution().sparkPlan().toString()


def test_scores_of_one_pass(spark, tables):
    h = knowledge._hits(spark, tables)
    a, b = ({(r.qid, r.chunk_id): r.score for r in f(h).collect()} for f in (lexical.bm25, lexical.overlaps))
    assert {(r.qid, r.chunk_id): (r.score, r.overlap) for r in lexical.scores(h).collect()} == {k: (s, b[k]) for k, s in a.items()}
    assert a.keys() == b.keys() and a
