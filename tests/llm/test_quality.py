"""Problem 10: junk that makes up most of its language is found all the same."""

from heddle.llm import quality


def test_copies_do_not_hide_each_other(spark, tmp_path):
    menu = "\n".join(["- 寿司 500円", "- 天ぷら 800円", "- うどん 400円", "- そば 450円"])
    good = "However, the volunteers met at the old station in order to talk about the trip, and they left late. It was not easy."
    data = [(i, menu, "ja") for i in range(30)]
    data += [(100 + i, f"{good} They met again on day {i}, and it was a long walk home.", "en") for i in range(60)]
    data += [(200, None, None), (201, "", None), (202, "昨日は友達と駅で会って、旅行のことをゆっくり話しました。とても楽しい一日でした。", "ja")]
    spark.createDataFrame(data, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [r.doc_id for r in quality.p10_found(spark, str(tmp_path)).collect()]
    assert sorted(got) == [*range(30), 200, 201]


def test_the_score_decides_before_the_check(spark):
    good = "However, the volunteers met at the old station in order to talk about the trip, and they left late. It was not easy."
    data = [(i, f"{good} They met again on day {i}, and it was a long walk home.", "en") for i in range(80)]
    data += [(100 + i, "\n".join(f"- {w}{i};{i * 3}" for w in ("tea", "milk", "bread", "salt")), "en") for i in range(4)]
    stats = quality.document_statistics(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    score = {r.doc_id: r.score for r in quality.outlier_scores(stats).collect()}
    assert max(score[i] for i in range(80)) < quality.OUTLIER < min(score[100 + i] for i in range(4))


def test_both_ways_of_looking_up_agree(spark, monkeypatch):
    data = [(i, "word " * (i % 7) + "and the end." * (i % 3) + "9;" * (i % 5), None if i % 4 else "en") for i in range(60)]
    stats = quality.document_statistics(spark.createDataFrame(data, "doc_id long, text string, lang string"))
    shipped = {r.doc_id: r.score for r in quality.outlier_scores(stats).collect()}
    monkeypatch.setattr(quality, "MAX_TABLE", 0)
    joined = {r.doc_id: r.score for r in quality.outlier_scores(stats).collect()}
    assert shipped.keys() == joined.keys() and all(abs(shipped[k] - joined[k]) < 1e-5 for k in shipped)
