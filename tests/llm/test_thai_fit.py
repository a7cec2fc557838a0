"""The Thai model is fitted on all quotes."""

import random

from heddle.llm import sentences


def test_model_of_all_quotes(spark, monkeypatch):
    """Counts of all distinct quotes, added up over tasks, give what one pass over them gives."""
    monkeypatch.setattr(sentences, "SAMPLE", 40, raising=False)
    draw = random.Random(7)
    words = ["รักกัน", "ดูแล", "เสมอ", "ทุกวัน", "ฟังเขา", "อย่ารีบ", "เพราะว่า", "พูดดีๆ", "คนเดียว", "ให้อภัย"]
    quotes = [" ".join("".join(draw.choices(words, k=draw.randint(1, 4))) for _ in range(draw.randint(2, 9))) for _ in range(600)]
    rows = [(q,) for q in [*quotes, *quotes[:50], None, "", "no Thai"]]
    want, got = sentences.fit_thai(sorted(set(quotes))), sentences.thai_model(spark.createDataFrame(rows, "q string"), "q")
    assert (got.odds, got.bars, got.prior, got.mean, got.spread) == (want.odds, want.bars, want.prior, want.mean, want.spread)
    assert want.bars and want.odds
    assert sentences.thai_model(spark.createDataFrame(rows[-3:], "q string"), "q").odds == {}
