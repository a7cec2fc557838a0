"""Problem 5: Thai letters inside Latin words, in texts that are otherwise clean."""

from heddle.llm import encoding


def test_accents_read_as_thai_inside_latin_words():
    for good in ("Miss Müller wrote to us", "ความรักของ Müller", "größer und später", "le désir", "le cœur"):
        bad = "".join(encoding._byte_chars("cp874").get(b, chr(b)) for b in good.encode()) if good.isascii() or good[0] < "ก" else good.replace("ü", "รผ")
        if good == "größer und später":
            bad = "spรคter kรถnnen"
            good = "später können"
        assert encoding.garbled_spans(bad), bad
        assert encoding.restore(bad) == good


def test_clean_words_beside_thai_stay():
    for t in ("เรียกGrabรถยนต์มา", "ใช้appรองรับ", "LINEกับเพื่อน", "ดูTVและรอ"):
        assert not encoding.garbled_spans(t), t


def test_what_twins_teach_restores_records_without_one(spark):
    said = "the author met Frau Müller and Herr Größe near the café in Köln before the long winter"
    alone = "Später können größere Stücke über die Prüfung helfen"
    bad = lambda t, codec: "".join(encoding._byte_chars(codec)[b] if b >= 128 else chr(b) for b in t.encode())
    rows = [("a", said), ("b", bad(said, "mac_roman")), ("c", bad(alone, "mac_roman")), ("d", bad(alone, "cp437")), ("e", None), ("f", "")]
    df = spark.createDataFrame(rows, "chunk_id string, text string")
    learned = [t for t, _ in encoding.learn_transformations(encoding.mark_suspects(df))]
    assert ("mac_roman", "utf-8") in learned and ("cp437", "utf-8") not in learned
    got = {r.chunk_id: (r.restored, r.learned) for r in encoding.restore_garbled(df).collect()}
    assert got["b"] == (said, True) and got["c"] == (alone, True) and got["d"] == (alone, False) and len(got) == 3


def test_one_text_garbled_in_two_ways():
    bad = "Sie übt".encode().decode("latin-1") + " . " + "".join(encoding._byte_chars("mac_roman").get(b, chr(b)) if b >= 128 else chr(b) for b in "größere Stücke".encode())
    assert encoding.restore(bad, (("latin-1", "utf-8"),)) == "Sie übt . größere Stücke"
