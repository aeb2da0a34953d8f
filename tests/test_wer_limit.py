from lakesift.operators import wer


def test_many_distinct_words(spark, monkeypatch):
    """Words are characters beyond the first plane, up to the last there is: none is a surrogate."""
    text = lambda a, b: " ".join(f"w{k}" for k in range(a, b))
    rows = [(0, text(0, 3000), text(2990, 3010)), (1, "a b", "a c"), (2, text(0, 60), text(1, 60))]
    df = spark.createDataFrame(rows, "id int, sentence string, hypothesis string")
    assert {r.id: r.wer_edits for r in wer.score(df).collect()} == {0: 3000, 1: 1, 2: 1}
    monkeypatch.setattr(wer, "_BASE", 0x10FFFF - 60)
    assert {r.id: r.wer_edits for r in wer.score(df.filter("id > 0")).collect()} == {1: 1, 2: 1}
    assert wer.MAX_WORDS > 10**6
