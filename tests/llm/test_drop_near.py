"""The near-duplicate stage where ids repeat or are null."""

from tideframe.llm import minhash


def test_drop_goes_by_id_and_text(spark):
    words = lambda s: " ".join(f"{s}{i}" for i in range(60))
    a, b = words("a"), words("b")
    rows = [(3, b), (5, a), (5, b + " end"), (None, b + " tail"), (None, words("c"))]
    out = minhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text").collect()
    assert {(r["doc_id"], r["text"]) for r in out} == {(3, b), (5, a), (None, words("c"))} and len(out) == 3
