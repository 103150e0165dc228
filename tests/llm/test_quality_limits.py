"""Limits of op4 that the sketches set."""

import pytest

from tideframe.llm import quality


@pytest.mark.parametrize("n", [120, 250])
def test_repeats_alone_reject_where_nobody_else_repeats(spark, n):
    words = lambda i, k: [f"w{i}x{j:02d}"[:7].ljust(7, "y") for j in range(k)]
    rows = [(i, " ".join(words(i, 62)), "g1") for i in range(n)]
    odd = words(n, 53)
    rows.append((n, " ".join(odd + odd[:9]), "g1"))  # 18 of 62 words: 29 %
    # where many texts repeat as much, nobody goes for it
    for i in range(n + 1, 2 * n):
        w = words(i, 53)
        rows.append((i, " ".join(w + w[:9]), "g2"))
    out = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", ["lang"]).collect()}
    assert out[n]["n_repeat_words"] == 18 and not out[n]["base_failed"]
    assert out[n]["failed"] == ["repeats"] and not out[n]["kept"]
    assert all(r["kept"] for i, r in out.items() if i != n)


def test_a_group_of_few_rows_has_the_limits_of_all(spark):
    words = lambda i, k: [f"w{i}x{j:02d}"[:7].ljust(7, "y") for j in range(k)]
    repeated = lambda i: " ".join((w := words(i, 53)) + w[:9])
    rows = [(0, repeated(0), "few")] + [(i, " ".join(words(i, 62)), "few") for i in range(1, 13)] + [(i, repeated(i), "many") for i in range(100, 220)]
    out = quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", ["lang"]).collect()
    assert all(r["kept"] for r in out)
