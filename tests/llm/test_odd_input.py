"""Text ids, clashing column names, added tokens, broken media, and joins beyond the broadcast limit."""

import collections
import json
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import gif, language, minhash, mixing, packing, quality, queries, sharding, shared, toxicity, urls, warc


def test_ids_are_the_librarys_also_with_added_tokens(tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    full, fast = tokenizers.Tokenizer.from_file(path), packing.Tokens(path)
    end = "<|endoftext|>"
    for text in (f"a {end} b", end, end * 3, f"{end}x", f"x  {end}", f"it's  {end}\n\n 12 3{end} é日本 \t", "<|endoftext|", "a" * 5000, " " * 300 + "b"):
        assert np.frombuffer(fast.encode(text), "<u4").tolist() == full.encode(text, add_special_tokens=False).ids
    spec = json.loads(Path(path).read_text(encoding="utf-8"))
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}}):
        other = tmp_path / "other.json"
        other.write_text(json.dumps(spec | change), encoding="utf-8")
        assert packing.plain_byte_bpe(spec | change) is None
        want = tokenizers.Tokenizer.from_file(str(other)).encode("Hello Big world", add_special_tokens=False).ids
        assert np.frombuffer(packing.Tokens(str(other)).encode("Hello Big world"), "<u4").tolist() == want
    packing.tokens(path)
    packing.tokens(str(other))
    assert packing.tokens.cache_info().currsize == 1 and toxicity._compressors.cache_info().maxsize == 1


CLASH = ("_h", "_rank", "_salt", "_src", "_hash", "_length", "_found", "_label", "_score", "_toxicity", "_rule", "_of", "_n", "_i", "_bucket", "_taken", "_group", "_size", "_source", "_host")


def test_text_ids_and_clashing_columns(spark):
    rows = [("a", "x y z " * 40, "en", "s"), ("b", "x y z " * 40, "en", "s"), (None, None, None, None), ("c", "u v w " * 300, "de", "t")]
    odd = spark.createDataFrame(rows, "doc_id string, text string, lang string, source string")
    for c in CLASH:
        odd = odd.withColumn(c, F.lit(c))
    assert {r["doc_id"] for r in packing.pack_documents(odd, "doc_id", "text", queries.tokenizer_path(), 64).collect()} == {"a", "b", "c", None}
    assert collections.Counter(r["component_id"] for r in minhash.near_duplicates(odd, "doc_id", "text").collect()) == {"a": 2, "c": 1, None: 1}
    model, mild = language.fit(odd, "text", "lang", ["doc_id"]), toxicity.NOTHING
    same = (language.reject_unknown(odd, "text", model), minhash.drop_near_duplicates(odd, "doc_id", "text"), mixing.mixed_documents(odd, "source", "text", ["doc_id"]), toxicity.reject_toxic(odd, "text", mild))
    sized = odd.withColumn("size", F.lit(3).cast("long"))
    more = (sharding.shard_groups(sized, "text", "size", 2, ["doc_id"]), mixing.mix_sources(sized, "source", "size", ["doc_id"]), urls.filter_urls(odd.withColumn("url", F.lit("http://a.com/")), "url", "text", queries.URL_RULES))
    assert all(out.columns == odd.columns for out in same) and all(out.count() == 4 for out in more)
    assert all(r[c] == c for out in (*same, *more) for r in out.collect() for c in CLASH)
    assert len(quality.judge_quality(odd, "doc_id", "text", ["lang", "source"]).collect()) == 4
    assert len(gif.text_media(odd, "doc_id", "text").collect()) == 4


def test_a_large_table_is_joined_by_salts(spark, monkeypatch):
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 2)
    left = spark.createDataFrame([("a" if i % 3 else None, i) for i in range(50)], "k string, _salt int")
    right = spark.createDataFrame([("a", 1), (None, 2), ("z", 3)], "of string, v int")
    out = shared.keyed_join(left, right, [("k", "of")], F.col("_salt")).collect()
    assert len(out) == 50 and all(r["v"] == (1 if r["k"] else 2) for r in out) and {r["_salt"] for r in out} == set(range(50))


def test_mixed_documents_are_the_mix(spark):
    rows = [(i % 30 if i % 7 else None, " ".join(["w"] * (i % 9)), f"s{i % 4}" if i % 5 else None) for i in range(120)] + [(500, "a b c", "s1")] * 6 + [(501, None, "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("times", F.lit("t"))
    got = collections.Counter((r["doc_id"], r["text"], r["source"]) for r in mixing.mixed_documents(df, "source", "text", ["doc_id"]).collect())
    sized = shared.written(df.select("doc_id", F.xxhash64("text").alias("hash"), "source", mixing.count_words("text").alias("size"), "text"))
    want = collections.Counter()
    for r in mixing.mix_sources(sized, "source", "size", ["doc_id", "hash"]).collect():
        want[(r["doc_id"], r["text"], r["source"])] += r["times"]
    assert got == +want
    assert mixing.mixed_documents(df.where("1 = 0"), "source", "text", ["doc_id"]).count() == 0


def test_scratch_folders_go(spark):
    with shared.scratch(spark):
        path = shared.shared_folder(spark)
        spark.range(3).write.parquet(path)
        assert spark.read.parquet(path).count() == 3
    assert not Path(path.removeprefix("file://")).exists()


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

    class Conf:
        def get(self, key, default):
            return default

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())


def test_media_that_breaks_off_gives_the_frames_before(spark):
    rng = np.random.default_rng(0)
    whole = gif.encode_gif(bytes(rng.integers(0, 256, 192 * 700, np.uint8)))
    frames = len(list(gif.decode_gif(whole)))
    assert frames == 3
    counts = [len(list(gif.decode_gif(whole[:n]))) for n in range(0, len(whole), 997)]
    assert counts == sorted(counts) and counts[0] == 0 and max(counts) <= frames
    noise = [bytes(rng.integers(0, 256, 300, np.uint8)) for _ in range(50)]
    for x in noise:
        list(gif.decode_gif(b"GIF89a" + bytes([9, 0, 9, 0]) + x))
    df = spark.createDataFrame([(i, whole[: 1000 * i]) for i in range(20)], "id long, media binary")
    assert gif.media_frames(df, "id", "media").count() == sum(len(list(gif.decode_gif(whole[: 1000 * i]))) for i in range(20))


def test_records_are_read_in_as_many_tasks_as_they_need(spark):
    rng = np.random.default_rng(1)
    pages = spark.createDataFrame([(i, f"http://a/{i}", rng.bytes(2000).hex()) for i in range(300)], "page_id long, url string, html string").repartition(3)
    index = warc.write_archives(pages, "page_id", "url", "html")
    out = warc.read_records(index, chunk=1 << 16)
    got = out.select("page_id", "payload_bytes", F.spark_partition_id().alias("p")).collect()
    assert len(got) == 300 and len({r["p"] for r in got}) > 3


def test_language_reads_long_texts_in_stretches():
    text = "der hund und die katze gingen zu einem haus " * 9000
    model = language.Model(("de", "en"), np.random.default_rng(0).normal(-8, 1, (language.BUCKETS, 2)).astype(np.float32), np.log([0.5, 0.5]))
    at, parts = zip(*language._runs([None, text, "kurz"]), strict=True)
    assert len(at) > 3 and "".join("".join(p) for p in parts).replace("kurz", "") == text
    whole, stretches = language.gram_buckets([text])[0], [language.gram_buckets([x])[0] for p in parts for x in p if x != "kurz"]
    assert np.array_equal(np.bincount(whole, minlength=language.BUCKETS), sum(np.bincount(x, minlength=language.BUCKETS) for x in stretches))
    assert language.scores([text], model)[0] == language.scores([text[:-1] + " "], model)[0]


def test_a_budget_that_no_total_meets_keeps_a_small_window():
    import time
    import tracemalloc

    began = time.process_time()
    tracemalloc.start()
    taken = mixing.subset_sum([1000, 1001], [10**6, 1], 300_000_500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken[0] * 1000 + taken[1] * 1001 == 300_000_001
    assert time.process_time() - began < 10 and peak < 200e6
    rng = np.random.default_rng(8)
    for _ in range(40):  # what is missing is less than the shortest length of which items are left
        lengths = sorted(set(rng.integers(2, 400, 6).tolist()))
        counts = rng.integers(1, 60, len(lengths)).tolist()
        budget = int(rng.integers(1, sum(a * b for a, b in zip(lengths, counts, strict=True))))
        got = mixing.subset_sum(lengths, counts, budget, exact=64, enough=128)
        short = budget - sum(a * k for a, k in zip(lengths, got, strict=True))
        assert 0 <= short < min(a for a, n, k in zip(lengths, counts, got, strict=True) if k < n) and all(0 <= k <= n for k, n in zip(got, counts, strict=True))
