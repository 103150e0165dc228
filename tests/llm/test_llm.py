"""The ten operators and the pipeline against brute force, on small hand-made tables with the awkward cases: nulls in any
column, empty, blank and long texts, ties, repeated rows, empty tables, extra columns with clashing names."""

import base64
import collections
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import components, gif, language, minhash, mixing, oracle, packing, quality, queries, sharding, shared, toxicity, urls, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
EN, DE = "the cat and the dog went to a house with some other things there", "der hund und die katze gingen zu einem haus mit ein paar anderen dingen"
BAD = "you are a worthless idiot and a stupid clown"


@pytest.fixture(scope="module")
def docs(spark):
    rng = np.random.default_rng(5)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ner", "tor", "sa") for b in ("bel", "dun", "fa", "gri", "hes", "jo")]
    line = lambda n: " ".join(rng.choice(words, n))
    base = line(120)
    edit = lambda k: " ".join(w if i % k else "changed" for i, w in enumerate(base.split()))
    rows = [(1, base, "en", "s1"), (2, base, "en", "s1"), (3, edit(90), "en", "s2"), (4, edit(10), "en", "s2"), (5, None, "en", "s1"), (6, "", None, None), (7, " \t\n ", "de", "s3"), (8, "one two three", "de", "s3"), (9, "One TWO three", None, "s3")]
    rows += [(10 + i, line(int(n)), "en" if i % 3 else "de", f"s{i % 4}") for i, n in enumerate(rng.integers(1, 200, 40))]
    rows += [(60, line(9000), "en", "s1"), (61, line(30) + "\n" + line(5) + "\n" + "x" * 50, None, None), (8, "one two three", "de", "s3"), (None, line(50), "en", "s1"), (70, "ß € 日本語 ÀÉ", "fr", "s9")]
    rows += [(100 + i, f"{EN} {line(20)}", "en", "s1") for i in range(20)] + [(130 + i, f"{DE} {line(20)}", "de", "s2") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumn("score", F.lit("x")).withColumn("shard", F.lit(9)).withColumn("n_words", F.lit("y"))


def none(df):
    return df.where("1 = 0")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


# --- shared -------------------------------------------------------------------------------------------------------


def test_gapless_rank_of_a_hot_key_with_ties(spark):
    df = spark.createDataFrame([("a" if i % 3 else None, i % 5) for i in range(300)], "k string, v int").withColumn("h", shared.unit_hash(1, "v"))
    out = shared.gapless_rank(df, ["k"], ["h", "v"], F.col("h"), "r", 8).collect()
    for k in ("a", None):
        assert sorted(r["r"] for r in out if r["k"] == k) == list(range(sum(r["k"] == k for r in out)))
    assert shared.gapless_rank(none(df), ["k"], ["h"], F.col("h"), "r").count() == 0


def test_word_spans_and_hashes_follow_the_definition():
    texts = ["a  b\tc", "", " \n", "ab", "b c", "É x y"]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    s, e, row = shared.word_spans(data, offsets)
    got = [[bytes(data[a:b]).decode() for a, b, r in zip(s, e, row, strict=True) if r == i] for i in range(len(texts))]
    assert got == [WORD.findall(t) for t in texts]
    h = shared.span_hashes(data, s, e)
    flat = [w for t in texts for w in WORD.findall(t)]
    assert all((h[i] == h[j]) == (flat[i] == flat[j]) for i in range(len(flat)) for j in range(i))


def test_components_match_union_find(spark):
    rng = np.random.default_rng(0)
    edges = [tuple(map(int, x)) for x in rng.integers(0, 60, (50, 2))] + [(i, i + 1) for i in range(100, 130)]
    root = {}
    find = lambda x: x if root.setdefault(x, x) == x else find(root[x])
    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for x in {y for a, b in edges if a != b for y in (a, b)}}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# --- language, toxicity -------------------------------------------------------------------------------------------


def test_language(spark, docs):
    model = language.fit(docs, "text", "lang", ["doc_id"])
    assert model.labels == ("de", "en", "fr")
    out = {r["doc_id"]: r for r in language.identify_language(docs, "text", model).collect()}
    assert all(out[i]["lang_pred"] == ("en" if i < 130 else "de") for i in (*range(100, 120), *range(130, 150)))
    assert all((out[i]["lang_pred"], out[i]["lang_score"]) == ("und", 0.0) for i in (5, 6, 7))
    assert all(0 <= r["lang_score"] <= 1 for r in out.values())
    again = language.fit(docs.repartition(5), "text", "lang", ["doc_id"])
    assert np.array_equal(model.logs, again.logs)
    kept = language.reject_unknown(docs, "text", model)
    assert kept.columns == docs.columns and {5, 6, 7}.isdisjoint(r["doc_id"] for r in kept.collect())
    nothing = language.fit(none(docs), "text", "lang", ["doc_id"])
    assert {r[0] for r in language.identify_language(docs, "text", nothing).select("lang_pred").collect()} == {"und"}
    assert language.identify_language(none(docs), "text", model).count() == 0


def test_language_scores_are_the_formula():
    texts, labels = [EN, DE, "das ist ein haus", "this is a house"], ["en", "de", "de", "en"]
    logs = np.full((language.BUCKETS, 2), 0.5)
    for t, y in zip(texts, labels, strict=True):
        np.add.at(logs, (language.gram_buckets([t])[0], int(y == "en")), 1)
    model = language.Model(("de", "en"), np.log(logs / logs.sum(0)).astype(np.float32), np.log([0.5, 0.5]))
    names, p = language.scores(["a house", None, "12", "ein haus"], model)
    for t, name, got in zip(["a house", "ein haus"], [names[0], names[3]], [p[0], p[3]], strict=True):
        z = model.priors + model.logs[language.gram_buckets([t])[0]].sum(0, dtype=float)
        assert name == model.labels[z.argmax()] and got == pytest.approx(np.exp(z.max() - np.logaddexp.reduce(z)))
    assert names[1:3] == ["und", "und"]


def plain_windows(text, least, first):
    words = re.sub(r"[^a-z\x80-\U0010ffff]+", " ", "".join(c.lower() if "A" <= c <= "Z" else c for c in text)).split()
    at = 0
    while at < len(words):
        size, end = 0, at
        while end < len(words) and size < first:
            size += len(words[end].encode()) + 1
            end += 1
        yield f" {' '.join(words[at:end])} ".encode() + bytes(range(128, 160))
        at, first = end, least


def plain_compressor(content):
    import zstandard

    held = zstandard.ZstdCompressionDict(bytes(range(128, 160)) + content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    how = zstandard.ZstdCompressionParameters.from_level(9, dict_size=32 + len(content), source_size=64, min_match=5, strategy=zstandard.STRATEGY_LAZY2, search_log=9, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress


def test_toxicity(spark, docs):
    rng = np.random.default_rng(1)
    words = "kabel lodun mifa nergri torhes sajo kafa lobel midun".split()
    make = lambda bad: " ".join([*rng.choice(words, 30), *(BAD.split() if bad else []), *rng.choice(words, 30)])
    rows = [(i, make(i % 3 == 0), int(i % 3 == 0)) for i in range(240)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(df.select("doc_id", "text"), df.where("doc_id < 180").select("doc_id", "toxic"), "doc_id", "text", "toxic")
    out = toxicity.score_toxicity(df.where("doc_id >= 180"), "text", model).collect()
    assert all((r["toxicity"] >= 0.7) == bool(r["toxic"]) for r in out)
    odd = toxicity.score_toxicity(docs, "text", model, "score").collect()
    assert all(0 <= r["score"] < 0.7 for r in odd) and len(odd) == docs.count()
    assert toxicity.reject_toxic(docs, "text", model).columns == docs.columns
    empty = toxicity.fit(df.select("doc_id", "text"), none(df).select("doc_id", "toxic"), "doc_id", "text", "toxic")
    assert toxicity.score_toxicity(df, "text", empty).where("toxicity >= 0.5").count() == 0
    assert toxicity.score_toxicity(none(df), "text", model).count() == 0
    long = " ".join(words * 30_000) + " " + BAD
    assert max(toxicity.differences(toxicity.windows(long), model.toxic, model.ordinary)) >= 6
    # the score by a plain program: its own windows, its own compressors
    pack = [plain_compressor(x) for x in (model.toxic, model.ordinary)]
    for text in (long, make(True), None, "", "x" * 3000):
        z = model.curve[0]
        for i, width in enumerate((96, 400)):
            total = 0.0
            for first in (96, 48) if width == 96 else (400,):
                for w in plain_windows(text or "", width, first):
                    m, n = (len(x(w)) for x in pack)
                    saved = n - m if min(m, n) <= 0.75 * (len(w) - 32) else 0
                    total += model.weights[i][min(max(saved + 2, 0), 13)]
            z += model.curve[1 + i] * np.clip(total, -30, 30)
        want = model.curve[-1] + (1 - model.curve[-1]) / (1 + np.exp(-np.clip(z, -30, 30)))
        assert toxicity.score_texts([text], model)[0] == pytest.approx(want)
    again = toxicity.fit(df.repartition(7).select("doc_id", "text"), df.where("doc_id < 180").select("doc_id", "toxic"), "doc_id", "text", "toxic")
    assert again == model


def test_windows_are_whole_words_in_order():
    for text in ("", None, " \n", "One TWO three-four!! five " * 40, "y" * 100 + " a b", "é ß " * 30):
        plain = bytes(toxicity._PLAIN[b] for b in (text or "").encode()).split()
        got = list(toxicity.windows(text))
        assert b" ".join(w.strip() for w in got).split() == plain
        assert all(len(w) >= 96 for w in got[:-1])
    long = "ab cde " * 400_000
    assert sum(w.count(b"cde") for w in toxicity.windows(long)) == 400_000


@pytest.mark.parametrize(("sf", "least", "most"), [("sf0.01", 11, 1), ("sf0.1", 57, 4)])
def test_toxic_texts_of_the_tables_are_found(spark, sf, least, most):
    """Held-out rows: about half of those of label 1 have nothing toxic in them."""
    path = f"/root/testdata/{sf}"
    labels = spark.read.parquet(f"{path}/labels.parquet").select("doc_id", "toxic")
    texts = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text")
    model = queries.toxicity_model(texts, labels)
    held = texts.join(labels.where(queries.id_remainder("doc_id", 3) == 1), "doc_id")
    got = toxicity.score_toxicity(held, "text", model).groupBy("toxic").agg(F.sum((F.col("toxicity") >= 0.7).cast("int")).alias("n")).collect()
    got = {r["toxic"]: r["n"] for r in got}
    assert got[1] >= least and got[0] <= most


# --- sharding, mixing, packing ------------------------------------------------------------------------------------


def brute_fit(sizes, capacity):
    room, out = [], [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        ok = [j for j, r in enumerate(room) if r >= sizes[i]]
        j = min(ok, key=lambda j: (room[j], j)) if ok else len(room)
        if not ok:
            room.append(max(capacity, sizes[i]))
        room[j] -= sizes[i]
        out[i] = j
    return out


def test_best_fit_decreasing_is_the_plain_loop():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        sizes = rng.integers(1, int(rng.choice([5, 50])), int(rng.integers(0, 80))).tolist()
        counts = collections.Counter(sizes)
        loads = collections.Counter()
        for size, a, b, shard in sharding.plan_shards(list(counts.items()), 60):
            loads[shard] += size * (b - a)
            counts[size] -= b - a
        assert not any(counts.values())
        assert sorted(loads.values()) == sorted(np.bincount(brute_fit(sizes, 60), sizes).astype(int).tolist() if sizes else [])
        plan = sharding.fit_into(list(collections.Counter(sizes).items()), 7)
        loads = collections.Counter()
        for size, a, b, shard in plan:
            loads[shard] += size * (b - a)
        assert all(0 <= x < 7 for x in loads) and sum(loads.values()) == sum(sizes)
        assert max(loads.values(), default=0) <= sum(sizes) / 7 + 60


def test_rooms_tree_is_a_sorted_list():
    rng, tree, plain = np.random.default_rng(3), sharding.Rooms(), []
    for i in range(3000):
        if plain and rng.random() < 0.45:
            tree.remove(plain.pop(int(rng.integers(len(plain)))))
        else:
            key = (int(rng.integers(0, 200)), i)
            tree.add(key)
            plain.append(key)
        size = int(rng.integers(0, 210))
        assert tree.tightest(size) == min((k for k in plain if k[0] >= size), default=None)
    depth = lambda t: 0 if t is None else 1 + max(depth(t[2]), depth(t[3]))
    assert depth(tree.root) <= 2 * np.log2(len(plain) + 1) + 1


def test_shards_of_all_groups_are_best_fit_decreasing(spark):
    rng = np.random.default_rng(8)
    rows = [(i, f"g{int(g)}" if g else None, int(n)) for i, (g, n) in enumerate(zip(rng.integers(0, 90, 400), rng.integers(0, 40, 400), strict=True))]
    rows += [(1000 + i, "hot", 3) for i in range(300)] + [(2000, "null", 5), (2001, "=x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long").withColumn("_group", F.lit(1)).withColumn("SLOT", F.lit("s"))
    out = sharding.shard_groups(df, "text", "size", 5, ["doc_id"]).collect()
    assert len(out) == len(rows) and "_group" in out[0].asDict()
    load, of, sizes = collections.Counter(), collections.defaultdict(set), collections.Counter()
    for r in out:
        load[r["shard"]] += r["size"] or 0
        of[r["text"]].add(r["shard"])
        sizes[r["text"]] += r["size"] or 0
    assert all(len(v) == 1 for v in of.values()) and len(of) == len({r[1] for r in rows})
    best = min(c for c in range(-(-sum(sizes.values()) // 5), sum(sizes.values()) + 1) if max(brute_fit(list(sizes.values()), max(c, max(sizes.values())))) < 5)
    assert sorted(load.values()) == sorted(np.bincount(brute_fit(list(sizes.values()), max(best, max(sizes.values()))), list(sizes.values()), minlength=5).astype(int).tolist())


def test_targets_stop_and_share_again():
    t = mixing.targets([("a", 1), ("b", 50), ("c", 1000), (None, 0)])
    assert t["a"] == 3 and t[None] == 0 and sum(t.values()) == pytest.approx(1051)
    assert t["b"] == 150 and t["c"] == pytest.approx(898)
    assert mixing.targets([]) == {}


def test_subset_sum_is_the_best_total():
    for seed in range(40):
        rng = np.random.default_rng(seed)
        lengths = sorted({int(x) for x in rng.integers(0, 30, 6)})
        counts = [int(x) for x in rng.integers(0, 3, len(lengths))]
        budget = int(rng.integers(0, 80))
        got = mixing.subset_sum(lengths, counts, budget)
        total = sum(a * b for a, b in zip(got, lengths, strict=True))
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= budget)
        assert total == best and all(a <= b for a, b in zip(got, counts, strict=True))
    far = mixing.subset_sum([7, 1000], [10**6, 10**6], 10**8 + 3)
    assert 0 <= 10**8 + 3 - far[0] * 7 - far[1] * 1000 < 7


@pytest.mark.parametrize(
    "lengths, counts, budget, best",
    [([100000, 500], [1, 100], 120000, 120000), ([90000], [3], 180000, 180000), ([70000], [2], 70000, 70000), ([70000], [2], 69999, 0), ([100000, 99000], [3, 3], 297000, 297000), ([99991, 99989, 3], [40, 40, 1], 39 * 99989, 39 * 99989), ([6, 200000], [10**6, 5], 10**6 + 1, 10**6)],
)
def test_subset_sum_takes_book_length_documents(lengths, counts, budget, best):
    got = mixing.subset_sum(lengths, counts, budget)
    assert sum(a * b for a, b in zip(got, lengths, strict=True)) == best and all(0 <= a <= b for a, b in zip(got, counts, strict=True))


def test_subset_sum_with_a_small_window_is_still_the_best():
    for seed in range(200):
        rng = np.random.default_rng(seed)
        lengths = sorted({int(x) for x in rng.integers(1, 40, 4)})
        counts = [int(x) for x in rng.integers(0, 5, len(lengths))]
        budget = int(rng.integers(0, 300))
        got = mixing.subset_sum(lengths, counts, budget, exact=1)
        best = max(s for c in itertools.product(*[range(n + 1) for n in counts]) if (s := sum(a * b for a, b in zip(c, lengths, strict=True))) <= budget)
        assert sum(a * b for a, b in zip(got, lengths, strict=True)) == best and all(0 <= a <= b for a, b in zip(got, counts, strict=True))


def test_mix(spark, docs):
    rows = docs.withColumn("size", mixing.count_words("text"))
    out = mixing.mix_sources(rows, "source", "size", ["doc_id"]).collect()
    assert len(out) == docs.count()
    assert all(r["size"] == len(WORD.findall(r["text"] or "")) for r in out)
    for s in {r["source"] for r in out}:
        own = [r for r in out if r["source"] == s]
        assert own[0]["source_size"] == sum(r["size"] for r in own)
        assert abs(sum(r["size"] * r["times"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
        assert all(0 <= r["times"] <= 3 for r in own)
    again = mixing.mix_sources(rows.repartition(7), "source", "size", ["doc_id"]).collect()
    key = lambda r: (r["doc_id"] or -1, r["text"] or "", r["times"])
    assert sorted(map(key, out)) == sorted(map(key, again))
    assert mixing.mix_sources(none(rows), "source", "size", ["doc_id"]).count() == 0
    n = sum(r["times"] for r in out)
    assert mixing.repeated(mixing.mix_sources(rows, "source", "size", ["doc_id"]), "times").count() == n


def test_window_plan_is_best_fit_decreasing():
    for seed in range(60):
        rng = np.random.default_rng(seed)
        capacity = int(rng.choice([10, 37, 100]))
        lengths = rng.integers(1, capacity + 1, int(rng.integers(0, 150))).tolist()
        used, places = collections.Counter(), collections.defaultdict(list)
        for length, a, b, window, each, offset in packing.plan_windows(collections.Counter(lengths), capacity):
            for r in range(a, b):
                places[window + (r - a) // each].append((offset + (r - a) % each * length, length))
                used[length] += 1
        assert used == collections.Counter(lengths)
        for v in places.values():
            v.sort()
            assert [o for o, _ in v] == [0, *itertools.accumulate(n for _, n in v)][:-1]
        loads = np.bincount(brute_fit(lengths, capacity), lengths) if lengths else []
        assert sorted(sum(n for _, n in v) for v in places.values()) == sorted(loads)


def test_pack(spark, docs):
    tokenizers = pytest.importorskip("tokenizers")
    path = queries.tokenizer_path()
    out = packing.pack_documents(docs, "doc_id", "text", path, 256).collect()
    full = tokenizers.Tokenizer.from_file(path)
    want = collections.Counter()
    for r in docs.collect():
        ids = [*full.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 256):
            want[(r["doc_id"], a, len(ids[a : a + 256]), zlib.crc32(np.array(ids[a : a + 256], "<u4").tobytes()), len(ids))] += 1
    assert want == collections.Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in out)
    for _, v in itertools.groupby(sorted(out, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        v, at = list(v), 0
        for r in v:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    assert packing.pack_documents(none(docs), "doc_id", "text", path, 256).count() == 0


# --- quality, near duplicates -------------------------------------------------------------------------------------


def brute_counts(t):
    w, seen, dup = WORD.findall(t or ""), set(), 0
    for line in (t or "").split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    c, mark = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7)), [0] * len(w)
    for i in range(len(w) - 7):
        if c[tuple(w[i : i + 8])] > 1:
            mark[i : i + 8] = [1] * 8
    return len(w), sum(map(len, w)), sum(ch in "#*$%&|<>" for ch in t or ""), dup, sum(mark)


def test_quality_limits_are_quantiles_within_two_per_cent_and_rerun_alike(spark):
    rng = np.random.default_rng(4)
    rows = [(int(n), int(n * rng.uniform(3, 9)), int(rng.integers(0, 4)), 10, int(rng.integers(0, 3)), int(rng.integers(0, 9)), f"g{i % 3}" if i % 50 else None) for i, n in enumerate(rng.integers(50, 500, 900))]
    df = spark.createDataFrame(rows, "n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long, lang string")
    got = {r["lang"]: r for r in quality.thresholds(df, ["lang"], least_rows=1).collect()}
    again = {r["lang"]: r for r in quality.thresholds(df.repartition(9), ["lang"], least_rows=1).collect()}
    assert got == again and set(got) == {"g0", "g1", "g2", None}
    exact = {"word_length": lambda r: r[1] / r[0], "symbols_a_word": lambda r: r[2] / r[0], "dup_lines": lambda r: r[4] / r[3], "repeats": lambda r: r[5] / r[0]}
    for g, limit in got.items():
        own = [r for r in rows if r[6] == g]
        for m, (_, lower, least, wide) in quality.MEASURES.items():
            x = sorted(map(exact[m], own))
            at = lambda rank: x[rank - 1]
            q = lambda p: at(int((len(x) - 1) * p) + 1)
            room = max(4 * (q(0.75) - q(0.25)), least)
            high = max(q(0.75) + room, at(max(1, min(int((len(x) - 1) * 0.99) + 1, len(x) - 2)))) if wide else q(0.75) + room
            assert limit[f"high_{m}"] == pytest.approx(high, rel=0.1)
            assert not lower or limit[f"low_{m}"] == pytest.approx(q(0.25) - room, abs=0.1 * high)


def test_small_groups_take_the_limits_of_their_language(spark):
    words = lambda n, i: " ".join(f"{'abcdefgh'[:n]}{i:03}{k}" for k in range(25))
    rows = [(i, words(2, i), "en", "big") for i in range(120)] + [(300 + i, words(8, i), "de", "big") for i in range(120)]
    rows += [(200, words(2, 7), "en", "tiny"), (201, words(8, 8), "en", "tiny"), (202, words(8, 9), "de", "tiny")]
    out = {r["doc_id"]: r for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), "doc_id", "text", ["lang", "source"]).collect()}
    assert out[200]["kept"] and out[202]["kept"] and out[201]["failed"] == ["word_length"]


def test_quality(spark, docs):
    extra = [(200, "a b c d e f g h " * 9, "en", "s1"), (201, "x\nx\n\n \n y\nx", "en", None), (202, "### " * 40, "en", "s1"), (203, "a " * 30, None, None)]
    df = docs.select("doc_id", "text", "lang", "source", "n_words").unionByName(spark.createDataFrame(extra, "doc_id long, text string, lang string, source string").withColumn("n_words", F.lit("z")))
    text = {r["doc_id"]: r["text"] for r in df.collect()}
    out = quality.judge_quality(df, "doc_id", "text", ["lang", "source"]).collect()
    assert len(out) == df.count()
    for r in out:
        n, chars, symbols, dup, rep = brute_counts(text[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, dup, rep)
        assert r["base_failed"] == (n < 20 or 100 * rep > 30 * n) and not (r["kept"] and r["base_failed"])
    assert quality.judge_quality(none(df), "doc_id", "text", ["lang", "source"]).count() == 0


def test_adaptive_limits_differ_by_group(spark):
    rows = [(i, ("ab " if i < 110 else "abcdefgh ") * 25, "g1" if i < 110 else "g2") for i in range(220)] + [(220, "abcdefgh " * 25, "g1")]
    rows = [(i, " ".join(f"{w}{k % 10}{k // 10}" for k, w in enumerate(t.split())), g) for i, t, g in rows]
    out = {r["doc_id"]: r["kept"] for r in quality.judge_quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", ["lang"]).collect()}
    assert out[220] is False and all(out[i] for i in range(220))


def test_near_duplicates(spark, docs):
    rng = np.random.default_rng(9)
    base = rng.integers(0, 500, 300)
    family = []
    for i in range(60):
        x = base.copy()
        x[rng.choice(300, int(rng.integers(0, 9)), replace=False)] += 1000 + i
        family.append((1000 + i, " ".join(map(str, x))))
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(family, "doc_id long, text string"))
    sets = [(r["doc_id"], shingles(r["text"])) for r in df.collect()]
    root = list(range(len(sets)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(sets)), 2):
        a, b = sets[i][1], sets[j][1]
        if a and b and 100 * len(a & b) >= 85 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    want = collections.Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))
    out = minhash.near_duplicates(df, "doc_id", "text", 85).collect()
    assert want == collections.Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out)
    assert all(r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"]) for r in out)
    assert minhash.near_duplicates(none(df), "doc_id", "text").count() == 0
    kept = minhash.drop_near_duplicates(docs, "doc_id", "text", 80)
    ids = collections.Counter(r["doc_id"] for r in kept.collect())
    assert kept.columns == docs.columns and max(ids.values()) == 1 and 2 not in ids and 9 not in ids and ids[8] == 1


# --- WARC, media, URLs --------------------------------------------------------------------------------------------


def test_warc(spark):
    rows = [(1, "http://a/1", "same"), (2, "http://a/2", "same"), (3, None, "other"), (4, "x\ny", None), (5, "http://a/5", ""), (6, "http://b", "ß" * 100_000), (None, "http://n", "same"), (7, "u", "other"), (7, "u", "other")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("payload", F.lit(1)).withColumn("file", F.lit("f"))
    index = warc.write_archives(pages, "page_id", "url", "html")
    got = warc.read_records(index).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(i or 0, last.get(h or "", 0))
    want = collections.Counter()
    for i, _, h in rows:
        body = (h or "").encode()
        response = i == last[h or ""]
        want[(i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if response else "revisit", None if response else last[h or ""])] += 1
    assert want == collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got)
    assert all(r["payload"] is None or len(r["payload"]) == r["payload_bytes"] for r in got)
    some = warc.read_records(index.where("page_id IN (2, 6)"), gap=10).collect()
    assert sorted(r["page_id"] for r in some) == [2, 6] and max(len(r["payload"]) for r in some) == 200_000
    least = warc.read_records(warc.write_archives(pages, "page_id", "url", "html", least=5)).collect()
    assert {(r["page_id"], r["record_type"]) for r in least if r["page_id"] in (1, 2, 4, 5)} == {(1, "response"), (2, "response"), (4, "response"), (5, "response")}
    assert warc.read_records(warc.write_archives(none(pages), "page_id", "url", "html")).count() == 0


@pytest.mark.parametrize("n", [0, 1, 191, 192, 193, 60_000])
def test_gif_round_trip(n):
    rng = np.random.default_rng(n)
    for data in (bytes(rng.integers(0, 256, n, np.uint8)), b"a" * n, b"the of and " * (n // 11)):
        n_bytes, total, media, digest, tail, size, _, _ = gif.store_text(data)
        want = data.ljust(max(192, -(-len(data) // 192) * 192))
        assert (n_bytes, total, digest, tail, size) == (len(data), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-16:]), len(media))


def test_gif_palettes_transparency_and_disposal():
    def frame(pixels, w, h, disposal, clear, palette):
        flags = disposal << 2 | (clear is not None)
        local = bytes(x for c in palette for x in c).ljust(768, b"\0")
        head = b"\x21\xf9\x04" + bytes([flags, 5, 0, clear or 0, 0]) + b"\x2c" + bytes([1, 0, 0, 0, w, 0, h, 0, 0x87]) + local
        return head + b"\x08" + gif._blocks(gif.lzw_pack(gif.lzw_codes(bytes(pixels))))

    red, green, blue = (255, 0, 0), (0, 255, 0), (0, 0, 255)
    data = b"GIF89a" + bytes([3, 0, 2, 0, 0x80, 0, 0]) + bytes([9, 9, 9, 8, 8, 8])
    data += frame([0, 0, 0, 0], 2, 2, 1, None, [red]) + frame([1, 0, 0, 1], 2, 2, 2, 0, [green, blue]) + frame([0], 1, 1, 3, None, [green]) + frame([0, 0], 2, 1, 0, None, [red]) + b"\x3b"
    f = list(gif.decode_gif(data))
    assert [x["start"] for x in f] == [0, 5, 10, 15] and [x["disposal"] for x in f] == [1, 2, 3, 0]
    assert f[1]["canvas"][0].tolist() == [[9, 9, 9], list(blue), list(red)]
    assert f[2]["canvas"][0].tolist() == [[9, 9, 9], list(green), [9, 9, 9]]  # the second frame's place went back to the background
    assert f[3]["canvas"].tolist() == [[[9, 9, 9], list(red), list(red)], [[9, 9, 9]] * 3]
    assert sum(gif.histogram(f[0]["canvas"])) == 18 and list(gif.decode_gif(b"no")) == []


def test_media_columns(spark, docs):
    out = gif.text_media(docs, "doc_id", "text").collect()
    assert len(out) == docs.count()
    frames = gif.media_frames(spark.createDataFrame([(r["doc_id"], r["media"]) for r in out if r["doc_id"] in (60, 5)] + [(1, None)], "doc_id long, media binary"), "doc_id", "media")
    got = frames.orderBy("doc_id", "frame").collect()
    assert {r["doc_id"] for r in got} == {5, 60} and [r["start_cs"] for r in got if r["doc_id"] == 60] == [10 * i for i in range(sum(r["doc_id"] == 60 for r in got))]
    assert gif.text_media(none(docs), "doc_id", "text").count() == 0


def test_url_rules_and_link_graph(spark):
    link = lambda *hosts: "".join(f'<a href="https://{h}/x">' for h in hosts)
    rows = [(1, "http://A.example.com/en/5?q", ""), (2, "https://a.example.com/en/71#f", ""), (3, "no scheme", link("b.org")), (4, None, None), (5, "http://b.org/es/1", ""), (6, "http://b.org/fr", ""), (7, "http://c.info/", link("b.org", "b.org")), (8, "http://d.info/p", link("t.net")), (9, "http://t.net/de/1", link("e.info")), (10, "http://e.info/", ""), (11, "http://x.com:80/en/", ""), (12, "http://a.example.com?x=http://y/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("Verdict", F.lit(1))
    out = {r["page_id"]: r for r in urls.filter_urls(pages, "url", "html", queries.URL_RULES, threshold=0.1).collect()}
    assert (out[1]["rule"], out[1]["verdict"], out[1]["host"], out[1]["path"]) == ("com/en/", "block", "a.example.com", "/en/5")
    assert (out[2]["rule"], out[2]["verdict"]) == ("example.com/en/7", "allow")
    assert (out[3]["host"], out[4]["path"], out[4]["rule"], out[4]["verdict"]) == ("", "", None, "allow")
    assert out[11]["rule"] is None and out[11]["host"] == "x.com:80" and out[12]["host"] == "a.example.com" and out[12]["path"] == ""
    assert out[7]["verdict"] == "block"  # it only links to a blocked host
    assert out[8]["verdict"] == "allow" and out[10]["verdict"] == "allow" and out[10]["trust"] > 0
    assert urls.filter_urls(none(pages), "url", "html", queries.URL_RULES).count() == 0
    # the scores are those of the power iteration
    hosts, edges = ["c.info", "b.org", "d.info", "t.net", "e.info", "a.example.com", "x.com:80"], [("c.info", "b.org"), ("d.info", "t.net"), ("t.net", "e.info")]
    seed = {"b.org": 0.5, "a.example.com": 1 / 3}
    score = {h: seed.get(h, 0.0) for h in hosts}
    for _ in range(30):
        stay = sum(v for h, v in score.items() if h not in {b for _, b in edges}) / sum(seed.values())
        flow = collections.Counter()
        for a, b in edges:
            flow[a] += score[b]
        score = {h: 0.15 * seed.get(h, 0.0) + 0.85 * (flow[h] + stay * seed.get(h, 0.0)) for h in hosts}
    got = {r["host"]: r["distrust"] for r in out.values() if r["host"]}
    assert all(got[h] == pytest.approx(score[h], abs=1e-4) for h in hosts)
    seed = {"t.net": 1.0, "a.example.com": 1 / 3}
    score = {h: seed.get(h, 0.0) for h in hosts}
    for _ in range(60):
        stay = sum(v for h, v in score.items() if h not in {a for a, _ in edges}) / sum(seed.values())
        flow = collections.Counter()
        for a, b in edges:
            flow[b] += score[a]
        score = {h: 0.15 * seed.get(h, 0.0) + 0.85 * (flow[h] + stay * seed.get(h, 0.0)) for h in hosts}
    got = {r["host"]: r["trust"] for r in out.values() if r["host"]}
    assert all(got[h] == pytest.approx(score[h], abs=1e-4) for h in hosts) and got["e.info"] > 0.1


def test_received_parts_are_those_of_all_seeds(spark, monkeypatch):
    """Trust and distrust against matrices, with hub hosts that are joined by salts."""
    rng = np.random.default_rng(4)
    n = 30
    links = {(int(a), int(b)) for a, b in rng.integers(0, n, (80, 2)) if a != b} | {(i, 0) for i in range(1, n)} | {(1, i) for i in range(2, n)}
    w = np.zeros((n, n))
    for a, b in links:
        w[a, b] = rng.uniform(0.5, 2)
    w /= np.maximum(w.sum(1, keepdims=True), 1e-12)
    trusted, blocked = (0.5 * rng.uniform(size=n) * (rng.uniform(size=n) < 0.2) for _ in range(2))
    hosts = spark.createDataFrame([(f"h{i}", float(trusted[i]), float(blocked[i])) for i in range(n)], "host string, trusted double, blocked double")
    edges = spark.createDataFrame([(f"h{a}", f"h{b}", float(w[a, b])) for a, b in links], "src string, dst string, share double")
    monkeypatch.setattr(shared, "BROADCAST_ROWS", 3)
    got = {r["host"]: r for r in urls.spread_trust(hosts, edges, rounds=200).collect()}
    back = w.T / np.maximum(w.sum(0)[:, None], 1e-12)
    for kind, move, seed in (("trust", w, trusted), ("distrust", back, blocked)):
        mass = np.linalg.inv(np.eye(n) - 0.85 * move.T) @ seed
        received = np.linalg.inv(np.eye(n) - 0.85 * move.T @ np.diag(1 - trusted - blocked)) @ (0.85 * move.T)
        seen, one = received @ seed, received @ np.ones(n)
        part = np.divide(seen, one, out=np.zeros(n), where=one > 1e-12)
        for i in range(n):
            assert got[f"h{i}"][kind] == pytest.approx(mass[i] * seed.sum() / mass.sum(), abs=1e-5)
            assert got[f"h{i}"][f"{kind}_in"] == pytest.approx(part[i], abs=1e-4)


# --- queries ------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_its_sql(spark, sf_dir, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    want = con.sql(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    key = lambda d: sorted(map(str, d[sorted(want.columns)].astype(object).where(d.notna(), None).itertuples(index=False, name=None)))
    assert key(got) == key(want)


def test_verdicts_over_links_equal_their_sql(spark):
    duckdb = pytest.importorskip("duckdb")
    pd = pytest.importorskip("pandas")
    rng = np.random.default_rng(2)
    hosts = [f"h{i}.example" for i in range(12)] + ["bad.org", "good.org"]
    rules = [("block", "bad.org", "/"), ("allow", "good.org", "/"), ("block", "h3.example", "/b")]
    rows = [(i, f"http://{rng.choice(hosts)}/{rng.choice(['a', 'b'])}{i}", "".join(f'<a href="//{h}/">' for h in rng.choice(hosts, int(rng.integers(0, 5))))) for i in range(150)]
    rows += [(200 + i, f"http://only{i % 3}.example/{i}", '<a href="//bad.org/">') for i in range(9)]  # these link to the blocked host alone
    frame = pd.DataFrame(rows, columns=["page_id", "url", "html"])
    con = duckdb.connect()
    con.register("pages", frame)
    want = {r[0]: r[1:] for r in con.sql(oracle.url_verdicts(rules)).fetchall()}
    out = urls.filter_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), "url", "html", rules).collect()
    assert {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in out} == want
    assert {"allow", "block"} == {r["verdict"] for r in out if r["rule"] is None}
