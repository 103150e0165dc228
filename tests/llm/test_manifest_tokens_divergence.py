"""Source divergences, Merkle proofs and token counts against plain programs: nulls, empty and long texts, ties, repeated rows,
empty tables, clashing columns."""

import collections
import hashlib
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideframe.llm import divergence, merkle, queries, shared, tokens

SCALE = 10**9


def term_docs(spark):
    rng = np.random.default_rng(3)
    words = ["Maß", "alpha", "BETA", "beta", "gamma", "é", "日本", "x", "zeta", "Éa"]
    text = lambda: " ".join(rng.choice(words, int(rng.integers(0, 12)), p=np.array([5, 9, 3, 3, 4, 2, 2, 1, 1, 1]) / 31))
    rows = [(i, text(), ["de", "en", None, ""][i % 4], [None, "s1", "s2", "s3", ""][int(rng.integers(0, 5))]) for i in range(120)]
    rows += [(200, None, "de", "s1"), (201, "", "fr", "s1"), (202, "1 2 -- _", "fr", "s2"), (203, "solo", "fr", "s3"), (204, "a" * 70_000 + " " + "b-a " * 3000, "en", "s1")]
    rows += [(7, "beta beta alpha", "de", "s2")] * 4 + [(300 + i, "rare", "it", "s1") for i in range(3)]
    return spark.createDataFrame(rows, "doc_id int, text string, lang string, source string").withColumn("n", F.lit(1)).withColumn("Term", F.lit("t")).withColumn("part", F.lit(2))


def plain_divergences(rows, least=3, top=200):
    counts, docs, groups = collections.Counter(), collections.Counter(), collections.defaultdict(set)
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups[lang].add(source)
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        for t in found:
            counts[lang, source, t] += 1
        for t in set(found):
            docs[lang, t] += 1
    out = []
    for lang, sources in groups.items():
        kept = sorted(t for k, t in docs if k == lang and docs[k, t] >= least)
        n = {s: sum(counts[lang, s, t] for t in kept) for s in sources}
        p = {s: {t: 1 + SCALE * (counts[lang, s, t] + 1) // (n[s] + len(kept)) for t in kept} for s in sources}
        all_ = {t: sum(counts[lang, s, t] for s in sources) for t in kept}
        q = {t: 1 + SCALE * (all_[t] + 1) // (sum(all_.values()) + len(kept)) for t in kept}
        apart = lambda a, b: (a - b) * (a - b) // b
        for s in sources:
            pairs = [(-sum(apart(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            terms = [(-apart(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s, t] and p[s][t] > q[t]]
            for part, items in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, name, -v, i + 1) for i, (v, _, name) in enumerate(items)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_divergences_are_the_plain_sums(spark, monkeypatch, small):
    df = term_docs(spark).repartition(5)
    if small:  # many shards, parts, stretches, hand-overs and pieces of pairs
        for name, value in (("BLOCK", 500), ("HELD", 20), ("CELLS", 7), ("SHARD", 2)):
            monkeypatch.setattr(divergence, name, value)
    out = divergence.source_divergences(df, "text", top=4 if small else 200, part_size=2 if small else 1000)
    assert out.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [(r["text"], r["lang"], r["source"]) for r in df.collect()]
    assert sorted(map(tuple, out.collect())) == plain_divergences(rows, top=4 if small else 200)
    if not small:
        assert divergence.source_divergences(df.where("1 = 0"), "text").count() == 0


def test_shares_are_exact(spark):
    cases = [(1, 1), (0, 5), (8_999_999_999_999_999 // 1000, 8_999_999_999_999_999), (123_456_789_012, 987_654_321_098_765), (7, 9_000_000_000_000_000)]
    df = spark.createDataFrame(cases, "a long, b long")
    want = [1 + SCALE * a // b for a, b in cases]
    assert [r[0] for r in df.select(divergence.share(F.col("a"), F.col("b"))).collect()] == want
    assert divergence._shares(*np.array(cases).T).tolist() == want


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def plain_path(levels, i):
    out = []
    for level in levels[:-1]:
        out.append((level[i ^ 1] if i ^ 1 < len(level) else "", bool(i & 1)))
        i >>= 1
    return out


def plain_proofs(rows):
    """(key, leaf) -> subroot, root, steps of rows (group, order, leaf)."""
    groups = collections.defaultdict(list)
    for g, o, leaf in rows:
        groups[g].append((o is not None, o or 0, leaf))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: plain_tree([x[2] for x in sorted(groups[g])]) for g in names}
    top = plain_tree([trees[g][-1][0] for g in names])
    out = []
    for at, g in enumerate(names):
        for i, (has, o, leaf) in enumerate(sorted(groups[g])):
            out.append((g, o if has else None, leaf, trees[g][-1][0], top[-1][0], plain_path(trees[g], i) + plain_path(top, at)))
    return out


@pytest.mark.parametrize("depth", [8, 2, 1])
def test_proofs_are_those_of_plain_trees(spark, monkeypatch, depth):
    monkeypatch.setattr(merkle, "DEPTH", depth)
    sizes = {None: 1, "": 2, "a": 5, "b": 16, "é": 17, "z": 33} if depth < 8 else {None: 3, "de": 300, "en": 1, "fr": 513}
    if depth < 8:
        sizes |= {f"k{i}": 1 for i in range(7)}
    rows = [(g, i, H(str(g), str(i))) for g, n in sizes.items() for i in range(n)]
    rows += [("a", 3, H("a", "3")), ("a", 3, H("other")), ("a", None, H("null")), ("b", None, H("b"))]  # repeated and tied rows
    df = spark.createDataFrame(rows, "grp string, ord int, leaf string").withColumn("place", F.lit(1)).withColumn("node", F.lit("x")).withColumn("g", F.lit(2.5)).repartition(4)
    out = merkle.merkle_proofs(df, "grp", ["ord"], "leaf", ["grp", "ord", "node"]).withColumn("folded", merkle.fold(F.col("leaf"), F.col("steps"))).withColumn("line", merkle.siblings(F.col("steps")))
    got = sorted((str(r["grp"]), str(r["ord"]), r["leaf"], r["subroot"], r["root"], r["line"], r["folded"], r["node"]) for r in out.collect())
    want = sorted((str(g), str(o), leaf, sub, root, "".join(s for s, _ in path), root, "x") for g, o, leaf, sub, root, path in plain_proofs(rows))
    assert got == want
    assert merkle.merkle_proofs(df.where("1 = 0"), "grp", ["ord"], "leaf", ["ord"]).count() == 0


def test_leaves_are_prefixed_fields(spark):
    long = "ä" * 100_000
    df = spark.createDataFrame([(1, None, "x"), (None, "", long)], "a long, b string, c string")
    got = [r[0] for r in df.select(merkle.leaf_of(F.col("a"), F.col("b"), F.col("c"))).collect()]
    assert got == [H("1:1", "-", "1:x"), H("-", "0:", "200000:", long)]


def test_ordered_ranks_of_one_hot_key(spark):
    df = spark.createDataFrame([("k" if i % 10 else None, i * 7919 % 1000) for i in range(1000)], "k string, v int").repartition(6)
    out = merkle.ordered_rank(df, ["k"], [F.col("v")], "r", 1000).collect()
    for key in ("k", None):
        own = sorted((r["v"], r["r"]) for r in out if r["k"] == key)
        assert [r for _, r in own] == list(range(len(own)))


@pytest.fixture(scope="module")
def words_file():
    pytest.importorskip("tokenizers")
    return queries.tokenizer_path("word_bpe_49k.json")


def library_count(path):
    import tokenizers

    full = tokenizers.Tokenizer.from_file(path)
    return lambda text: len(full.encode(text, add_special_tokens=False).ids)


def test_proved_strings_are_one_token(words_file):
    proof, count = tokens.prove(words_file), library_count(words_file)
    some = random.Random(0).sample(sorted(proof.whole), 2000)
    assert all(count(w) == 1 for w in some) and len(proof.whole) > 30_000
    assert set("abcé") <= set(proof.letters) and set("07") <= set(proof.numbers) and set("!'") <= set(proof.others) and set(" \n\t") <= set(proof.spaces)


def test_counts_are_the_librarys(words_file):
    count, own = library_count(words_file), tokens.Counter(words_file, tokens.prove(words_file))
    rng = random.Random(1)
    bits = ["'", "s", "'S", "ll", "LL", "İ", "ſ", "Σ", "ς", "é", "é", "́", " ", "\n", "\x1c", "\x85", "\xa0", "1", "½", "²", "!", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "日本", "😀", "ǅ", " ", " ", "​", "K", "Å", "\0", "</w>", "ß", "ﬁ", "한", "가", "q" * 70, "the", "Hello"]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert own.count(text) == count(text), text
    long = "The quick brown fox's 3 hens " * 60_000
    assert own.count(long) == count(long)
    assert own.count("ab" * 100_000) == count("ab" * 100_000)


def test_token_column(spark, words_file, tmp_path):
    texts = ["Hello world, it's <|endoftext|> 42!", "", None, "naïve 日本語 é", "Hello world, it's <|endoftext|> 42!"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id int, text string, N_TOKENS string").withColumn("_text", F.lit(1))
    out = tokens.count_tokens(df, "text", words_file, limit=9).orderBy("doc_id")
    count = library_count(words_file)
    assert [r["n_tokens"] for r in out.collect()] == [count(t or "") for t in texts]
    assert out.columns == ["doc_id", "text", "_text", "n_tokens", "over_limit"] and [r["over_limit"] for r in out.collect()] == [count(t or "") > 9 for t in texts]
    assert tokens.count_tokens(df.where("1 = 0"), "text", words_file).count() == 0
    # files of another form are counted by their library
    spec = json.loads(open(words_file, encoding="utf-8").read())
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec | {"normalizer": None}), encoding="utf-8")
    for path in (str(other), queries.tokenizer_path("byte_bpe_50k.json")):
        assert tokens.prove(path) is None and tokens.Counter(path, None).count("Hello Big worlds") == library_count(path)("Hello Big worlds")
    sentencepiece = pytest.importorskip("sentencepiece")
    path = queries.tokenizer_path("piece_bpe_32k.model")
    assert tokens.Counter(path, tokens.prove(path)).count("Hello Big worlds") == len(sentencepiece.SentencePieceProcessor(model_file=path).encode("Hello Big worlds"))


def test_op13_counts_every_text(spark, sf_dir, words_file):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    count = library_count(words_file)
    got = {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in queries.op13_tokens(spark, sf_dir).collect()}
    assert got == {r["doc_id"]: (len((r["text"] or "").encode()), n := count(r["text"] or ""), n > 2048) for r in docs}
    assert shared.TEXT_BATCH
