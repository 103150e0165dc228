"""The pipeline's stages against plain programs over the rows that each gets."""

import collections
import itertools
import re

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tideframe.llm import language, mixing, packing, queries, shared, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def toxic(spark, docs, rows, sf_dir):
    score = toxicity.score_texts([r["text"] for r in rows], queries.toxicity_model(docs, queries.table(spark, sf_dir, "labels")))
    return collections.Counter(r["doc_id"] for r, s in zip(rows, score, strict=True) if s < 0.7)


def known_language(spark, docs, rows, sf_dir):
    names, score = language.scores([r["text"] for r in rows], queries.language_model(docs))
    return collections.Counter(r["doc_id"] for r, n, s in zip(rows, names, score, strict=True) if n != "und" and s >= 0.5)


def first_of_near(spark, docs, rows, sf_dir):
    sets, root = [shingles(r["text"]) for r in rows], list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in itertools.combinations(range(len(rows)), 2):
        a, b = sets[i], sets[j]
        if a and b and 100 * len(a & b) >= 80 * len(a | b):
            root[find(j)] = find(i)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(r["doc_id"], least.get(find(i), r["doc_id"]))
    return collections.Counter(r["doc_id"] for i, r in enumerate(rows) if not sets[i] or least[find(i)] == r["doc_id"])


def test_stages_are_plain_programs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    plain = {"toxicity": toxic, "language": known_language, "near_duplicates": first_of_near}
    assert [name for name, _ in corpus_pipeline.STAGES] == [*plain, "mixing", "packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        rows = docs.collect()
        out = shared.written(stage(spark, docs, sf_dir))
        assert out.columns == docs.columns, name
        got = collections.Counter(r["doc_id"] for r in out.collect())
        if name in plain:
            assert got == plain[name](spark, docs, rows, sf_dir), name
        else:
            size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in rows}
            total = collections.Counter()
            for r in rows:
                total[r["source"]] += size[r["doc_id"]]
            goal = mixing.targets(list(total.items()))
            for s, words in total.items():
                own = [r["doc_id"] for r in rows if r["source"] == s]
                counts = collections.Counter(size[d] for d in own)
                whole = int(goal[s] // words) if words else 0
                more = mixing.subset_sum(list(counts), list(counts.values()), int(round(goal[s])) - whole * words)
                taken = dict(zip(counts, more, strict=True))
                assert all(whole <= got[d] <= whole + 1 for d in own)
                assert collections.Counter(size[d] for d in own if got[d] > whole) == +collections.Counter(taken)
        docs = out
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    tokens = packing.tokens(queries.tokenizer_path())
    lengths = [len(tokens.encode(r["text"] or "")) // 4 + 1 for r in docs.collect()]
    pieces = [n for x in lengths for n in [2048] * (x // 2048) + [x % 2048] * bool(x % 2048)]
    assert sorted(r["length"] for r in packed) == sorted(pieces)
    room = []
    for n in sorted(pieces, reverse=True):
        fit = [i for i, r in enumerate(room) if r >= n]
        if fit:
            room[min(fit, key=lambda i: room[i])] -= n
        else:
            room.append(2048 - n)
    loads = collections.Counter()
    for r in packed:
        loads[r["sequence_id"]] += r["length"]
    assert sorted(loads.values()) == sorted(2048 - r for r in room)


def test_empty_documents_go_through(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir)
        assert out.count() == 0
    odd = spark.createDataFrame([(1, None, None, None, None), (None, "the of and", "en", "s", 3), (1, "", "en", "s", 0), (1, "", "en", "s", 0)], docs.schema)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, sf_dir).columns == docs.columns, name
        assert stage(spark, odd, sf_dir).agg(F.count(F.lit(1))).first()[0] >= 0
    assert np.isfinite(odd.count())
