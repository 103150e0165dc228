"""How far the sources of a language stand from each other, term by term and in all, in whole numbers.

Terms are counted by Arrow inside mapInArrow: ascii_lower, split_pattern_regex, dictionary_encode and a hash group_by over
(source, term) give partial counts, which Spark adds up. A language's kept terms are dealt to shards by a hash of the term;
a shard's counts are columns (term, source, count), from which numpy makes the shard's part of every divergence of two
sources. Zero counts are never written out: f(p, q) over all terms is that of two zero counts for every term, corrected
where one or both of the sources have the term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import keyed_join, text_slices, unit_hash, written

#: Bytes between terms: all of ASCII but letters.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
#: Bytes of text that are split at once, and partial counts that a task holds before it hands them over.
BLOCK, HELD = 4 << 20, 300_000
#: Kept terms a shard, and cells that numpy works on at once.
SHARD, CELLS = 50_000, 1 << 20
SCALE = 1_000_000_000


def _stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(row of each stretch, stretches) of at most some BLOCK bytes; longer texts are cut at spaces, which end terms."""
    rows: list[int] = []
    parts: list[str] = []
    held = 0
    for i, t in enumerate(texts.to_pylist()):
        for part in text_slices(t, BLOCK) if len(t) > BLOCK else (t,):
            rows.append(i)
            parts.append(part)
            held += len(part)
            if held >= BLOCK:
                yield np.array(rows), pa.array(parts, pa.large_string())
                rows, parts, held = [], [], 0
    if rows:
        yield np.array(rows), pa.array(parts, pa.large_string())


def _by_row(texts: pa.Array) -> pa.Table:
    """(row, term, n) of a batch's texts."""
    found = []
    for rows, parts in _stretches(texts):
        words = pc.split_pattern_regex(pc.ascii_lower(parts), pattern=BETWEEN)
        at, word = pc.list_parent_indices(words), pc.list_flatten(words)
        there = pc.not_equal(pc.binary_length(word), 0)
        coded = pc.dictionary_encode(pc.filter(word, there))
        counts = pa.table({"row": pa.array(rows).take(pc.filter(at, there)), "term": coded.indices}).group_by(["row", "term"]).aggregate([("term", "count")])
        found.append(pa.table({"row": counts["row"], "term": coded.dictionary.take(counts["term"].combine_chunks()), "n": counts["term_count"]}))
    if not found:
        return pa.table({"row": pa.array([], pa.int64()), "term": pa.array([], pa.large_string()), "n": pa.array([], pa.int64())})
    # a text in several stretches has one row a term again
    return found[0] if len(found) == 1 else pa.concat_tables(found).group_by(["row", "term"]).aggregate([("n", "sum")]).rename_columns(["row", "term", "n"])


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs): occurrences of each term and the documents that have it. Null is ''."""
    keys = ["lang", "source", "term"]

    def merged(tables: list[pa.Table]) -> pa.Table:
        out = pa.concat_tables(tables).group_by(keys).aggregate([("n", "sum"), ("docs", "sum")])
        return out.select([*keys, "n_sum", "docs_sum"]).rename_columns([*keys, "n", "docs"])

    def batches_of(table: pa.Table) -> list[pa.RecordBatch]:
        kinds = pa.schema([*[(k, pa.string()) for k in keys], ("n", pa.int64()), ("docs", pa.int64())])
        return table.cast(kinds).combine_chunks().to_batches(max_chunksize=20_000)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0
        for batch in batches:
            one = _by_row(batch.column(2))
            at = one["row"].combine_chunks()
            # Arrow's groups are by (lang, source) and term in one step: a row of `one` is a document that has the term
            held.append(pa.table({"lang": batch.column(0).take(at), "source": batch.column(1).take(at), "term": one["term"], "n": one["n"], "docs": pa.array(np.ones(len(at), np.int64))}))
            rows += len(at)
            if rows > HELD:
                held = [merged(held)]
                rows = len(held[0])
                if rows > HELD // 2:
                    yield from batches_of(held[0])
                    held, rows = [], 0
        if held:
            yield from batches_of(merged(held))

    texts = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    return texts.mapInArrow(count, "lang string, source string, term string, n long, docs long").groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share(n: Column, total: Column) -> Column:
    """1 + floor(10^9 * n / total) for 0 <= n <= total, in three steps of 10^3: exact below a total of 9 * 10^15."""
    rest, out = n, F.lit(0).cast("long")
    for _ in range(3):
        out = out * 1000 + F.call_function("div", rest * 1000, total)
        rest = F.pmod(rest * 1000, total)
    return out + 1


def _shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """As share(), of arrays."""
    rest, out = n, 0
    for _ in range(3):
        out, rest = out * 1000 + rest * 1000 // total, rest * 1000 % total
    return out + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def shard_divergences(term: np.ndarray, source: np.ndarray, n: np.ndarray, totals: np.ndarray, mine: np.ndarray) -> np.ndarray:
    """The shard's part of the divergence of each source of ``mine`` (positions) from every source.

    A row is a term (numbered from 0, in order), a source and its count; totals are the sources' occurrences and kept terms.
    """
    terms, every = (int(term[-1]) + 1 if len(term) else 0), np.arange(len(totals))
    value, none = _shares(n + 1, totals[source]), _shares(np.ones(len(totals), np.int64), totals)
    base = apart(none[mine][:, None], none)
    out, row = terms * base, np.full(len(totals), -1)
    row[mine] = np.arange(len(mine))
    # the terms that one of the two has: equal shares of a source count at once
    (of, p), times = np.unique(np.stack([source, value]), axis=1, return_counts=True) if len(term) else (np.zeros((2, 0), np.int64), np.zeros(0, np.int64))
    step = max(1, CELLS // max(1, len(totals)))
    for a in range(0, len(of), step):
        o, v, m = of[a : a + step], p[a : a + step, None], times[a : a + step, None]
        own = row[o] >= 0
        np.add.at(out, row[o[own]], m[own] * (apart(v[own], none) - base[row[o[own]]]))
        np.add.at(out.T, o, m * (apart(none[mine], v) - base.T[o]))
    # those that both have: pairs of sources within a term
    first = np.searchsorted(term, np.arange(terms))
    width = np.diff(np.append(first, len(term)))[term]
    left = np.flatnonzero(row[source] >= 0)
    ends = np.cumsum(width[left])
    a = 0
    while a < len(left):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CELLS, "right")))
        i = np.repeat(left[a:b], width[left[a:b]])
        j = first[term[i]] + np.arange(len(i)) - np.repeat(np.cumsum(width[left[a:b]]) - width[left[a:b]], width[left[a:b]])
        r, h = row[source[i]], every[source[j]]
        both = apart(value[i], value[j]) - apart(value[i], none[h]) - apart(none[source[i]], value[j]) + base[r, h]
        np.add.at(out, (r, h), both)
        a = b
    return out


def _shard(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """(lang, source, item, value): a shard's part of the divergences of one part of a language's sources from all."""
    names = right["source"].combine_chunks()
    left = left.set_column(left.column_names.index("term"), "term", pc.dictionary_encode(left["term"].combine_chunks()).indices).sort_by("term")
    numbers = [np.asarray(x, np.int64) for x in (left["term"], pc.index_in(left["source"], value_set=names), left["n"], right["total"])]
    mine = np.flatnonzero(np.asarray(right["part_of"]) == key[2].as_py())
    value = shard_divergences(*numbers, mine)
    g, h = np.nonzero(mine[:, None] != np.arange(len(names)))
    return pa.table({"lang": pa.array([key[0].as_py()] * len(g), pa.string()), "source": names.take(pa.array(mine[g])), "item": names.take(pa.array(h)), "value": pa.array(value[g, h])})


def source_divergences(df: DataFrame, text: str, lang: str = "lang", source: str = "source", least_docs: int = 3, top: int = 200, part_size: int = 1000) -> DataFrame:
    """(lang, source, part, item, value, rank), see below; null text, lang and source are ''.

    Terms are runs of letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms of at least
    ``least_docs`` of its documents. Within (lang, source), a kept term's share is p = 1 + floor(10^9 (n + 1) / (N + V)): n its
    occurrences, N those of all kept terms, V their number. f(p, q) = floor((p - q)^2 / q). Part `pair` has, for every other
    source of the language, the sum of f over the kept terms (0 without any), q being the other's share; part `term` has the
    ``top`` terms that the source has more than its language (p > q) by f, q being the language's share. Ranks go from 1 by
    falling value, ties by item bytewise.

    All sums are whole numbers of 64 bits: exact up to 9 * 10^15 occurrences and 10^9 kept terms a language. Every group of
    an occurring (lang, source) has its pairs, also without terms; a language of one source has none. Repeated rows are
    documents each, an empty table gives an empty one, other columns are not read. Pairs are as many as sources squared;
    sources are worked on ``part_size`` at a time, so a task holds part_size x sources numbers.
    """
    counts = written(term_counts(df, text, lang, source))
    entry = F.struct("source", "n")
    kept = written(counts.groupBy("lang", "term").agg(F.sum("docs").alias("_docs"), F.sum("n").alias("every"), F.collect_list(entry).alias("e")).where(F.col("_docs") >= least_docs).drop("_docs"))
    found = kept.select("lang", "term", "every", F.explode("e").alias("e")).select("lang", "term", "every", "e.*")
    groups = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"))]).distinct()
    langs = written(kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("every").alias("lang_n")).withColumnRenamed("lang", "_lang"))
    own = written(found.groupBy("lang", "source").agg(F.sum("n").alias("own_n")).withColumnsRenamed({"lang": "_l", "source": "_s"}))
    spread = unit_hash(3, "source")
    sized = keyed_join(keyed_join(groups, own, [("lang", "_l"), ("source", "_s")], spread), langs, [("lang", "_lang")], spread)
    v = F.coalesce("v", F.lit(0))
    sized = written(sized.select("lang", "source", v.alias("v"), (F.coalesce("own_n", F.lit(0)) + v).alias("total"), (F.coalesce("lang_n", F.lit(0)) + v).alias("lang_total")))
    most = sized.agg(F.coalesce(F.max("v"), F.lit(0))).first()[0]
    sources = sized.groupBy("lang").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]

    # terms of a source against its language
    own = sized.select(F.col("lang").alias("_l"), F.col("source").alias("_s"), "total", "lang_total")
    terms = keyed_join(found, own, [("lang", "_l"), ("source", "_s")], unit_hash(5, "term"), "inner")
    p, q = share(F.col("n") + 1, F.col("total")), share(F.col("every") + 1, F.col("lang_total"))
    terms = terms.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    terms = terms.select("lang", "source", "item", F.call_function("div", (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("q")).alias("value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    terms = terms.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= top).withColumn("part", F.lit("term"))

    # sources against each other, by shards of the terms
    shards, parts = max(1, -(-most // SHARD)), max(1, -(-sources // part_size))
    part = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part")
    left = found.select("lang", F.pmod(unit_hash(7, "term"), F.lit(shards)).cast("int").alias("shard"), "term", "source", "n", part)
    right = sized.where("v > 0").select("lang", "source", "total", F.pmod(spread, F.lit(parts)).cast("int").alias("part_of"), part)
    right = right.select("*", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"))
    keys = ["lang", "shard", "part"]
    sums = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(_shard, "lang string, source string, item string, value long")
    bare = sized.where("v = 0").select("lang", "source")
    bare = bare.join(bare.withColumnRenamed("source", "item"), "lang").where("source <> item").select("lang", "source", "item", F.lit(0).cast("long").alias("value"))
    pairs = sums.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).unionByName(bare)
    pairs = pairs.withColumn("rank", F.row_number().over(by_value)).withColumn("part", F.lit("pair"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))
