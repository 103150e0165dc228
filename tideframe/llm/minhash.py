"""Near duplicates by min-max hashing: each permutation gives the least and the greatest hash of a text's shingles, so a
signature of 2p values costs p hash evaluations a shingle; bands of the signature are the buckets.

Texts with one shingle set are one class, so copies never meet in pairs. In a bucket, classes are compared with a leader,
the class that shares most buckets with others, and not with each other; exact similarities to the leader then tell, as
1 - Jaccard is a metric, which classes can still be linked. Small buckets' remaining pairs are compared at once, larger
buckets choose further leaders, until none is open: no candidate is dropped. Every link is confirmed on full sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import free_names, light, lower_ascii, mix, runs_of_words, span_hashes, text_blocks, word_spans, written

BANDS, ROWS, WORDS = 24, 6, 5
#: Buckets of up to so many open classes are compared pair by pair, larger ones in blocks of so many shingles.
PAIRED, BLOCK = 32, 40_000


def _permutations(n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 20)
    return mix(i * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1), mix(i * np.uint64(0xD1B54A32D192ED03))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct hashes of all rows' shingles, offsets). Fewer words than ``words`` are one shingle; none, no shingle."""
    n = len(offsets) - 1
    low = lower_ascii(data)
    start, end, row = word_spans(low, offsets)
    w = span_hashes(low, start, end)
    count = np.bincount(row, minlength=n)
    key, at = runs_of_words(w, row, words)
    of = row[at]
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < words))
    if len(short):
        total = np.zeros(len(short), np.uint64)
        for i in range(words - 1):
            has = count[short] > i
            total[has] = mix(total[has] + w[first[short[has]] + i] * np.uint64(2 * i + 3))
        key, of = np.concatenate([key, mix(total ^ np.uint64(0x5851F42D4C957F2D) * count[short].astype(np.uint64))]), np.concatenate([of, short])
    order = np.lexsort((key, of))
    key, of = key[order], of[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
    key, of = key[new], of[new]
    return key, np.searchsorted(of, np.arange(n + 1))


def signatures(keys: np.ndarray, offsets: np.ndarray, bands: int, rows: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(band hashes, low bytes of all values), one row for each non-empty set: band b holds ``rows`` values, least and
    greatest in turn."""
    full = np.flatnonzero(np.diff(offsets))
    starts = offsets[full]
    p = bands * rows // 2
    a, b = _permutations(p, seed)
    low, high = np.empty((len(full), p), np.uint64), np.empty((len(full), p), np.uint64)
    for i in range(p if len(full) else 0):
        x = keys * a[i] + b[i]
        low[:, i] = np.minimum.reduceat(x, starts)
        high[:, i] = np.maximum.reduceat(x, starts)
    values = np.stack([low, high], 2).reshape(len(full), bands, rows)
    out = np.tile(np.arange(bands, dtype=np.uint64) + np.uint64(1), (len(full), 1))
    for i in range(rows):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + values[:, :, i])
    return out, mix(values.reshape(len(full), bands * rows)).astype(np.uint8)


def shingle_features(df: DataFrame, doc_id: str, text: str, bands: int = BANDS, rows: int = ROWS, words: int = WORDS, seed: int = 7) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls (16 bytes that tell the shingle set; null if it is empty), bands
    (array<long>) and sig (a byte of each value of the signature)."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_blocks(batch.column(2)):
                keys, at = shingle_sets(data, offsets, words)
                n = np.diff(at)
                found, low = signatures(keys, at, bands, rows, seed)
                full = np.flatnonzero(n)
                cls: list = [None] * (b - a)
                sig: list = [None] * (b - a)
                if len(full):
                    one, two = np.add.reduceat(mix(keys), at[full]), np.bitwise_xor.reduceat(mix(keys * np.uint64(0xD1B54A32D192ED03)), at[full])
                    raw = np.stack([mix(one + n[full].astype(np.uint64)), two], 1).astype("<u8").tobytes()
                    for i, r in enumerate(full):
                        cls[r], sig[r] = raw[16 * i : 16 * i + 16], low[i].tobytes()
                ends = np.zeros(b - a + 1, np.int32)
                ends[1:] = np.cumsum(n > 0) * bands
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(found.astype(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array(n.astype(np.int64)), pa.array(cls, pa.binary()), lists, pa.array(sig, pa.binary())], names=["doc_id", "text_hash", "n_shingles", "cls", "bands", "sig"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text)).mapInArrow(features, f"doc_id {kind}, text_hash long, n_shingles long, cls binary, bands array<long>, sig binary")


def shared_shingles(pairs: DataFrame, words: int = WORDS) -> DataFrame:
    """(a, b, total, same) from (a, text_a, b, text_b, total): how many shingles both texts have, on their full sets. While
    consecutive rows have the same a, its set is computed once."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, np.zeros(0, np.uint64)
        for batch in batches:
            names, same = batch.column(0).to_pylist(), np.zeros(batch.num_rows, np.int64)
            for a, b, data, offsets in text_blocks(batch.column(3)):
                keys, at = shingle_sets(data, offsets, words)
                for i in range(a, b):
                    if names[i] != last:
                        last = names[i]
                        left = np.frombuffer(batch.column(1)[i].as_py().encode(), np.uint8)
                        held, _ = shingle_sets(left, np.array([0, len(left)], np.int64), words)
                    own = keys[at[i - a] : at[i - a + 1]]
                    same[i] = int((held[np.minimum(np.searchsorted(held, own), len(held) - 1)] == own).sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(4), pa.array(same)], names=["a", "b", "total", "same"])

    return pairs.select("a", "text_a", "b", "text_b", "total").mapInArrow(count, "a binary, b binary, total long, same long")


def likely(pairs: DataFrame, least: float) -> DataFrame:
    """The (a, b, total) of (a, b, total, sig_a, sig_b) whose signatures don't tell a similarity below ``least`` by more than
    six standard errors, which a true link does less than once in 10^8."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(batch.num_rows, -1) for i in (3, 4))
                low = least - 6 * (least * (1 - least) / x.shape[1]) ** 0.5
                yield batch.select(["a", "b", "total"]).filter(pa.array((x == y).mean(1) >= low))

    return pairs.select("a", "b", "total", "sig_a", "sig_b").mapInArrow(keep, "a binary, b binary, total long")


def class_components(classes: DataFrame, fetch: Callable[[DataFrame], DataFrame], percent: int = 85, small: int = 12, leaders: int = 1) -> DataFrame:
    """(node, root) of the classes that links join: 100 * shared shingles >= percent * shingles of both together.

    classes: cls, n_shingles, bands, sig; fetch gives (cls, text) of the wanted classes. A bucket's classes are compared
    with a leader. Classes that links so far put into one component aren't compared any more. Of the other pairs, those
    are compared whose sizes and whose distances to all leaders so far allow a link. Buckets of over ``small`` open classes
    take up to ``leaders`` leaders first, which rules more pairs out; whatever is then left in any bucket is compared, pair by
    pair or in blocks, see block_links(). A comparison is by signatures first, see likely(), and then on full sets.
    """
    near = (100 - percent) / 100 + 1e-9
    fits = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    allowed = lambda x, y: F.forall(F.zip_with(x, y, lambda p, q: F.coalesce(F.abs(p - q) <= near, F.lit(True))), lambda z: z)

    rows = classes.select("cls", F.explode("bands").alias("bucket"))
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    rows = written(rows.join(sizes, "bucket"))
    weight = rows.groupBy("cls").agg(F.sum("size").alias("weight"))
    about = written(classes.select("cls", F.col("n_shingles").alias("n"), "sig").join(weight, "cls"))
    open_ = written(rows.join(about.drop("sig"), "cls").select("bucket", "cls", "n", "weight", F.array().cast("array<double>").alias("far"), F.lit(True).alias("out")))
    found: dict[str, DataFrame | None] = {"pairs": None}

    def compare(pairs: DataFrame) -> DataFrame:
        """(a, b, d, linked) of all pairs compared up to now, both ways round, after those of (a, b, total) are. d is the
        distance; it is null where signatures alone ruled a link out."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "total").dropDuplicates(["a", "b"])
        known = found["pairs"]
        if known is not None:
            pairs = pairs.join(known, ["a", "b"], "left_anti")
        sig = about.select("cls", "sig")
        pairs = pairs.join(sig.toDF("a", "sig_a"), "a").join(sig.toDF("b", "sig_b"), "b")
        pairs = written(likely(pairs, percent / 100))
        text = written(fetch(pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).distinct()))
        full = pairs.join(text.toDF("b", "text_b"), "b").join(text.toDF("a", "text_a"), "a")
        same = shared_shingles(full)
        linked = 100 * F.col("same") >= percent * (F.col("total") - F.col("same"))
        new = written(same.select("a", "b", (1 - F.col("same") / (F.col("total") - F.col("same"))).alias("d"), linked.alias("linked")))
        both = new.union(new.select(F.col("b").alias("a"), F.col("a").alias("b"), "d", "linked"))
        found["pairs"] = both if known is None else known.union(both)
        return found["pairs"]

    for k in range(leaders):
        now = open_.groupBy("bucket").agg(F.max_by(F.struct("cls", "n", "far"), F.when(F.col("out"), F.struct("weight", "cls"))).alias("l"), F.count(F.lit(1)).alias("size"), F.max("out").alias("some"))
        now = now.where(f"size > {small if k else 1} AND some")
        led = open_.join(now.select("bucket", F.col("l.cls").alias("leader"), F.col("l.n").alias("nl"), F.col("l.far").alias("fl")), "bucket", "left")
        led = written(led.where("leader IS NULL OR leader <> cls"))
        pairs = led.where(fits(F.col("n"), F.col("nl")) & allowed(F.col("far"), F.col("fl"))).select(F.col("leader").alias("a"), F.col("cls").alias("b"), (F.col("n") + F.col("nl")).alias("total"))
        if k and pairs.isEmpty():
            break
        known = compare(pairs).select(F.col("a").alias("leader"), F.col("b").alias("cls"), "d", "linked")
        nxt = led.join(known, ["leader", "cls"], "left")
        out = ~F.coalesce("linked", F.lit(False)) if not k else F.col("out")
        nxt = nxt.select("bucket", "cls", "n", "weight", F.concat("far", F.array("d")).alias("far"), out.alias("out"))
        left = nxt.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.max("out").alias("_some")).where("_size > 1 AND _some")
        open_ = written(nxt.join(left.select("bucket"), "bucket", "left_semi"))
    components = lambda: written(connected_components(found["pairs"].where("linked AND a < b").select("a", "b")))
    joined = components()
    roots = joined.toDF("_node", "_root")
    open_ = open_.join(roots, F.col("cls") == F.col("_node"), "left").withColumn("root", F.coalesce("_root", "cls")).drop("_node", "_root")
    several = open_.groupBy("bucket").agg((F.min("root") < F.max("root")).alias("_several")).where("_several")
    open_ = written(open_.join(several.select("bucket"), "bucket", "left_semi"))
    sizes = open_.groupBy("bucket").agg(F.count(F.lit(1)).alias("_size"), F.sum("n").alias("_total"))
    open_ = written(open_.join(sizes, "bucket"))
    few = open_.where(F.col("_size") <= PAIRED)
    x, y = few.alias("x"), few.alias("y")
    rest = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & (F.col("x.cls") < F.col("y.cls")) & (F.col("x.root") != F.col("y.root")) & fits(F.col("x.n"), F.col("y.n")) & allowed(F.col("x.far"), F.col("y.far")))
    rest = written(rest.select(F.col("x.cls").alias("a"), F.col("y.cls").alias("b"), (F.col("x.n") + F.col("y.n")).alias("total")))
    many = open_.where(F.col("_size") > PAIRED)
    none_left, none_large = rest.isEmpty(), many.isEmpty()
    if not none_left:
        compare(rest)
    edges = found["pairs"].where("linked AND a < b").select("a", "b")
    if not none_large:
        edges = edges.union(block_links(many, fetch(many.select("cls").distinct()), percent))
    return joined if none_left and none_large else written(connected_components(edges))


def block_links(members: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different roots inside large buckets.

    members: bucket, cls, root, _total (shingles of the bucket); texts: cls, text. A bucket's classes are dealt into blocks
    of about BLOCK shingles, and each pair of blocks is one group, in which all sets are intersected at once. A group gives
    only links that join roots not yet joined in it, so it returns fewer rows than it has.
    """
    parts = F.ceil(F.col("_total") / BLOCK).cast("int")
    rows = members.select("bucket", "cls", "root", parts.alias("_parts"), F.pmod(F.xxhash64("cls"), parts).cast("int").alias("part"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    rows = rows.withColumn("low", F.least("part", "_other")).withColumn("high", F.greatest("part", "_other")).drop("_other", "_parts")

    def between(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "cls"])
        keys, at = [], []
        for a, _, data, offsets in text_blocks(pa.array(pdf["text"])):
            k, o = shingle_sets(data, offsets)
            keys.append(k)
            at.append(np.repeat(np.arange(len(o) - 1) + a, np.diff(o)))
        row, size = np.concatenate(at), np.bincount(np.concatenate(at), minlength=len(pdf))
        _, word, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        shared = n[word] > 1
        word, row = np.unique(word[shared], return_inverse=True)[1], row[shared]
        has = np.zeros((len(pdf), int(word.max(initial=-1)) + 1), np.float32)
        has[row, word] = 1
        first = int((pdf["part"] == pdf["low"]).sum())
        one = pdf["low"].iloc[0] == pdf["high"].iloc[0]
        left, right = np.arange(first), np.arange(first) if one else np.arange(first, len(pdf))
        same = has[left] @ has[right].T
        roots, cls = pdf["root"].tolist(), pdf["cls"].tolist()
        number = {r: i for i, r in enumerate(dict.fromkeys(roots))}
        of = np.array([number[r] for r in roots])
        linked = (100 * same >= percent * (size[left][:, None] + size[right][None] - same)) & (of[left][:, None] != of[right][None])
        up = list(range(len(number)))

        def top(i: int) -> int:
            while up[i] != i:
                up[i] = up[up[i]]
                i = up[i]
            return i

        out = []
        for i, j in np.argwhere(linked).tolist():
            x, y = top(of[left[i]]), top(of[right[j]])
            if x != y:
                up[x] = y
                out.append((cls[left[i]], cls[right[j]]))
        return pd.DataFrame(out, columns=["a", "b"])

    return written(rows.join(texts, "cls").groupBy("bucket", "low", "high").applyInPandas(between, "a binary, b binary"))


def near_duplicates(df: DataFrame, doc_id: str, text: str, percent: int = 85, bands: int = BANDS, rows: int = ROWS, with_hash: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    A text's set is its distinct runs of five words (A-Z lower-cased), or all its words if they are fewer. Rows are linked
    whose sets' Jaccard similarity is at least ``percent`` per cent. component_id is the smallest doc_id that links reach,
    kept tells whether it is the row's own. Empty sets (null, empty or blank text) are linked with nothing. Rows with a
    null doc_id count in no component's smallest id: without another id theirs is null and they are kept. Rows with one
    doc_id and equal texts are kept or dropped alike. An empty table gives an empty result. ``with_hash`` adds text_hash, xxhash64 of the text.
    """
    found = written(shingle_features(df, doc_id, text, bands, rows))
    classes = written(found.where("cls IS NOT NULL").groupBy("cls").agg(F.min("doc_id").alias("least"), F.min(F.struct("doc_id", "text_hash")).alias("rep"), F.first("n_shingles").alias("n_shingles"), F.count(F.lit(1)).alias("rows"), F.first("bands").alias("bands"), F.first("sig").alias("sig")))
    body = df.select(F.col(doc_id).alias("_doc"), F.col(text).alias("text"))

    def fetch(wanted: DataFrame) -> DataFrame:
        rep = written(classes.join(wanted, "cls", "left_semi").select("cls", F.col("rep.doc_id").alias("_id"), F.col("rep.text_hash").alias("_hash")))
        on = F.col("_doc").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
        return body.join(light(rep), on).select("cls", "text").dropDuplicates(["cls"])

    roots = class_components(classes.select("cls", "n_shingles", "bands", "sig"), fetch, percent)
    named = roots.join(classes.select("cls", "least"), F.col("node") == F.col("cls"))
    first = named.groupBy("root").agg(F.min("least").alias("component"))
    by_class = classes.select("cls", "least", "rows").join(roots.join(first, "root").select(F.col("node").alias("cls"), "component"), "cls", "left")
    # a class of one row that nothing links is its own component; of the others, classes of copies over 1 / 1,000 of the
    # rows, 1,000 at most, are broadcast, and their rows are spread over keys that no class has
    by_class = by_class.where("rows > 1 OR component IS NOT NULL").select(F.col("cls").alias("_cls"), "rows", F.coalesce("component", "least").alias("component"))
    by_class, total = written(by_class), found.count()
    hot = by_class.where(F.col("rows") * 1000 >= total).select(F.col("_cls").alias("_hot"), F.col("component").alias("_of_hot"))
    rest = by_class.where(F.col("rows") * 1000 < total).select("_cls", "component")
    more = ["text_hash"] if with_hash else []
    out = found.select("doc_id", "n_shingles", "cls", "text_hash").join(F.broadcast(hot), F.col("cls") == F.col("_hot"), "left")
    apart = F.unhex(F.hex(F.xxhash64("doc_id", "text_hash")))
    out = out.withColumn("_key", F.when(F.col("_hot").isNotNull() | F.col("cls").isNull(), apart).otherwise(F.col("cls")))
    out = out.join(rest, F.col("_key") == F.col("_cls"), "left")
    component = F.when(F.col("cls").isNull(), F.col("doc_id")).otherwise(F.coalesce("_of_hot", "component", "doc_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), "text_hash")
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"), *more)


def drop_near_duplicates(df: DataFrame, doc_id: str, text: str, percent: int = 80) -> DataFrame:
    """The rows of the first document of each component, with the columns of df; of rows with one doc_id and text, one.

    Rows to drop are found by id (null is one) and hash of the text; where they are few, they are broadcast and the texts stay where they are.
    """
    of, hash_of, n, h = free_names(df, "_of", "_hash_of", "_n", "_h")
    gone = near_duplicates(df, doc_id, text, percent, with_hash=True).where("NOT kept")
    gone = written(gone.select(F.col("doc_id").alias(of), F.col("text_hash").alias(hash_of)).distinct())
    on = F.col(doc_id).eqNullSafe(F.col(of)) & (F.xxhash64(text) == F.col(hash_of))
    kept = df.join(light(gone), on, "left_anti")
    again = written(df.groupBy(F.col(doc_id).alias(of), F.xxhash64(text).alias(hash_of)).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1))
    if again.isEmpty():
        return kept
    once = kept.join(light(again), on, "left_anti")
    many = kept.join(light(again), on, "left_semi").withColumn(h, F.xxhash64(text)).dropDuplicates([doc_id, h]).drop(h)
    return once.unionByName(many)
