"""Toxicity by compression distance: each window of a text is compressed with a zstandard dictionary of toxic text and
with one of ordinary text; toxic windows come out shorter with the first.

zstandard trains both dictionaries on windows as they are: the ordinary one on those of ordinary texts, the toxic one on
those of toxic texts, behind the ordinary one's content. So what toxic texts share with ordinary ones costs the same in
both and cancels in the comparison. Windows are runs of whole words of at least 96 bytes, once from the start and once half a
window on, and of at least 400 bytes. Labelled rows are dealt into two halves by a hash: one trains the dictionaries, the
other calibrates. There, the shares of toxic and ordinary windows that are so many bytes shorter give the weight of such a
window, and a logistic curve over a text's sums of weights (above a floor for wrong labels) gives its score.
"""

from __future__ import annotations

import functools
import struct
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, text_slices, unit_hash, written

#: (least bytes of a window, where they start): each is a histogram, those of one width are added up.
SCALES = ((96, 0), (96, 48), (400, 0))
WIDTHS = tuple(dict.fromkeys(w for w, _ in SCALES))
#: Differences from -SHIFT to BINS - 1 - SHIFT bytes have a bin each, smaller and larger ones the first and the last.
LEVEL, BINS, SHIFT = 9, 14, 2
#: Bytes of the ordinary dictionary and of what the toxic one has besides.
COMMON, OWN = 100_000, 4_000
#: Both dictionaries begin with it and every window is followed by it: what a first match costs is then in both lengths.
CARRIER = bytes(range(128, 160))
_SUM = 30.0
#: Ends the tables of a zstandard dictionary; its content follows.
_OFFSETS = struct.pack("<III", 1, 4, 8)
#: A-Z lower-cased; other ASCII characters that are no letter are spaces.
_PLAIN = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i > 127 else 32 for i in range(256))


@dataclass(frozen=True)
class Model:
    """Dictionaries' contents, the weight of a window by width and bytes saved, and the curve (bias, a slope a width, floor):
    some 200 KB."""

    toxic: bytes
    ordinary: bytes
    weights: tuple[tuple[float, ...], ...]
    curve: tuple[float, ...]


#: Every text scores below one half.
NOTHING = Model(b"", b"", ((0.0,) * BINS,) * len(WIDTHS), (-5.0, *[0.0] * len(WIDTHS), 0.0))


def windows(text: str | None, least: int = SCALES[0][0], first: int = 0) -> Iterator[bytes]:
    """Runs of whole words (lower-cased letters) of at least ``least`` bytes, the first of at least ``first`` if that is set,
    in order; the last may be shorter. Null has none."""
    for part in text_slices(text or ""):
        held, size, most = [], 0, first or least
        for w in part.encode().translate(_PLAIN).split():
            held.append(w)
            size += len(w) + 1
            if size >= most:
                yield b" %b " % b" ".join(held)
                held, size, most = [], 0, least
        if held:
            yield b" %b " % b" ".join(held)


def trained(samples: Sequence[bytes], size: int, k: int, d: int) -> bytes:
    """About ``size`` bytes of content that zstandard trains on the samples (segments of k bytes, parts of d); samples that
    are too few to train on are taken as they are."""
    import zstandard

    try:
        whole = zstandard.train_dictionary(size + 500, list(samples), k=k, d=d, level=3).as_bytes()
        return whole[whole.index(_OFFSETS) + len(_OFFSETS) :][-size:]
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@functools.lru_cache(maxsize=1)
def _compressors(toxic: bytes, ordinary: bytes):
    """(compress with the toxic dictionary, with the ordinary one); a worker keeps those of one model."""
    import zstandard

    made = []
    for content in (CARRIER + toxic, CARRIER + ordinary):
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        how = zstandard.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content), source_size=64, min_match=5, strategy=zstandard.STRATEGY_LAZY2, search_log=9, window_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
        held.precompute_compress(compression_params=how)
        made.append(zstandard.ZstdCompressor(dict_data=held, compression_params=how).compress)
    return made[0], made[1]


def differences(found: Iterable[bytes], toxic: bytes, ordinary: bytes) -> list[int]:
    """Bytes that each window is shorter with the toxic dictionary. A window that neither shortens by a quarter is foreign to
    both (another language, say) and has 0: what is in no dictionary is coded in a way of its own, by whose tables two
    lengths can differ by more than a word."""
    a, b = _compressors(toxic, ordinary)
    out = []
    for w in found:
        z = w + CARRIER
        m, n = len(a(z)), len(b(z))
        out.append(n - m if 4 * min(m, n) <= 3 * len(w) else 0)
    return out


def histograms(text: str | None, toxic: bytes, ordinary: bytes) -> np.ndarray:
    """For each width, how many windows of a text are so many bytes shorter."""
    out = np.zeros((len(WIDTHS), BINS), np.int64)
    for width, first in SCALES:
        saved = np.array(differences(windows(text, width, first), toxic, ordinary), np.int64)
        out[WIDTHS.index(width)] += np.bincount(np.clip(saved + SHIFT, 0, BINS - 1), minlength=BINS)
    return out


def train(bad: Sequence[bytes], good: Sequence[bytes]) -> tuple[bytes, bytes]:
    """(content of the toxic dictionary, of the ordinary one) from windows of toxic and of ordinary texts."""
    ordinary = trained(good, COMMON, 50, 8)
    return ordinary + trained(bad, OWN, 12, 6), ordinary


def calibrate(counts: np.ndarray, toxic: np.ndarray, prior: float = 5.0, rounds: int = 30) -> tuple[tuple[tuple[float, ...], ...], tuple[float, ...]]:
    """(weights by width and bin, curve) from texts' histograms (n x widths x BINS) and their labels (n).

    Some texts carry label 1 though nothing in them is toxic. So the chance of label 1 is a floor plus the rest times a
    logistic curve of the text's sums of weights, and a text of label 1 counts as toxic by its share above the floor. Both
    are fitted in turn (expectation and maximisation).
    """
    n, widths, _ = counts.shape
    kind, floor, w, weights = toxic.astype(float), 0.01, np.zeros(widths + 1), np.zeros((widths, BINS))
    ridge = np.diag([0.01] + [0.1] * widths)
    for _ in range(rounds):
        for i in range(widths):
            own = counts[:, i]
            both = own.sum(0) + 1e-9
            share = [(x @ own + 1 + prior * both / both.sum()) / ((x @ own).sum() + BINS + prior) for x in (kind, 1 - kind)]
            weights[i] = np.maximum.accumulate(np.log(share[0] / share[1]))  # more bytes saved never count for less
        x = np.column_stack([np.ones(n), np.clip(np.einsum("nib,ib->ni", counts, weights), -_SUM, _SUM)])
        for _ in range(25):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w = w + np.clip(np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (kind - p) - ridge @ w), -2, 2)
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        kind = np.where(toxic == 1, p / (p + floor * (1 - p) + 1e-12), 0.0)
        floor = float(np.clip(((1 - kind) * toxic).sum() / max((1 - kind).sum(), 1e-9), 1e-4, 0.5))
    return tuple(map(tuple, weights.tolist())), (*w.tolist(), floor)


def fit(docs: DataFrame, labels: DataFrame, key: str, text: str, toxic: str, most_toxic: int = 3000, most_ordinary: int = 5000, seed: int = 0) -> Model:
    """A model from the docs whose key has a label (1 or 0; other labels and null texts are left out; of several labels of
    one key, the larger).

    A bounded sample, by seeded hashes of keys: at most ``most_toxic`` keys of label 1 and ``most_ordinary`` of label 0,
    half of them for the dictionaries and half for the calibration. The driver gets the different windows of the first
    half's texts, so about as many bytes as these have, and the counts of the other half's. Without rows of both labels in
    both halves every text scores below one half.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & F.col(key).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.max(toxic).cast("int").alias("label"))
    picked = []
    for label, most in ((1, most_toxic), (0, most_ordinary)):
        keys = known.where(F.col("label") == label).withColumn("h", unit_hash(seed, "key"))
        picked.append(keys.orderBy("h", "key").limit(most).select("key", "label", (unit_hash(seed + 1, "key") % 2).cast("int").alias("half")))
    keys = F.broadcast(picked[0].unionByName(picked[1]))  # at most most_toxic + most_ordinary keys
    rows = docs.where(F.col(text).isNotNull()).select(F.col(key).alias("doc"), F.col(text).alias("text")).join(keys, F.col("doc") == F.col("key"))
    rows = written(rows.select("label", "half", "text").repartition(32))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = list(dict.fromkeys(windows(t.as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.binary())], names=["label", "w"])

    pool = rows.where("half = 0").select("label", "text").mapInArrow(cut, "label int, w binary").distinct().withColumn("h", unit_hash(seed, "w"))
    bad, good = ([bytes(r[0]) for r in pool.where(F.col("label") == y).orderBy("h", "w").select("w").toLocalIterator()] for y in (1, 0))
    if not bad or not good:
        return NOTHING
    one, two = train(bad, good)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [histograms(t.as_py(), one, two).ravel().tolist() for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["label", "n"])

    held = rows.where("half = 1").select("label", "text").mapInArrow(count, "label int, n array<long>").collect()
    held = sorted((r["label"], list(r["n"])) for r in held)
    y = np.array([r[0] for r in held], float)
    if not 0 < y.sum() < len(y):
        return NOTHING
    return Model(one, two, *calibrate(np.array([r[1] for r in held], float).reshape(len(y), len(WIDTHS), BINS), y))


def score_texts(texts: Iterable[str | None], model: Model) -> np.ndarray:
    counts = np.array([histograms(t, model.toxic, model.ordinary) if model.toxic else np.zeros((len(WIDTHS), BINS)) for t in texts]).reshape(-1, len(WIDTHS), BINS)
    bias, *slopes, floor = model.curve
    total = np.clip(np.einsum("nib,ib->ni", counts, np.array(model.weights)), -_SUM, _SUM) @ np.array(slopes)
    return floor + (1 - floor) / (1 + np.exp(-np.clip(bias + total, -30, 30)))


def score_toxicity(df: DataFrame, text: str, model: Model, score: str = "toxicity") -> DataFrame:
    """Adds ``score`` (0 to 1) from the whole text; null is taken as empty. Other columns and repeated rows stay, a column
    of that name is replaced, and an empty table stays empty."""

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series(score_texts(texts, model), dtype="float64")

    return df.withColumn(score, scored(F.col(text)))


def reject_toxic(df: DataFrame, text: str, model: Model, threshold: float = 0.7) -> DataFrame:
    """The rows whose score is below the threshold, with the columns of df. Null and empty texts stay, repeated rows stay or go
    alike, an empty table stays empty."""
    name = free_name(df, "_toxicity")
    return score_toxicity(df, text, model, name).where(F.col(name) < threshold).drop(name)
