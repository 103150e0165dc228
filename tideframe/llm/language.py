"""Language identification: multinomial naive Bayes over hashed character n-grams.

The log-probability matrix (buckets x labels) is broadcast; a batch of texts is one sparse list of bucket numbers whose
matrix rows are summed by text.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_name, free_names, mix, text_slices, unit_hash

BUCKETS, GRAMS, UNKNOWN = 1 << 15, (1, 2, 3), "und"


@dataclass(frozen=True)
class Model:
    """Sorted labels, log-probabilities (buckets x labels, float32) and log-priors."""

    labels: tuple[str, ...]
    logs: np.ndarray
    priors: np.ndarray


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _letters(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points, text numbers) of lower-cased texts between spaces; what is no letter is a space, and runs of spaces are one."""
    points = [np.frombuffer(f" {t.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    row = np.repeat(np.arange(len(points), dtype=np.int32), [len(p) for p in points])
    c = np.concatenate(points) if points else np.zeros(0, np.uint32)
    c = np.where(((c >= 97) & (c <= 122)) | ((c >= 0xC0) & (c != 0xD7) & (c != 0xF7)), c, 32)
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != 32) | (c[:-1] != 32) | (row[1:] != row[:-1])
    return c[keep], row[keep]


def gram_buckets(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket numbers, text numbers) of the n-grams of the texts' words, in order of the texts. An n-gram may hold the
    space before or after its word, but lies in one word."""
    c, row = _letters(texts)
    c = c.astype(np.uint64)
    buckets, rows = [], []
    for n in GRAMS:
        if len(c) < n:
            continue
        whole = row[: len(c) - n + 1] == row[n - 1 :]
        for i in range(1, n - 1) if n > 1 else (0,):
            whole &= c[i : len(c) - n + 1 + i] != 32
        at = np.flatnonzero(whole)
        h = np.full(len(at), n, np.uint64)
        for i in range(n):
            h = h * np.uint64(0x100000001B3) + c[at + i]
        buckets.append((mix(h) >> np.uint64(49)).astype(np.int32))
        rows.append(row[at])
    if not rows:
        return np.zeros(0, np.int32), np.zeros(0, np.int32)
    b, r = np.concatenate(buckets), np.concatenate(rows)
    order = np.argsort(r, kind="stable")
    return b[order], r[order]


def _runs(texts: Sequence[str | None], most: int = 100_000) -> Iterator[tuple[list[int], list[str]]]:
    """(numbers of the texts, stretches) of at most about ``most`` characters together: short texts whole, long ones cut at
    spaces. No gram reaches over a space, so the stretches' grams are the text's. What has no space is not cut."""
    rows, held, size = [], [], 0
    for i, t in enumerate(texts):
        for part in text_slices(t, most) if t else ():
            if held and size + len(part) > most:
                yield rows, held
                rows, held, size = [], [], 0
            rows.append(i)
            held.append(part)
            size += len(part)
    if held:
        yield rows, held


def fit(df: DataFrame, text: str, label: str, order: Sequence[str], per_label: int = 1000, alpha: float = 0.5, seed: int = 0, most_labels: int = 1000) -> Model:
    """A model from the rows with a label and a letter.

    About ``per_label`` rows of each label are counted, those with the smallest seeded hash of ``order``. Counts are summed
    in Spark; the driver gets at most BUCKETS numbers a label. More than ``most_labels`` labels are an error, so the matrix
    that is broadcast has at most BUCKETS x ``most_labels`` numbers. Without rows there are no labels.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull() & F.col(text).rlike(r"\p{L}"))
    n = {r[0]: r[1] for r in rows.groupBy(label).count().limit(most_labels + 1).collect()}
    if len(n) > most_labels:
        raise ValueError(f"more than {most_labels} labels in {label}")
    if not n:
        return Model((), np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    part = F.lit(1.0)
    for name, count in n.items():
        part = F.when(F.col(label) == name, F.lit(min(1.0, per_label / count))).otherwise(part)
    picked = rows.where(unit_hash(seed, *order) <= part * float(1 << 63)).select(F.col(label).alias("label"), F.col(text).alias("text"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, np.ndarray] = {}
        for batch in batches:
            labels, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, parts in _runs(texts):
                buckets, of = gram_buckets(parts)
                for name in {labels[i] for i in at}:
                    mine = np.array([labels[i] == name for i in at])
                    total = totals.setdefault(name, np.zeros(BUCKETS, np.int64))
                    total += np.bincount(buckets[mine[of]], minlength=BUCKETS)
        for name, total in totals.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at)), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["label", "bucket", "n"])

    sums = picked.mapInArrow(counted, "label string, bucket int, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")).toPandas()
    labels = tuple(sorted(n))
    table = np.full((BUCKETS, len(labels)), alpha)
    np.add.at(table, (sums["bucket"].to_numpy(int), sums["label"].map({x: i for i, x in enumerate(labels)}).to_numpy(int)), sums["n"].to_numpy(float))
    total = np.array([n[x] for x in labels], float)
    return Model(labels, np.log(table / table.sum(0)).astype(np.float32), np.log(total / total.sum()))


def scores(texts: Sequence[str | None], model: Model) -> tuple[list[str], np.ndarray]:
    """(label, its posterior) of each text; ``und`` and 0 for null or without a letter, and for all if there are no labels."""
    known = [t if has_letter(t) and model.labels else None for t in texts]
    total = np.tile(model.priors, (len(known), 1))
    for at, parts in _runs(known):
        buckets, of = gram_buckets(parts)
        if len(of):
            starts = np.flatnonzero(np.diff(of, prepend=-1))
            np.add.at(total, np.array(at)[of[starts]], np.add.reduceat(model.logs[buckets], starts, axis=0, dtype=np.float64))
    if not model.labels:
        return [UNKNOWN] * len(known), np.zeros(len(known))
    pick = total.argmax(1)
    part = 1 / np.exp(total - total.max(1, keepdims=True)).sum(1)
    has = np.array([t is not None for t in known], bool)
    return [model.labels[i] if h else UNKNOWN for i, h in zip(pick, has, strict=True)], np.where(has, part, 0.0)


def identify_language(df: DataFrame, text: str, model: Model, label: str = "lang_pred", score: str = "lang_score") -> DataFrame:
    """Adds ``label`` and ``score`` from the whole text. Other columns and repeated rows stay, columns of those names are
    replaced, and an empty table stays empty. A long text is read in stretches, so a task holds one batch of texts."""
    held = df.sparkSession.sparkContext.broadcast(model)  # BUCKETS x labels numbers of 4 bytes

    @F.pandas_udf("label string, score double")
    def identified(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            names, best = scores(texts.tolist(), held.value)
            yield pd.DataFrame({"label": pd.Series(names, dtype=object), "score": best})

    out = df.drop(label, score)
    found = free_name(out, "_found")
    out = out.withColumn(found, identified(F.col(text)))
    return out.withColumn(label, F.col(found)["label"]).withColumn(score, F.col(found)["score"]).drop(found)


def reject_unknown(df: DataFrame, text: str, model: Model, threshold: float = 0.5) -> DataFrame:
    """The rows with a language of at least that posterior, with the columns of df."""
    label, score = free_names(df, "_label", "_score")
    out = identify_language(df, text, model, label, score)
    return out.where((F.col(label) != UNKNOWN) & (F.col(score) >= threshold)).drop(label, score)
