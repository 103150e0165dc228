"""Packing by best fit decreasing: pieces of documents, longest first, enter the open window with the tightest room.

Documents longer than a window are first cut into full windows and a rest. Best fit decreasing depends on the lengths
alone, so it is run on the count of pieces of each length (at most ``capacity`` numbers, whatever the corpus): windows
with one history are an interval of window numbers, and a segment tree over the remaining capacity finds the tightest
intervals. The plan says for each length which ranks go to which windows; a join by length carries it to the pieces.
"""

from __future__ import annotations

import functools
import json
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, gapless_rank, spread_over, unit_hash, written


class RoomTree:
    """A segment tree over 0..capacity: how many lists of open windows there are below each node."""

    def __init__(self, capacity: int) -> None:
        self.n = 1 << capacity.bit_length()
        self.full = [False] * (2 * self.n)

    def set(self, room: int, full: bool) -> None:
        i = room + self.n
        self.full[i] = full
        while i > 1:
            i //= 2
            self.full[i] = self.full[2 * i] or self.full[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        """The smallest room of an open window that is no less than size."""
        i = size + self.n
        if self.full[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.full[i + 1]:
                i += 1
                while i < self.n:
                    i = 2 * i if self.full[2 * i] else 2 * i + 1
                return i - self.n
            i //= 2
        return None


def plan_windows(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, first window, pieces a window, offset) of best fit decreasing over counted lengths.

    Ranks of a length go to windows in turn: rank r lies in window first + (r - first rank) // pieces, at
    offset + ((r - first rank) % pieces) * length.

    >>> plan_windows({6: 2, 4: 1, 3: 2}, 10)
    [(6, 0, 2, 0, 1, 0), (4, 0, 1, 0, 1, 6), (3, 0, 1, 1, 1, 6), (3, 1, 2, 2, 1, 0)]
    """
    tree, open_, windows, plan = RoomTree(capacity), [[] for _ in range(capacity + 1)], 0, []

    def keep(first: int, end: int, room: int) -> None:
        if end > first and room:
            open_[room].append((first, end))
            tree.set(room, True)

    for length in sorted((x for x in counts if x > 0), reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, first, end = capacity, windows, windows + -(-left // (capacity // length))
                windows = end
            else:
                first, end = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            each = room // length
            used = min(end - first, left // each)
            if used:
                plan.append((length, rank, rank + used * each, first, each, capacity - room))
                keep(first, first + used, room - each * length)
                rank, left = rank + used * each, left - used * each
            first += used
            if left and first < end:  # fewer pieces than one window takes
                plan.append((length, rank, rank + left, first, left, capacity - room))
                keep(first, first + 1, room - left * length)
                rank, left, first = rank + left, 0, first + 1
            keep(first, end, room)
    return plan


#: What the fast encoder stands for: the split of byte-level BPE files without settings of their own.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def plain_byte_bpe(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """(ranks, added tokens) of a tokenizers file that is byte-level BPE with the usual split, no normalizer, ids in order
    of merging and added tokens that match as they are; None for any other file."""
    model, split, added = spec["model"], spec.get("pre_tokenizer") or {}, spec["added_tokens"]
    usual = split.get("type") == "ByteLevel" and not split.get("add_prefix_space") and split.get("use_regex", True)
    odd = any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not usual or odd or model.get("type", "BPE") != "BPE" or spec.get("normalizer") or any(x[k] for x in added for k in ("lstrip", "rstrip", "single_word")):
        return None
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
    byte = {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(keep))}
    special = {x["content"]: x["id"] for x in added}
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    if any(set(t) - byte.keys() for t in vocab) or any(vocab.get("".join(m)) != 256 + i for i, m in enumerate(merges)) or len(vocab) != 256 + len(merges):
        return None
    return {bytes(byte[c] for c in t): i for t, i in vocab.items()}, special


class Tokens:
    """Token ids of texts as little-endian 32-bit numbers, those that the tokenizers library gives for the file with
    add_special_tokens=False. Files of the form that plain_byte_bpe() knows are encoded by tiktoken, which is some three
    times faster; added tokens in a text are found first, as the library does. Any other file goes to the library."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            known = plain_byte_bpe(json.load(file))
        if known is None:
            import tokenizers

            encode = tokenizers.Tokenizer.from_file(path).encode
            self.ids = lambda text: encode(text, add_special_tokens=False).ids
            return
        import tiktoken

        ranks, special = known
        encoding = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens=special)
        self.ids = lambda text: encoding.encode(text, allowed_special="all") if any(x in text for x in special) else encoding.encode_ordinary(text)

    def encode(self, text: str) -> bytes:
        ids = self.ids(text)
        return struct.pack(f"<{len(ids)}I", *ids)


@functools.lru_cache(maxsize=1)
def tokens(path: str) -> Tokens:
    """One a Python worker, kept from task to task."""
    return Tokens(path)


def pieces(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: a document's ids and the end id, cut into full windows and a rest.

    Null text is empty: one piece, the end id. ``tokenizer`` is a file that every executor can read. doc_id has any type
    and may be null or repeated: each row has its pieces. An empty table has none. Other columns are left out.
    """
    kind = df.schema[doc_id].dataType

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, step = tokens(tokenizer).encode, end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            of: list[int] = []
            out: list[list[int]] = [[], [], [], []]
            for row, t in enumerate(batch.column(1)):
                ids = encode(t.as_py() or "") + last
                for a in range(0, len(ids), step):
                    part = ids[a : a + step]
                    of.append(row)
                    for column, x in zip(out, (a // 4, len(part) // 4, zlib.crc32(part), len(ids) // 4), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(of, pa.int64())), *[pa.array(x, pa.int64()) for x in out]], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(cut, f"doc_id {kind.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long")


def pack(df: DataFrame, length: str, order: list[str], capacity: int = 2048, seed: int = 0) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` (long): best fit decreasing of rows of 1 to ``capacity`` tokens.

    Rows of one length are taken in a seeded order of ``order``; repeated rows each get a place. An empty table stays
    empty. df should be a written table: it is read for the counts and again for the places.
    """
    df = df.drop("sequence_id", "offset")
    counts = {int(r[0]): int(r[1]) for r in df.groupBy(length).count().collect()}  # at most capacity rows
    size, a, b, window, each, at, h, rank = free_names(df, "_length", "_a", "_b", "_window", "_each", "_offset", "_h", "_rank")
    plan = [tuple(map(int, x)) for x in plan_windows(counts, capacity)]
    rows = df.sparkSession.createDataFrame(plan, ", ".join(f"{x} long" for x in (size, a, b, window, each, at)))
    ranked = gapless_rank(df.withColumn(h, unit_hash(seed, *order)), [length], [h, *order], F.col(h), rank, spread_over(sum(counts.values()))).drop(h)
    # the plan has at most a few rows for each length and room, however many pieces there are
    out = ranked.join(F.broadcast(rows), (F.col(length) == F.col(size)) & (F.col(rank) >= F.col(a)) & (F.col(rank) < F.col(b)))
    place = F.col(rank) - F.col(a)
    out = out.withColumn("sequence_id", F.col(window) + F.floor(place / F.col(each))).withColumn("offset", F.col(at) + F.pmod(place, F.col(each)) * F.col(length))
    return out.drop(rank, *rows.columns)


def pack_documents(df: DataFrame, doc_id: str, text: str, tokenizer: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """The packed pieces of all documents; see pieces() and pack()."""
    return pack(written(pieces(df, doc_id, text, tokenizer, capacity, end_id)), "length", ["doc_id", "start"], capacity)
