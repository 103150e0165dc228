"""Token counts by the whole-token shortcut: which vocabulary strings encode alone as one token is proved once, before the
job; pre-tokens among them count one each, and only the rest is merged.

The proof asks the library's bare merging model for every vocabulary string with a word end. The pre-tokens of a text are
found by one regular expression over characters whose class and lower case the proof has checked against the library, one
by one; a text with any other character is normalised and split by the library itself, and counted in the same way.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import free_names, text_slices

#: Fixed values of the file's form: how its normalizer and pre-tokenizer are written down.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
END = "</w>"
#: Characters that the proof looks at: Latin blocks, general punctuation, currency signs.
CANDIDATES = [*map(chr, (*range(0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)))]


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level files: printable Latin-1 bytes are themselves, the others follow
    from U+0100."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(spare)) for b in range(256)]


_LETTERS = byte_letters()
_TO_LETTERS = dict(enumerate(_LETTERS))
_FROM_LETTERS = {ord(c): b for b, c in enumerate(_LETTERS)}


def in_letters(word: str) -> str:
    return word.encode().decode("latin-1").translate(_TO_LETTERS)


@dataclass(frozen=True)
class Proof:
    """What holds for a file: pre-tokens that are one token, and the checked characters by class. Bounded by the vocabulary."""

    whole: frozenset[str]
    letters: str
    numbers: str
    others: str
    spaces: str


def knows(spec: dict) -> bool:
    """Whether the file is BPE with word ends, lower case and byte letters, whose added tokens match as they are."""
    model = spec["model"]
    odd = any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")) or spec.get("post_processor")
    added = any(x[k] for x in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized"))
    return not odd and not added and model.get("end_of_word_suffix") == END and spec.get("normalizer") == NORMALIZER and spec.get("pre_tokenizer") == PRE_TOKENIZER


def _bare(spec: dict):
    """The file's merging model alone: a string is one pre-token."""
    import tokenizers

    return tokenizers.Tokenizer.from_str(json.dumps(spec | {"added_tokens": [], "normalizer": None, "pre_tokenizer": None, "post_processor": None, "truncation": None, "padding": None}))


@functools.lru_cache(maxsize=2)
def prove(path: str) -> Proof | None:
    """The proof of a file, or None where the shortcut isn't known to hold for its form."""
    if not path.endswith(".json"):
        return None
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    if not knows(spec):
        return None
    import tokenizers

    byte = {c: b for b, c in enumerate(_LETTERS)}
    words = []
    for entry in spec["model"]["vocab"]:
        body = entry.removesuffix(END)
        if body != entry and body and not set(body) - byte.keys():
            try:
                words.append(bytes(byte[c] for c in body).decode())
            except UnicodeDecodeError:  # a part of a character is never a pre-token
                continue
    whole = frozenset(w for w, e in zip(words, _bare(spec).encode_batch([in_letters(w) for w in words]), strict=True) if len(e.ids) == 1)
    full = tokenizers.Tokenizer.from_file(path)
    split = lambda text: [x for x, _ in full.pre_tokenizer.pre_tokenize_str(full.normalizer.normalize_str(text))]
    groups: dict[str, list[str]] = {"letter": [], "number": [], "other": [], "space": []}
    for c in CANDIDATES:
        low = in_letters(c.lower())
        seen = {
            "letter": [["a" + low + "a"], ["1", low, "1"], ["!", low, "!"]],
            "number": [["a", low, "a"], ["1", low, "1"], ["!", low, "!"]],
            "other": [["a", low, "a"], ["1", low, "1"], ["!" + low + "!"]],
            "space": [["a", "a"], ["1", "1"], ["!", "!"]],
        }
        got = [split(x + c + x) for x in "a1!"]
        for kind, want in seen.items():
            if got == want and len(c.lower()) == 1:
                groups[kind].append(c)
    return Proof(whole, *["".join(groups[k]) for k in ("letter", "number", "other", "space")])


#: Counts of merged pre-tokens that a worker keeps, and the longest that it keeps.
KEPT, LONGEST = 200_000, 64


class Counter:
    """Counts the library's tokens of a text (add_special_tokens=False, no truncation), the shortcut first."""

    def __init__(self, path: str, proof: Proof | None) -> None:
        self.proof, self.known = proof, {}
        if proof is None:
            self.count = _library_counts(path)
            return
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        import tokenizers

        full = tokenizers.Tokenizer.from_file(path)
        self.normal, self.split, self.merge = full.normalizer.normalize_str, full.pre_tokenizer.pre_tokenize_str, _bare(spec).encode
        kind = lambda chars: "[" + "".join(map(re.escape, {c.lower(): 0 for c in chars})) + "]"
        self.words = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|{kind(proof.letters)}+|{kind(proof.numbers)}|{kind(proof.others)}+").findall
        self.unproved = re.compile(f"[^{''.join(map(re.escape, proof.letters + proof.numbers + proof.others + proof.spaces))}]").search
        added = [x["content"] for x in spec["added_tokens"] if x["content"]]
        self.added = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None

    def merged(self, word: str) -> int:
        """Tokens of one pre-token that isn't a whole one."""
        n = self.known.get(word)
        if n is None:
            n = len(self.merge(in_letters(word)).ids)
            if len(word) <= LONGEST:
                if len(self.known) >= KEPT:
                    self.known.clear()
                self.known[word] = n
        return n

    def plain(self, text: str) -> int:
        """Tokens of a text without added tokens."""
        whole = self.proof.whole
        if self.unproved(text):
            found = [x.translate(_FROM_LETTERS).encode("latin-1").decode() for x, _ in self.split(self.normal(text))]
        else:
            found = self.words(text.lower())
        rest = [x for x in found if x not in whole]
        return len(found) - len(rest) + sum(map(self.merged, rest))

    def count(self, text: str) -> int:  # replaced by the library's where the form isn't known
        n, at = 0, 0
        for m in self.added.finditer(text) if self.added else ():
            n, at = n + 1 + self._stretches(text[at : m.start()]), m.end()
        return n + self._stretches(text[at:] if at else text)

    def _stretches(self, text: str) -> int:
        """Stretches end at a space, which no pre-token holds and no composition crosses."""
        return sum(map(self.plain, text_slices(text))) if text else 0


def _library_counts(path: str) -> Callable[[str], int]:
    if path.endswith(".model"):
        import sentencepiece

        encode = sentencepiece.SentencePieceProcessor(model_file=path).encode
        return lambda text: len(encode(text, num_threads=1))
    import tokenizers

    full = tokenizers.Tokenizer.from_file(path)
    full.no_truncation()
    full.no_padding()
    return lambda text: len(full.encode(text, add_special_tokens=False).ids)


_OWN: dict[str, Counter] = {}


def counter(path: str, proof: Proof | None) -> Counter:
    """One a Python worker, kept from task to task."""
    if path not in _OWN:
        _OWN.clear()
        _OWN[path] = Counter(path, proof)
    return _OWN[path]


def count_tokens(df: DataFrame, text: str, tokenizer: str, name: str = "n_tokens", limit: int | None = None, keep: Sequence[str] | None = None) -> DataFrame:
    """df's columns (or those of ``keep``) with ``name``: the tokens of each text, long; with a ``limit``, ``over_limit`` too.

    ``tokenizer`` is a file that every executor can read: .json for tokenizers, .model for sentencepiece. Null and empty
    texts have no tokens. Repeated rows are counted each, an empty table stays empty; a column of a new one's name is
    replaced. A text is read in stretches of some 10^6 characters; only one without spaces is one stretch. The proof (at
    most the vocabulary) is broadcast.
    """
    spark, keep = df.sparkSession, list(df.columns if keep is None else keep)
    kept = df.select(*[c for c in keep if c.lower() not in (name.lower(), *(["over_limit"] if limit is not None else []))], F.col(text).alias(free_names(df, "_text")[0]))
    proof = spark.sparkContext.broadcast(prove(tokenizer))
    *columns, source = kept.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = counter(tokenizer, proof.value).count
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            n = pa.array([of(t.as_py()) if t.is_valid else 0 for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], n], names=[*columns, name])

    schema = kept.select(*columns, F.lit(0).cast("long").alias(name)).schema
    out = kept.mapInArrow(count, schema)
    return out if limit is None else out.withColumn("over_limit", F.col(name) > limit)
