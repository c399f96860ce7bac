"""Byte-level BPE encoding and decoding in batched numpy merge rounds.

The symbols of many words lie in one flat array.  In each round every word merges its lowest-rank
adjacent pair, wherever it occurs in the word; ranks are found by binary search over the sorted keys of
all pairs.  A word that has no pair left leaves the array.  Since a pair that holds a merged symbol
always ranks after the merge that made it, a round gives what merging one pair at a time would give.

Words are cut from texts by the tokenizer's own pattern.  Each Python worker keeps the ids of words it
has met, up to a bound; what it has forgotten is merged again.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

#: Words that a worker remembers, and characters of text that it works on at once.
REMEMBERED = 250_000
CHARS_AT_ONCE = 1 << 20
NO_PAIR = np.int64(1) << 40


def _byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = dict(zip(plain, map(chr, plain), strict=True))
    others = (b for b in range(256) if b not in shown)
    shown.update((b, chr(256 + k)) for k, b in enumerate(others))
    return [shown[b] for b in range(256)]


def _unsupported(spec: dict) -> list[str]:
    """What a tokenizer file asks for that ``ByteBpe`` does not do."""
    model, cut, back = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("decoder") or {}
    found = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k)]
    found += [k for k, holds in (("model", model.get("type", "BPE") != "BPE"), ("normalizer", spec.get("normalizer")), ("pre-tokenizer", cut.get("type") != "ByteLevel"), ("prefix space", cut.get("add_prefix_space")), ("own pattern", not cut.get("use_regex", True)), ("decoder", back.get("type") != "ByteLevel")) if holds]
    found += [f"added token with {k}" for t in spec["added_tokens"] for k in ("lstrip", "rstrip", "single_word", "normalized") if t.get(k)]
    made = {a + b: k for k, (a, b) in reversed(list(enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"])))}
    early = any(made.get(x, -1) >= k for k, m in enumerate(model["merges"]) for x in (m if isinstance(m, list) else m.split(" ")))
    return found + ["a merge of a symbol that is made later"] * early


class ByteBpe:
    """A byte-level BPE vocabulary: ``encode`` texts to ids, ``decode`` ids to text.

    ``pattern`` is what the file's byte-level pre-tokenizer cuts words by; a file with anything else is refused.
    """

    def __init__(self, path: str, pattern: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if found := _unsupported(spec):
            raise ValueError(f"{path} is not a plain byte-level BPE: {', '.join(found)}")
        vocab: dict[str, int] = spec["model"]["vocab"]
        letters = _byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.first = np.array([vocab[c] for c in letters], np.int64)
        self.size = max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        merges = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.cut = regex.compile("|".join(map(regex.escape, self.specials))) if self.specials else None
        self.words = regex.compile(pattern)
        raw = [b""] * self.size
        for token, i in vocab.items():
            raw[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        for token, i in self.specials.items():
            raw[i] = token.encode()
        self.bytes, self.byte_len = np.frombuffer(b"".join(raw), np.uint8), np.array(list(map(len, raw)), np.int64)
        self.byte_at = np.cumsum(self.byte_len) - self.byte_len
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.at, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.ids, self.used = np.zeros(4096, np.int32), 0
        self._learn_ids(list(self.specials), np.array(list(self.specials.values()), np.int32), np.ones(len(self.specials), np.int64))

    def _learn_ids(self, words: list[str], ids: np.ndarray, counts: np.ndarray) -> None:
        k = len(self.index)
        while k + len(words) > len(self.at):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.n[k : k + len(words)] = counts
        self.at[k : k + len(words)] = self.used + np.cumsum(counts) - counts
        self.used += len(ids)
        self.index.update(zip(words, range(k, k + len(words)), strict=True))

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NO_PAIR)

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each word has."""
        counts = np.array(list(map(len, words)), np.int64)
        sym = self.first[np.frombuffer(b"".join(words), np.uint8)]
        word = np.repeat(np.arange(len(words)), counts)
        rank = np.full(len(sym), NO_PAIR)
        if len(sym) > 1:
            inside = word[:-1] == word[1:]
            rank[:-1][inside] = self._rank(sym[:-1][inside], sym[1:][inside])
        done_sym, done_word = [], []
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(sym)])
            low = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = low == NO_PAIR
            if over.any():
                done_sym.append(sym[over])
                done_word.append(word[over])
                sym, word, rank, low = sym[~over], word[~over], rank[~over], low[~over]
                if not len(sym):
                    break
            at = np.flatnonzero(rank == low)
            # Of pairs that overlap (as in "aaa") every other one is merged, from the left.
            new_run = np.r_[True, at[1:] != at[:-1] + 1]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            sym[at] = self.made[rank[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            now = at - np.arange(len(at))  # where the merged symbols are after the others have gone
            sym, word, rank = sym[keep], word[keep], rank[keep]
            changed = np.unique(np.r_[now, now[now > 0] - 1])
            rank[changed] = NO_PAIR
            changed = changed[changed < len(sym) - 1]
            changed = changed[word[changed] == word[changed + 1]]
            rank[changed] = self._rank(sym[changed], sym[changed + 1])
        sym, word = np.concatenate([*done_sym, sym]), np.concatenate([*done_word, word])
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _split(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return self.words.findall(text)
        out, done = [], 0
        for m in self.cut.finditer(text):
            out += self.words.findall(text[done : m.start()])
            out.append(m.group())
            done = m.end()
        return out + self.words.findall(text[done:])

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.index) > REMEMBERED:
            self._forget()
        split = [self._split(t) for t in texts]
        new = list(set().union(*split) - self.index.keys())
        if new:
            self._learn_ids(new, *self.merge([w.encode() for w in new]))
        found = self.index.__getitem__
        return [gather(self.ids, self.at[k], self.n[k]) for k in (np.fromiter(map(found, s), np.int64, len(s)) for s in split)]

    def decode(self, ids: np.ndarray) -> str:
        return gather(self.bytes, self.byte_at[ids], self.byte_len[ids]).tobytes().decode("utf-8", "replace")


def gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The slices flat[at : at + n], one after another."""
    ends = np.cumsum(n)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - (ends - n), n)]


_loaded: dict[tuple[str, str], ByteBpe] = {}


def in_parts(texts: list[str], most: int = CHARS_AT_ONCE) -> Iterator[tuple[int, int]]:
    """Bounds of parts of ``texts`` of about ``most`` characters; a longer text is a part of its own."""
    start = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield start, k
            start, size = k, 0
        size += len(t)
    if start < len(texts):
        yield start, len(texts)


def bpe_encode_decode(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int), decoded (text) for each row of ``docs``.

    ``tokenizer``: path of a byte-level tokenizer file that every executor has.  Null texts count as
    empty: no ids, empty text.  The strings of the file's added tokens are taken as those tokens inside
    texts.  A text of any length is one part of a batch.  Repeated rows and null ids are kept; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if (tokenizer, pattern) not in _loaded:
            _loaded[tokenizer, pattern] = ByteBpe(tokenizer, pattern)
        bpe = _loaded[tokenizer, pattern]
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            for i, j in in_parts(texts):
                ids = bpe.encode(texts[i:j])
                offsets = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=offsets[1:])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                decoded = pa.array([bpe.decode(x) for x in ids], pa.string())
                yield pa.RecordBatch.from_arrays([b.column("doc_id")[i:j], pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int32())), decoded], ["doc_id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def digests(coded: DataFrame) -> DataFrame:
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return digests(bpe_encode_decode(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN))
