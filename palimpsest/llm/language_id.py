"""Language identification by bit-sliced Bloom filters of character n-grams.

Each slot of the filter holds a bitmask of languages.  The slots that an n-gram hashes to are ANDed, and
what is left are all languages whose profile holds the n-gram.  Per language these bits are counted over
a text's n-grams; the share that a random slot pattern would pass by chance is taken off; the language
with the largest corrected count is the answer, and that count's share of the n-grams is the score.

A language's profile is every 3-gram that makes up at least ``least_share`` of the 3-grams of all its
training texts, so it has at most 1 / least_share of them whatever the corpus's size, and the filter,
of a fixed number of slots, is all that is sent to the executors: 8 MB for each 64 languages.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import in_parts
from palimpsest.llm.common import id_fold, materialize, table

NONE = "und"
SLOT_BITS = 20
#: Odd multipliers, one for each hash function.
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93)
#: n-grams rarer than this in a language stay out of its profile, which bounds it; 0 keeps them all.  Rare ones are mostly
#: names and foreign words: on sf0.1 held-out accuracy is 99.91 % with this bound and 99.23 % without one.
LEAST_SHARE = 2e-5
#: n-grams that a training task holds before it hands its counts on.
HELD = 1 << 20
#: Letters are looked up to here; the few planes beyond hold none.
TOP = 0x34000

_letters: list[np.ndarray] = []


def _letter_table() -> np.ndarray:
    """Code point -> code point of its lower case, or 0 if it is no letter."""
    if not _letters:
        found = np.zeros(TOP + 1, np.uint64)
        for c in range(TOP):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                found[c] = ord(low) if len(low) == 1 else c
        _letters.append(found)
    return _letters[0]


def letter_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """3-grams around every letter (other characters count as one blank), text after text; how many each text has."""
    flat = np.frombuffer("\0".join(["", *texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = _letter_table()[np.minimum(flat, TOP)]
    at = np.flatnonzero(low)
    grams = (low[at - 1] << np.uint64(42)) | (low[at] << np.uint64(21)) | low[at + 1]
    ends = np.cumsum([len(t) + 1 for t in texts])
    return grams, np.diff(np.searchsorted(at, np.r_[0, ends], side="right"))


def _slots(grams: np.ndarray) -> list[np.ndarray]:
    return [((grams * np.uint64(m)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64) for m in HASHES]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, n = _added(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])
        held.clear()

    for b in batches:
        texts, langs = [t or "" for t in b.column("text").to_pylist()], np.array(b.column("lang").to_pylist(), object)
        for i, j in in_parts(texts):
            for lang in dict.fromkeys(langs[i:j]):
                own = [t for t, x in zip(texts[i:j], langs[i:j], strict=True) if x == lang]
                grams, n = np.unique(letter_grams(own)[0], return_counts=True)
                parts = held.setdefault(lang, [])
                parts.append((grams, n.astype(np.int64)))
                size += len(grams)
            if size > HELD:
                held.update({k: [_added(v)] for k, v in held.items()})
                size = sum(len(v[0][0]) for v in held.values())
                if size > HELD // 2:
                    yield from out()
                    size = 0
    yield from out()


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(grams)).astype(np.int64)


class LanguageFilter:
    """The bit-sliced filter: ``slices[k]`` holds the bits of languages 64 k to 64 k + 63 for each slot."""

    def __init__(self, profiles: dict[str, np.ndarray], usual: str | None):
        self.langs, self.usual = sorted(profiles), usual
        self.slices = np.zeros(((len(self.langs) + 63) // 64, 1 << SLOT_BITS), np.uint64)
        chance = []
        for k, lang in enumerate(self.langs):
            bits, bit = self.slices[k // 64], np.uint64(1 << k % 64)
            full = np.zeros(1 << SLOT_BITS, bool)
            for s in _slots(profiles[lang].astype(np.uint64)):
                full[s] = True
            bits[full] |= bit
            chance.append(full.mean() ** len(HASHES))
        self.chance = np.array(chance)

    def decide(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        grams, n = letter_grams(texts)
        slots = _slots(grams)
        starts = np.cumsum(n) - n
        some = np.flatnonzero(n)
        hits = np.zeros((len(texts), len(self.langs)))
        for k, bits in enumerate(self.slices):
            mask = bits[slots[0]]
            for s in slots[1:]:
                mask &= bits[s]
            for i in range(min(64, len(self.langs) - 64 * k) if len(some) else 0):
                hits[some, 64 * k + i] = np.add.reduceat((mask >> np.uint64(i)) & np.uint64(1), starts[some])
        total = np.maximum(n, 1)[:, None]
        share = np.clip((hits / total - self.chance) / (1 - self.chance), 0, 1)
        best = share.argmax(1) if self.langs else np.zeros(len(texts), int)
        names, score = [], np.zeros(len(texts))
        for i, k in enumerate(best):
            if not n[i] or not self.langs:
                names.append(NONE)
            else:
                score[i] = share[i, k]
                names.append(self.langs[k] if score[i] > 0 else self.usual)
        return names, score


def train(docs: DataFrame, learn: Column, text_col: str = "text", lang_col: str = "lang", least_share: float = LEAST_SHARE) -> LanguageFilter:
    """The filter of all rows of ``docs`` where ``learn`` holds and the language is known.

    At most 1 / ``least_share`` n-grams of each language reach the driver.  Null and empty texts teach nothing; an empty
    table gives a filter that knows no language.
    """
    rows = docs.where(learn & F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counts = materialize(rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")), "grams")
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    kept = counts.join(totals, "lang").where(F.col("n") >= F.col("total") * least_share).select("lang", "gram").toPandas()
    most = totals.orderBy(F.desc("total"), "lang").first()
    profiles = {lang: g["gram"].to_numpy() for lang, g in kept.groupby("lang")}
    return LanguageFilter(profiles, most["lang"] if most else None)


def identify(docs: DataFrame, model: LanguageFilter, keep: list[str], text_col: str = "text", out: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """Columns ``keep`` of ``docs``, and named by ``out`` the language and its score.

    A null text or one without a letter is ``und`` with score 0, as is every text if nothing was learned.
    A text with letters always gets a learned language: without any evidence the most frequent one, with
    score 0; ties go to the language that sorts first.  Texts of any length are read whole.  Repeated rows are kept;
    an empty table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or "" for t in b.column("__text").to_pylist()]
            for i, j in in_parts(texts):
                names, score = shared.value.decide(texts[i:j])
                part = b.slice(i, j - i)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, *out])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    schema = docs.select(*keep).schema.add(out[0], "string").add(out[1], "double")
    return rows.mapInArrow(run, schema)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id are neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_fold("doc_id", 3) == 1, F.lit(False)))
    model = train(docs, id_fold("doc_id", 3) != 1)
    return identify(docs, model, ["doc_id", "held_out"]).select("doc_id", "held_out", "lang_pred", "score")
