"""Token counts of a piece BPE vocabulary by heap-and-linked-list merging.

A text's characters are a linked list.  A heap holds the adjacent pairs that are pieces; the best one is
popped again and again, and its two symbols become one.  The count is the number of symbols at first
minus the number of merges; no identifiers are made.  A symbol that is no piece counts as many tokens as
it has bytes.

Merges never cross a place where no piece of the vocabulary has these two neighbours: before a space
mark after another character, and around characters that only occur as themselves.  Texts are cut
there, and each Python worker remembers the counts of parts that it has met, up to a bound.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import table

MARK = "▁"
REMEMBERED = 400_000
#: The production limit of op9's over_limit.
LIMIT = 4096


class PieceCounter:
    """Counts tokens as the library does for a BPE model with byte fallback, no normalization rules and a dummy prefix."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds = (sp.is_control, sp.is_unknown, sp.is_byte, sp.is_unused)
        usual = [i for i in range(sp.get_piece_size()) if not any(kind(i) for kind in kinds)]
        #: Rank of each piece: the higher the score, the earlier.  Equal scores have equal ranks.
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in usual}
        if any(MARK in p.lstrip(MARK) for p in self.rank):
            raise ValueError("pieces with a space mark inside: texts can't be cut at spaces")
        if sum(r == 0 and len(p) > 1 for p, r in self.rank.items()) > 1:
            raise ValueError("pieces that users defined are never cut, which merging does not know")
        if not all(map(sp.is_byte, sp.encode("\U0010fffd")[1:])):
            raise ValueError("a model without byte fallback")
        self.lines_apart = not any("\n" in p and len(p) > 1 for p in self.rank)
        self.line = self._surcharge("\n") + 1
        self.parts = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.known: dict[str, int] = {}

    def _surcharge(self, symbol: str) -> int:
        return 0 if symbol in self.rank else len(symbol.encode()) - 1

    def count_part(self, part: str) -> int:
        """Symbols minus merges, plus the further bytes of symbols that are no pieces."""
        rank, n = self.rank, len(part)
        if part in rank and n == 1:
            return 1
        symbol: list[str | None] = list(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(rank[pair], i, pair) for i in range(n - 1) if (pair := part[i : i + 2]) in rank]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, pair = heapq.heappop(heap)
            j = after[i]
            if symbol[i] is None or j >= n or symbol[i] + symbol[j] != pair:  # one of the two has changed since
                continue
            symbol[i], symbol[j] = pair, None
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (new := pair + symbol[k]) in rank:
                    heapq.heappush(heap, (rank[new], i, new))
            if (h := before[i]) >= 0 and (new := symbol[h] + pair) in rank:
                heapq.heappush(heap, (rank[new], h, new))
        return n - merges + sum(self._surcharge(s) for s in symbol if s is not None)

    def _known(self, part: str) -> int:
        n = self.known.get(part)
        if n is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            n = self.count_part(part)
            if len(part) < 200:
                self.known[part] = n
        return n

    def count(self, text: str) -> int:
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        if not self.lines_apart:
            return sum(map(self._known, self.parts.findall(marked)))
        lines = marked.split("\n")
        return (len(lines) - 1) * self.line + sum(sum(map(self._known, self.parts.findall(x))) for x in lines)


_loaded: dict[str, PieceCounter] = {}


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens for each row of ``docs``.

    ``tokenizer``: path of a piece model that every executor has.  Null texts count as empty: no bytes and
    no tokens.  Strings like ``<s>`` inside texts are ordinary text.  Of pairs of equal rank the left one
    merges first.  Texts of any length are counted whole.  Repeated rows and null ids are kept; an empty table gives
    no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _loaded:
            _loaded[tokenizer] = PieceCounter(tokenizer)
        counter = _loaded[tokenizer]
        for b in batches:
            n = [counter.count(t.as_py() or "") for t in b.column("text")]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("n_bytes"), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    text = F.col(text_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), text.alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long")


def op9_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    counts = token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > LIMIT)
