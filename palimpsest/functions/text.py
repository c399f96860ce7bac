"""Column functions over text.  All run in the JVM except ``normalized``, ``entropy`` and those of ``canon``."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from palimpsest.functions import vocabulary as V
from palimpsest.functions.canon import shannon, slices

#: What strict decoders take as base64 and as hex.
STRICT_BASE64 = "^(?:[A-Za-z0-9+/]{4})*(?:[A-Za-z0-9+/]{2}==|[A-Za-z0-9+/]{3}=)?$"
STRICT_HEX = "^(?:[0-9A-Fa-f]{2})*$"
BASE64_RUN, HEX_RUN = "[A-Za-z0-9+/=]+", "[0-9A-Fa-f]{16,}"

_SINGLE = {chr(k): v for k, v in V.CONFUSABLE.items() if len(v) == 1}
_MULTIPLE = {chr(k): v for k, v in V.CONFUSABLE.items() if len(v) > 1}


def let(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once and not again for each element that a lambda meets."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip_invisible(text: Column) -> Column:
    """CAN-01."""
    return F.translate(text, V.INVISIBLE, "")


def fold_confusables(text: Column) -> Column:
    """CAN-02.  All outputs are ASCII, so the order of replacements doesn't matter."""
    out = F.translate(text, "".join(_SINGLE), "".join(_SINGLE.values()))
    for source, target in _MULTIPLE.items():
        out = F.replace(out, F.lit(source), F.lit(target))
    return out


def kernel(text: Column) -> Column:
    """The part of canonicalization that the JVM does: deletions and folding."""
    return fold_confusables(strip_invisible(text))


@F.arrow_udf(DoubleType())
def entropy(text: pa.Array) -> pa.Array:
    """CAN-04: Shannon bits a character, summed in the order of characters; 0 for the empty string.

    Counting in the JVM takes a pass over the text for each distinct character; this takes one.
    """
    return pa.array((None if t is None else shannon(t) for t in chain.from_iterable(slices(text))), pa.float64())


def is_candidate(run: Column, encoding: str) -> Column:
    """CAN-05: alphabet, length and entropy, all inclusive."""
    pattern, least, floor = ("^[0-9A-Fa-f]+$", V.HEX_CHARS, V.HEX_ENTROPY) if encoding == "hex" else ("^[A-Za-z0-9+/=]+$", V.BASE64_CHARS, V.BASE64_ENTROPY)
    return run.rlike(pattern) & (F.length(run) >= least) & (entropy(run) >= floor)


def decoded(run: Column, encoding: str) -> Column:
    """CAN-06: the text that a candidate encodes, strictly, or null."""
    strict = STRICT_HEX if encoding == "hex" else STRICT_BASE64
    raw = F.when(run.rlike(strict), F.try_to_binary(run, F.lit(encoding))).cast("string")
    return F.when(is_candidate(run, encoding) & F.is_valid_utf8(raw), raw)


def maximal_runs(text: Column, encoding: str) -> Column:
    """CAN-07: the maximal runs of an encoding's alphabet (hex: those of 16 and more)."""
    return F.regexp_extract_all(text, F.lit(HEX_RUN if encoding == "hex" else BASE64_RUN), F.lit(0))


@F.arrow_udf(StringType())
def normalized(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """TXT-01: NFKC, lower case, Unicode white space collapsed.  The JVM's tables are of another Unicode version."""
    form = unicodedata.normalize
    for some in chain.from_iterable(map(slices, batches)):
        yield pa.array([None if t is None else " ".join(form("NFKC", t).lower().split()) for t in some], pa.string())


def tokens(normal: Column) -> Column:
    return F.filter(F.split(normal, " "), lambda w: w != "")


def shingles(words: Column, k: int = V.SHINGLE) -> Column:
    """TXT-03: the set of k-grams of words, joined by spaces; empty if there are fewer words."""
    n = F.size(words)
    # ``slice`` copies all words for each gram, which costs the square of a text's words.
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def hashed_shingles(words: Column, k: int = V.SHINGLE) -> Column:
    """A hash of each k-gram of words, in order; empty if there are fewer words."""
    n = F.size(words)
    grams = F.transform(F.sequence(F.lit(0), F.greatest(n - k, F.lit(0))), lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))


def contains_run(text: Column, run: Column) -> Column:
    """TXT-04: whether ``run`` occurs in ``text`` as whole tokens."""
    pad = lambda c: F.concat(F.lit(" "), c, F.lit(" "))
    return F.contains(pad(text), pad(run))


def excerpt(text: Column, n: int = 60) -> Column:
    """TXT-05."""
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def digest(text: Column) -> Column:
    """TXT-06."""
    return F.sha2(text.cast("binary"), 256)


def payload_id(text: Column) -> Column:
    """DRS-10."""
    return F.left(digest(text), F.lit(16))


def _b64url(segment: Column) -> Column:
    plain = F.translate(segment, "-_", "+/")
    padded = F.rpad(plain, (F.ceil(F.length(plain) / 4) * 4).cast("int"), F.lit("="))
    return F.when(padded.rlike(STRICT_BASE64), F.try_to_binary(padded, F.lit("base64"))).cast("string")


def is_jwt(text: Column) -> Column:
    """TXT-07: three dotted parts, a header object with ``alg``, a JSON payload."""
    part = lambda i: F.element_at(F.split(text, r"\."), i)
    header, body = _b64url(part(1)), _b64url(part(2))
    three = text.rlike(r"^[^.]+\.[^.]+\.[^.]*$")
    good = F.get_json_object(header, "$.alg").isNotNull() & F.try_parse_json(body).isNotNull()
    return F.coalesce(F.when(three, good), F.lit(False))


def carries_hash(text: Column, source: Column) -> Column:
    """TXT-08."""
    return F.coalesce(F.contains(text, digest(source)), F.lit(False))


def is_data_uri(text: Column) -> Column:
    """TXT-09."""
    body = F.regexp_extract(text, r"^data:[^;,]+;base64,(.+)$", 1)
    return F.coalesce((body != "") & body.rlike(STRICT_BASE64), F.lit(False))


def is_ssh_key(text: Column) -> Column:
    """TXT-10: the key blob's first length-prefixed field names the algorithm."""
    words = F.split(text, " ")
    algorithm, key = F.get(words, F.lit(0)), F.get(words, F.lit(1))
    blob = F.when(key.rlike(STRICT_BASE64), F.try_to_binary(key, F.lit("base64")))
    n = F.least(F.conv(F.hex(F.substring(blob, 1, 4)), 16, 10).cast("long"), F.lit(1 << 16)).cast("int")
    return F.coalesce(F.substring(blob, F.lit(5), n) == algorithm.cast("binary"), F.lit(False))


def repository_identity(source: Column) -> Column:
    """TXT-12: repository, revision and path of ``github.com/repository@revision:path``."""
    part = lambda i: F.regexp_extract(source, r"^github\.com/([^:]*)@([^:@]*):(.*)$", i)
    return F.struct(part(1).alias("repository"), part(2).alias("revision"), part(3).alias("path"))


def replayed(text: Column, edits: Column) -> Column:
    """CAN-13: what a stage's edits make of its input, piece by piece."""
    two = F.struct(F.split(text, "").alias("chars"), edits.alias("edits"))

    def joined(x: Column) -> Column:
        chars, found = x["chars"], x["edits"]
        before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(found, i - 1)["end"])
        pieces = F.transform(found, lambda e, i: F.concat(F.slice(chars, before(i) + 1, e["start"] - before(i)), F.array(e["after"])))
        done = F.coalesce(F.get(found, F.size(found) - 1)["end"], F.lit(0))
        return F.array_join(F.concat(F.flatten(pieces), F.slice(chars, done + 1, F.size(chars))), "")

    return let(two, joined)
