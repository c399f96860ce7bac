"""The canonicalizer: invisible characters, confusables, NFKC, then recursive decoding, with an edit trace.

It needs Python's Unicode tables and a choice per run of text, so it is one Arrow UDF, in a text-only
and a traced form; the same function body serves both, and tracing never changes the text.
"""

from __future__ import annotations

import base64
import re
import unicodedata
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain
from math import log2
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

EDIT_TYPE = "struct<stage:string,start:int,end:int,before:string,after:string,depth:int>"
_EDIT = pa.struct([("stage", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("before", pa.string()), ("after", pa.string()), ("depth", pa.int32())])


class Edit(NamedTuple):
    stage: str
    start: int
    end: int
    before: str
    after: str
    depth: int = 0


class Canon(NamedTuple):
    text: str
    edits: list[Edit]
    ceiling_hit: bool
    max_depth_reached: int
    stages: frozenset[str]  # of those with an edit


#: Texts of one slice of a batch, and their bytes unless it is one text.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 18

_HIDDEN = re.compile(f"[{V.INVISIBLE}]+")
_LOOKALIKE = re.compile(f"[{''.join(map(chr, V.CONFUSABLE))}]+")

# Tables by code point, for passes over whole texts at once.
_BMP = 0x10000
_IS_HIDDEN, _IS_LOOKALIKE = np.uint8(1), np.uint8(2)
_ODD = np.zeros(_BMP, np.uint8)
_ODD[[*map(ord, V.INVISIBLE)]] = _IS_HIDDEN
_ODD[[*V.CONFUSABLE]] = _IS_LOOKALIKE
_FOLDED = np.arange(_BMP, dtype=np.uint32)
_FOLDED[[k for k, v in V.CONFUSABLE.items() if len(v) == 1]] = [ord(v) for v in V.CONFUSABLE.values() if len(v) == 1]
_LONGER = [(chr(k), v) for k, v in V.CONFUSABLE.items() if len(v) > 1]


def _outside(alphabet: str) -> bytes:
    """1 for each byte that is none of an alphabet of ASCII, else 0."""
    return bytes(chr(b) not in alphabet for b in range(256))


_NOT_HEX = _outside("0123456789ABCDEFabcdef")
_NOT_B64 = _outside("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/=")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _runs(text: str, outside: bytes, least: int) -> list[tuple[int, int]]:
    """Maximal runs of an alphabet of ASCII that have ``least`` characters, in one pass: a pattern begins anew at each character."""
    # One byte a character; those beyond ASCII are outside like any other.
    marks = (text.encode() if text.isascii() else np.minimum(_codes(text), 255).astype(np.uint8).tobytes()).translate(outside)
    if bytes(least) not in marks:
        return []
    ends = np.flatnonzero(np.frombuffer(marks, bool))
    edges = np.concatenate(([-1], ends, [len(marks)]))
    return [(int(edges[k]) + 1, int(edges[k + 1])) for k in np.flatnonzero(np.diff(edges) > least)]


def _substituted(stage: str, text: str, spans: Iterable[tuple[int, int, str]], trace: bool) -> tuple[str, list[Edit]]:
    """``text`` with spans replaced; spans that touch are one edit."""
    out, edits, done = [], [], 0
    for a, b, new in spans:
        out += (text[done:a], new)
        if trace:
            if edits and edits[-1].end == a:
                last = edits.pop()
                edits.append(Edit(stage, last.start, b, last.before + text[a:b], last.after + new))
            else:
                edits.append(Edit(stage, a, b, text[a:b], new))
        done = b
    return "".join([*out, text[done:]]), edits


def _hidden(text: str, trace: bool) -> tuple[str, list[Edit]]:
    return _substituted("invisible", text, ((m.start(), m.end(), "") for m in _HIDDEN.finditer(text)), trace)


def _folded(text: str, trace: bool) -> tuple[str, list[Edit]]:
    return _substituted("confusables", text, ((m.start(), m.end(), m.group().translate(V.CONFUSABLE)) for m in _LOOKALIKE.finditer(text)), trace)


def _composed(text: str, trace: bool) -> tuple[str, list[Edit]]:
    """NFKC.  Changes are placed by pieces that begin at starters where these normalize alone; else as one region."""
    whole = unicodedata.normalize("NFKC", text)
    if whole == text or not trace:
        return whole, []
    cuts = [0, *(k for k in range(1, len(text)) if not unicodedata.combining(text[k])), len(text)]
    pieces = [(a, b, text[a:b], unicodedata.normalize("NFKC", text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
    if "".join(p[3] for p in pieces) == whole:
        return _substituted("nfkc", text, ((a, b, new) for a, b, old, new in pieces if old != new), trace)
    same = next((k for k, (x, y) in enumerate(zip(text, whole, strict=False)) if x != y), min(len(text), len(whole)))
    room = min(len(text), len(whole)) - same
    tail = next((k for k in range(room) if text[-1 - k] != whole[-1 - k]), room)
    return _substituted("nfkc", text, [(same, len(text) - tail, whole[same : len(whole) - tail])], trace)


def shannon(run: str) -> float:
    """Bits a character, summed in the order of characters."""
    n = len(run)
    if n < 64 or not run.isascii():
        counts = [run.count(c) for c in sorted(set(run))]
    else:
        every = np.bincount(np.frombuffer(run.encode(), np.uint8))
        counts = every[every > 0].tolist()
    total = 0.0
    for k in counts:
        total -= k / n * log2(k / n)
    return total


def try_decode(run: str, encoding: str) -> str | None:
    """CAN-05 and CAN-06: the text of a candidate, or None if it is refused."""
    least, floor = (V.HEX_CHARS, V.HEX_ENTROPY) if encoding == "hex" else (V.BASE64_CHARS, V.BASE64_ENTROPY)
    if len(run) < least or shannon(run) < floor:
        return None
    try:
        raw = bytes.fromhex(run) if encoding == "hex" else base64.b64decode(run, validate=True)
        return raw.decode()
    except ValueError:
        return None


def candidates(text: str) -> Iterable[tuple[int, int, str | None]]:
    """CAN-08: reported spans with what they decode to.

    Hex comes first in each run of base64's alphabet; only where it accepts nothing is a long enough run
    offered whole as base64.
    """
    # Shorter runs of base64's alphabet hold no candidate of either encoding.
    for a, b in _runs(text, _NOT_B64, V.HEX_CHARS):
        run = text[a:b]
        hexes = [(a + x, a + y, try_decode(run[x:y], "hex")) for x, y in _runs(run, _NOT_HEX, V.HEX_CHARS)]
        if b - a >= V.BASE64_CHARS and all(x[2] is None for x in hexes):
            yield a, b, try_decode(run, "base64")
        else:
            yield from hexes


def _unhidden(text: str) -> str:
    for c in V.INVISIBLE:
        text = text.replace(c, "")
    return text


def _unlike(text: str) -> str:
    """Outputs are of ASCII, so the order of replacements doesn't matter."""
    for source, target in _LONGER:
        text = text.replace(source, target)
    if text.isascii():
        return text
    codes = _codes(text)
    return np.where(codes < _BMP, _FOLDED[np.minimum(codes, _BMP - 1)], codes).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def _plain(text: str) -> tuple[str, list[str]]:
    """What the three character stages make of a text, and those that change it: the traced ones without edits."""
    odd = np.bitwise_or.reduce(_ODD[np.minimum(_codes(text), _BMP - 1)])
    stages = []
    for stage, flag, step in (("invisible", _IS_HIDDEN, _unhidden), ("confusables", _IS_LOOKALIKE, _unlike)):
        if odd & flag:
            text = step(text)
            stages.append(stage)
    if not text.isascii() and (whole := unicodedata.normalize("NFKC", text)) != text:
        return whole, [*stages, "nfkc"]
    return text, stages


_STEPS = (("invisible", _hidden), ("confusables", _folded), ("nfkc", _composed))


def canonicalize(text: str, ceiling: int = V.CEILING, trace: bool = True, depth: int = 0) -> Canon:
    """CAN-12.  An accepted decode is a document of its own at the next depth; the host is not scanned again."""
    edits: list[Edit] = []
    stages: set[str] = set()
    if not trace and not text.isascii():
        text, changed = _plain(text)
        stages.update(changed)
    for stage, traced in _STEPS if trace else ():
        if not text.isascii():
            new, found = traced(text, True)
            if new != text:
                stages.add(stage)
            text = new
            edits += (e._replace(depth=depth) for e in found)
    out, done, hit, deepest = [], 0, False, depth
    for a, b, inner in candidates(text):
        old = text[a:b]
        if inner is not None and depth >= ceiling:
            hit, inner, stage = True, None, V.DECODE_CEILING
        else:
            stage = V.DECODE
        stages.add(stage)
        if trace:
            edits.append(Edit(stage, a, b, old, old if inner is None else inner, depth))
        if inner is not None:
            sub = canonicalize(inner, ceiling, trace, depth + 1)
            edits += sub.edits
            stages |= sub.stages
            hit, deepest = hit or sub.ceiling_hit, max(deepest, sub.max_depth_reached)
            out += (text[done:a], sub.text)
            done = b
    return Canon("".join([*out, text[done:]]), edits, hit, deepest, frozenset(stages))


def _bounds(text: pa.Array) -> Iterator[slice]:
    """Where the slices of a batch are."""
    size = pc.fill_null(pc.binary_length(text), 0).to_pylist()
    at, held = 0, 0
    for k, n in enumerate(size):
        if k > at and (held + n > SLICE_BYTES or k - at == SLICE_ROWS):
            yield slice(at, k)
            at, held = k, 0
        held += n
    if at < len(size):
        yield slice(at, len(size))


def slices(text: pa.Array) -> Iterator[list[str | None]]:
    """The texts of a batch a few at a time, by their bytes: what is made of one slice is sent before the next is read.

    A batch is of so many rows, whatever their length, and an edit takes many times the room of the text that it is of.
    """
    return (text[s].to_pylist() for s in _bounds(text))


def _listed(rows: list[list | None], values: pa.Array) -> pa.Array:
    """``values``, which are those of all ``rows`` in order, as one list a row; null for None."""
    ends = [0, *accumulate(len(r or ()) for r in rows)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), values, mask=pa.array([r is None for r in rows]))


def _edits(rows: list[list[Edit] | None]) -> pa.Array:
    """Column by column, so no edit is a dictionary."""
    columns = [pa.array([e[i] for r in rows for e in r or ()], field.type) for i, field in enumerate(_EDIT)]
    return _listed(rows, pa.StructArray.from_arrays(columns, fields=list(_EDIT)))


def _canons(rows: list[Canon | None], edits: bool) -> pa.Array:
    stages = [r and [s for s in V.TRACE_LABELS if s in r.stages] for r in rows]
    columns = {
        "text": pa.array([r and r.text for r in rows], pa.string()), **({"edits": _edits([r and r.edits for r in rows])} if edits else {}),
        "ceiling_hit": pa.array([r and r.ceiling_hit for r in rows], pa.bool_()), "max_depth_reached": pa.array([r and r.max_depth_reached for r in rows], pa.int32()),
        "stages": _listed(stages, pa.array([s for r in stages for s in r or ()], pa.string())),
    }
    return pa.StructArray.from_arrays([*columns.values()], [*columns], mask=pa.array([r is None for r in rows]))


_FLAGS = "ceiling_hit:boolean,max_depth_reached:int,stages:array<string>"


def canonical_udf(ceiling: int = V.CEILING):
    """text -> struct<text, ceiling_hit, max_depth_reached, stages>; null for null."""

    @F.arrow_udf(f"struct<text:string,{_FLAGS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in chain.from_iterable(map(slices, batches)):
            yield _canons([None if t is None else canonicalize(t, ceiling, trace=False) for t in some], False)

    return run


def is_candidate(run: str, encoding: str) -> bool:
    """CAN-05: alphabet, length and entropy, all inclusive."""
    outside, least, floor = (_NOT_HEX, V.HEX_CHARS, V.HEX_ENTROPY) if encoding == "hex" else (_NOT_B64, V.BASE64_CHARS, V.BASE64_ENTROPY)
    return len(run) >= least and run.isascii() and 1 not in run.encode().translate(outside) and shannon(run) >= floor


def round_trip_udf(ceiling: int = V.CEILING):
    """text, dressed, runs (encoding, run) -> struct<declined, ceiling, differ>.

    Whether one of the runs that the dressing makes is no candidate; whether the text or the dressed one reaches the
    ceiling; and whether, if neither does, their canonical texts differ.  No canonical text goes back to the JVM, and a
    text that comes several times in a row, once for each chain, is canonicalized once.
    """

    @F.arrow_udf("struct<declined:boolean,ceiling:boolean,differ:boolean>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        last, plain = None, None
        for text, dressed, runs in batches:
            for s in _bounds(dressed):
                rows = []
                for k in range(s.start, s.stop):
                    t, d = text[k].as_py(), dressed[k].as_py()
                    if plain is None or t != last:
                        last, plain = t, canonicalize(t, ceiling, trace=False)
                    again = canonicalize(d, ceiling, trace=False)
                    hit = plain.ceiling_hit or again.ceiling_hit
                    declined = any(not is_candidate(r["run"], r["encoding"]) for r in runs[k].as_py())
                    rows.append((declined, hit, not hit and plain.text != again.text))
                yield pa.StructArray.from_arrays([pa.array(c, pa.bool_()) for c in zip(*rows, strict=True)], ["declined", "ceiling", "differ"])

    return run


def traced_udf(ceiling: int = V.CEILING):
    """text -> struct<text, edits, ceiling_hit, max_depth_reached, stages>; null for null."""

    @F.arrow_udf(f"struct<text:string,edits:array<{EDIT_TYPE}>,{_FLAGS}>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in chain.from_iterable(map(slices, batches)):
            yield _canons([None if t is None else canonicalize(t, ceiling) for t in some], True)

    return run


def stage_udf(stage: str):
    """One stage by name: text -> struct<text, edits>."""
    step = {"invisible": _hidden, "confusables": _folded, "nfkc": _composed}[stage]

    @F.arrow_udf(f"struct<text:string,edits:array<{EDIT_TYPE}>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for some in chain.from_iterable(map(slices, batches)):
            rows = [None if t is None else step(t, True) for t in some]
            columns = [pa.array([r and r[0] for r in rows], pa.string()), _edits([r and r[1] for r in rows])]
            yield pa.StructArray.from_arrays(columns, ["text", "edits"], mask=pa.array([r is None for r in rows]))

    return run


def replay(text: str, edits: list[Edit]) -> str:
    """CAN-13: what one stage's edits make of its input; an edit that doesn't fit raises."""
    out, done = [], 0
    for e in edits:
        if e.start < done or text[e.start : e.end] != e.before:
            raise ValueError(f"{e} does not fit at {done}")
        out += (text[done : e.start], e.after)
        done = e.end
    return "".join([*out, text[done:]])
