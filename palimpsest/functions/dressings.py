"""Encodings of a payload and chains of them, as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from palimpsest.functions import vocabulary as V
from palimpsest.functions.canon import slices

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def substitutes() -> dict[str, str]:
    """ASCII character -> its confusable of lowest code point."""
    found: dict[str, str] = {}
    for source in sorted(V.CONFUSABLE):
        target = V.CONFUSABLE[source]
        if len(target) == 1:
            found.setdefault(target, chr(source))
    return found


def to_base64(text: Column) -> Column:
    """DRS-01; Spark breaks lines, so these are taken out."""
    return F.replace(F.base64(text.cast("binary")), F.lit("\r\n"), F.lit(""))


def to_hex(text: Column) -> Column:
    return F.lower(F.hex(text.cast("binary")))


def homoglyph(text: Column) -> Column:
    table = substitutes()
    return F.translate(text, "".join(table), "".join(table.values()))


#: Characters of the longest text that is split into an array of them, which takes half the time of a pattern and many times the text's room.
SPLIT_CHARS = 1 << 20


def zero_width(text: Column) -> Column:
    split = F.array_join(F.split(text, ""), "\u200b")
    return F.when(F.length(text) <= SPLIT_CHARS, split).otherwise(F.regexp_replace(text, r"(?s)(?<=.)(?=.)", "\u200b"))


_B32 = np.frombuffer((_UPPER + "234567").encode(), np.uint8)
_B32_PAD = (0, 1, 3, 4, 6)  # by the bytes that the last five lack


def b32(raw: bytes) -> str:
    """The standard library's base32, five bytes of all at a time: that one has a step of Python for each five."""
    lack = -len(raw) % 5
    fives = np.frombuffer(raw + bytes(lack), np.uint8).reshape(-1, 5).astype(np.uint64)
    whole = fives @ np.array([1 << 32, 1 << 24, 1 << 16, 1 << 8, 1], np.uint64)
    out = _B32[(whole[:, None] >> np.arange(35, -1, -5, dtype=np.uint64)) & np.uint64(31)].tobytes().decode()
    pad = _B32_PAD[lack]
    return out[: len(out) - pad] + "=" * pad


@F.arrow_udf(StringType())
def to_base32(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """DRS-05: the JVM has no such function, and one of lambdas over five bytes at a time costs seconds a megabyte."""
    for some in chain.from_iterable(map(slices, batches)):
        yield pa.array([None if t is None else b32(t.encode()) for t in some], pa.string())


def to_url_percent(text: Column) -> Column:
    """DRS-06: unreserved characters only stay."""
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("%7E", "~"), ("*", "%2A")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return out


def to_rot13(text: Column) -> Column:
    turned = _UPPER[13:] + _UPPER[:13] + _LOWER[13:] + _LOWER[:13]
    return F.translate(text, _UPPER + _LOWER, turned)


DRESSINGS: dict[str, Callable[[Column], Column]] = {"base64": to_base64, "hex": to_hex, "homoglyph": homoglyph, "zero_width": zero_width}
HELD_OUT_DRESSINGS: dict[str, Callable[[Column], Column]] = {"base32": to_base32, "url_percent": to_url_percent, "rot13": to_rot13}


def registry() -> dict[str, Callable[[Column], Column]]:
    """DRS-08: both registries, which must not share a name."""
    if both := DRESSINGS.keys() & HELD_OUT_DRESSINGS.keys():
        raise ValueError(f"bound and held out at once: {sorted(both)}")
    return DRESSINGS | HELD_OUT_DRESSINGS


def dress(text: Column, chain: tuple[str, ...]) -> Column:
    """DRS-08: later links wrap earlier ones; the empty chain changes nothing."""
    known = registry()
    if unknown := [x for x in chain if x not in known]:
        raise KeyError(f"no dressing is named {unknown}")
    return reduce(lambda c, link: known[link](c), chain, text)


def with_prefixes(rows: DataFrame, chains: tuple[tuple[str, ...], ...], text: str = "text") -> tuple[DataFrame, dict[tuple[str, ...], str]]:
    """``rows`` with a column for each prefix of ``chains``, and its name by prefix.

    Each is dressed once, from the prefix before; what is read several times is not inlined again.
    """
    prefixes = sorted({c[:k] for c in chains for k in range(1, len(c) + 1)}, key=len)
    named = {(): text} | {p: f"__t{i}" for i, p in enumerate(prefixes)}
    for n in range(1, max(map(len, prefixes), default=0) + 1):
        rows = rows.withColumns({named[p]: dress(F.col(named[p[:-1]]), p[-1:]) for p in prefixes if len(p) == n})
    return rows, named


def chain_name(chain: tuple[str, ...]) -> str:
    return V.CHAIN_SEPARATOR.join(chain) or V.CLEAN


def render_chain(chain: Column) -> Column:
    """DRS-09."""
    return F.when(F.size(chain) == 0, F.lit(V.CLEAN)).otherwise(F.array_join(chain, V.CHAIN_SEPARATOR))


def parse_chain(name: Column) -> Column:
    """DRS-09's inverse: null for a name with an unknown link."""
    links = F.when(name == V.CLEAN, F.array().cast("array<string>")).otherwise(F.split(name, r"\+"))
    known = F.array(*[F.lit(x) for x in registry()])
    return F.when(F.size(F.array_except(links, known)) == 0, links)


def item_id(payload: Column, chain: Column) -> Column:
    """DRS-11."""
    return F.concat(payload, F.lit(V.ID_SEPARATOR), chain)


def parse_item_id(item: Column) -> Column:
    """DRS-11's strict inverse: payload and chain, or null."""
    payload = F.regexp_extract(item, r"^([0-9a-f]{16})::([^:]+)$", 1)
    chain = F.regexp_extract(item, r"^([0-9a-f]{16})::([^:]+)$", 2)
    return F.when((payload != "") & parse_chain(chain).isNotNull(), F.struct(payload.alias("payload_id"), chain.alias("chain")))


def encoding_depth(links: Column) -> Column:
    """DRS-13."""
    return F.size(F.filter(links, lambda x: x.isin(*V.DECODED_LINKS)))


def chain_class(links: Column) -> Column:
    """DRS-12: null for a chain that mixes bound and held-out links."""
    inside = lambda names: F.size(F.array_except(links, F.array(*map(F.lit, names)))) == 0
    return F.when(inside(DRESSINGS), F.lit(V.BOUND)).when(inside(HELD_OUT_DRESSINGS), F.lit(V.HELD_OUT))


def probes(links: Column) -> Column:
    """DRS-14: what the canonicalizer can engage a held-out chain with; null for others."""
    table = F.create_map(*[x for k, v in V.PROBES.items() for x in (F.lit(k), F.lit(v))])
    return F.when((F.size(links) == 1) & (chain_class(links) == V.HELD_OUT), F.element_at(table, F.get(links, F.lit(0))))


def chain_problems(chains: tuple[tuple[str, ...], ...], held_out: tuple[tuple[str, ...], ...], least_held_out: int = 2) -> list[str]:
    """DRS-15: what is wrong with a declaration of chains."""
    problems = [f"{chain_name(c)} is declared twice" for c in {*chains} if chains.count(c) > 1]
    problems += [f"{chain_name(c)} is bound and held out" for c in {*chains} & {*held_out}]
    problems += [f"{chain_name(c)}: unknown bound link" for c in chains if {*c} - DRESSINGS.keys()]
    problems += [f"{chain_name(c)}: a held-out chain is one held-out link" for c in held_out if len(c) != 1 or {*c} - HELD_OUT_DRESSINGS.keys()]
    if () not in chains:
        problems.append("the clean chain is missing")
    if len({*held_out}) < least_held_out:
        problems.append(f"fewer than {least_held_out} held-out chains")
    if not any(sum(x in V.DECODED_LINKS for x in c) > V.CEILING for c in chains):
        problems.append("no chain is deeper than the ceiling")
    return problems


def min_payload_bytes(encoding: str) -> int:
    """DRS-16: the fewest bytes whose encoding is long enough to be a candidate."""
    length = (lambda n: 2 * n) if encoding == "hex" else (lambda n: 4 * -(-n // 3))
    least = V.HEX_CHARS if encoding == "hex" else V.BASE64_CHARS
    return next(n for n in range(1, least + 1) if length(n) >= least)


def declined(text: Column, chain: tuple[str, ...]) -> Column:
    """DRS-17: the number of the first link whose output the decoder declines by length or entropy; null if none."""
    from palimpsest.functions.text import is_candidate

    steps = [(k + 1, is_candidate(dress(text, chain[: k + 1]), link)) for k, link in enumerate(chain) if link in V.DECODED_LINKS]
    return F.coalesce(*[F.when(~ok, F.lit(k)) for k, ok in steps], F.lit(None).cast("int"))
