"""Personal data by rules and a skip-chain conditional random field.

Rules find e-mail addresses, IPv4 addresses, card numbers and phone numbers.  Their spans always stay;
in the field they are observed labels.  Its variables are the tokens with a digit or an at sign (any
other token is none of these kinds) with labels none, email, ip, card, phone.  Neighbouring tokens share
a potential, and so do distant tokens of one document that are equal, or have the same mailbox name or
the same last digits: skip edges join each such token to the next one like it, and to the first one like it
that a rule has labelled, so a label reaches all mentions at once.  There are a few edges a token.  Loopy messages
carry a label from a mention that a rule finds to those that no rule matches, until they settle; a token whose
belief in a kind is at least ``SURE`` (``SURE_ALONE`` without a skip edge) becomes a further span.

Weights are trained by piecewise conditional likelihood on all documents, with the rules' spans as labels: the
label of a token given its shape, that of a token given its neighbour's, and that of a token given that of one
like it, each with its own normalizer and a quadratic penalty.  A token that no rule labels but that is like one with a
label is what the field is asked about, so it is no example of the label none.  Only counts of shapes and of pairs
of labels leave the executors.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.bpe import in_parts
from palimpsest.llm.common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = len(KINDS) + 1
#: Rounds of messages at most, the change below which they have settled, and how much of a message is kept.
ROUNDS = 100
SETTLED = 1e-4
DAMPING = 0.3
SURE = 0.9
SURE_ALONE = 0.95
#: The weight of the quadratic penalty, against mean log likelihoods.
PENALTY = 1e-3
FEATURES = 25

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A match may not begin inside a run of digits: one that could would have begun at the run's start.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"(?<![0-9])[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_HINT = re.compile(r"[0-9@]")
_BLANK = re.compile(r"[\x20\x09-\x0D]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_BLANKS = " \t\n\x0b\x0c\r"
Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """Each at sign is looked at once, so runs without one cost nothing."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            done = domain.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return found


def base_spans(text: str) -> list[Span]:
    """(kind, start, end) of the rules' matches, by kind and start; ends are exclusive, in code points."""
    out = [(0, a, b) for a, b in _emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := _NOT_DIGIT.sub("", m.group())) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m.group())) <= 15:
                out.append((3, m.start(), m.end()))
    return out


def tokens(text: str) -> list[tuple[int, int]]:
    """Bounds of the tokens between white space that hold a digit or an at sign."""
    out, done = [], 0
    m = _HINT.search(text)
    while m:
        start = max(text.rfind(c, done, m.start()) for c in _BLANKS) + 1 or done
        end = _BLANK.search(text, m.end())
        done = end.start() if end else len(text)
        out.append((start, done))
        m = _HINT.search(text, done)
    return out


def _core(text: str, a: int, b: int) -> tuple[int, int]:
    """A token without the marks around it."""
    while a < b and not (text[a].isalnum() or text[a] in "+("):
        a += 1
    while b > a and not text[b - 1].isalnum():
        b -= 1
    return a, b


def _shape(word: str, digits: str) -> list[int]:
    """The numbers of the features that hold."""
    n, letters = len(digits), sum(map(str.isalpha, word))
    on = [min(n, 20) // 4, 6 + min(len(word), 39) // 8]
    on += [11 + min(word.count("@"), 1), 13 + min(word.count("."), 3)]
    on += [k for k, holds in ((17, "-" in word), (18, word.startswith("+")), (19, "(" in word or ")" in word), (20, not letters), (21, letters > n), (22, 13 <= n <= 19 and luhn(digits)), (24, 13 <= n <= 19 and not luhn(digits)), (23, "@" in word and "." in word.partition("@")[2])) if holds]
    return on


class Graph:
    """Tokens of several documents as nodes, with their shapes, observed labels and edges."""

    def __init__(self, texts: list[str], found: list[list[Span]]):
        self.doc: list[int] = []
        self.span: list[tuple[int, int]] = []
        self.seen: list[int] = []
        shapes: list[list[int]] = []
        self.near: list[tuple[int, int]] = []
        self.skip: list[tuple[int, int, bool]] = []
        for d, text in enumerate(texts):
            like: dict[tuple[tuple[str, str], bool], list[int]] = {}
            by_start = sorted((a, b, k) for k, a, b in found[d])
            at, before = 0, -1
            for a, b in tokens(text):
                node = len(self.doc)
                label, i = 0, at
                while i < len(by_start) and by_start[i][0] < b:
                    if by_start[i][1] > a:
                        label = label or by_start[i][2] + 1
                    if by_start[i][1] <= b and i == at:
                        at += 1
                    i += 1
                x, y = _core(text, a, b)
                word = text[x:y]
                digits = _NOT_DIGIT.sub("", word)
                self.doc.append(d)
                self.span.append((x, y))
                self.seen.append(label)
                shapes.append(_shape(word, digits))
                if before >= 0 and not text[before:a].strip(_BLANKS):
                    self.near.append((node - 1, node))
                before = b
                for key in self._keys(word, digits):
                    like.setdefault(key, []).append(node)
            for (_, same), nodes in like.items():
                self.skip += ((i, j, same) for i, j in itertools.pairwise(nodes))
                known = next((k for k, i in enumerate(nodes) if self.seen[i]), None)
                if known is not None:
                    self.skip += ((nodes[known], j, same) for k, j in enumerate(nodes) if abs(k - known) > 1)
        self.shape = np.zeros((len(shapes), FEATURES), np.float64)
        for row, on in zip(self.shape, shapes, strict=True):
            row[on] = 1

    @staticmethod
    def _keys(word: str, digits: str) -> Iterator[tuple[tuple[str, str], bool]]:
        if len(word) >= 5:
            yield ("word", word.lower()), True
        if len(digits) >= 7 and 2 * len(digits) > len(word):
            yield ("digits", digits[-7:]), False
        box = word.partition("@")[0].lower()
        if "@" in word and len(box) >= 3:
            yield ("box", box), False


def _maximized(value_and_slope, w: np.ndarray, steps: int = 400) -> np.ndarray:
    """Weights of least penalized mean cost, by momentum steps of bounded size."""
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = value_and_slope(w)[1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def token_cost(w: np.ndarray, on: np.ndarray, label: np.ndarray, n: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cost of labels given shapes (with a constant as the last one), penalized, and its slope; ``w``: LABELS x shapes."""
    p = _normal(on @ w.T)
    rows = np.arange(len(label))
    off = p.copy()
    off[rows, label] -= 1
    cost = -(n * np.log(np.maximum(p[rows, label], 1e-300))).sum() / n.sum() + PENALTY / 2 * (w[:, :-1] ** 2).sum()
    return cost, (off * n[:, None]).T @ on / n.sum() + PENALTY * np.c_[w[:, :-1], np.zeros(LABELS)]


def pair_cost(w: np.ndarray, pairs: np.ndarray, bias: np.ndarray, forms: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean cost of each label given the other of a pair, penalized, and its slope.

    ``pairs``: counts, LABELS x LABELS; ``forms``: potentials that ``w`` weighs.
    """
    potential = np.tensordot(w, forms, 1)
    total = 2 * max(pairs.sum(), 1.0)
    right, down = _normal(potential + bias[None, :]), _normal((potential + bias[:, None]).T).T
    cost = -(pairs * (np.log(np.maximum(right, 1e-300)) + np.log(np.maximum(down, 1e-300)))).sum() / total
    off = (right * pairs.sum(1, keepdims=True) - pairs) + (down * pairs.sum(0, keepdims=True) - pairs)
    return cost + PENALTY / 2 * (w**2).sum(), np.tensordot(forms, off, 2) / total + PENALTY * w


class SkipChainCrf:
    """Log potentials: ``shape`` of a token (LABELS x shapes and a constant), ``near`` of neighbours, ``agree`` of tokens that
    are equal and of those that are alike.

    Trained from counts: ``masks`` (shapes as bits), ``labels`` and ``n`` of tokens; ``near`` and ``skips`` (equal, alike) of pairs.
    """

    def __init__(self, masks: np.ndarray, labels: np.ndarray, n: np.ndarray, near: np.ndarray, skips: np.ndarray):
        self.shape, self.near, self.agree = np.zeros((LABELS, FEATURES + 1)), np.zeros((LABELS, LABELS)), np.zeros(2)
        if not len(masks):
            return
        on = np.c_[(masks[:, None] >> np.arange(FEATURES)[None, :]) & 1, np.ones(len(masks))].astype(np.float64)
        self.shape = _maximized(lambda w: token_cost(w, on, labels, n), self.shape)
        bias = np.log((np.bincount(labels, n, LABELS) + 1) / (n.sum() + LABELS))
        each = np.eye(LABELS**2).reshape(-1, LABELS, LABELS)
        self.near = _maximized(lambda w: pair_cost(w, near, bias, each), np.zeros(LABELS**2)).reshape(LABELS, LABELS)
        self.agree = np.array([_maximized(lambda w, x=x: pair_cost(w, x, bias, np.eye(LABELS)[None]), np.zeros(1))[0] for x in skips])

    def own(self, g: Graph) -> np.ndarray:
        """Log potentials of each node alone; an observed label is certain."""
        own = g.shape @ self.shape[:, :-1].T + self.shape[:, -1]
        seen = np.array(g.seen, np.int64)
        own[seen > 0] = -50.0
        own[seen > 0, seen[seen > 0]] = 0.0
        return own - own.max(1, keepdims=True)

    def pairs(self, g: Graph) -> list[tuple[int, int, np.ndarray]]:
        """Edges with their log potentials; several between the same two nodes are one, so that they are no loop."""
        found: dict[tuple[int, int], np.ndarray] = {}
        for i, j in g.near:
            found[i, j] = self.near
        for i, j, exact in g.skip:
            at = (min(i, j), max(i, j))
            found[at] = found.get(at, 0.0) + np.eye(LABELS) * self.agree[0 if exact else 1]
        return [(i, j, p) for (i, j), p in found.items()]

    def beliefs(self, g: Graph) -> np.ndarray:
        """Each node's probability of each label after loopy message passing."""
        n, own, pairs = len(g.doc), self.own(g), self.pairs(g)
        if not pairs:
            return _normal(own)
        i, j = np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])
        potential = np.array([p[2] for p in pairs])
        # Message e goes i -> j, message E + e goes j -> i.
        source, target = np.r_[i, j], np.r_[j, i]
        potential = np.concatenate([potential, potential.transpose(0, 2, 1)])
        back = np.r_[np.arange(len(i)) + len(i), np.arange(len(i))]
        message = np.zeros((len(source), LABELS))
        for _ in range(ROUNDS):
            belief = own + _sums(message, target, n)
            out = belief[source] - message[back]
            new = out[:, :, None] + potential
            top = new.max(1, keepdims=True)
            new = np.log(np.exp(new - top).sum(1)) + top[:, 0]
            new -= new.max(1, keepdims=True)
            new = DAMPING * message + (1 - DAMPING) * new
            moved = np.abs(new - message).max()
            message = new
            if moved < SETTLED:
                break
        return _normal(own + _sums(message, target, n))


def _sums(message: np.ndarray, target: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(target, message[:, k], n) for k in range(LABELS)], 1)


def _normal(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def find(texts: list[str], crf: SkipChainCrf) -> list[tuple[list[Span], list[Span]]]:
    """Per text: the rules' spans, and those that the field adds, which overlap none of them."""
    base = [base_spans(t) if _HINT.search(t) else [] for t in texts]
    g = Graph(texts, base)
    added: list[list[Span]] = [[] for _ in texts]
    if g.doc:
        belief = crf.beliefs(g)
        kind = belief[:, 1:].argmax(1)
        linked = np.zeros(len(kind), bool)
        linked[[x for i, j, _ in g.skip for x in (i, j)]] = True  # tokens with a skip edge
        sure = (belief[np.arange(len(kind)), kind + 1] >= np.where(linked, SURE, SURE_ALONE)) & (np.array(g.seen) == 0)
        for node in np.flatnonzero(sure):
            (a, b), d = g.span[node], g.doc[node]
            if b > a and all(b <= x or a >= y for _, x, y in base[d]):
                added[d].append((int(kind[node]), a, b))
    return list(zip(base, added, strict=True))


def counts(g: Graph) -> Iterator[tuple[int, int, int]]:
    """(kind, key, label): kind 0 a token's shape and label; 1 neighbours, 2 equal and 3 like tokens, the key being the other label.

    A token without a label that is like one with a label counts nowhere.
    """
    seen = g.seen
    asked = {x for i, j, _ in g.skip for x, y in ((i, j), (j, i)) if seen[y] and not seen[x]}
    bits = (g.shape.astype(np.int64) << np.arange(FEATURES)).sum(1).tolist()
    yield from ((0, b, s) for k, (b, s) in enumerate(zip(bits, seen, strict=True)) if k not in asked)
    for kind, edges in ((1, g.near), (2, [(i, j) for i, j, exact in g.skip if exact]), (3, [(i, j) for i, j, exact in g.skip if not exact])):
        yield from ((kind, seen[i], seen[j]) for i, j in edges if i not in asked and j not in asked)


def _stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: Counter[tuple[int, int, int]] = Counter()
    for b in batches:
        texts = [t if t and _HINT.search(t) else "" for t in b.column("text").to_pylist()]
        for i, j in in_parts(texts):
            found.update(counts(Graph(texts[i:j], [base_spans(t) if t else [] for t in texts[i:j]])))
    if found:
        kind, key, label = zip(*found, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), pa.array(key, pa.int64()), pa.array(label, pa.int32()), pa.array(list(found.values()), pa.int64())], ["kind", "key", "label", "n"])


def train(docs: DataFrame, text_col: str = "text") -> SkipChainCrf:
    """The field's weights from counts over all documents.

    What reaches the driver is a row for each shape and pair of labels that occurs: shapes are 25 bits of few
    combinations, so some thousands at most, whatever the number of documents.  An empty table gives weights of zero.
    """
    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(_stats, "kind int, key long, label int, n long")
    got = rows.groupBy("kind", "key", "label").agg(F.sum("n").alias("n")).orderBy("kind", "key", "label").collect()
    pairs = np.zeros((3, LABELS, LABELS))
    for r in got:
        if r["kind"]:
            pairs[r["kind"] - 1, r["key"], r["label"]] += r["n"]
    tokens = [r for r in got if r["kind"] == 0]
    column = lambda c, t: np.array([r[c] for r in tokens], t)
    return SkipChainCrf(column("key", np.int64), column("label", np.int64), column("n", np.float64), pairs[0], pairs[1:])


_SPANS = "array<struct<kind:string,start:int,end:int>>"


def find_pii(docs: DataFrame, crf: SkipChainCrf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base, added for each row of ``docs``: arrays of (kind, start, end), in code points, end exclusive.

    Null texts count as empty and have no spans.  A text of any length is one document of the field; of labels with
    equal beliefs the first listed counts.  Repeated rows and null ids are kept; an empty table gives no rows; other
    columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def shown(spans: list[Span]) -> list[dict]:
            return [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in sorted(spans)]

        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            for i, j in in_parts(texts):
                got = find(texts[i:j], shared.value)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), pa.array([shown(b) for b, _ in got], kind), pa.array([shown(a) for _, a in got], kind)], ["doc_id", "base", "added"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {_SPANS}, added {_SPANS}")


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """n_email, n_ip, n_card, n_phone and base_sha256 are of the rules' spans; spans has those that the field adds too."""
    docs = table(spark, sf_dir, "documents")
    found = find_pii(docs, train(docs))
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    place = {k: i for i, k in enumerate(KINDS)}
    rank = lambda s: F.struct(F.element_at(F.create_map(*[x for k, i in place.items() for x in (F.lit(k), F.lit(i))]), s["kind"]).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.array_sort(F.transform(F.concat("base", "added"), rank))
    return found.select(
        "doc_id", *[F.size(F.expr(f"filter(base, s -> s.kind = '{k}')")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", one), ","), 256).alias("base_sha256"), F.array_join(F.transform(every, one), ",").alias("spans"),
    )
