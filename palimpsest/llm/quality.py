"""Quality scores by positive-unlabelled learning.

The classifier sees trusted positives and unlabelled web text, and no negatives.  With the share pi of positives
in such text, the risk on negatives is that on all unlabelled text less pi times that on positives; as this
difference can fall below zero only by overfitting, it is held at zero (the non-negative unbiased risk).
A logistic model on shape statistics of the whole text minimises it; its probability is the score.

The share pi is estimated from the same two samples: a model is fitted to tell positives from unlabelled rows on
one half of each, and on the other half the least ratio, over cuts of its score, of unlabelled to positive rows
above the cut is what positives can make up of the unlabelled ones at most.

Fitting uses a bounded sample: at most ``SAMPLE`` positives and ``SAMPLE`` unlabelled rows, chosen by a
hash of their ids.  Scoring covers every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import id_fold, table

#: Rows of each kind that the model is fitted on at most.
SAMPLE = 20_000
STEPS = 600
CUT = 0.3

_CLASSES = 8


def _byte_classes() -> np.ndarray:
    """Lower, upper, digit, blank, line end, sentence mark, other mark, beyond ASCII."""
    kind = np.full(256, 6, np.int8)
    kind[128:] = 7
    for letters, k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\x0b\x0c\r", 3), (b"\n", 4), (b".,;:?'\"-()", 5)):
        kind[list(letters)] = k
    return kind


_KIND = _byte_classes()


def features(text: str) -> np.ndarray:
    """Shape statistics of a whole text; an empty text has all zeros."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    if not words:
        return np.zeros(22)
    flat = np.frombuffer(raw, np.uint8)
    kind = _KIND[flat]
    share = np.bincount(kind, minlength=_CLASSES) / len(raw)
    n = len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lasts = np.frombuffer(b"".join([w[-1:] for w in words]), np.uint8)
    tail = _KIND[lasts]
    lines = [x for x in raw.split(b"\n") if x]
    again = sum(map(bytes.__eq__, words[1:], words[:-1]))
    marks = np.bincount(flat[kind == 6], minlength=256)
    return np.array([
        *share,
        np.log1p(n), lengths.mean(), lengths.std(), (lengths > 20).mean(),
        len(set(words)) / n, np.log(len(set(words)) + 1) / np.log(n + 2), again / max(1, n - 1),
        (tail == 6).mean(), (tail == 5).mean(), sum(w.isupper() for w in words) / n, (lengths == 1).mean(),
        len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), marks.max() / len(raw),
    ])


def _basis(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised features, their squares and a constant, all bounded."""
    z = np.clip((x - mean) / scale, -6, 6)
    return np.concatenate([z, z * z / 6, np.ones((len(z), 1))], 1)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risks(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> tuple[float, float]:
    """The risk on positives, and the unbiased one on negatives: log loss, a positive costs -log s, a negative -log (1 - s)."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    cost = lambda s: -np.log1p(-np.minimum(s, 1 - 1e-12)).mean()
    return prior * -np.log(np.maximum(sp, 1e-12)).mean(), cost(su) - prior * cost(sp)


def gradient(w: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float) -> np.ndarray:
    """Of both risks together; where the one on negatives is below zero, the step that raises it again."""
    sp, su = _sigmoid(p @ w), _sigmoid(u @ w)
    negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
    if risks(w, p, u, prior)[1] < 0:
        return -negative
    return prior * (p.T @ (sp - 1)) / len(p) + negative


def _descend(w: np.ndarray, slope, steps: int = STEPS) -> np.ndarray:
    m, v = np.zeros_like(w), np.zeros_like(w)
    for step in range(1, steps + 1):
        grad = slope(w) + 1e-3 * np.r_[w[:-1], 0]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - 0.03 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def mixture_share(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows, from scores of either: the ratio of those above a cut where it is surely least."""
    cuts = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    p, u = above(positive), above(unlabelled)
    doubt = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    best = np.argmin((u + doubt) / p)
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


class PuModel:
    """Logistic model with weights fitted by non-negative positive-unlabelled risk; ``prior`` None: estimated."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None = None):
        every = np.concatenate([positive, unlabelled])
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-6
        p, u = (_basis(x, self.mean, self.scale) for x in (positive, unlabelled))
        self.prior = self._prior(p, u) if prior is None else prior
        start = np.zeros(p.shape[1])
        start[-1] = np.log(self.prior / (1 - self.prior))
        self.weights = _descend(start, lambda w: gradient(w, p, u, self.prior))

    @staticmethod
    def _prior(p: np.ndarray, u: np.ndarray) -> float:
        if min(len(p), len(u)) < 2:
            return 0.5
        even, odd = (p[::2], u[::2]), (p[1::2], u[1::2])
        apart = lambda w: even[0].T @ (_sigmoid(even[0] @ w) - 1) / len(even[0]) + even[1].T @ _sigmoid(even[1] @ w) / len(even[1])
        w = _descend(np.zeros(p.shape[1]), apart, STEPS // 2)
        return mixture_share(odd[0] @ w, odd[1] @ w)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(_basis(x, self.mean, self.scale) @ self.weights, -30, 30)))


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        x = [features(t.as_py() or "").tolist() for t in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("kind"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "kind", "x"])


def train(docs: DataFrame, labels: DataFrame, learn, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> PuModel | None:
    """The model of positives (label 1) and unlabelled rows among ids that ``learn`` admits; None without either.

    Labels other than 1 are not learned from: they only keep their rows out of the unlabelled ones.  Each sample has
    at most ``sample`` ids, by a hash; of an id with several rows one is learned from, that of the least statistics,
    so at most that many rows reach the driver.  Null ids and null labels are not learned from; empty tables give None.
    """
    of = labels.where(learn(id_col) & F.col(label_col).isNotNull()).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("label"))
    rows = docs.where(learn(id_col)).select(F.col(id_col).alias("doc_id"))
    order = F.xxhash64(F.lit("pu"), F.col("doc_id"))
    positive = of.where("label = 1").select("doc_id").join(rows.distinct(), "doc_id", "left_semi").orderBy(order, "doc_id").limit(sample)
    marked = labels.select(F.col(id_col).alias("doc_id"))
    unlabelled = rows.distinct().join(marked, "doc_id", "left_anti").orderBy(order, "doc_id").limit(sample)
    chosen = positive.withColumn("kind", F.lit(1)).union(unlabelled.withColumn("kind", F.lit(0)))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    kind = docs.schema[id_col].dataType.simpleString()
    found = texts.select("doc_id", "kind", "text").mapInArrow(_featured, f"doc_id {kind}, kind int, x array<double>")
    got = found.groupBy("doc_id", "kind").agg(F.min("x").alias("x")).select("kind", "x").toPandas()
    x, kind = np.array(got["x"].tolist()), got["kind"].to_numpy()
    if not (kind == 1).any() or not (kind == 0).any():
        return None
    # A fixed order of rows makes sums, and so the weights, the same in every run.
    order = np.lexsort((*x.T, kind))
    x, kind = x[order], kind[order]
    return PuModel(x[kind == 1], x[kind == 0])


def score(docs: DataFrame, model: PuModel | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and score: the probability of label 1 for every whole text.

    Null texts count as empty, and empty ones are scored like any other; without a model every score is
    0.5.  Texts of any length are read whole; equal texts have equal scores.  Repeated rows are kept; an empty
    table gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.array([features(t.as_py() or "") for t in b.column("__text")])
                s = np.full(len(x), 0.5) if shared.value is None else shared.value.score(x)
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(s)], [*keep, "score"])

    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    return rows.mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a null id are neither learned from nor held out."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(id_fold("doc_id", 5) == 0, F.lit(False)))
    model = train(docs, table(spark, sf_dir, "labels"), lambda c: id_fold(c, 5) != 0)
    return score(docs, model, ["doc_id", "held_out"]).withColumn("predicted", F.when(F.col("score") >= CUT, 1).otherwise(0))
