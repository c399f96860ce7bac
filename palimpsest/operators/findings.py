"""Findings (limits of a set of cells) and the four verdicts, as queries over the cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import dressings as D
from palimpsest.functions import stats as S
from palimpsest.functions import vocabulary as V

COLUMN = ("baseline_key", "chain", "chain_class")
FINDING = ("finding", *COLUMN, "benign_class", "canon_on", "family", "x", "y", "limit")


def _finding(df: DataFrame, name: str, x, y, limit) -> DataFrame:
    pick = lambda c: F.col(c) if c in df.columns else F.lit(None)
    kinds = {"canon_on": "boolean"}
    axes = [pick(c).cast(kinds.get(c, "string")).alias(c) for c in FINDING[1:7]]
    return df.select(F.lit(name).alias("finding"), *axes, x.cast("double").alias("x"), y.cast("double").alias("y"), limit.cast("double").alias("limit"))


def saturation(cells: DataFrame) -> DataFrame:
    """FND-01: AUCs of which more than a twentieth of comparisons are ties."""
    share = F.col("tied") / F.col("pairs")
    return _finding(cells.where(F.col("kind") == "auc").where(share > V.TIE_SHARE), "saturation", F.col("tied"), F.col("pairs"), share)


def resolution(cells: DataFrame) -> DataFrame:
    """FND-02: what one benign item moves a rate by."""
    return _finding(cells.where("kind = 'auc'"), "resolution", F.col("n_neg"), F.col("n_pos"), 1 / F.col("n_neg"))


def rate_pinned(cells: DataFrame) -> DataFrame:
    """FND-03: rates at the same end under both conditions."""
    key = [*COLUMN, "family", "benign_class"]
    pick = lambda c, on: F.max(F.when(F.col("canon_on") == on, F.col(c)))
    two = cells.where("kind = 'rate'").groupBy(*key).agg(*[pick(c, on).alias(f"{c}_{int(on)}") for c in ("k", "n") for on in (True, False)])
    two = two.where("(k_0 = 0 AND k_1 = 0) OR (k_0 = n_0 AND k_1 = n_1)")
    return _finding(two, "rate_pinned", F.col("k_0"), F.col("k_1"), F.when(F.col("k_0") == 0, 0.0).otherwise(1.0))


def _canon(cells: DataFrame, method: str) -> DataFrame:
    """DIM-04."""
    return cells.where((F.col("contrast") == "canon_on_vs_off") & (F.col("method") == method))


def sign_disagreement(cells: DataFrame) -> DataFrame:
    """FND-04: an AUC difference and the recall difference of its column with opposite signs."""
    recall = _canon(cells, V.NEWCOMBE).where((F.col("family") == V.ATTACK) & (F.col("population") == V.ALL_ITEMS)).select(*COLUMN, F.col("value").alias("recall"))
    met = _canon(cells, V.DELTA_AUC_METHOD).join(recall, list(COLUMN)).where(F.signum("value") * F.signum("recall") < 0)
    return _finding(met, "sign_disagreement", F.col("value"), F.col("recall"), F.lit(0))


def bound_chain(cells: DataFrame) -> DataFrame:
    """FND-05: AUC differences on bound chains, which are what they are by definition."""
    return _finding(_canon(cells, V.DELTA_AUC_METHOD).where(F.col("chain_class") == V.BOUND), "bound_chain_definitional", F.col("value"), F.lit(None), F.lit(None))


def windows_matched(cells: DataFrame) -> DataFrame:
    """FND-06: differences that leave the single-window companion by more than its half-width."""
    key = [*COLUMN, "family", "benign_class"]
    pick = lambda c, p: F.max(F.when(F.col("population") == p, F.col(c)))
    two = _canon(cells, V.NEWCOMBE).groupBy(*key).agg(pick("value", V.ALL_ITEMS).alias("whole"), *[pick(c, V.SINGLE_WINDOW).alias(c) for c in ("value", "lo", "hi")])
    half = (F.col("hi") - F.col("lo")) / 2
    return _finding(two.where(F.abs(F.col("whole") - F.col("value")) > half), "windows_matched_divergence", F.col("whole"), F.col("value"), half)


def findings(cells: DataFrame) -> DataFrame:
    """FND-07."""
    return reduce(DataFrame.unionByName, [f(cells) for f in (saturation, resolution, rate_pinned, sign_disagreement, bound_chain, windows_matched)])


def _verdict(df: DataFrame, condition: str, evaluable, triggered, **computed) -> DataFrame:
    outcome = F.when(~evaluable, "not_evaluable").when(triggered, "triggered").otherwise("not_triggered")
    shown = F.to_json(F.struct(*[c.alias(k) for k, c in computed.items()]), {"ignoreNullFields": "false"})
    return df.select(F.lit(condition).alias("condition"), outcome.alias("outcome"), shown.alias("computed"))


def n1(cells: DataFrame, baseline: str, chain: str, benign_class: str) -> DataFrame:
    """JOIN-17: false positives cost more than recall gains, on the one declared cell."""
    here = _canon(cells, V.NEWCOMBE).where((F.col("population") == V.ALL_ITEMS) & (F.col("baseline_key") == baseline) & (F.col("chain") == chain))
    attack = F.col("family") == V.ATTACK
    benign = F.coalesce(F.col("benign_class") == benign_class, F.lit(False))
    pick = lambda cond, c: F.max(F.when(cond, F.col(c)))
    one = here.agg(*[pick(attack, c).alias(f"r_{c}") for c in ("value", "lo", "hi")], *[pick(benign, c).alias(f"f_{c}") for c in ("value", "lo", "hi")])
    value, lo, hi = S.mover(*[F.col(c) for c in ("f_value", "f_lo", "f_hi", "r_value", "r_lo", "r_hi")])
    there = F.col("r_value").isNotNull() & F.col("f_value").isNotNull()
    return _verdict(one, "N1", there, lo > 0, difference=F.round(value, 9), lo=F.round(lo, 9), hi=F.round(hi, 9))


def n2(cells: DataFrame) -> DataFrame:
    """No encoded bound chain lowers recall before canonicalization."""
    links = D.parse_chain(F.expr("substring(contrast, length('clean_vs_') + 1)"))
    pairs = cells.where(F.startswith("contrast", F.lit("clean_vs_")) & (F.col("family") == V.ATTACK) & ~F.col("canon_on") & (F.col("chain_class") == V.BOUND))
    one = pairs.where(D.encoding_depth(links) > 0).agg(F.count("*").alias("pairs"), F.count_if(F.col("lo") > 0).alias("degraded"), F.count_if(F.col("hi") < 0).alias("improved"))
    return _verdict(one, "N2", F.col("pairs") > 0, F.col("degraded") == 0, pairs=F.col("pairs"), degraded=F.col("degraded"), improved=F.col("improved"))


def n3(layer_p95: DataFrame, inference: DataFrame) -> DataFrame:
    """The layer's p95 against a share of the fastest baseline's and an absolute bound.  Columns: p95; baseline_key, p95."""
    fastest = inference.agg(F.min("p95").alias("fastest"), F.min_by("baseline_key", F.struct("p95", "baseline_key")).alias("baseline"))
    one = layer_p95.agg(F.max("p95").alias("layer")).crossJoin(fastest)
    ceiling = F.least(V.LAYER_SHARE * F.col("fastest"), F.lit(float(V.LAYER_CEILING_NS)))
    there = F.col("layer").isNotNull() & F.col("fastest").isNotNull()
    return _verdict(one, "N3", there, F.col("layer") > ceiling, layer=F.col("layer"), ceiling=ceiling, fastest=F.col("baseline"))


def n4(cells: DataFrame) -> DataFrame:
    """JOIN-18: recovery on bound chains, but on none that is held out or beyond the ceiling."""
    over = cells.where("census = 'ceiling_hit' AND k > 0").select(F.col("chain").alias("over")).distinct()
    links = D.parse_chain(F.col("chain"))
    gain = _canon(cells, V.NEWCOMBE).where((F.col("family") == V.ATTACK) & (F.col("population") == V.ALL_ITEMS))
    gain = gain.join(over, F.col("chain") == F.col("over"), "left")
    held = F.col("chain_class") == V.HELD_OUT
    side = F.when(held & (D.probes(links) == "none"), "excluded").when(held | F.col("over").isNotNull(), "general").when(D.encoding_depth(links) > 0, "bound")
    gain = gain.withColumn("side", side)
    n = lambda s, cond=F.lit(True): F.count_if((F.col("side") == s) & cond)
    one = gain.agg(n("general").alias("general"), n("bound").alias("bound"), n("general", F.col("lo") > 0).alias("reached"), n("bound", F.col("lo") > 0).alias("recovers"), n("excluded").alias("excluded"))
    names = ("general", "bound", "reached", "recovers", "excluded")
    return _verdict(one, "N4", (F.col("general") > 0) & (F.col("bound") > 0), (F.col("reached") == 0) & (F.col("recovers") > 0), **{c: F.col(c) for c in names})


def unevaluable(verdicts: DataFrame) -> DataFrame:
    """VRD-05: the verdicts that abort a run."""
    return verdicts.where("outcome = 'not_evaluable'").select("condition")
