"""Report tables from cells: sections, pivots, rendered values, numbered findings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

#: Section of a cell: the first that claims it.
SECTIONS = ("recall", "false positives", "canonical against raw", "clean against dressed", "area difference", "area", "single window", "census")


def section(df: DataFrame) -> DataFrame:
    """RPT-02: each cell's section; null if none claims it."""
    kind, method = F.col("kind"), F.col("method")
    claims = (
        (kind == "rate") & (F.col("family") == V.ATTACK),
        (kind == "rate") & (F.col("family") == V.BENIGN),
        (method == V.NEWCOMBE) & (F.col("contrast") == "canon_on_vs_off") & (F.col("population") == V.ALL_ITEMS),
        F.startswith("contrast", F.lit("clean_vs_")),
        method == V.DELTA_AUC_METHOD,
        kind == "auc",
        (method == V.NEWCOMBE) & (F.col("population") == V.SINGLE_WINDOW),
        kind == "count",
    )
    return df.withColumn("section", F.coalesce(*[F.when(c, F.lit(s)) for s, c in zip(SECTIONS, claims, strict=True)]))


def unclaimed(df: DataFrame) -> DataFrame:
    return section(df).where("section IS NULL")


def shown(df: DataFrame) -> DataFrame:
    """RPT-03: each cell as text with fixed places; a zero is never negative."""
    fixed = lambda c, n: F.format_string(f"%.{n}f", F.when(F.abs(c) < 0.5 * 10**-n, F.lit(0.0)).otherwise(c))
    signed = lambda c, n: F.format_string(f"%+.{n}f", F.when(F.abs(c) < 0.5 * 10**-n, F.lit(0.0)).otherwise(c))
    value, lo, hi = F.col("value"), F.col("lo"), F.col("hi")
    count = F.format_string("%d/%d", F.col("k"), F.col("n"))
    rate = F.concat(count, F.lit(" ("), fixed(value * 100, 2), F.lit("%)"))
    span = lambda n, by, f: F.concat(F.lit(" ["), f(lo * by, n), F.lit(", "), f(hi * by, n), F.lit("]"))
    auc = F.concat(fixed(value, 4), span(4, 1, fixed))
    points = F.concat(signed(value * 100, 2), F.lit(" pp"), span(2, 100, signed))
    area = F.concat(signed(value, 4), span(4, 1, signed))
    text = F.when(F.col("kind") == "rate", rate).when(F.col("kind") == "count", count).when(F.col("kind") == "auc", auc).when(F.col("method") == V.DELTA_AUC_METHOD, area).otherwise(points)
    return df.withColumn("shown", text)


def slot_problems(df: DataFrame, rows: list[str], column: str) -> DataFrame:
    """RPT-01's gate: slots of a table that two cells claim."""
    return df.groupBy(*rows, column).count().where("count > 1")


def pivoted(df: DataFrame, rows: list[str], column: str, values: list) -> DataFrame:
    """RPT-01: one row for each combination of ``rows``, one column for each of ``values``."""
    return df.groupBy(*rows).pivot(column, values).agg(F.first("shown"))


def numbered(findings: DataFrame) -> DataFrame:
    """RPT-04: findings in printed order with numbers; equal kinds share a group number."""
    order = [F.col(c).asc_nulls_first() for c in ("finding", "baseline_key", "chain", "benign_class", "family", "canon_on")]
    w = Window.partitionBy("all").orderBy(*order)
    kind = Window.partitionBy("all").orderBy("finding")
    df = findings.withColumn("all", F.lit(0))
    return df.withColumn("number", F.row_number().over(w)).withColumn("group", F.dense_rank().over(kind)).drop("all")


#: A cell's coordinate, and for each finding the coordinates that it names beside its own baseline, chain and class.
COORDINATE = ("kind", "baseline_key", "chain", "chain_class", "canon_on", "family", "benign_class", "contrast", "population")
_AREA = {"kind": "auc", "contrast": "attacks_vs_", "population": V.ALL_ITEMS}
_AREA_DELTA = {"kind": "delta", "contrast": "canon_on_vs_off", "population": V.ALL_ITEMS}
NAMED: dict[str, list[dict]] = {
    "saturation": [_AREA], "resolution": [_AREA], "bound_chain_definitional": [_AREA_DELTA],
    "sign_disagreement": [_AREA_DELTA, {**_AREA_DELTA, "family": V.ATTACK, "benign_class": None}],
    "rate_pinned": [{"kind": "rate", "contrast": None, "population": V.ALL_ITEMS, "canon_on": on} for on in (True, False)],
    "windows_matched_divergence": [{**_AREA_DELTA, "population": p} for p in (V.ALL_ITEMS, V.SINGLE_WINDOW)],
}


def named(findings: DataFrame) -> DataFrame:
    """Each finding with each cell coordinate that it names, as ``key``."""

    def key(given: dict) -> Column:
        types = {"canon_on": "boolean"}
        value = lambda c: F.col(c) if c not in given else F.concat(F.lit(given[c]), "benign_class") if given[c] == "attacks_vs_" else F.lit(given[c])
        return F.struct(*[value(c).cast(types.get(c, "string")).alias(c) for c in COORDINATE])

    keys = F.coalesce(*[F.when(F.col("finding") == k, F.array(*map(key, given))) for k, given in NAMED.items()])
    return findings.withColumn("key", F.explode(keys))


def anchored(findings: DataFrame, cells: DataFrame) -> DataFrame:
    """JOIN-20: for each coordinate that a finding names how many cells are there, null axes meeting null ones.

    One cell is an anchor; none or several are none.
    """
    keys = named(findings)
    there = cells.groupBy(*COORDINATE).agg(F.count("*").alias("cells"))
    same = reduce(lambda x, y: x & y, [F.col(f"key.{c}").eqNullSafe(there[c]) for c in COORDINATE])
    return keys.join(there.select(*[there[c] for c in COORDINATE], "cells"), same, "left").select(*[keys[c] for c in findings.columns], "key", F.coalesce("cells", F.lit(0)).alias("cells"))


def headlines(df: DataFrame) -> DataFrame:
    """RPT-05: the best and worst canonical recall of each baseline, by chain."""
    rates = df.where((F.col("kind") == "rate") & (F.col("family") == V.ATTACK) & F.col("canon_on"))
    best, worst = F.struct("value", "chain"), F.struct(-F.col("value"), F.col("chain"))
    return rates.groupBy("baseline_key").agg(F.max_by("chain", best).alias("best_chain"), F.max("value").alias("best"), F.max_by("chain", worst).alias("worst_chain"), F.min("value").alias("worst"))


def back_to_clean(df: DataFrame) -> DataFrame:
    """RPT-05: chains whose canonical recall is that of the clean chain, by baseline."""
    rates = df.where((F.col("kind") == "rate") & (F.col("family") == V.ATTACK) & F.col("canon_on"))
    clean = rates.where(F.col("chain") == V.CLEAN).select("baseline_key", F.col("k").alias("k0"), F.col("n").alias("n0"))
    return rates.where(F.col("chain") != V.CLEAN).join(clean, "baseline_key").groupBy("baseline_key").agg(F.count("*").alias("chains"), F.count_if((F.col("k") == F.col("k0")) & (F.col("n") == F.col("n0"))).alias("returned"))


def credits(items: DataFrame, sources: DataFrame) -> DataFrame:
    """SNK-08, JOIN-09: rows that each pinned source (source, licence) gave; unmatched rows under a null licence."""
    by = items.groupBy("source").agg(F.count("*").alias("rows"))
    met = by.join(sources, "source", "full_outer")
    return met.select("source", "licence", F.coalesce("rows", F.lit(0)).alias("rows"))
