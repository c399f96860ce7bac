"""Cells: rates, censuses, AUCs and paired differences of a scores table.

All producers read one keyed table.  ``score`` rows meet only on keys, and AUCs come from window ranks, so
nothing compares every attack with every benign item.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import dressings as D
from palimpsest.functions import stats as S
from palimpsest.functions import vocabulary as V
from palimpsest.sources.shared import materialize

AXES = ("baseline_key", "chain", "chain_class", "canon_on", "family", "benign_class")
COLUMNS = (
    "kind", *AXES, "contrast", "population", "census", "k", "n", "value", "lo", "hi", "method", "n_pos", "n_neg", "tied", "pairs",
)


def keyed(scores: DataFrame, baselines: DataFrame) -> DataFrame:
    """JOIN-11: each score with its cell's axes and whether it is a detection (MDL-08); an undeclared baseline is an error."""
    parsed = D.parse_item_id(F.col("item_id"))
    rows = scores.withColumn("parsed", parsed).join(F.broadcast(baselines.select("baseline_key", "threshold")), "baseline_key", "left")
    undeclared = F.raise_error(F.concat(F.lit("no baseline is declared as "), F.coalesce("baseline_key", F.lit("null")))).cast("double")
    rows = rows.withColumn("threshold", F.when(F.col("threshold").isNull(), undeclared).otherwise(F.col("threshold")))
    return rows.select(
        "baseline_key", F.col("parsed.chain").alias("chain"), D.chain_class(D.parse_chain(F.col("parsed.chain"))).alias("chain_class"),
        (F.col("condition") == V.CANONICAL).alias("canon_on"), "family", "benign_class", F.col("parsed.payload_id").alias("payload_id"), "item_id",
        "p_injection", (F.col("p_injection") >= F.col("threshold")).alias("detected"), "n_windows", "ceiling_hit",
    )


def _count(c: Column) -> Column:
    return F.count_if(c)


def _cells(df: DataFrame, kind: str, **given: Column) -> DataFrame:
    types = {"k": "long", "n": "long", "value": "double", "lo": "double", "hi": "double", "n_pos": "long", "n_neg": "long", "tied": "long", "pairs": "long", "canon_on": "boolean"}
    given = {"kind": F.lit(kind), "population": F.lit(V.ALL_ITEMS), **given}
    pick = lambda c: given[c] if c in given else F.col(c) if c in df.columns else F.lit(None)
    return df.select(*[pick(c).cast(types.get(c, "string")).alias(c) for c in COLUMNS])


def rate_cells(rows: DataFrame) -> DataFrame:
    """AGG-02, AGG-03: recall of attacks and the false-positive rate of each benign class."""
    by = rows.groupBy(*AXES).agg(_count(F.col("detected")).alias("k"), F.count("*").alias("n"))
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return _cells(by.withColumn("lo", lo).withColumn("hi", hi), "rate", value=F.col("k") / F.col("n"), method=F.lit(V.WILSON))


def census_cells(rows: DataFrame) -> DataFrame:
    """AGG-04, AGG-05: documents at the ceiling (canonical only) and of more than one window."""
    by = rows.groupBy(*AXES).agg(_count(F.col("ceiling_hit")).alias("hits"), _count(F.col("n_windows") > 1).alias("wide"), F.count("*").alias("n"))
    two = F.array(
        F.struct(F.lit("ceiling_hit").alias("census"), F.when(F.col("canon_on"), F.col("hits")).alias("k")),
        F.struct(F.lit("window_overflow").alias("census"), F.col("wide").alias("k")),
    )
    return _cells(by.withColumn("c", F.explode(two)).select("*", "c.census", "c.k").where("k IS NOT NULL"), "count")


def census_problems(rows: DataFrame) -> DataFrame:
    """AGG-04's gate: canonical rows without a ceiling flag, and raw rows with one."""
    return rows.where(F.col("canon_on") == F.col("ceiling_hit").isNull()).select("item_id", "baseline_key", "canon_on")


def edit_census_cells(rows: DataFrame, traces: DataFrame) -> DataFrame:
    """AGG-06, JOIN-12: documents that each stage edited.  ``traces``: item_id, stages."""
    on = rows.where("canon_on").join(traces, "item_id", "left")
    sums = [_count(F.array_contains("stages", s)).alias(s) for s in V.STAGES]
    by = on.groupBy(*AXES).agg(*sums, F.count("*").alias("n"))
    each = F.array(*[F.struct(F.lit(f"edits:{s}").alias("census"), F.col(s).alias("k")) for s in V.STAGES])
    return _cells(by.withColumn("c", F.explode(each)).select("*", "c.census", "c.k"), "count")


def _sides(rows: DataFrame) -> DataFrame:
    """Attacks once for each benign class, and that class's items: ``against``, ``positive``."""
    classes = F.array(*map(F.lit, V.BENIGN_CLASSES))
    against = F.when(F.col("family") == V.ATTACK, classes).otherwise(F.array("benign_class"))
    return rows.withColumn("against", F.explode(against)).withColumn("positive", (F.col("family") == V.ATTACK).cast("int"))


_AUC_KEY = ("baseline_key", "chain", "chain_class", "canon_on", "against")


def _components(rows: DataFrame) -> DataFrame:
    """Each item's structural component, from counts of the other side below and beside it.

    Distinct scores are dealt by ranges of (cell, score), so a cell is many tasks: sums run within a range, and the
    sums of the ranges before, of which there are as many as tasks and cells, are added by a join.
    """
    by = _sides(rows).groupBy(*_AUC_KEY, "p_injection").agg(F.sum("positive").alias("pos"), F.sum(1 - F.col("positive")).alias("neg"))
    tasks = int(by.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = materialize(by.repartitionByRange(tasks, *_AUC_KEY, "p_injection").withColumn("range", F.spark_partition_id()), "ranges")
    total = by.groupBy(*_AUC_KEY, "range").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cell = Window.partitionBy(*_AUC_KEY)
    before = cell.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offset = total.select(
        *_AUC_KEY, "range", F.sum("pos").over(cell).alias("n_pos"), F.sum("neg").over(cell).alias("n_neg"),
        *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("pos", "neg")],
    )
    below = Window.partitionBy(*_AUC_KEY, "range").orderBy("p_injection").rowsBetween(Window.unboundedPreceding, -1)
    by = by.join(offset, [*_AUC_KEY, "range"])
    under = lambda c: F.col(f"{c}_before") + F.coalesce(F.sum(c).over(below), F.lit(0))
    v10 = (under("neg") + F.col("neg") / 2) / F.col("n_neg")
    v01 = (F.col("n_pos") - under("pos") - F.col("pos") / 2) / F.col("n_pos")
    return by.where("n_pos > 1 AND n_neg > 1").withColumn("v10", v10).withColumn("v01", v01)


def _moment(value: str, times: str, power: int = 1) -> Column:
    return F.sum(F.col(times) * F.pow(F.col(value), power))


def auc_table(rows: DataFrame) -> DataFrame:
    """AGG-07 for each cell: AUC, variance, ties."""
    by = _components(rows).groupBy(*_AUC_KEY).agg(
        F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"), F.sum(F.col("pos") * F.col("neg")).alias("tied"),
        _moment("v10", "pos").alias("s10"), _moment("v10", "pos", 2).alias("q10"), _moment("v01", "neg").alias("s01"), _moment("v01", "neg", 2).alias("q01"),
    )
    var = lambda q, s, n: F.greatest((F.col(q) - F.col(s) * F.col(s) / F.col(n)) / (F.col(n) - 1), F.lit(0.0))
    by = by.withColumn("auc", F.col("s10") / F.col("n_pos")).withColumn("pairs", F.col("n_pos") * F.col("n_neg"))
    return by.withColumn("variance", var("q10", "s10", "n_pos") / F.col("n_pos") + var("q01", "s01", "n_neg") / F.col("n_neg"))


def auc_cells(rows: DataFrame) -> DataFrame:
    """JOIN-06: rank separation of attacks from one benign class."""
    half = S.Z * F.sqrt("variance")
    return _cells(
        auc_table(rows), "auc", benign_class=F.col("against"), contrast=F.concat(F.lit("attacks_vs_"), "against"), value=F.col("auc"),
        lo=F.greatest(F.lit(0.0), F.col("auc") - half), hi=F.least(F.lit(1.0), F.col("auc") + half), method=F.lit(V.AUC_METHOD),
    )


def auc_delta_cells(rows: DataFrame) -> DataFrame:
    """AGG-08, JOIN-07: canonical minus raw AUC, paired by item.

    The variance of items' differences is that of both sides less twice their covariance, and is exactly
    zero where the two conditions agree.
    """
    part = _components(rows).select(*_AUC_KEY, "p_injection", "v10", "v01", "n_pos", "n_neg")
    item = _sides(rows).select(*_AUC_KEY, "p_injection", "positive", "item_id").join(part, [*_AUC_KEY, "p_injection"])
    item = item.withColumn("v", F.when(F.col("positive") == 1, F.col("v10")).otherwise(F.col("v01")))
    key = [c for c in _AUC_KEY if c != "canon_on"]
    two = item.groupBy(*key, "positive", "item_id").agg(F.max(F.when(F.col("canon_on"), F.col("v"))).alias("on"), F.max(F.when(~F.col("canon_on"), F.col("v"))).alias("off"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    two = two.where("on IS NOT NULL AND off IS NOT NULL")
    side = two.groupBy(*key, "positive").agg(F.count("*").alias("n"), F.avg("on").alias("on"), F.avg("off").alias("off"), F.var_samp(F.col("on") - F.col("off")).alias("v"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    by = side.groupBy(*key).agg(F.sum(F.col("v") / F.col("n")).alias("variance"), F.max(F.when(F.col("positive") == 1, F.col("on") - F.col("off"))).alias("value"), F.max("n_pos").alias("n_pos"), F.max("n_neg").alias("n_neg"))
    half = S.Z * F.sqrt(F.greatest("variance", F.lit(0.0)))
    return _cells(by, "delta", benign_class=F.col("against"), contrast=F.lit("canon_on_vs_off"), lo=F.col("value") - half, hi=F.col("value") + half, method=F.lit(V.DELTA_AUC_METHOD))


def _paired(df: DataFrame, key: list[str], first: str, second: str) -> DataFrame:
    """AGG-13: the 2 x 2 table of two detections, and Newcombe's interval."""
    x, y = F.col(first), F.col(second)
    by = df.groupBy(*key).agg(_count(x & y).alias("a"), _count(x & ~y).alias("b"), _count(~x & y).alias("c"), _count(~x & ~y).alias("d"))
    theta, lo, hi = S.newcombe(*map(F.col, "abcd"))
    return by.withColumn("value", theta).withColumn("lo", lo).withColumn("hi", hi).withColumn("n", F.col("a") + F.col("b") + F.col("c") + F.col("d"))


_ITEM_KEY = ("baseline_key", "chain", "chain_class", "family", "benign_class", "item_id")


def _conditions(rows: DataFrame) -> DataFrame:
    """JOIN-03: one row per item with both conditions; grouping meets them without a join."""
    pick = lambda c, on: F.max(F.when(F.col("canon_on") == on, F.col(c)))
    return rows.groupBy(*_ITEM_KEY).agg(
        pick("detected", True).alias("on"), pick("detected", False).alias("off"), pick("n_windows", True).alias("w_on"), pick("n_windows", False).alias("w_off"), F.count("*").alias("rows")
    )


def unpaired_items(rows: DataFrame) -> DataFrame:
    """JOIN-03's gate: items that one condition lacks, or that occur more than once in one."""
    return _conditions(rows).where("on IS NULL OR off IS NULL OR rows <> 2").select(*_ITEM_KEY)


def canon_delta_cells(rows: DataFrame, single_window: bool = False) -> DataFrame:
    """JOIN-03, JOIN-04: canonical against raw on the same items; on those of one window in both, if asked for."""
    two = _conditions(rows).where("on IS NOT NULL AND off IS NOT NULL")
    if single_window:
        two = two.where("w_on = 1 AND w_off = 1")
    population = F.lit(V.SINGLE_WINDOW if single_window else V.ALL_ITEMS)
    return _cells(_paired(two, list(_ITEM_KEY[:-1]), "on", "off"), "delta", contrast=F.lit("canon_on_vs_off"), population=population, method=F.lit(V.NEWCOMBE))


def chain_delta_cells(rows: DataFrame) -> DataFrame:
    """JOIN-05: clean against dressed, paired by payload; only payloads on both sides count."""
    key = ["baseline_key", "canon_on", "family", "benign_class", "payload_id"]
    clean = rows.where(F.col("chain") == V.CLEAN).select(*key, F.col("detected").alias("clean"))
    clean = clean.withColumn("benign_class", F.coalesce("benign_class", F.lit("")))
    dressed = rows.where(F.col("chain") != V.CLEAN).withColumn("benign_class", F.coalesce("benign_class", F.lit("")))
    by = _paired(dressed.join(clean, key), ["baseline_key", "canon_on", "family", "benign_class", "chain", "chain_class"], "clean", "detected")
    by = by.withColumn("contrast", F.concat(F.lit("clean_vs_"), "chain")).withColumn("benign_class", F.nullif("benign_class", F.lit("")))
    # A held-out chain against the clean one, which is bound, spans both axes.
    straddles = F.when(F.col("chain_class") == V.BOUND, F.col("chain_class"))
    return _cells(by.withColumn("chain_class", straddles), "delta", chain=F.lit(None), method=F.lit(V.NEWCOMBE))


def cells(rows: DataFrame, traces: DataFrame | None = None) -> DataFrame:
    """AGG-21: every cell that a scores table supports."""
    parts = [rate_cells(rows), census_cells(rows), auc_cells(rows), canon_delta_cells(rows), chain_delta_cells(rows), auc_delta_cells(rows), canon_delta_cells(rows, True)]
    if traces is not None:
        parts.append(edit_census_cells(rows, traces))
    return reduce(DataFrame.unionByName, parts)


def ordered(df: DataFrame) -> DataFrame:
    """SRT-07."""
    return df.orderBy("kind", *AXES, "contrast", "population", "census")


def pooling_problems(df: DataFrame) -> DataFrame:
    """AGG-12: cells that pool benign classes or chain classes without a contrast that spans them."""
    pooled = (F.col("family") == V.BENIGN) & F.col("benign_class").isNull()
    mixed = F.col("chain_class").isNull() & ~F.coalesce(F.startswith("contrast", F.lit("clean_vs_")), F.lit(False))
    return df.where(pooled | mixed).select("kind", *AXES, "contrast")


def completeness_problems(df: DataFrame, baselines: DataFrame, chains: DataFrame) -> DataFrame:
    """JOIN-19: rate cells of the required grid that are not there."""
    kinds = [(V.ATTACK, None), *[(V.BENIGN, c) for c in V.BENIGN_CLASSES]]
    rows = [F.struct(F.lit(f).alias("family"), F.lit(c).cast("string").alias("benign_class"), F.lit(on).alias("canon_on")) for f, c in kinds for on in (True, False)]
    grid = baselines.select("baseline_key").crossJoin(chains.select("chain")).withColumn("g", F.explode(F.array(*rows))).select("baseline_key", "chain", "g.*").alias("g")
    have = df.where("kind = 'rate'").alias("h")
    same = reduce(lambda x, y: x & y, [F.col(f"g.{c}").eqNullSafe(F.col(f"h.{c}")) for c in ("baseline_key", "chain", "canon_on", "family", "benign_class")])
    return grid.join(have, same, "left_anti")
