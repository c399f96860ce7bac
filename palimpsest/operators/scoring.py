"""Scoring items under baselines and conditions, and checking what shards bring back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import canon as K
from palimpsest.functions import text as T
from palimpsest.functions import vocabulary as V

KEY = ("item_id", "baseline_key", "condition")
#: Baselines of the digest scorer: key, threshold and characters of a window.
BASELINES = (("digest-a", 0.5, 64), ("digest-b", 0.25, 128))


def baseline_table(spark, baselines=BASELINES) -> DataFrame:
    rows = [F.struct(F.lit(k).alias("baseline_key"), F.lit(t).alias("threshold"), F.lit(w).alias("window")) for k, t, w in baselines]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("b")).select("b.*")


def digest_score(key: Column, text: Column) -> Column:
    """MDL-07: 52 bits of a digest of baseline and text, as a number in [0, 1)."""
    hexed = F.left(F.sha2(F.concat(key, F.lit("\x1f"), text).cast("binary"), 256), F.lit(13))
    return F.conv(hexed, 16, 10).cast("long") / F.lit(float(1 << 52))


def conditioned(items: DataFrame, ceiling: int = V.CEILING) -> DataFrame:
    """Each item raw and canonical: condition, seen, and of the canonicalizer the depth and whether it hit its ceiling.

    Items are canonicalized once, before baselines fan out; items that bring a column ``canonical`` are not again.
    """
    rows = items.withColumnRenamed("canonical", "c") if "canonical" in items.columns else items.withColumn("c", K.canonical_udf(ceiling)("text"))
    two = F.array(
        F.struct(F.lit(V.RAW).alias("condition"), F.col("text").alias("seen"), F.lit(None).cast("int").alias("max_depth_reached"), F.lit(None).cast("boolean").alias("ceiling_hit")),
        F.struct(F.lit(V.CANONICAL).alias("condition"), F.col("c.text").alias("seen"), F.col("c.max_depth_reached").alias("max_depth_reached"), F.col("c.ceiling_hit").alias("ceiling_hit")),
    )
    return rows.withColumn("c", F.explode(two)).select("*", "c.*").drop("c")


def demanded(items: DataFrame, baselines: DataFrame) -> DataFrame:
    """JOIN-01: every key that a run owes.  Baselines are a declared handful."""
    both = F.explode(F.array(F.lit(V.RAW), F.lit(V.CANONICAL)))
    return items.select("item_id").crossJoin(F.broadcast(baselines.select("baseline_key"))).withColumn("condition", both)


def score_items(items: DataFrame, baselines: DataFrame, ceiling: int = V.CEILING) -> DataFrame:
    """P3 with the digest scorer: one row of scores per item, baseline and condition."""
    rows = conditioned(items, ceiling).crossJoin(F.broadcast(baselines))
    return rows.select(
        "item_id", "family", "benign_class", "label", "baseline_key", "condition",
        digest_score(F.col("baseline_key"), F.col("seen")).alias("p_injection"),
        (1 + F.floor(F.length("seen") / F.col("window"))).cast("int").alias("n_windows"), "max_depth_reached", "ceiling_hit",
    )


def shard_of(n: int) -> Column:
    """SRT-06: the shard of a score key, by a digest of its JSON."""
    key = F.concat(F.lit('["'), F.concat_ws('","', *KEY), F.lit('"]'))
    return (F.conv(F.left(T.digest(key), F.lit(8)), 16, 10).cast("long") % n).cast("int")


def owed(demand: DataFrame, done: DataFrame) -> DataFrame:
    """The keys of a resumed run that no shard has yet."""
    return demand.join(done.select(*KEY), list(KEY), "left_anti")


def coverage_problems(demand: DataFrame, carried: DataFrame, shards: int) -> DataFrame:
    """JOIN-13: keys that are missing, unexpected, in more than one row, or in the wrong ``shard``."""
    have = carried.groupBy(*KEY).agg(F.count("*").alias("n"), F.max(F.when(F.col("shard") != shard_of(shards), 1).otherwise(0)).alias("off"))
    met = demand.select(*KEY).distinct().withColumn("wanted", F.lit(True)).join(have, list(KEY), "full_outer")
    found = F.array_compact(F.array(
        F.when(F.col("n").isNull(), F.lit("missing")), F.when(F.col("wanted").isNull(), F.lit("unexpected")),
        F.when(F.col("n") > 1, F.lit("duplicated")), F.when(F.col("off") > 0, F.lit("misplaced")),
    ))
    return met.select(*KEY, F.explode(found).alias("problem"))


def agreement_problems(carried: DataFrame) -> DataFrame:
    """JOIN-14: keys whose rows differ."""
    rest = [c for c in carried.columns if c not in (*KEY, "shard")]
    one = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    return carried.groupBy(*KEY).agg(F.countDistinct(one).alias("records")).where("records > 1")


def path_problems(headers: DataFrame, declared: DataFrame) -> DataFrame:
    """JOIN-15: baselines whose shards ran on other paths than declared, or on several."""
    seen = headers.groupBy("baseline_key").agg(F.array_sort(F.collect_set("path")).alias("paths"))
    met = seen.join(declared.select("baseline_key", F.col("path").alias("declared")), "baseline_key", "left")
    return met.where((F.size("paths") > 1) | F.col("declared").isNull() | (F.col("paths")[0] != F.col("declared")))


def smoke_sample(items: DataFrame, k: int) -> DataFrame:
    """The first ``k`` items of each family, class and chain by id: the sampling operator of short runs."""
    from pyspark.sql import Window

    w = Window.partitionBy("family", "benign_class", "chain").orderBy("item_id")
    return items.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= k).drop("__k")


def reduce_windows(scores: DataFrame) -> DataFrame:
    """MDL-04, AGG-19: item and window scores to the highest score and the number of windows."""
    return scores.groupBy("item_id").agg(F.max("p").alias("p_injection"), F.count("*").alias("n_windows"))


def with_model(open_model: Callable[[], Callable[[list[str]], list[float]]], rows: DataFrame, batch: int = 8) -> DataFrame:
    """MDL-06: ``rows`` (item_id, text) scored by a model that each worker opens once, in small batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = open_model()
        for b in batches:
            texts = [t or "" for t in b.column("text").to_pylist()]
            p = [x for i in range(0, len(texts), batch) for x in model(texts[i : i + batch])]
            yield pa.RecordBatch.from_arrays([b.column("item_id"), pa.array(p, pa.float64())], ["item_id", "p"])

    return rows.select("item_id", "text").mapInArrow(run, "item_id string, p double")
