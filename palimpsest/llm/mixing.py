"""Mixing sources to target weights by Sainte-Lague apportionment.

The mix is dealt in blocks of equally many words.  Blocks go to sources by the highest quotients
target / (2 * seats + 1), then within a source to its shards by their sizes; a shard's documents, in a
seeded order, are one stream of words that is cut into blocks, and a quota of q for n blocks takes each
block q div n times and q mod n seeded ones once more.  Quotas are integers and sums of quotas are
exact, so no document is drawn by chance from another, and reruns agree.

Shards hold about SHARD_WORDS words whatever the source's size, so a source with a third of all rows
is as many small groups.  Tables with one row per source or shard are all that is apportioned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import WORD, materialize, table

BLOCK_WORDS = 16
SHARD_WORDS = 1 << 20
MOST_REPEATS = 3
WEIGHTS = (5, 2, 1)
#: Multipliers of the seeded order of blocks: primes, none of which divides a shard's number of blocks.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579, 2147483563, 2147483549, 2147483543, 2147483497)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = pc.fill_null(pc.cast(pc.count_substring_regex(b.column("text"), WORD), pa.int64()), 0)
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("source"), b.column("mix"), n], ["doc_id", "source", "mix", "size"])


def sainte_lague(parties: DataFrame, group: list[str], key: list[str], weight: str, seats: str, out: str) -> DataFrame:
    """Adds ``out``: the integer quota of each party; within a group quotas add up to ``seats``.

    Rounding seats * weight / total is off by a few seats at most; these are given to the highest next
    quotients or taken back from the lowest.  Each party enters as many quotients as it could win, which
    together are at most a few per party.  Groups of no weight get nothing.  Ties fall by ``key``.
    """
    g = Window.partitionBy(*group)
    df = parties.withColumn("_w", F.sum(weight).over(g)).withColumn("_n", F.count("*").over(g))
    share = F.when(F.col("_w") > 0, F.col(weight) / F.col("_w")).otherwise(F.lit(0.0))
    df = df.withColumn("_base", F.floor(F.col(seats) * share + 0.5).cast("long"))
    df = df.withColumn("_off", F.when(F.col("_w") > 0, F.col(seats) - F.sum("_base").over(g)).otherwise(F.lit(0)).cast("long"))
    most = F.floor((F.abs("_off") + F.col("_n")) * share).cast("long") + 2
    df = materialize(df.withColumn("_most", F.when(F.col("_off") < 0, F.least(most, F.col("_base"))).otherwise(most)), "rounded")
    steps = df.where("_off != 0 AND _most > 0").select(*group, *[k for k in key if k not in group], weight, "_base", "_off", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_most") - 1)).alias("_j"))
    gain = F.col("_off") > 0
    quotient = F.when(gain, -F.col(weight) / (2 * (F.col("_base") + F.col("_j")) + 1)).otherwise(F.col(weight) / (2 * (F.col("_base") - F.col("_j")) - 1))
    order = Window.partitionBy(*group).orderBy("_q", *key, "_j")
    steps = steps.withColumn("_q", quotient).withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= F.abs("_off"))
    on = list(dict.fromkeys([*group, *key]))
    moved = steps.groupBy(*on).agg(F.sum(F.signum(F.col("_off"))).cast("long").alias("_moved"))
    df = df.join(moved, on, "left").withColumn(out, F.col("_base") + F.coalesce("_moved", F.lit(0)))
    return df.drop("_w", "_n", "_base", "_off", "_most", "_moved")


def _targets(sources: DataFrame) -> DataFrame:
    """Adds weight and target to rank, source, source_size: shares by weight, at most 3 times a source.

    In the order of size / weight a source is capped if it stays below the level that the sources
    before it leave; the level then is right for all the others.
    """
    every = Window.partitionBy("every")
    before = every.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    cap = MOST_REPEATS * F.col("source_size")
    none = F.lit(0).cast("long")
    df = sources.withColumn("every", F.lit(0)).withColumn("rank", F.row_number().over(every.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("rank") % len(WEIGHTS) + 1).cast("int"))
    df = df.withColumn("weight", weight).withColumn("total", F.sum("source_size").over(every))
    df = df.withColumn("_left", F.col("total") - F.coalesce(F.sum(cap).over(before), none))
    df = df.withColumn("_open", F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), none))
    df = df.withColumn("capped", cap * F.col("_open") < F.col("_left") * F.col("weight"))
    left = F.col("total") - F.sum(F.when(F.col("capped"), cap).otherwise(none)).over(every)
    rest = F.sum(F.when(F.col("capped"), none).otherwise(F.col("weight"))).over(every)
    return df.withColumn("target", F.when(F.col("capped"), cap.cast("double")).otherwise(left * F.col("weight") / rest)).drop("_left", "_open")


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 11,
    block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """doc_id, source, size, source_size, target, taken for each row of ``docs``.

    Null and empty texts have size 0 and take nothing; a null source is a source of its own, the last.
    Repeated rows count as often as they occur.  Ties in quotients fall by rank of source and shard, ties in the seeded
    order of documents by id and size.  A long text is one part of its shard's stream, in memory a number for each of
    its blocks.  An empty table gives no rows; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("mix"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = materialize(rows.mapInArrow(_word_counts, f"doc_id {kind}, source string, mix long, size long"), "sizes")

    sources = _targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    sources = sources.withColumn("blocks", F.floor(F.col("total") / block_words + 0.5).cast("long"))
    sources = sainte_lague(sources, ["every"], ["rank"], "target", "blocks", "quota")
    sources = sources.withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1)).cast("long"))
    sources = materialize(sources.select("source", "rank", "source_size", "target", "quota", "shards"), "sources")

    of = sources.withColumnRenamed("source", "its")
    member = rows.join(of, F.col("source").eqNullSafe(F.col("its"))).withColumn("shard", F.pmod("mix", F.col("shards")))
    shards = member.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shards = sainte_lague(shards, ["rank"], ["shard"], "shard_size", "quota", "q")
    shards = shards.select(
        "rank", "shard", F.greatest(F.ceil(F.col("shard_size") / block_words), F.lit(1)).cast("long").alias("n"), "q",
        F.element_at(F.array(*[F.lit(p).cast("long") for p in PRIMES]), (F.pmod(F.xxhash64(F.lit(seed), "rank", "shard"), F.lit(len(PRIMES))) + 1).cast("int")).alias("a"),
        F.pmod(F.xxhash64(F.lit(seed + 1), "rank", "shard"), F.lit(1 << 30)).alias("b"),
    )
    stream = Window.partitionBy("rank", "shard").orderBy("mix", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = member.withColumn("end", F.sum("size").over(stream)).withColumn("start", F.col("end") - F.col("size")).join(shards, ["rank", "shard"])
    taken = F.expr(f"""
        aggregate(sequence(start div {block_words}, (end - 1) div {block_words}), 0L, (acc, j) -> acc
          + (least(end, (j + 1) * {block_words}) - greatest(start, j * {block_words}))
          * least({MOST_REPEATS}L, q div n + if(pmod(a * j + b, n) < q % n, 1L, 0L)))
    """)
    return placed.select("doc_id", "source", "size", "source_size", "target", F.when(F.col("size") > 0, taken).otherwise(F.lit(0).cast("long")).alias("taken"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
