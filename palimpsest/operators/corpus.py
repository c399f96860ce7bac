"""Building a labelled corpus: gates, overlap removal, draws, rendering and cross-checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palimpsest.functions import canon as K
from palimpsest.functions import dressings as D
from palimpsest.functions import text as T
from palimpsest.functions import vocabulary as V
from palimpsest.sources.shared import materialize


def withdraw(pool: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """FLT-01: ``pool`` (split, index, label, text) without the texts whose digests are withdrawn."""
    gone = withdrawals.select(F.col("digest").alias("gone")).distinct()
    return pool.withColumn("digest", T.digest(F.col("text"))).join(gone, F.col("digest") == F.col("gone"), "left_anti").drop("digest")


def withdrawal_problems(pool: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """FLT-01's gate: declared rows that the pool lacks, and rows of withdrawn texts that are not declared."""
    key = ["digest", "split", "index", "label"]
    there = pool.withColumn("digest", T.digest(F.col("text"))).join(withdrawals.select("digest").distinct(), "digest", "left_semi").select(*key)
    one = withdrawals.select(*key).withColumn("declared", F.lit(True))
    met = one.join(there.withColumn("observed", F.lit(True)), key, "full_outer")
    return met.where("declared IS NULL OR observed IS NULL").select(*key, F.when(F.col("declared").isNull(), "undeclared").otherwise("missing").alias("problem"))


def contradictions(pool: DataFrame) -> DataFrame:
    """FLT-03: non-empty texts under more than one label."""
    by = pool.where("text <> ''").groupBy("text").agg(F.countDistinct("label").alias("labels"), F.count("*").alias("rows"))
    return by.where("labels > 1").select("text", "labels", "rows")


def without_contradictions(pool: DataFrame) -> DataFrame:
    return pool.join(contradictions(pool).select("text"), "text", "left_anti")


def difference(declared: DataFrame, observed: DataFrame, column: str) -> DataFrame:
    """FLT-04: values on one side only, and the side."""
    a, b = declared.select(column).distinct(), observed.select(column).distinct()
    return a.exceptAll(b).withColumn("side", F.lit("declared")).union(b.exceptAll(a).withColumn("side", F.lit("observed")))


def overlap(first: DataFrame, second: DataFrame) -> DataFrame:
    """FLT-05: texts of both selections."""
    return first.select("text").intersect(second.select("text"))


def exclusion_index(sources: DataFrame) -> DataFrame:
    """FLT-06: normal form -> the sorted keys of the sources (source, text) that hold it."""
    normal = sources.select("source", T.normalized("text").alias("norm")).where("norm <> ''")
    return normal.groupBy("norm").agg(F.array_sort(F.collect_set("source")).alias("sources"))


def excluded(rows: DataFrame, index: DataFrame) -> DataFrame:
    """FLT-06: the rows that some source holds, with its keys."""
    return rows.withColumn("norm", T.normalized("text")).join(index, "norm").drop("norm")


def remaining(rows: DataFrame, index: DataFrame) -> DataFrame:
    """FLT-06: the rows that no source holds."""
    return rows.withColumn("norm", T.normalized("text")).join(index, "norm", "left_anti").drop("norm")


def exclusion_counts(removed: DataFrame) -> DataFrame:
    """FLT-06: rows matched by each source; a row of k sources counts k times."""
    return removed.select(F.explode("sources").alias("source")).groupBy("source").agg(F.count("*").alias("matched"))


def exclusion_outcomes(planned: DataFrame, loaded: DataFrame, counts: DataFrame) -> DataFrame:
    """FLT-07, JOIN-10: each planned source (source, required) with what it loaded and matched."""
    met = planned.join(loaded, "source", "left").join(counts, "source", "left")
    state = F.when(F.col("rows").isNotNull(), "loaded").when(F.col("required"), "missing").otherwise("unavailable")
    return met.select("source", "required", state.alias("state"), F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("matched", F.lit(0)).alias("matched"))


def first_of_each(rows: DataFrame, key: str, *order: str) -> DataFrame:
    """AGG-16: the first row of each value of ``key``."""
    w = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")


def draw_head(rows: DataFrame, n: int, by: str = "text") -> DataFrame:
    """SRT-01: distinct texts, the first ``n`` by text or by payload id."""
    key = F.col("text") if by == "text" else T.payload_id(F.col("text"))
    return rows.select("text").distinct().orderBy(key).limit(n)


def draw_seeded(rows: DataFrame, n: int, seed: int) -> DataFrame:
    """SRT-02: ``n`` distinct texts by a seeded hash, so the draw is the same for any partitioning.

    The order is that of sha256(seed : text), not of a Mersenne twister on one machine.
    """
    return rows.select("text").distinct().orderBy(seeded(seed, F.col("text")), "text").limit(n)


def seeded(seed: int | Column, text: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.sha2(F.concat(seed.cast("string"), F.lit(":"), text).cast("binary"), 256)


def draw_per_group(rows: DataFrame, group: str, cap: int, seed: int) -> DataFrame:
    """SRT-03: at most ``cap`` rows of each group, by a seeded hash of group and text."""
    order = F.sha2(F.concat_ws(":", F.lit(seed), F.col(group), F.col("text")).cast("binary"), 256)
    w = Window.partitionBy(group).orderBy(order, "text")
    return rows.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= cap).drop("__k")


def eligible(files: DataFrame, suffixes: tuple[str, ...], least: int, most: int) -> DataFrame:
    """FLT-08, FLT-09: files (path, text) of a suffix, in any case, and size whose canonicalization meets a run to decode.

    Path and size are tested first, so only files that pass are canonicalized.
    """
    suffix = F.lower(F.concat(F.lit("."), F.substring_index("path", ".", -1)))
    some = files.where(F.contains("path", F.lit(".")) & suffix.isin(*suffixes) & F.octet_length("text").between(least, most))
    met = some.withColumn("__stages", K.canonical_udf()("text")["stages"])
    return met.where(F.arrays_overlap("__stages", F.array(F.lit(V.DECODE), F.lit(V.DECODE_CEILING)))).drop("__stages")


def chain_table(spark) -> DataFrame:
    """All chains with class, depth and probes."""
    names = F.array(*[F.lit(D.chain_name(c)) for c in V.CHAINS])
    df = spark.range(1).select(F.explode(names).alias("chain")).withColumn("links", D.parse_chain(F.col("chain")))
    return df.select("chain", "links", D.chain_class(F.col("links")).alias("chain_class"), D.encoding_depth(F.col("links")).alias("depth"), D.probes(F.col("links")).alias("probes"))


def render(payloads: DataFrame, chains: tuple[tuple[str, ...], ...] = V.CHAINS) -> DataFrame:
    """REN-01, REN-02, JOIN-02: each payload in each chain.  ``payloads``: family, benign_class, source, label, text.

    One pass over the payloads makes all chains; nothing is joined, and each prefix of a chain is dressed once.
    """
    rows, named = D.with_prefixes(payloads.withColumn("payload_id", T.payload_id(F.col("text"))), chains)
    each = [F.struct(F.lit(D.chain_name(c)).alias("chain"), F.col(named[c]).alias("dressed")) for c in chains]
    rows = rows.withColumn("d", F.explode(F.array(*each)))
    return rows.select(
        D.item_id(F.col("payload_id"), F.col("d.chain")).alias("item_id"), "payload_id", "source", "family", "benign_class", "label", F.col("d.chain").alias("chain"), F.col("d.dressed").alias("text")
    )


def id_collisions(items: DataFrame) -> DataFrame:
    """JOIN-21: item ids of more than one text."""
    return items.groupBy("item_id").agg(F.countDistinct("text").alias("texts")).where("texts > 1")


def similar(sources: DataFrame, payloads: DataFrame, ratio: float = V.OVERLAP_RATIO, k: int = V.SHINGLE) -> DataFrame:
    """JOIN-08: sources (id, text) that hold a payload (payload_id, text), or ``ratio`` of its shingles.

    An inverted index finds pairs, and full sets of shingles confirm them.  A match lacks few of a payload's
    shingles, so it has one of the rarest of them, one more than it may lack: only these are looked up, and
    a shingle that all texts share brings nothing together unless a payload has no rarer ones.  Payloads of
    fewer than ``k`` tokens are found by runs of the lengths that occur among them, in the same way.

    The index holds hashes, and of the sources only those that some payload has, written once; a collision brings a pair
    together that is not confirmed.  Texts and their sets of shingles are read for such pairs alone.
    """
    source = sources.select("id", T.normalized("text").alias("norm")).select("id", T.tokens(F.col("norm")).alias("w"))
    wanted = payloads.select("payload_id", T.normalized("text").alias("norm")).select("payload_id", "norm", T.tokens(F.col("norm")).alias("w"))
    wanted = wanted.where(F.size("w") > 0)
    occur = [r["n"] for r in wanted.where(F.size("w") < k).select(F.size("w").alias("n")).distinct().collect()]  # fewer than k
    long = wanted.where(F.size("w") >= k).withColumn("s", T.shingles(F.col("w"), k))
    every = long.select("payload_id", F.size("s").alias("need"), F.explode(F.array_distinct(T.hashed_shingles(F.col("w"), k))).alias("h"))
    brief = wanted.where(F.size("w") < k)
    for n in sorted(occur):
        brief = brief.withColumn(f"h{n}", F.get(T.hashed_shingles(F.col("w"), n), F.lit(0)).alias("h"))
    brief = brief.select("payload_id", F.coalesce(*[F.when(F.size("w") == n, F.col(f"h{n}")) for n in sorted(occur)], F.lit(None).cast("long")).alias("h"))
    grams = F.array_distinct(F.concat(*[T.hashed_shingles(F.col("w"), n) for n in (*sorted(occur), k)]))
    sought = every.select("h").union(brief.select("h")).distinct()
    have = materialize(source.select("id", F.explode(grams).alias("h")).join(sought, "h", "left_semi"), "have")
    often = have.groupBy("h").agg(F.count("*").alias("often"))
    rarest = Window.partitionBy("payload_id").orderBy("often", "h")
    rare = every.join(often, "h", "left").withColumn("often", F.coalesce("often", F.lit(0))).withColumn("place", F.row_number().over(rarest))
    # With at least ceil(ratio * need) shared, at most need less that are lacking.
    rare = rare.where(F.col("place") <= F.col("need") - F.ceil(ratio * F.col("need") - 1e-9) + 1).where("often > 0").select("payload_id", "h")
    pairs = have.join(rare.union(brief), "h").select("id", "payload_id").distinct()
    met = pairs.join(wanted.select("payload_id", "norm", T.shingles(F.col("w"), k).alias("ps")), "payload_id").join(source, "id")
    shared = F.size(F.array_intersect("ps", T.shingles(F.col("w"), k))) / F.nullif(F.size("ps"), F.lit(0))
    found = met.withColumn("score", shared).where(F.col("score").isNull() | (F.col("score") >= ratio))
    holds = F.when(F.coalesce("score", F.lit(1.0)) == 1, T.contains_run(F.array_join("w", " "), F.col("norm"))).otherwise(F.lit(False))
    out = found.select("id", "payload_id", "score", F.when(holds, F.lit("contains")).otherwise(F.lit("shingles")).alias("kind"))
    return out.where("score IS NOT NULL OR kind = 'contains'")


def tally(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """AGG-20: rows before and after each gate."""
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(i).alias("step"), F.lit(name).alias("gate"), "rows") for i, (name, df) in enumerate(stages)]
    return reduce(DataFrame.union, counts)
