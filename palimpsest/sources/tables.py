"""Where the measurement's inputs come from on the standard tables.

Labelled documents are the pool (toxic: attack; others: code-like benign), user turns of conversations
are the chat-like benign class, and benchmark texts are what must not overlap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-05: split (the language), index, label, source, text of labelled documents."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id")
    return rows.select(F.col("lang").alias("split"), F.col("doc_id").alias("index"), F.col("toxic").alias("label"), "source", "text")


def chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC-09: distinct non-empty user turns."""
    return table(spark, sf_dir, "conversations").where("role = 'user' AND text <> ''").select("text").distinct()


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of exactly one family and class, each once, with the first source by name."""
    of = lambda df, family, kind, label: df.select("text", F.lit(family).alias("family"), F.lit(kind).cast("string").alias("benign_class"), F.lit(label).alias("label"), "source")
    rows = pool(spark, sf_dir).where("text <> ''")
    every = of(rows.where("label = 1"), V.ATTACK, None, 1).union(of(rows.where("label = 0"), V.BENIGN, "b_code", 0))
    every = every.union(of(chat(spark, sf_dir).withColumn("source", F.lit("conversations")), V.BENIGN, "b_chat", 0))
    kind = F.coalesce("benign_class", F.lit(""))
    # Rows meet by digest; the text of a group is carried, not compared.
    by = every.groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest")).agg(
        F.any_value("text").alias("text"), *[F.min(c).alias(c) for c in ("family", "benign_class", "label", "source")], F.min(kind).alias("__a"), F.max(kind).alias("__b")
    )
    return by.where("__a = __b").drop("digest", "__a", "__b")


def exclusion_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that a corpus must not hold: source, text."""
    return table(spark, sf_dir, "benchmark").select(F.lit("benchmark").alias("source"), "text").union(table(spark, sf_dir, "conversations").select(F.concat(F.lit("conversations/"), "role"), "text"))


def strings_of(df: DataFrame) -> DataFrame:
    """SRC-06: every string at any depth of every row, as one column ``text``."""
    from pyspark.sql import types as T

    def inside(c, kind):
        """An array of the strings in ``c``, or None if its type holds none."""
        if isinstance(kind, T.StringType):
            return F.array(c)
        if isinstance(kind, T.ArrayType):
            if inside(F.lit(None), kind.elementType) is None:
                return None
            return F.flatten(F.transform(c, lambda x: inside(x, kind.elementType)))
        if isinstance(kind, T.MapType):
            sides = [inside(f(c), T.ArrayType(k)) for f, k in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
            sides = [F.coalesce(s, F.array().cast("array<string>")) for s in sides if s is not None]
            return F.concat(*sides) if sides else None
        if isinstance(kind, T.StructType):
            parts = [inside(c.getField(f.name), f.dataType) for f in kind.fields]
            parts = [F.coalesce(p, F.array().cast("array<string>")) for p in parts if p is not None]
            return F.concat(*parts) if parts else None
        return None

    parts = [p for f in df.schema.fields if (p := inside(F.col(f"`{f.name}`"), f.dataType)) is not None]
    if not parts:
        return df.select(F.lit(None).cast("string").alias("text")).where("false")
    every = F.concat(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])
    return df.select(F.explode(every).alias("text")).where("text IS NOT NULL")
