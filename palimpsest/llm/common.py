"""What the corpus operators share: text rules, and tables cut from their lineage (``sources.shared``)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.shared import Tables, materialize

__all__ = ["SPACE", "WORD", "Tables", "ascii_lower", "id_fold", "materialize", "table", "with_collapsed_space"]

#: `[\x20\x09-\x0D]`, the white space of the contracts, and the runs of everything else.
SPACE = "[\\x20\\x09-\\x0D]"
WORD = "[^\\x20\\x09-\\x0D]+"

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def id_fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % F.lit(parts)


def with_collapsed_space(df: DataFrame, text: str, out: str) -> DataFrame:
    """``out``: ``text`` (null: empty) with each run of white space replaced by one space.

    Five literal replacements and a test for a double space keep the regular expression off nearly
    all texts.
    """
    c = F.coalesce(F.col(text), F.lit(""))
    for space in "\t\n\x0b\x0c\r":
        c = F.replace(c, F.lit(space), F.lit(" "))
    raw = f"__{out}"
    df = df.withColumn(raw, c)
    two = F.contains(F.col(raw), F.lit("  "))
    return df.withColumn(out, F.when(two, F.regexp_replace(raw, " {2,}", " ")).otherwise(F.col(raw))).drop(raw)
