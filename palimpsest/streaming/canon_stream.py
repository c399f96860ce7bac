"""Canonicalization and classification of a stream: the batch expressions, unchanged, on ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.canon import canonical_udf
from palimpsest.operators.scoring import digest_score


def canonical_stream(rows: DataFrame, id_col: str, baseline: str, threshold: float, text_col: str = "text") -> DataFrame:
    """id, canonical text's digest, depth, ceiling flag, score and detection of each row, stateless."""
    out = rows.select(F.col(id_col).alias("id"), canonical_udf()(F.col(text_col)).alias("c"))
    p = digest_score(F.lit(baseline), F.col("c.text"))
    return out.select("id", F.sha2("c.text", 256).alias("digest"), "c.max_depth_reached", "c.ceiling_hit", p.alias("p_injection"), (p >= threshold).alias("detected"))


def read_text_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(folder)


def run_to_end(stream: DataFrame, out: str, checkpoint: str) -> None:
    """Write all that is there, then stop.  What a former run wrote under ``checkpoint`` is not written again."""
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def detections_by_window(stream: DataFrame, ts_col: str, length: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Rows and detections of each time window, with late rows admitted up to ``late``."""
    return stream.withWatermark(ts_col, late).groupBy(F.window(ts_col, length)).agg(F.count("*").alias("rows"), F.count_if("detected").alias("detections"))
