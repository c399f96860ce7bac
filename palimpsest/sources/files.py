"""Reading and writing the measurement's files: JSON lines, archives, tables of code points, manifests."""

from __future__ import annotations

import hashlib
import io
import json
import re
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions import vocabulary as V

ITEM_SCHEMA = "id string, source string, family string, benign_class string, dressing array<string>, text string, label int"
SCORE_SCHEMA = "item_id string, family string, benign_class string, label int, baseline_key string, condition string, p_injection double, n_windows int, max_depth_reached int, ceiling_hit boolean"
TRACE_SCHEMA = "item_id string, stages array<string>"
RESULT_KINDS = ("rate", "count", "auc", "delta")


class InputRefused(ValueError):
    """A file that a run must not go on with; ``problems`` has all that is wrong."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def read_items(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """SRC-01: corpus rows, refused if they break the schema's rules or aren't as many as declared."""
    df = spark.read.schema(ITEM_SCHEMA).option("mode", "FAILFAST").json(path)
    bad = df.agg(
        F.count("*").alias("rows"), F.count_if(F.col("id").isNull() | F.col("text").isNull()).alias("null"), F.count_if(~F.col("family").isin(V.ATTACK, V.BENIGN)).alias("family"),
        F.count_if((F.col("family") == V.ATTACK) != (F.col("label") == 1)).alias("label"), F.count_if((F.col("family") == V.BENIGN) == F.col("benign_class").isNull()).alias("class"),
    ).first()
    problems = [f"{bad[k]} rows break the rule on {k}" for k in ("null", "family", "label", "class") if bad[k]]
    if expected_rows is not None and bad["rows"] != expected_rows:
        problems.append(f"{bad['rows']} rows instead of {expected_rows}")
    if problems:
        raise InputRefused(problems)
    return df


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """SRC-02: score rows; a repeated key is refused."""
    df = spark.read.schema(SCORE_SCHEMA).option("mode", "FAILFAST").json(path)
    again = df.groupBy("item_id", "baseline_key", "condition").count().where("count > 1").limit(3).collect()
    if again:
        raise InputRefused([f"{r['item_id']} {r['baseline_key']} {r['condition']} occurs {r['count']} times" for r in again])
    return df


def read_traces(spark: SparkSession, path: str) -> DataFrame:
    """SRC-03: item and stages; an unknown stage is refused, a missing file has no traces.

    Of a repeated item the last line stays: by file, place of the block in it, and place in the block.
    """
    if not exists(spark, path):
        return spark.createDataFrame([], TRACE_SCHEMA)
    df = spark.read.schema(TRACE_SCHEMA).option("mode", "FAILFAST").json(path).select("*", F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line")).alias("at"))
    odd = df.select(F.explode(F.array_except("stages", F.array(*map(F.lit, V.TRACE_LABELS)))).alias("stage")).distinct().limit(5).collect()
    if odd:
        raise InputRefused([f"unknown stage {r['stage']}" for r in odd])
    return df.groupBy("item_id").agg(F.max_by("stages", "at").alias("stages"))


def read_shard(spark: SparkSession, path: str) -> tuple[dict, DataFrame, DataFrame]:
    """SRC-11: a shard's header line, its records, and lines that are no record (a torn end)."""
    lines = spark.read.text(path)
    header = lines.where(F.get_json_object("value", "$.shard").isNotNull()).limit(2).collect()
    if len(header) != 1:
        raise InputRefused(["a shard has one header line"])
    rest = lines.where(F.get_json_object("value", "$.shard").isNull())
    parsed = rest.select("value", F.from_json("value", SCORE_SCHEMA).alias("r"))
    return json.loads(header[0]["value"]), parsed.where("r.item_id IS NOT NULL").select("r.*"), parsed.where("r.item_id IS NULL").select("value")


def write_json_lines(df: DataFrame, path: str, *order: str, rebuild: bool = False) -> None:
    """SNK-01, SNK-02, SNK-05: rows in a total order over the part files; an existing path only if ``rebuild``."""
    row = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    df.orderBy(*order).select(row.alias("value")).write.mode("overwrite" if rebuild else "errorifexists").text(path)


def append_shards(df: DataFrame, path: str) -> None:
    """SNK-04: append scored rows by shard."""
    df.write.mode("append").partitionBy("shard").parquet(path)


def write_traces(df: DataFrame, path: str) -> None:
    """SNK-06: item and edits."""
    df.select("item_id", "edits").write.mode("overwrite").parquet(path)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """SRC-12: cells of a results file; numbers that aren't finite and unknown kinds are refused."""
    df = spark.read.option("mode", "FAILFAST").json(path)
    numbers = [c for c, t in df.dtypes if t == "double"]
    strange = F.lit(False)
    for c in numbers:
        strange = strange | F.isnan(c) | (F.abs(c) == F.lit(float("inf")))
    bad = df.agg(F.count_if(strange).alias("n"), F.count_if(~F.col("kind").isin(*RESULT_KINDS)).alias("k")).first()
    if bad["n"] or bad["k"]:
        raise InputRefused([f"{bad['n']} rows with numbers that are not finite, {bad['k']} of unknown kinds"])
    return df


def archive_files(spark: SparkSession, path: str, least: int, most: int, entries: int = 200_000) -> DataFrame:
    """SRC-08, SRC-16: archive, path and text of the UTF-8 members of tar.gz files within a size band.

    One archive is one row of a task; its members stream out one at a time.  ``entries`` members of an
    archive are looked at; more are refused, not dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("path"), b.column("content"), strict=True):
                with tarfile.open(fileobj=io.BytesIO(content.as_py()), mode="r|gz") as tar:
                    for k, member in enumerate(tar):
                        if k >= entries:
                            raise InputRefused([f"{name} has over {entries} members"])
                        if not member.isfile() or not least <= member.size <= most:
                            continue
                        try:
                            text = tar.extractfile(member).read().decode()
                        except UnicodeDecodeError:
                            continue
                        yield pa.RecordBatch.from_pylist([{"archive": name.as_py(), "path": member.name.partition("/")[2] or member.name, "text": text}])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, path string, text string")


_CONFUSABLE_LINE = r"^([0-9A-F]{4,6}) ;\t([0-9A-F ]+) ;\tMA"


def read_confusables(spark: SparkSession, path: str) -> DataFrame:
    """SRC-14: code point and target of the single-source lines of a Unicode confusables file."""
    lines = spark.read.text(path).where(F.col("value").rlike(_CONFUSABLE_LINE))
    part = lambda i: F.regexp_extract("value", _CONFUSABLE_LINE, i)
    points = F.transform(F.split(F.trim(part(2)), " +"), lambda x: F.conv(x, 16, 10).cast("int"))
    return lines.select(F.conv(part(1), 16, 10).cast("int").alias("source"), points.alias("target"))


def derive_confusables(upstream: DataFrame, blocks: list[tuple[int, int]]) -> DataFrame:
    """CAN-15: in-scope sources with all-ASCII targets; a source with two targets is refused."""
    scope = F.lit(False)
    for a, b in blocks:
        scope = scope | F.col("source").between(a, b)
    text = F.array_join(F.transform("target", lambda x: F.char(x)), "")
    kept = upstream.where(scope & F.forall("target", lambda x: x < 128)).select("source", text.alias("target")).distinct()
    two = kept.groupBy("source").count().where("count > 1").limit(3).collect()
    if two:
        raise InputRefused([f"U+{r['source']:04X} has {r['count']} targets" for r in two])
    return kept


def manifest_of(files: DataFrame) -> DataFrame:
    """SNK-03: path, sha256, rows and bytes of files read as ``binaryFile``."""
    lines = F.size(F.filter(F.split(F.col("content").cast("string"), "\n"), lambda x: x != ""))
    return files.select("path", F.sha2("content", 256).alias("sha256"), lines.alias("rows"), F.col("length").alias("bytes"))


def canonical_json(value: object) -> str:
    """TXT-15: JSON with sorted keys."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def declaration_digest(value: object) -> str:
    return hashlib.sha256(canonical_json(value).encode()).hexdigest()


def is_lfs_pointer(text: str) -> bool:
    """TXT-14."""
    return text.startswith("version https://git-lfs.github.com/spec/v1\n") and "\noid sha256:" in text


def covered(path: str, attributes: str) -> bool:
    """TXT-13: whether a pattern of a gitattributes text with filter=lfs matches ``path``."""
    import fnmatch

    patterns = [line.split()[0] for line in attributes.splitlines() if "filter=lfs" in line and not line.startswith("#")]
    return any(fnmatch.fnmatch(path, p) or fnmatch.fnmatch(path.rpartition("/")[2], p) for p in patterns)


def storage_problems(files: list[tuple[str, int]], attributes: str, warn: int = 50 << 20, refuse: int = 100 << 20) -> list[str]:
    """TXT-13: files too large to publish outside large-file storage."""
    return [f"{p}: {n} bytes, {'refused' if n > refuse else 'large'}" for p, n in files if n > warn and not covered(p, attributes)]


def inject(page: str, block: str, name: str) -> str:
    """SNK-09: ``page`` with what stands between the markers of ``name`` replaced."""
    begin, end = f"<!-- {name}:begin -->", f"<!-- {name}:end -->"
    if page.count(begin) != 1 or page.count(end) != 1 or page.index(begin) > page.index(end):
        raise InputRefused([f"the page needs one {begin} before one {end}"])
    head, _, rest = page.partition(begin)
    return f"{head}{begin}\n{block.strip()}\n{end}{rest.partition(end)[2]}"


def words_outside_blocks(page: str) -> int:
    """RPT-06: words of prose, without comments, code and tables."""
    page = re.sub(r"<!--.*?-->", " ", page, flags=re.S)
    page = re.sub(r"```.*?```", " ", page, flags=re.S)
    return sum(len(line.split()) for line in page.splitlines() if not line.lstrip().startswith("|"))
