"""What a run declares, and what is wrong with it: draws, baselines and their lineage, coordinates, files, labels, timing.

Gates give one row per problem and none where all is in order; small files are read on the driver.
"""

from __future__ import annotations

import json
import time
import tomllib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.functions import stats as S
from palimpsest.functions import text as T
from palimpsest.functions import vocabulary as V
from palimpsest.functions.canon import canonicalize
from palimpsest.operators import corpus as P
from palimpsest.sources.files import InputRefused, exists

# Relations of a baseline to a dataset, draw methods and their orders, names of the positive class.
TRAINED_ON, SEEDED = "trained-on", "seeded-from-declared-training-source"
HEAD, SEEDED_RANDOM = "head", "seeded_random"
SORT_KEYS = ("text", "payload_id")
POSITIVE_NAMES = ("injection", "prompt_injection", "prompt-injection", "jailbreak", "malicious", "unsafe", "attack")
LEAST_BASELINES = 2
RESULT_KEYS = ("schema_version", "run", "cells", "verdict")


def read_declaration(path: str) -> dict:
    """SRC-04: a TOML declaration with tables ``baseline`` (key, architecture, tokenizer, threshold) and ``draw``; all problems at once."""
    with open(path, "rb") as f:
        found = tomllib.load(f)
    kinds = {"key": str, "architecture": str, "tokenizer": str, "threshold": float}
    problems = [f"baseline {k}: {c} is not a {t.__name__}" for k, b in enumerate(found.get("baseline", [])) for c, t in kinds.items() if not isinstance(b.get(c), t)]
    problems += [f"baseline {b['key']}: threshold out of range" for b in found.get("baseline", []) if isinstance(b.get("threshold"), float) and not 0 <= b["threshold"] <= 1]
    problems += [f"no table {name}" for name in ("baseline", "draw") if name not in found]
    if problems:
        raise InputRefused(problems)
    return found


def baselines_of(spark: SparkSession, declaration: dict) -> DataFrame:
    columns = ("key", "architecture", "tokenizer", "threshold")
    return spark.createDataFrame([tuple(b[c] for c in columns) for b in declaration["baseline"]], "baseline_key string, architecture string, tokenizer string, threshold double")


def selection_problems(draws: DataFrame) -> DataFrame:
    """CFG-01.  ``draws``: name, method, seed, sort_key.  Each method admits its own parameter and no other."""
    method, seed, key = F.col("method"), F.col("seed"), F.col("sort_key")
    head, random = method == HEAD, method == SEEDED_RANDOM
    cases = (
        (~method.isin(HEAD, SEEDED_RANDOM), "unknown method"), (head & seed.isNotNull(), "a seed that nothing uses"), (head & key.isNull(), "no order"),
        (head & ~key.isin(*SORT_KEYS), "unknown order"), (random & key.isNotNull(), "an order that nothing uses"), (random & seed.isNull(), "no seed"),
    )
    return draws.select("name", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in cases]))).alias("problem"))


def one_hop_reaches(trained: DataFrame, seeds: DataFrame) -> DataFrame:
    """FLT-11: baseline, dataset and the seeds of the dataset that the baseline is trained on.

    ``trained``: baseline, source; ``seeds``: dataset, source.
    """
    return trained.join(seeds, "source").groupBy("baseline", "dataset").agg(F.array_sort(F.collect_set("source")).alias("seeds"))


def required_exclusion_sources(trained: DataFrame, seeds: DataFrame) -> DataFrame:
    """FLT-11: the seeds that some baseline reaches, which the corpus must not overlap."""
    return seeds.join(trained, "source", "left_semi").select("source").distinct()


def lineage_problems(relations: DataFrame, trained: DataFrame, seeds: DataFrame) -> DataFrame:
    """FLT-11: baselines that are scored over their own training text, declared or at one hop.  ``relations``: baseline, dataset, relation."""
    met = relations.join(one_hop_reaches(trained, seeds), ["baseline", "dataset"], "left")
    direct = F.coalesce(F.col("relation") == TRAINED_ON, F.lit(False))
    hop = F.col("seeds").isNotNull() & ~F.coalesce(F.col("relation") == SEEDED, F.lit(False))
    problem = F.when(direct, F.lit("trained on the dataset")).when(hop, F.concat(F.lit("undeclared hop by "), F.array_join("seeds", ",")))
    return met.select("baseline", "dataset", problem.alias("problem")).where("problem IS NOT NULL")


def baseline_set_problems(baselines: DataFrame, datasets: DataFrame) -> DataFrame:
    """FLT-12.  ``baselines``: baseline_key, architecture, tokenizer, dataset_revision, sample_size, outcome, judged_by; ``datasets``: revision."""
    few = baselines.agg(F.count("*").alias("n")).where(F.col("n") < LEAST_BASELINES).select(F.lit("*").alias("subject"), F.lit("too few baselines").alias("problem"))
    pair = baselines.groupBy("architecture", "tokenizer").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("baseline_key")), ",").alias("subject"))
    again = baselines.groupBy("baseline_key").agg(F.count("*").alias("n")).where("n > 1").select("baseline_key", F.lit("declared more than once"))
    stale = baselines.where("dataset_revision IS NOT NULL").join(datasets, F.col("dataset_revision") == F.col("revision"), "left_anti")
    sizes = baselines.where("sample_size > 0").agg(F.countDistinct("sample_size").alias("n")).where("n > 1").select(F.lit("*"), F.lit("records of different sample sizes"))
    kept = baselines.where("outcome = 'kept' AND coalesce(judged_by, '') = ''")
    parts = (pair.where("n > 1").select("subject", F.lit("same architecture and tokenizer")), again, stale.select("baseline_key", F.lit("record of a revision that is not pinned")), sizes, kept.select("baseline_key", F.lit("kept by nobody's judgement")))
    for part in parts:
        few = few.union(part)
    return few


def presence_problems(spark: SparkSession, paths: list[str]) -> list[str]:
    """GAT-02: the files of a corpus that are missing where others are there."""
    there = {p: exists(spark, p) for p in paths}
    return [p for p, here in there.items() if not here] if any(there.values()) else []


def coordinate_problems(cells: DataFrame) -> DataFrame:
    """GAT-04: cells whose contrast is none of those that their own chains and classes make."""
    chains = cells.where("chain IS NOT NULL").select(F.concat(F.lit("clean_vs_"), "chain").alias("contrast"))
    classes = cells.where("benign_class IS NOT NULL").select(F.concat(F.lit("attacks_vs_"), "benign_class"))
    known = chains.union(classes).union(cells.sparkSession.range(1).select(F.lit("canon_on_vs_off"))).distinct()
    return cells.where("contrast IS NOT NULL").join(known, "contrast", "left_anti").select("kind", "baseline_key", "contrast")


def positive_index(labels: dict[int, str]) -> int:
    """MDL-02: the one label that names the positive class."""
    found = [k for k, x in labels.items() if x.strip().casefold() in POSITIVE_NAMES]
    if len(found) != 1:
        raise InputRefused([f"{len(found)} of the labels {sorted(labels.values())} name a positive class"])
    return found[0]


def special_frame(probes: list[tuple[list[int], list[int]]], declared: int) -> tuple[tuple[int, ...], tuple[int, ...]]:
    """MDL-05: the prefix and suffix by which every probe's framed ids differ from its bare ones, of ``declared`` tokens."""
    sides = lambda bare, framed: {(tuple(framed[:k]), tuple(framed[k + len(bare) :])) for k in range(len(framed) - len(bare) + 1) if framed[k : k + len(bare)] == bare}
    if not probes or not all(bare for bare, _ in probes):
        raise InputRefused(["a probe without tokens shows no frame"])
    found = set.intersection(*(sides(bare, framed) for bare, framed in probes))
    if len(found) != 1:
        raise InputRefused([f"{len(found)} frames fit the probes"])
    prefix, suffix = found.pop()
    if len(prefix) + len(suffix) != declared:
        raise InputRefused([f"a frame of {len(prefix) + len(suffix)} tokens where {declared} are declared"])
    return prefix, suffix


def render_results(run: dict, cells: list[dict], verdicts: list[dict], schema_version: int = 1) -> str:
    """SNK-07: the published file: four keys in a fixed order."""
    if not run or not cells:
        raise InputRefused(["a results file has a run block and cells"])
    return json.dumps(dict(zip(RESULT_KEYS, (schema_version, run, cells, verdicts), strict=True)), ensure_ascii=False, indent=2, allow_nan=False) + "\n"


def verdict_lines(verdicts: DataFrame) -> DataFrame:
    """RPT-07: each verdict as a line of prose, with what it was computed from."""
    shown = F.regexp_replace(F.regexp_replace(F.regexp_replace("computed", r'[{}"]', ""), ":", " = "), ",", "; ")
    return verdicts.select("condition", F.concat("condition", F.lit(": "), F.replace("outcome", F.lit("_"), F.lit(" ")), F.lit(" ("), shown, F.lit(")")).alias("line"))


def timed(rows: DataFrame, text_col: str = "text") -> DataFrame:
    """TIM-01: ``rows`` with the nanoseconds that canonicalizing each text took in its worker, tracing on."""

    @F.arrow_udf("long")
    def took(text: pa.Array) -> pa.Array:
        out = []
        for t in text.to_pylist():
            began = time.perf_counter_ns()
            if t is not None:
                canonicalize(t)
            out.append(time.perf_counter_ns() - began)
        return pa.array(out, pa.int64())

    return rows.withColumn("elapsed_ns", took(text_col))


def timing_percentiles(timings: DataFrame, group: str, value: str = "elapsed_ns") -> DataFrame:
    """AGG-15: nearest-rank p50 and p95 and the number of timings, by group and over all ('overall').

    Windows run over distinct values of a group, not over its rows.
    """
    both = timings.select(F.explode(F.array(F.col(group), F.lit("overall"))).alias(group), F.col(value).alias("v"))
    by = both.groupBy(group, "v").agg(F.count("*").alias("c"))
    whole = Window.partitionBy(group)
    by = by.withColumn("upto", F.sum("c").over(whole.orderBy("v"))).withColumn("n", F.sum("c").over(whole))
    at = lambda num, den: F.min(F.when(F.col("upto") >= S.nearest_rank(num, den, F.col("n")), F.col("v")))
    return by.groupBy(group).agg(at(1, 2).alias("p50"), at(19, 20).alias("p95"), F.max("n").alias("n"))


def draw_problems(code: DataFrame, chat: DataFrame, messages: DataFrame, size: int, allowance: int) -> DataFrame:
    """SRT-05's gates, before a draw.  All have a column ``text``; ``messages`` are hand-written."""
    of = lambda df, name: df.where("text <> ''").agg(F.countDistinct("text").alias(name))
    written = messages.agg(F.count("*").alias("written"), F.countDistinct("text").alias("different"))
    shared = of(messages.select("text").join(chat.select("text"), "text", "left_semi"), "shared")
    one = written.crossJoin(shared).crossJoin(of(chat.join(messages.select("text"), "text", "left_anti"), "left")).crossJoin(of(code, "code"))
    cases = (
        (F.col("written") != allowance, "not as many hand-written texts as allowed"), (F.col("different") < F.col("written"), "a hand-written text twice"), (F.col("shared") > 0, "a hand-written text in the pool"),
        (F.lit(size < allowance), "more allowed than the sample holds"), (F.col("left") < size - allowance, "too few chat texts"), (F.col("code") < size, "too few code texts"),
    )
    return one.select(F.explode(F.array_compact(F.array(*[F.when(c, F.lit(p)) for c, p in cases]))).alias("problem"))


def draw_benign_items(code: DataFrame, chat: DataFrame, messages: DataFrame, size: int, allowance: int, seed: int, source: str) -> DataFrame:
    """SRT-05: exactly ``size`` texts of each benign class: seeded ones of ``code``, and all messages with seeded ones of ``chat``.

    text, benign_class, source; refused if a gate fails.
    """
    if problems := [r["problem"] for r in draw_problems(code, chat, messages, size, allowance).collect()]:
        raise InputRefused(problems)
    pool = chat.where("text <> ''").join(messages.select("text"), "text", "left_anti")
    parts = [
        (P.draw_seeded(code.where("text <> ''"), size, seed), V.BENIGN_CLASSES[0], "code"), (messages.select("text"), V.BENIGN_CLASSES[1], "hand-authored"),
        (P.draw_seeded(pool, size - allowance, seed), V.BENIGN_CLASSES[1], source),
    ]
    one, two, three = (df.select("text", F.lit(c).alias("benign_class"), F.lit(s).alias("source")) for df, c, s in parts)
    return one.union(two).union(three).withColumn("payload_id", T.payload_id(F.col("text")))
