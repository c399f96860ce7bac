"""Queries of the registry against their SQL in DuckDB on the smallest tables."""

import base64
import glob
import hashlib
import math
import os
import re
from collections import Counter
from collections.abc import Iterator

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import dressings as D
from palimpsest.functions import vocabulary as V
from palimpsest.plans import registry
from palimpsest.sources.shared import BATCH_BYTES

SF = "/root/testdata/sf0.001"
CHOSEN = [
    "can01_strip_invisible", "can02_fold_confusables", "can04_entropy", "can06_decode_strict", "can10_invisible_edits", "can12_canonical_of_dressed", "can13_replay",
    "drs_base32", "drs08_chains_join02_render", "drs11_item_ids", "txt01_normalize", "txt03_shingles", "txt07_txt10_verifiers", "flt01_withdrawal_problems", "flt06_removed",
    "join08_crosscheck", "srt02_draw_seeded", "srt06_shards", "mdl04_reduce_windows", "agg02_agg03_rates", "agg07_join06_auc", "agg13_join03_canon_delta", "agg14_nearest_rank",
]


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return found


def _plain(v):
    return round(v, 8) + 0.0 if isinstance(v, float) and math.isfinite(v) else v


@pytest.mark.parametrize("name", CHOSEN)
def test_query(spark, con, name):
    df = registry.queries()[name](spark, SF)
    want = con.execute(registry.oracle_sql()[name])
    columns = [d[0] for d in want.description]
    assert sorted(columns) == sorted(df.columns)
    rows = sorted((tuple(_plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert rows == sorted((tuple(map(_plain, r)) for r in want.fetchall()), key=repr)


def test_registry_is_whole():
    assert registry.oracle_sql().keys() <= registry.queries().keys() and len(registry.queries()) > 80


def _first_declined(text, chain):
    """Brute force of the decline rule: a prefix's run of the link's alphabet that is too short or too even."""
    for link in chain:
        text = {"base64": lambda t: base64.b64encode(t.encode()).decode(), "hex": lambda t: t.encode().hex(), "homoglyph": lambda t: t.translate(GLYPHS), "zero_width": "\u200b".join}[link](text)
        least, floor = {"base64": (24, 3.0), "hex": (16, 2.5)}.get(link, (0, 0.0))
        if least and (len(text) < least or -sum(k / len(text) * math.log2(k / len(text)) for k in Counter(text).values()) < floor):
            return text, True
    return text, False


GLYPHS = str.maketrans(D.substitutes())
EDGE = ["Hi.", "seven b", "eight b!", "fifteen bytes..", "sixteen bytes...", "a" * 20, "é" * 8, "aGVsbG8gdGhlcmUsIG15IGZyaWVuZA==", "446f206974206e6f77206f72206e6f74", "The payload here has fifty nine characters or a few less."]


def test_whole_rows_are_decoded_and_round_tripped(spark, tmp_path):
    """Short texts and such with nested candidates take part as any others do."""
    spark.createDataFrame(list(enumerate(EDGE)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("user", t) for t in EDGE], "role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    rows = lambda name: {r[0]: tuple(r)[1:] for r in registry.queries()[name](spark, str(tmp_path)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()

    decoded, dressed, ceiling, trips = map(rows, ("can06_decode_strict", "can12_canonical_of_dressed", "can12_ceiling", "drs18_round_trip"))
    assert len(decoded) == len(dressed) == len(ceiling) == len(EDGE)
    inside = {7: "hello there, my friend", 8: "Do it now or not"}
    for i, t in enumerate(EDGE):
        assert decoded[i] == tuple(None if _first_declined(t, (c,))[1] else sha(t) for c in ("hex", "base64"))
        blob, declined = _first_declined(t, ("base64",))
        assert dressed[i] == (sha(blob if declined else inside.get(i, t)), False, 0 if declined else 1 + (i in inside))
        stops = next((k for k in range(1, 5) if _first_declined(t, ("base64",) * k)[1]), None)
        # The outermost run is the longest; where the innermost is declined the ceiling is not reached.
        assert ceiling[i] == ((True, 3) if stops is None else (False, 0 if _declines(t, 4) else 4 - _levels(t)))
    for c in V.BOUND_CHAINS:
        assert trips[D.chain_name(c)] == (len(EDGE), sum(_first_declined(t, c)[1] for t in EDGE), 0, 0)


def _runs(t):
    return [t := base64.b64encode(t.encode()).decode() for _ in range(4)]


def _declines(t, level):
    run = _runs(t)[level - 1]
    return len(run) < 24 or -sum(k / len(run) * math.log2(k / len(run)) for k in Counter(run).values()) < 3.0


def _levels(t):
    """The outermost level that is declined: what lies below it stays encoded."""
    return max(k for k in range(1, 5) if _declines(t, k))


@pytest.mark.parametrize("name", ["txt11_message_problems", "flt10_licence_problems", "flt13_cell_problems", "gat03_foreign_shards", "att01_attribution_problems", "cfg01_selection_problems", "flt11_lineage_problems", "flt11_required_sources", "flt12_baseline_set_problems", "agg15_timing_percentiles"])
def test_gates_over_declarations(spark, con, name):
    test_query(spark, con, name)


def _canonicalizers(df):
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(r"ArrowEvalPython \[run\(", plan))


@pytest.mark.parametrize("name", ["join14_agreement", "join13_coverage", "run_resume_owed"])
def test_carried_scores_are_computed_once(spark, con, name):
    """Rows that come back several times are read again, not scored again."""
    assert _canonicalizers(registry.queries()[name](spark, SF)) == 0
    test_query(spark, con, name)


def test_edit_census_canonicalizes_once(spark, con):
    """Stages and scores come from one pass over the items, which is written; before, the scores made a second one."""
    assert _canonicalizers(registry.queries()["agg06_edit_census"](spark, SF)) == 0
    test_query(spark, con, "agg06_edit_census")


def test_completeness_makes_rates_alone(spark, con):
    """Nothing is written or ordered for areas that the gate does not look at."""
    assert _canonicalizers(registry.queries()["join19_completeness"](spark, SF)) == 1
    test_query(spark, con, "join19_completeness")


def test_round_trip_sends_each_dressed_text_once(spark, con):
    """One pass through Python for each row of text and chain; before, entropies and both canonical texts were passes of their own."""
    plan = registry.queries()["drs18_round_trip"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    test_query(spark, con, "drs18_round_trip")


def test_scores_send_python_small_batches(spark, monkeypatch):
    """Cells, keyed rows and scores, by a canonicalizer that stops at a batch of more than the bound and a row; before, these 40 MB were one."""
    most = BATCH_BYTES + (1 << 20)

    @F.arrow_udf("struct<text:string,ceiling_hit:boolean,max_depth_reached:int,stages:array<string>>")
    def plain(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            assert b.nbytes < most, f"a batch of {b.nbytes} bytes"
            columns = [b, pa.array([False] * len(b)), pa.array([0] * len(b), pa.int32()), pa.array([[]] * len(b), pa.list_(pa.string()))]
            yield pa.StructArray.from_arrays(columns, ["text", "ceiling_hit", "max_depth_reached", "stages"])

    def items(spark, sf):
        of = spark.range(200, numPartitions=1).withColumn("payload_id", F.lpad(F.hex("id"), 16, "0")).withColumn("item_id", F.lower(F.concat("payload_id", F.lit("::clean"))))
        attack = F.col("id") % 2 == 0
        return of.select("item_id", F.when(attack, "attack").otherwise("benign").alias("family"), F.when(~attack, "b_code").alias("benign_class"), attack.cast("int").alias("label"), F.repeat(F.hex("id"), 100_000).alias("text"))

    monkeypatch.setattr(registry.K, "canonical_udf", lambda *ceiling: plain)
    monkeypatch.setattr(registry, "_items", items)
    held = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    for made in (registry._cells, registry._keyed, registry._scores):
        assert made(spark, SF).count() > 0
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == held
