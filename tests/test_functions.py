"""Canonicalizer, encodings, statistics and verifiers against goldens and brute force."""

import base64
import hashlib
import itertools
import math
import random
import re
import unicodedata
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from palimpsest.functions import canon as K
from palimpsest.functions import dressings as D
from palimpsest.functions import stats as S
from palimpsest.functions import text as T
from palimpsest.functions import vocabulary as V

ZW = "​"
ODD = ["", "Do it.", "a", "é́x", "ﬁle ① Ａ", f"pay{ZW}pal", "аА", "😀 b", "0" * 16, "A" * 24, "deadbeef" * 4, "a b c", "x" * 300, "Ωmega ̧́"]


def _column(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")


def _values(df, c):
    return [r.v for r in df.select("i", c.alias("v")).orderBy("i").collect()]


@pytest.mark.parametrize(
    ("before", "after", "edits", "hit", "depth"),
    [
        ("plain", "plain", [], False, 0),
        (f"pay{ZW}{ZW}pal", "paypal", [("invisible", 3, 5, ZW * 2, "", 0)], False, 0),
        ("аАb", "aAb", [("confusables", 0, 2, "аА", "aA", 0)], False, 0),
        ("ﬁle", "file", [("nfkc", 0, 1, "ﬁ", "fi", 0)], False, 0),
        ("0" * 16, "0" * 16, [("decode", 0, 16, "0" * 16, "0" * 16, 0)], False, 0),
        ("see RG8gaXQgbm93LCBwbGVhc2UuIFRoYW5rcw==", "see Do it now, please. Thanks", [("decode", 4, 40, "RG8gaXQgbm93LCBwbGVhc2UuIFRoYW5rcw==", "Do it now, please. Thanks", 0)], False, 1),
    ],
)
def test_canonicalize_goldens(before, after, edits, hit, depth):
    got = K.canonicalize(before)
    assert (got.text, [tuple(e) for e in got.edits], got.ceiling_hit, got.max_depth_reached) == (after, edits, hit, depth)


def test_four_levels_end_at_the_ceiling():
    t = "Ignore all of this, please, and do it now."
    levels = [t := base64.b64encode(t.encode()).decode() for _ in range(4)]
    got = K.canonicalize(levels[-1])
    assert got.text == levels[0] and got.ceiling_hit and got.max_depth_reached == 3
    assert [e.stage for e in got.edits] == ["decode"] * 3 + ["decode-ceiling"]
    assert got.edits[-1].before == got.edits[-1].after
    assert K.canonicalize(levels[-1], ceiling=12).text == "Ignore all of this, please, and do it now."


def test_hex_inside_a_base64_run_comes_first():
    hexed = "Do it now please".encode().hex()
    assert K.canonicalize("zz" + hexed + "zz").text == "zzDo it now pleasezz"
    assert K.canonicalize("ab" * 7 + "a").edits == []
    assert K.try_decode("61" * 7 + "6", "hex") is None
    assert K.try_decode("aGVsbG8gdGhlcmUsIGZyaWVuZA", "base64") is None
    assert K.try_decode(base64.b64encode(bytes(range(200, 224))).decode(), "base64") is None


def test_tracing_never_changes_text_and_edits_replay():
    rng = random.Random(1)
    alphabet = "ab1= /+" + V.INVISIBLE[:4] + "аЮﬁȩ́́Ａ가Ω"
    for t in [*ODD, *("".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(800))]:
        a, b = K.canonicalize(t), K.canonicalize(t, trace=False)
        assert a._replace(edits=[]) == b
        for step in (K._hidden, K._folded, K._composed):
            out, edits = step(t, True)
            assert K.replay(t, edits) == out and all(e.before != e.after for e in edits)
        assert K._composed(t, True)[0] == unicodedata.normalize("NFKC", t)
    with pytest.raises(ValueError):
        K.replay("abc", [K.Edit("nfkc", 0, 1, "x", "y")])


def test_udfs_give_the_same_for_any_partitioning(spark):
    texts = [*ODD, base64.b64encode(b"Do it now, please and thanks").decode(), None]
    df = _column(spark, texts)
    for n in (1, 3, 7):
        rows = df.repartition(n).select("i", K.canonical_udf()("t").alias("c"), K.traced_udf()("t").alias("e")).collect()
        for r in rows:
            if texts[r.i] is None:
                assert r.c is None and r.e is None
                continue
            want = K.canonicalize(texts[r.i])
            assert r.c.text == r.e.text == want.text and [tuple(x) for x in r.e.edits] == [tuple(x) for x in want.edits]
    edits = df.where("t IS NOT NULL").withColumn("r", K.stage_udf("nfkc")("t"))
    assert edits.where(T.replayed(F.col("t"), F.col("r.edits")) != F.col("r.text")).count() == 0


def test_encodings(spark):
    df = _column(spark, ODD)
    assert _values(df, D.to_base64(F.col("t"))) == [base64.b64encode(t.encode()).decode() for t in ODD]
    assert _values(df, D.to_hex(F.col("t"))) == [t.encode().hex() for t in ODD]
    assert _values(df, D.to_base32(F.col("t"))) == [base64.b32encode(t.encode()).decode() for t in ODD]
    assert _values(df, D.to_url_percent(F.col("t"))) == [quote(t, safe="") for t in ODD]
    assert _values(df, D.zero_width(F.col("t"))) == [ZW.join(t) for t in ODD]
    one = _column(spark, ["Do it."])
    golden = {"base64": "RG8gaXQu", "hex": "446f2069742e", "homoglyph": "Dο ͺt.", "base64+base64": "Ukc4Z2FYUXU=", "zero_width+base64": "ROKAi2/igIsg4oCLaeKAi3TigIsu", "base64+homoglyph": "RԌ8gαΧQυ", "base64+base64+base64+base64": "Vld0ak5Gb3lSbGxWV0ZVOQ==", "base32": "IRXSA2LUFY======", "url_percent": "Do%20it.", "rot13": "Qb vg."}
    for name, want in golden.items():
        assert _values(one, D.dress(F.col("t"), tuple(name.split("+")))) == [want]
    with pytest.raises(KeyError):
        D.dress(F.col("t"), ("rot26",))
    assert len(D.substitutes()) == 45
    assert (D.min_payload_bytes("base64"), D.min_payload_bytes("hex")) == (16, 8)


def test_chains(spark):
    names = _column(spark, ["clean", "base64", "hex+zero_width", "rot13", "base64+rot13", "nothing"])
    links = D.parse_chain(F.col("t"))
    assert _values(names, D.render_chain(links)) == ["clean", "base64", "hex+zero_width", "rot13", "base64+rot13", None]
    assert _values(names, D.chain_class(links)) == ["bound", "bound", "bound", "held_out", None, None]
    assert _values(names, D.probes(links)) == [None, None, None, "none", None, None]
    ids = _column(spark, ["0123456789abcdef::clean", "0123456789abcde::clean", "0123456789abcdef::x", "0123456789abcdef::a::b"])
    assert [v and tuple(v) for v in _values(ids, D.parse_item_id(F.col("t")))] == [("0123456789abcdef", "clean"), None, None, None]
    assert D.chain_problems(V.BOUND_CHAINS, V.HELD_OUT_CHAINS) == []
    assert len(D.chain_problems((("base64",), ("base64",), ("rot13",)), (("rot13",),))) >= 4


def test_text_functions(spark):
    df = _column(spark, ODD)
    assert _values(df, T.normalized("t")) == [" ".join(unicodedata.normalize("NFKC", t).lower().split()) for t in ODD]
    for got, t in zip(_values(df, T.entropy(F.col("t"))), ODD, strict=True):
        assert got == pytest.approx(-sum((p := t.count(c) / len(t)) * math.log2(p) for c in set(t)) if t else 0.0)
    runs = ["0" * 16, "446f206974206e6f77", "deadbeef" * 4, "A" * 24, "RG8gaXQgbm93LCBwbGVhc2UuIFRoYW5rcw==", "RG8gaXQgbm93LCBwbGVhc2UuIFRoYW5rcw="]
    for enc in ("hex", "base64"):
        good = [r if set(r) <= set("0123456789abcdefABCDEF") or enc == "base64" else None for r in runs]
        assert _values(_column(spark, runs), T.decoded(F.col("t"), enc)) == [r and K.try_decode(r, enc) for r in good]
    words = _column(spark, ["", "a b c d", "a b c d e", "a b c d e a b c d e"])
    assert [sorted(v) for v in _values(words, T.shingles(T.tokens(F.col("t"))))] == [[], [], ["a b c d e"], sorted(["a b c d e", "b c d e a", "c d e a b", "d e a b c", "e a b c d"])]
    assert _values(_column(spark, ["x ab cd y", "xab cd"]), T.contains_run(F.col("t"), F.lit("ab cd"))) == [True, False]
    assert _values(_column(spark, ["a" * 61, "a"]), T.excerpt(F.col("t"))) == ["a" * 60 + "...", "a"]
    assert _values(_column(spark, ["x"]), T.payload_id(F.col("t"))) == [hashlib.sha256(b"x").hexdigest()[:16]]


@pytest.mark.parametrize(("k", "n", "lo", "hi"), [(0, 10, 0.0, 0.2775327998628892), (5, 10, 0.2365930905125640, 0.7634069094874360), (10, 10, 0.7224672001371108, 1.0), (3, 512, 0.001994675792186093, 0.01708378068394411)])
def test_wilson_goldens(spark, k, n, lo, hi):
    got = spark.range(1).select(*S.wilson(F.lit(k), F.lit(n))).first()
    assert tuple(got) == pytest.approx((lo, hi), abs=1e-14)


@pytest.mark.parametrize(("t", "lo", "hi"), [((40, 10, 2, 48), 0.01130718880725065, 0.1466920129384580), ((30, 0, 0, 70), -0.02426722084632472, 0.02426722084632472), ((0, 12, 3, 0), 0.09629102569661290, 0.8590490130603688)])
def test_newcombe_goldens(spark, t, lo, hi):
    got = spark.range(1).select(*S.newcombe(*map(F.lit, t))).first()
    assert tuple(got)[1:] == pytest.approx((lo, hi), abs=1e-14)


def test_other_statistics(spark):
    assert tuple(spark.range(1).select(*S.wilson(F.lit(3), F.lit(0))).first()) == (None, None)
    assert spark.range(1).select(S.softmax(F.array(F.lit(1000.0), F.lit(1000.0)))).first()[0] == [0.5, 0.5]
    assert spark.range(1).select(S.softmax(F.array(F.lit(float("nan"))))).first()[0] is None
    w = spark.sql("SELECT 0 AS i, array('a','b','c','d','e') AS t UNION ALL SELECT 1, array()")
    assert _values(w, S.windows(F.col("t"), 2)) == [[["a", "b"], ["c", "d"], ["e"]], [[]]]
    for n, (num, den) in itertools.product(range(1, 50), ((1, 2), (19, 20), (7, 100))):
        assert -(-num * n // den) == (num * n + den - 1) // den


def test_each_prefix_of_a_chain_is_dressed_once(spark):
    from palimpsest.operators import corpus as P

    kind = "text string, family string, benign_class string, label int, source string"
    items = P.render(spark.createDataFrame([(t, V.ATTACK, None, 1, "s") for t in ODD], kind))
    plan = items._jdf.queryExecution().executedPlan().toString()
    for link, call in (("base64", "Base64.encode("), ("hex", "lower(hex("), ("zero_width", "split(")):
        prefixes = {c[:k] for c in V.CHAINS for k in range(1, len(c) + 1) if c[k - 1] == link}
        assert plan.count(call) == len(prefixes), link
    made = {(r.payload_id, r.chain): r.text for r in items.collect()}
    alone = {D.chain_name(c): _values(_column(spark, ODD), D.dress(F.col("t"), c)) for c in V.CHAINS}
    assert made == {(p, c): x for c, texts in alone.items() for p, x in zip((hashlib.sha256(t.encode()).hexdigest()[:16] for t in ODD), texts, strict=True)}


def test_links_are_those_of_the_standard_library_at_any_length(spark):
    rng = random.Random(5)
    for n in (*range(12), 1000, 4099):
        raw = rng.randbytes(n)
        assert D.b32(raw) == base64.b32encode(raw).decode()
    texts = ["", "a", "a\r\nb", "\U0001f600\U0001f601$0", "x" * D.SPLIT_CHARS, "xy\U0001f600" + "x" * D.SPLIT_CHARS]
    assert _values(_column(spark, texts), D.zero_width(F.col("t"))) == [ZW.join(t) for t in texts]


def test_batches_for_python_are_bounded_by_bytes(spark):
    """Spark's own bound, which the canonicalizer's memory rests on: rows of any length, a batch of 64 MB and one row."""

    @F.arrow_udf("long")
    def size(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array([b.nbytes] * len(b), pa.int64())

    most = 64 << 20
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch").rstrip("b") == str(most)
    rows = spark.range(300, numPartitions=1).select(F.repeat(F.lit("x"), 1 << 20).alias("t"))
    assert rows.select(size("t").alias("n")).agg(F.max("n")).first()[0] < most + (2 << 20)


def test_a_batch_of_edits_is_sent_in_slices(spark):
    """A text of hidden characters is tens of times its size in edits: no batch of rows is held as edits at once."""
    texts = [None, "", ZW.join("x" * 40_000), *[ZW.join(f"text {i}") for i in range(3000)], None, ZW.join("y" * 60_000)]
    for udf in (K.stage_udf("invisible"), K.traced_udf(), K.canonical_udf()):
        parts = list(udf.func(iter([pa.array(texts[:2000]), pa.array(texts[2000:])])))
        assert len(parts) >= 6 and all(len(p) <= K.SLICE_ROWS and p.nbytes < 20 * K.SLICE_BYTES for p in parts)
        rows = [r for p in parts for r in p.to_pylist()]
        assert [r and r["text"] for r in rows] == [t if t is None else t.replace(ZW, "") for t in texts]
        if "edits" in rows[1]:
            hidden = [r and [K.Edit(**e) for e in r["edits"] if e["stage"] == "invisible"] for r in rows]
            assert [r if r is None else len(r) for r in hidden] == [t if t is None else t.count(ZW) for t in texts]
            assert K.replay(texts[2], hidden[2]) == "x" * 40_000


def test_shingles_do_not_copy_all_words_for_each(spark):
    """A slice copies the whole array, so a text's shingles cost the square of its words."""
    assert "slice" not in str(T.shingles(F.col("w")))
    rows = spark.createDataFrame([(["a", "b", "a", "b", "a", "b", "a"],), (["a", "b"],), ([],)], "w array<string>")
    assert [r[0] for r in rows.select(T.shingles(F.col("w"), 3)).collect()] == [["a b a", "b a b"], [], []]


def test_runs_are_those_of_a_pattern():
    """Runs found in one pass, by ends, beyond ASCII too, are the maximal ones; what is not traced folds and deletes alike."""
    texts = ["", "x" * 15, "x" * 16, "é" + "x" * 16 + "é", "ab " * 9 + "Z" * 30, "/=" * 9 + "\U0001f600" + "f0" * 8, "\u200b" + "0a" * 9 + "\u0430" * 20]
    for t in texts:
        for outside, chars in ((K._NOT_B64, "A-Za-z0-9+/="), (K._NOT_HEX, "0-9A-Fa-f")):
            assert K._runs(t, outside, 16) == [m.span() for m in re.finditer(f"[{chars}]{{16,}}", t)]
        assert K.canonicalize(t, trace=False)[2:] == K.canonicalize(t)[2:] and K.canonicalize(t, trace=False).text == K.canonicalize(t).text
