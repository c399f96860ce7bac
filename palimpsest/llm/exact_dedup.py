"""Exact duplicates by deterministic block naming.

Texts are cut into fixed-size blocks.  The distinct blocks are sorted and get integer names; then
adjacent pairs of names get names in the same way, level by level, until one name is left for each
document: its identity is (level, name).  Two documents have the same identity exactly if their texts are
equal: a name stands for one block or one pair of names, never for a hash of it, so nothing can collide.

The block that is named first, at level -1, is a text's ends: its length with its first and last bytes.  An
ends block that one document has is that document's identity already, as no other text can be equal.  Only
the texts whose ends block is shared are named further, block by block, so long unique texts are not dealt
out in pieces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.llm.common import Tables, materialize, table, with_collapsed_space

BLOCK_BYTES = 4096
END_BYTES = 48
ENDS = ["n_bytes", "head", "tail"]


def _named(held: Tables, distinct: DataFrame, by: list[str]) -> DataFrame:
    """``distinct`` rows sorted within hash partitions, numbered: equal rows share a partition."""
    return held.cut(distinct.sortWithinPartitions(*by).withColumn("name", F.monotonically_increasing_id()), "names")


def _rows(held: Tables, docs: DataFrame, id_col: str, text_col: str, block_bytes: int, whole: bool) -> DataFrame:
    """Rows of ``docs`` with a uid, the name of their ends, whether that is shared, and if so their blocks; ``whole``: and as ``row``."""
    row = [F.struct(*docs.columns).alias("row")] if whole else []
    keep = ["row"] if whole else []
    base = with_collapsed_space(docs.select(*row, F.col(id_col).alias("doc_id"), F.col(text_col).alias("t")), "t", "t").withColumn("b", F.col("t").cast("binary"))
    n = F.octet_length("b")
    tail = F.substring("b", F.greatest(n - END_BYTES + 1, F.lit(1)), F.lit(END_BYTES))
    # A whole row has its text already: the normalized one is made again after the rows have been dealt.
    carried = [*keep, "doc_id", *([] if whole else ["b"])]
    base = base.select(*carried, n.alias("n_bytes"), F.substring("b", 1, END_BYTES).alias("head"), tail.alias("tail"))
    ends = _named(held, base.groupBy(*ENDS).agg((F.count("*") > 1).alias("shared")), ENDS)

    # Both sides of this join are dealt out for it alone, so a key with many rows can be split.  It is a
    # merge join at every size: texts move once, and nothing depends on whether ``ends`` can be broadcast.
    met = base.join(ends.hint("merge"), ENDS)
    if whole:
        met = with_collapsed_space(met.withColumn("t", F.col("row")[text_col]), "t", "t").withColumn("b", F.col("t").cast("binary"))
    count = F.greatest(F.ceil(F.col("n_bytes") / block_bytes), F.lit(1)).cast("int")
    cut = f"transform(sequence(0, n_blocks - 1), i -> substring(b, i * {block_bytes} + 1, {block_bytes}))"
    met = met.withColumn("n_blocks", count).select(
        *keep, F.monotonically_increasing_id().alias("uid"), "doc_id", F.unhex(F.sha2("b", 256)).alias("sha"), "shared", F.col("name").alias("ends"),
        F.when(F.col("shared"), F.expr(cut)).alias("blocks"),
    )
    return materialize(met, "rows")


def _who() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("uid").alias("uid"))


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty; empty texts are equal to each other.  Of equal texts the row with the
    smallest id stays, null ids last; of repeated rows with that id exactly one stays.  keep_id is null
    only where a whole group has null ids.  A text of any length is cut whole, into one array of its blocks.
    An empty table gives no rows; other columns are ignored.
    """
    with Tables(docs.sparkSession) as held:
        rows = _rows(held, docs, id_col, text_col, block_bytes, False)
        alone = rows.where("NOT shared").select(
            "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
        )
        open_rows = rows.where("shared")
        member = materialize(open_rows.select("uid", "doc_id", "sha").join(_identities(held, open_rows), "uid"), "members")
    # The third key, which no side is dealt by yet, makes the join deal out both, so a large group can be split.
    part = F.pmod(F.xxhash64("name"), F.lit(1024))
    member = member.withColumn("part", part)
    group = member.groupBy("level", "name").agg(F.min(_who()).alias("first"), F.count("*").alias("group_size")).withColumn("part", part)
    met = member.alias("m").join(group.alias("g"), ["level", "name", "part"])
    met = met.select(
        "m.doc_id", F.col("g.first.id").alias("keep_id"), "g.group_size", (F.col("m.uid") == F.col("g.first.uid")).alias("kept"), F.lower(F.hex("m.sha")).alias("text_sha256")
    )
    return alone.unionByName(met)


def _identities(held: Tables, rows: DataFrame) -> DataFrame:
    """uid -> (level, name): the one name that is left of each document's blocks."""
    top = rows.agg(F.max(F.size("blocks"))).first()[0] or 1
    blocks = rows.select("uid", F.size("blocks").alias("n"), F.posexplode("blocks").alias("pos", "block"))
    names = _named(held, blocks.select("block").distinct(), ["block"])
    level = blocks.join(names, "block").select("uid", "n", "pos", "name")
    done, k = [], 0
    while top > 1:
        level = held.cut(level, f"level{k}")
        done.append(level.where("n = 1").select("uid", F.lit(k).alias("level"), "name"))
        # Adjacent names meet; what is left over at the end is paired with -1, which names nothing.
        side = lambda odd: F.max(F.when(F.col("pos") % 2 == odd, F.col("name")))
        pairs = level.where("n > 1").groupBy("uid", "n", F.floor(F.col("pos") / 2).alias("half"))
        pairs = pairs.agg(side(0).alias("a"), F.coalesce(side(1), F.lit(-1)).alias("b"))
        pairs = held.cut(pairs, f"pairs{k}")
        names = _named(held, pairs.select("a", "b").distinct(), ["a", "b"])
        level = pairs.join(names, ["a", "b"]).select("uid", F.ceil(F.col("n") / 2).cast("int").alias("n"), F.col("half").alias("pos"), "name")
        top, k = (top + 1) // 2, k + 1
    out = level.select("uid", F.lit(k).alias("level"), "name")
    for df in done:
        out = out.unionByName(df)
    return out


def exact_dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text, as ``exact_dedup`` chooses it.

    A row whose ends are its identity goes on as it is; of the others the first of each identity does.
    """
    with Tables(docs.sparkSession) as held:
        rows = _rows(held, docs, id_col, text_col, block_bytes, True)
        open_rows = rows.where("shared")
        member = open_rows.select("uid", "doc_id").join(_identities(held, open_rows), "uid")
        first = materialize(member.groupBy("level", "name").agg(F.min(_who()).alias("first")).select("first.uid"), "first")
    return rows.where("NOT shared").select("row.*").unionByName(open_rows.join(first, "uid", "left_semi").select("row.*"))


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM t WINDOW w AS (PARTITION BY t)
"""
