"""Gates over declarations: licences, confirmatory cells, hand-written messages, shard files, credits.

Each gives one row per problem, and none where all is in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palimpsest.functions import text as T
from palimpsest.functions import vocabulary as V

COMPATIBLE = ("mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "isc", "cc0-1.0", "unlicense", "0bsd", "psf-2.0", "python-2.0")
REFUSED = ("gpl-2.0", "gpl-3.0", "gpl-3.0-only", "gpl-3.0-or-later", "agpl-3.0", "lgpl-3.0", "cc-by-sa-4.0", "cc-by-nc-4.0", "cc-by-nd-4.0", "openrail", "other", "unknown")
NOT_DECLARED = "not-declared"
KINDS = ("jwt", "content_hash", "data_uri", "ssh_public_key")
SSH_ALGORITHMS = ("ssh-ed25519", "ssh-rsa")
_STRIPPED = r"^[.,;:!?()\[\]{}\"']+|[.,;:!?()\[\]{}\"']+$"


def _listed(rows: DataFrame, keys: list[str], *problems: Column) -> DataFrame:
    return rows.select(*keys, F.explode(F.array_compact(F.array(*problems))).alias("problem"))


def licence_problems(sources: DataFrame) -> DataFrame:
    """FLT-10.  ``sources``: label, repository, revision, attribution, redistributed, identifier, accepted (null: by nobody)."""
    name = F.lower(F.trim("identifier"))
    names = lambda c: F.contains("attribution", F.col(c))
    licence = (
        F.when(~F.col("redistributed"), F.lit(None))
        .when(name == "", F.lit("empty identifier"))
        .when(name == NOT_DECLARED, F.when(F.col("accepted").isNull(), F.lit("no licence")))
        .when(name.isin(*REFUSED), F.lit("refused licence"))
        .when(~name.isin(*COMPATIBLE), F.lit("unknown licence"))
    )
    revision = (F.coalesce("revision", F.lit("")) != "") & ~names("revision")
    return _listed(sources, ["label"], F.when(~names("repository"), F.lit("repository not credited")), F.when(revision, F.lit("revision not credited")), licence)


def cell_problems(cells: DataFrame, chains: DataFrame, ceiling: int = V.CEILING) -> DataFrame:
    """FLT-13.  A confirmatory cell (benign_class, chain) is of a class and a chain of the table, and the chain is held out or
    deeper than the ceiling: what the layer recovers by construction can't come out either way."""
    met = cells.join(F.broadcast(chains.select("chain", "chain_class", "depth")), "chain", "left")
    problem = (
        F.when(~F.col("benign_class").isin(*V.BENIGN_CLASSES), F.lit("unknown class"))
        .when(F.col("chain_class").isNull(), F.lit("undeclared chain"))
        .when((F.col("chain_class") != V.HELD_OUT) & (F.col("depth") <= ceiling), F.lit("not falsifiable"))
    )
    return _listed(met, ["benign_class", "chain"], problem)


def carries(kind: Column, text: Column, source: Column) -> Column:
    """Whether a message carries what its kind says, anywhere in it; null for an unknown kind."""
    jwt = F.exists(F.split(text, r"\s+"), lambda t: T.is_jwt(F.regexp_replace(t, _STRIPPED, "")))
    uris = F.regexp_extract_all(text, F.lit(r"(?s)data:(?!;base64,)(?=.+?;base64,\s*(\S+))"), F.lit(1))
    ssh = [T.is_ssh_key(F.concat(F.lit(f"{a} "), F.regexp_extract(text, rf"{a} \s*(\S+)", 1))) for a in SSH_ALGORITHMS]
    of = {"jwt": jwt, "content_hash": (F.coalesce(source, F.lit("")) != "") & T.carries_hash(text, source), "data_uri": F.exists(uris, lambda u: u.rlike(T.STRICT_BASE64)), "ssh_public_key": ssh[0] | ssh[1]}
    return F.coalesce(*[F.when(kind == k, ok) for k, ok in of.items()])


def message_problems(messages: DataFrame) -> DataFrame:
    """TXT-11.  ``messages``: key, kind, text, hashed_source.  Each repeated key and text is one problem; the text's is at its
    smallest key."""
    kind, source = F.col("kind"), F.col("hashed_source")
    known = kind.isin(*KINDS)
    each = _listed(
        messages, ["key"], F.when(~known, F.lit("unknown kind")), F.when(known & (F.coalesce(source, F.lit("")) != "") & (kind != "content_hash"), F.lit("source of no hash")),
        F.when(known & ~carries(kind, F.col("text"), source), F.lit("not what it declares")),
    )
    keys = messages.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated key"))
    texts = messages.groupBy("text").agg(F.min("key").alias("key"), F.count("*").alias("n")).where("n > 1").select("key", F.lit("repeated text"))
    return each.union(keys).union(texts)


def foreign_shards(headers: DataFrame, run: DataFrame) -> DataFrame:
    """GAT-03.  Files (name, shards, shard, build_id) that the run, which has the same columns, may not append to."""
    met = headers.alias("h").join(run.alias("r"), F.col("h.name") == F.col("r.name"))
    same = lambda *cs: reduce(lambda a, b: a & b, [F.col(f"h.{c}").eqNullSafe(F.col(f"r.{c}")) for c in cs])
    return _listed(met.select("h.name", same("shards", "shard").alias("split"), same("build_id").alias("corpus")), ["name"], F.when(~F.col("split"), F.lit("split")), F.when(~F.col("corpus"), F.lit("corpus")))


def attribution_problems(committed: DataFrame, expected: DataFrame) -> DataFrame:
    """ATT-01's gate: lines (number, line) of one credits file that the other lacks, and the side that has them."""
    one, two = committed.select("number", "line"), expected.select("number", "line")
    return one.exceptAll(two).withColumn("side", F.lit("committed")).union(two.exceptAll(one).withColumn("side", F.lit("expected")))
