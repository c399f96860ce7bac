"""Exact top-k inner products by best-first search of M-trees.

Vectors are rounded to integers and dealt to the nearest of a few pivots, then into trees of bounded size.  An
M-tree's nodes are pages: a routing object, a covering radius, and the distance to the parent's routing object.
For a query q and a node with routing object c and radius r, no vector below it scores more than q.c + |q| r; and
without computing q.c, no more than q.p + |q| (d(c, p) + r) for the parent's object p.  Nodes are taken up in the
order of these bounds; a node is left alone as soon as k better scores are known.

Trees are built once and stored as pages.  Each query is searched in the tree that it lies in first; its k-th score
there is a bound that the roots of all trees, in chunks, are held against, and only trees that may hold a better
vector get the query.  There a block of queries searches together, and a page is computed for those queries alone
whose bounds still allow it.  A tree is read once for ``SLICE`` blocks of queries, which stream past it.

Vectors too long for exact float64 products stay out of the trees.  They, as queries and as candidates, are
scanned: a float64 product with a bound on its error leaves out what cannot be among the k best, and the rest
is computed in Python's integers.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from palimpsest.llm.common import Tables, materialize, table

#: Vectors of a tree, of a leaf page and of a block of queries; entries of an inner page.
TREE_VECTORS = 8192
LEAF = 64
BLOCK = 512
FANOUT = 16
#: Pivots at most, roots of a chunk, and blocks of queries that one reading of a tree serves at most.
PIVOTS = 256
CHUNK = 4096
SLICE = 64
#: Squared length below which float64 products, sums and squared distances of two integer vectors are exact.
EXACT = float(1 << 51)


class MTree:
    """A bulk-loaded M-tree over integer vectors (float64 rows)."""

    def __init__(self, vectors: np.ndarray, pages: tuple[bytes, ...] | None = None):
        """``pages``: what the method of that name gave for these vectors; without it the tree is built."""
        self.vectors = vectors
        self.at: list[int] = []  # rows of the routing objects
        self.parent: list[int] = []
        self.radius: list[float] = []
        self.to_parent: list[float] = []
        self.members: list[np.ndarray] = []
        if pages is None:
            self._build(np.arange(len(vectors)))
        else:
            at, parent, radius, to_parent, sizes, members = (np.frombuffer(x, t) for x, t in zip(pages, PAGE_TYPES, strict=True))
            self.at, self.parent, self.radius, self.to_parent = at, parent, radius, to_parent
            self.members = np.split(members, np.cumsum(sizes)[:-1])
        self.center = vectors[np.asarray(self.at, np.int64)]
        self.children: list[list[int]] = [[] for _ in self.at]
        for k, above in enumerate(self.parent):
            if above >= 0:
                self.children[above].append(k)

    def pages(self) -> tuple[bytes, ...]:
        flat = np.concatenate(self.members)
        parts = (self.at, self.parent, self.radius, self.to_parent, list(map(len, self.members)), flat)
        return tuple(np.asarray(x, t).tobytes() for x, t in zip(parts, PAGE_TYPES, strict=True))

    def _node(self, rows: np.ndarray, above: int) -> int:
        own = self.vectors[rows]
        near = ((own - own.mean(0)) ** 2).sum(1).argmin()
        c = own[near]
        self.at.append(int(rows[near]))
        self.parent.append(above)
        self.radius.append(float(np.sqrt(((own - c) ** 2).sum(1).max())))
        self.to_parent.append(0.0 if above < 0 else float(np.sqrt(((c - self.vectors[self.at[above]]) ** 2).sum())))
        self.members.append(rows[:0])
        return len(self.at) - 1

    def _build(self, rows: np.ndarray) -> None:
        """A page for ``rows``: far-apart objects are picked one after another and take what is nearest to them.  The root comes first."""
        todo = [(rows, -1)]
        while todo:
            rows, above = todo.pop()
            at = self._node(rows, above)
            own = self.vectors[rows]
            if len(rows) <= LEAF or self.radius[at] == 0:
                self.members[at] = rows
                continue
            pick = int(((own - self.vectors[self.at[at]]) ** 2).sum(1).argmax())
            least, nearest = np.full(len(rows), np.inf), np.zeros(len(rows), int)
            for k in range(FANOUT):
                d = ((own - own[pick]) ** 2).sum(1)
                nearest[d < least] = k
                least = np.minimum(least, d)
                pick = int(least.argmax())
                if least[pick] == 0:
                    break
            todo += [(part, at) for k in range(FANOUT) if len(part := rows[nearest == k])]

    def search(self, queries: np.ndarray, ids: np.ndarray, own: np.ndarray, tree_rows: np.ndarray, k: int, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Scores and positions of each query's k best (short of k: -inf), less those that score under its ``known``.

        ``ids``: sort order of the tree's vectors among equal scores; ``own``: each query's row, which is
        not a candidate of its own; ``tree_rows``: the rows of the tree's vectors.
        """
        n = len(queries)
        norm = np.sqrt((queries**2).sum(1))
        best, place = np.full((n, k), -np.inf), np.full((n, k), -1)
        worst = np.full(n, -np.inf) if known is None else known.copy()
        entry = itertools.count()
        every = np.arange(n)
        at_root = queries @ self.center[0]
        heap = [(-np.inf, next(entry), 0, every, at_root, _limit(at_root, norm, self.radius[0]))]
        while heap:
            _, _, node, who, score, bound = heapq.heappop(heap)
            open_ = bound >= worst[who]  # an equal score may still win by a smaller id
            who, score = who[open_], score[open_]
            if not len(who):
                continue
            rows = self.members[node]
            if len(rows):
                found = queries[who] @ self.vectors[rows].T
                found[own[who][:, None] == tree_rows[rows][None, :]] = -np.inf
                better = np.flatnonzero(found.max(1) >= worst[who])
                who, found = who[better], found[better]
                both = np.concatenate([best[who], found], 1)
                where = np.concatenate([place[who], np.broadcast_to(rows, (len(who), len(rows)))], 1)
                order = np.lexsort((ids[where], -both), axis=1)[:, :k]
                best[who], place[who] = np.take_along_axis(both, order, 1), np.take_along_axis(where, order, 1)
                worst[who] = np.maximum(worst[who], best[who, k - 1])
                continue
            for child in self.children[node]:
                far = self.to_parent[child] + self.radius[child]
                able = _limit(score, norm[who], far) >= worst[who]  # by the stored distance, before any product
                if able.any():
                    mine = who[able]
                    inner = queries[mine] @ self.center[child]
                    limit = _limit(inner, norm[mine], self.radius[child])
                    open_ = limit >= worst[mine]
                    if open_.any():
                        heapq.heappush(heap, (-float(limit[open_].max()), next(entry), child, mine[open_], inner[open_], limit[open_]))
        place[best == -np.inf] = -1
        return best, place


#: at, parent, radius, to_parent, number of members, members of all nodes.
PAGE_TYPES = (np.int32, np.int32, np.float64, np.float64, np.int32, np.int32)
PAGES = ("at", "parent", "radius", "to_parent", "sizes", "members")


def _limit(score: np.ndarray, norm: np.ndarray, far: float | np.ndarray) -> np.ndarray:
    """What no vector within ``far`` of an object scores more than; products are exact, roots are not."""
    return score + norm * far * (1 + 1e-12) + 1e-9


def _unpack(blob: bytes, n: int, kind: type = np.int64) -> np.ndarray:
    return np.frombuffer(blob, kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def _pack(batches: Iterator[pa.RecordBatch], most: int, kind: type = np.int64) -> Iterator[pa.RecordBatch]:
    """Rows of one block each: its vectors as bytes, padded to its longest one."""
    held: list[pa.RecordBatch] = []

    def out(b: pa.Table) -> pa.RecordBatch:
        vectors = b.column("v").to_pylist()
        width = max(1, *map(len, vectors))
        flat = np.zeros((len(vectors), width), kind)
        for row, v in zip(flat, vectors, strict=True):
            row[: len(v)] = v
        lists = [pa.array([b.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("row", "vec_id")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([flat.tobytes()], pa.binary())], ["rows", "ids", "vectors"])

    for b in batches:
        held.append(b)
        while sum(x.num_rows for x in held) >= most:
            t = pa.Table.from_batches(held)
            yield out(t.slice(0, most))
            held = t.slice(most).combine_chunks().to_batches()
    if any(x.num_rows for x in held):
        yield out(pa.Table.from_batches(held))


def _met(r: dict, kind: type) -> tuple[np.ndarray, ...]:
    """rows, ids, q_rows, q_ids, vectors and queries, of one width, of a row in which two blocks meet."""
    rows, ids, q_rows, q_ids = (np.array([2**63 - 1 if x is None else x for x in r[c]], np.int64) for c in ("rows", "ids", "q_rows", "q_ids"))
    vectors, queries = _unpack(r["vectors"], len(rows), kind), _unpack(r["q_vectors"], len(q_rows), kind)
    width = max(vectors.shape[1], queries.shape[1])
    return rows, ids, q_rows, q_ids, *(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (vectors, queries))


LAST = 2**63 - 1  # in place of a null id, which comes last


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Rows of a column of lists, ending in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    n = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    width = max(1, width, int(n.max(initial=0)))
    if len(n) and (n == width).all():
        return flat.reshape(len(n), width)
    out = np.zeros((len(n), width), flat.dtype)
    out[np.arange(width)[None, :] < n[:, None]] = flat
    return out


def _wide(*matrices: np.ndarray) -> list[np.ndarray]:
    width = max(m.shape[1] for m in matrices)
    return [np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in matrices]


def _ids(column: pa.Array) -> np.ndarray:
    return column.fill_null(LAST).to_numpy(zero_copy_only=False)


def _cells(pivots: np.ndarray):
    """Adds the number of the nearest pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell = np.zeros(b.num_rows, np.int32)
            for i in range(0, b.num_rows if len(pivots) > 1 else 0, 1024):
                v, p = _wide(_matrix(b.column("v").slice(i, 1024)).astype(np.float64), pivots)
                cell[i : i + 1024] = ((p**2).sum(1)[None, :] - 2 * v @ p.T).argmin(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell)], [*b.schema.names, "cell"])

    return run


TREE = "rows array<long>, ids array<long>, asked array<boolean>, vectors binary, " + ", ".join(f"{p} binary" for p in PAGES)


def _plant(most: int):
    """Rows in the order of their buckets to trees: of one bucket each, and of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def out() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            v = _matrix(t.column("v"))
            tree = MTree(v.astype(np.float64))
            lists = [pa.array([t.column(c).to_pylist()], kind) for c, kind in (("row", pa.list_(pa.int64())), ("vec_id", pa.list_(pa.int64())), ("asked", pa.list_(pa.bool_())))]
            blobs = [pa.array([x], pa.binary()) for x in (v.tobytes(), *tree.pages())]
            held.clear()
            return pa.RecordBatch.from_arrays([*lists, *blobs], ["rows", "ids", "asked", "vectors", *PAGES])

        for b in batches:
            bucket = b.column("bucket").to_numpy()
            cuts = np.r_[0, np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, len(bucket)] if len(bucket) else np.zeros(1, int)
            for i, j in itertools.pairwise(cuts):
                if held and held[-1].column("bucket")[0].as_py() != bucket[i]:
                    yield out()
                while i < j:
                    n = min(int(j - i), most - sum(x.num_rows for x in held))
                    held.append(b.slice(i, n))
                    i += n
                    if sum(x.num_rows for x in held) >= most:
                        yield out()
        if held:
            yield out()

    return run


def _tree(r: dict) -> tuple[MTree, np.ndarray, np.ndarray]:
    """The tree of a stored row, with its rows and ids."""
    rows, ids = np.array(r["rows"], np.int64), np.array([LAST if x is None else x for x in r["ids"]], np.int64)
    return MTree(_unpack(r["vectors"], len(rows)).astype(np.float64), tuple(r[p] for p in PAGES)), rows, ids


HOME = "q_row long, query_id long, tree long, v array<long>, known double, vec_ids array<long>, scores array<long>"


def _at_home(k: int):
    """Each query with its k best in the tree that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                asked = np.flatnonzero(r["asked"])
                tree, rows, ids = _tree(r)
                for i in range(0, len(asked), BLOCK):
                    mine = asked[i : i + BLOCK]
                    best, place = tree.search(tree.vectors[mine], np.append(ids, 0), rows[mine], rows, k)
                    found = [x[x >= 0] for x in place]
                    cand = [[None if ids[j] == LAST else int(ids[j]) for j in x] for x in found]
                    score = [s[: len(x)].astype(np.int64).tolist() for s, x in zip(best, found, strict=True)]
                    columns = [rows[mine], ids[mine], np.full(len(mine), r["tree"]), tree.vectors[mine].astype(np.int64).tolist(), best[:, k - 1], cand, score]
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q_row", "query_id", "tree", "v", "known", "vec_ids", "scores"])

    return run


def _packed(table: pa.Table, columns: list[tuple[str, str, pa.DataType]]) -> list[pa.Array]:
    """One row: the vectors ``v`` as bytes, and other columns as lists."""
    return [pa.array([_matrix(table.column("v")).tobytes()], pa.binary()), *[pa.array([table.column(c).to_pylist()], pa.list_(t)) for c, _, t in columns]]


def _pages_of(most: int, columns: list[tuple[str, str, pa.DataType]]):
    """Rows with vectors ``v`` to rows of ``most`` of them each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            held.append(b)
            while sum(x.num_rows for x in held) >= most:
                t = pa.Table.from_batches(held)
                yield pa.RecordBatch.from_arrays(_packed(t.slice(0, most), columns), ["vs", *[n for _, n, _ in columns]])
                held = t.slice(most).combine_chunks().to_batches()
        if any(x.num_rows for x in held):
            yield pa.RecordBatch.from_arrays(_packed(pa.Table.from_batches(held), columns), ["vs", *[n for _, n, _ in columns]])

    return run


Q_COLUMNS = [("q_row", "q_rows", pa.int64()), ("query_id", "q_ids", pa.int64()), ("tree", "homes", pa.int64()), ("known", "knowns", pa.float64())]
R_COLUMNS = [("tree", "trees", pa.int64()), ("radius", "radii", pa.float64())]


def _roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for r in b.to_pylist():
            root = int(np.frombuffer(r["at"], np.int32)[0])
            v = _unpack(r["vectors"], r["n"])[root].tolist()
            yield pa.RecordBatch.from_arrays([pa.array([r["tree"]]), pa.array([float(np.frombuffer(r["radius"], np.float64)[0])]), pa.array([v], pa.list_(pa.int64()))], ["tree", "radius", "v"])


SENT = "tree long, q_rows array<long>, q_ids array<long>, q_vectors binary, knowns array<double>"


def _sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block of queries and a chunk of roots to the queries that each tree is to see."""
    for b in batches:
        for r in b.to_pylist():
            q, c = _wide(_unpack(r["q_vectors"], len(r["q_rows"])), _unpack(r["r_vectors"], len(r["trees"])))
            rows, ids, homes, known = np.array(r["q_rows"]), np.array(r["q_ids"]), np.array(r["homes"]), np.array(r["knowns"])
            qf = q.astype(np.float64)
            limit = _limit(qf @ c.astype(np.float64).T, np.sqrt((qf**2).sum(1))[:, None], np.array(r["radii"])[None, :])
            able = (limit >= known[:, None]) & (homes[:, None] != np.array(r["trees"])[None, :])
            for k, tree in enumerate(r["trees"]):
                w = np.flatnonzero(able[:, k])
                if len(w):
                    lists = [pa.array([x[w].tolist()], pa.list_(t)) for x, t in ((rows, pa.int64()), (ids, pa.int64()), (known, pa.float64()))]
                    yield pa.RecordBatch.from_arrays([pa.array([tree]), lists[0], lists[1], pa.array([q[w].tobytes()], pa.binary()), lists[2]], ["tree", "q_rows", "q_ids", "q_vectors", "knowns"])


def _search(k: int):
    """A tree, then the queries that it is to see, then the next tree: each is read once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = rows = ids = None
        for b in batches:
            for one in range(b.num_rows):
                r = b.slice(one, 1).to_pylist()[0]
                if r["kind"] == 0:
                    tree, rows, ids = _tree(r)
                    continue
                q_rows, q_ids, known = np.array(r["q_rows"]), np.array(r["q_ids"]), np.array(r["knowns"])
                queries, vectors = _wide(_unpack(r["q_vectors"], len(q_rows)), tree.vectors)
                if vectors.shape[1] > tree.vectors.shape[1]:
                    tree = MTree(vectors, tuple(np.asarray(x, t).tobytes() for x, t in zip((tree.at, tree.parent, tree.radius, tree.to_parent, list(map(len, tree.members)), np.concatenate(tree.members)), PAGE_TYPES, strict=True)))
                best, place = tree.search(queries.astype(np.float64), np.append(ids, 0), q_rows, rows, k, known)
                who, rank = np.nonzero(place >= 0)
                at = place[who, rank]
                cand = [None if x == LAST else int(x) for x in ids[at]]
                yield pa.RecordBatch.from_arrays([pa.array(q_rows[who]), pa.array(q_ids[who]), pa.array(cand, pa.int64()), pa.array(best[who, rank].astype(np.int64))], ["q_row", "query_id", "vec_id", "score"])

    return run


def _by_trees(held: Tables, small: DataFrame, k: int, most: int) -> DataFrame:
    """q_row, query_id, vec_id, score: for each row that is ``asked`` at least its k best among ``small`` (row, vec_id, asked, v)."""
    spark = small.sparkSession
    trees = -(-small.count() // most)
    sample = small.orderBy(F.xxhash64(F.lit("pivot"), "row"), "row").limit(min(PIVOTS, trees)).select("v").toArrow() if trees > 1 else None
    pivots = np.zeros((1, 1)) if sample is None else _matrix(sample.column("v")).astype(np.float64)
    kinds = "row long, vec_id long, asked boolean, v array<long>"
    dealt = held.cut(small.mapInArrow(_cells(pivots), kinds + ", cell int"), "dealt")
    cells = dealt.groupBy("cell").agg(F.count("*").alias("n")).orderBy("cell").collect()  # a row for each pivot at most
    parts = [-(-r["n"] // most) for r in cells]
    starts = dict(zip((r["cell"] for r in cells), itertools.accumulate([0, *parts]), strict=False))
    table_of = F.create_map(*[x for r, n in zip(cells, parts, strict=True) for x in (F.lit(r["cell"]), F.struct(F.lit(starts[r["cell"]]).alias("start"), F.lit(n).alias("n")))]) if cells else None
    if table_of is None:
        return spark.createDataFrame([], "q_row long, query_id long, vec_id long, score long")
    of = table_of[F.col("cell")]
    bucket = (of["start"] + F.pmod(F.xxhash64("row"), of["n"])).cast("int")
    planted = dealt.withColumn("bucket", bucket).repartition(max(1, sum(parts)), F.xxhash64("bucket")).sortWithinPartitions("bucket", "row").mapInArrow(_plant(most), TREE)
    trees = held.cut(planted.withColumn("tree", F.monotonically_increasing_id()), "trees")

    tasks = max(1, spark.sparkContext.defaultParallelism)
    home = held.cut(trees.repartition(tasks, F.xxhash64("tree")).mapInArrow(_at_home(k), HOME), "home")
    queries = home.mapInArrow(_pages_of(BLOCK, Q_COLUMNS), "vs binary, q_rows array<long>, q_ids array<long>, homes array<long>, knowns array<double>").withColumnRenamed("vs", "q_vectors")
    queries = held.cut(queries.withColumn("block", F.monotonically_increasing_id()), "queries")
    roots = trees.select("tree", F.size("rows").alias("n"), "at", "radius", "vectors").mapInArrow(_roots, "tree long, radius double, v array<long>")
    chunks = max(1, -(-trees.count() // CHUNK))
    roots = roots.repartition(chunks, F.xxhash64("tree")).mapInArrow(_pages_of(CHUNK, R_COLUMNS), "vs binary, trees array<long>, radii array<double>").withColumnRenamed("vs", "r_vectors")
    roots = held.cut(roots.withColumn("chunk", F.spark_partition_id()), "roots")

    to_chunks = queries.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    sent = to_chunks.join(roots.hint("merge"), "chunk").repartition(tasks, F.xxhash64("block", "trees")).mapInArrow(_sent, SENT)
    slices = max(1, -(-queries.count() // SLICE))
    sent = sent.select("tree", F.pmod(F.xxhash64("q_rows"), F.lit(slices)).alias("slice"), F.lit(1).alias("kind"), "q_rows", "q_ids", "q_vectors", "knowns")
    of_trees = trees.select("tree", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(slices - 1).cast("long"))).alias("slice"), F.lit(0).alias("kind"), "rows", "ids", "vectors", *PAGES)
    every = of_trees.unionByName(sent, allowMissingColumns=True)
    every = every.repartition(max(tasks, int(spark.conf.get("spark.sql.shuffle.partitions"))), F.xxhash64("tree", "slice")).sortWithinPartitions("tree", "slice", "kind")
    away = every.mapInArrow(_search(k), "q_row long, query_id long, vec_id long, score long")
    here = home.select("q_row", "query_id", F.explode(F.arrays_zip("vec_ids", "scores")).alias("x")).select("q_row", "query_id", F.col("x.vec_ids").alias("vec_id"), F.col("x.scores").alias("score"))
    return materialize(here.union(away), "found")


def _integers(v: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of each component, in Python's integers."""
    return np.array([math.floor(scale * x) if math.isfinite(scale * x) else scale * int(x) for x in v.tolist()], object)


def _order_key(score: int) -> bytes:
    """Bytes that sort as integers do: sign and length, then the magnitude, inverted below zero."""
    n = max(8, -(-abs(score).bit_length() // 8))
    if score >= 0:
        return ((1 << 31) + n).to_bytes(4) + score.to_bytes(n)
    return ((1 << 31) - 1 - n).to_bytes(4) + (256**n - 1 + score).to_bytes(n)


def scan(queries: np.ndarray, vectors: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int, scale: int) -> Iterator[list[tuple[int, int]]]:
    """For each query its k best (exact score, position) by score, then by id; ``own``: pairs that do not count."""
    with np.errstate(over="ignore", invalid="ignore"):
        q, v = np.floor(scale * queries), np.floor(scale * vectors)
        near = q @ v.T
        off = (q.shape[1] + 4) * 2.0**-52 * np.sqrt((q**2).sum(1))[:, None] * np.sqrt((v**2).sum(1))[None, :]
        least, most = near - off, near + off
    unknown = ~(np.isfinite(least) & np.isfinite(most))  # too large for float64
    least[unknown], most[unknown] = -np.inf, np.inf
    least[own] = -np.inf
    floor = np.partition(least, -k, axis=1)[:, -k] if len(vectors) > k else np.full(len(queries), -np.inf)
    maybe = (most >= floor[:, None]) & ~own
    _, same = np.unique(vectors, axis=0, return_inverse=True)  # a vector that is there many times is computed once
    known: dict[int, np.ndarray] = {}
    for i, query in enumerate(queries):
        mine, score = _integers(query, scale), {}
        for j in np.flatnonzero(maybe[i]):
            if (at := int(same[j])) not in score:
                if at not in known:
                    known[at] = _integers(vectors[j], scale)
                score[at] = int(mine @ known[at])
        yield heapq.nsmallest(k, ((score[int(same[j])], int(j)) for j in np.flatnonzero(maybe[i])), key=lambda x: (-x[0], ids[x[1]]))


def _scan(k: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                rows, ids, q_rows, q_ids, vectors, queries = _met(r, np.float64)
                out = []
                for at, best in enumerate(scan(queries, vectors, q_rows[:, None] == rows[None, :], ids, k, scale)):
                    for score, j in best:
                        cand = None if ids[j] == 2**63 - 1 else int(ids[j])
                        out.append((int(q_rows[at]), int(q_ids[at]), cand, score if -(2**63) <= score < 2**63 else None, _order_key(score)))
                columns = zip(*out, strict=True) if out else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["q_row", "query_id", "vec_id", "score", "place"])

    return run


def top_k(vectors: DataFrame, k: int, is_query, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", tree_vectors: int = TREE_VECTORS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all other rows.

    Each component x counts as floor(scale * x).  A vector that is null or holds a null or a component that
    is not finite takes no part.  Shorter vectors count as ending in zeros.  Ties go to the smaller id, null
    ids last; repeated rows are candidates of each other; a query with fewer than k candidates has fewer
    rows; an empty table gives none; other columns, long texts too, are ignored.  Ranks are exact at any size; a score that no long holds is null.
    """
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    fine = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), x.alias("x")).where(F.col("x").isNotNull() & fine)
    squares = F.aggregate("x", F.lit(0.0), lambda a, c: a + (F.abs(c * scale) + 1) * (F.abs(c * scale) + 1))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", (squares >= EXACT).alias("long"))
    rows = materialize(rows, "vectors")
    asked = is_query(F.col("vec_id"))
    small, large = rows.where("NOT long"), rows.where("long")

    v = F.transform("x", lambda c: F.floor(scale * c)).alias("v")
    with Tables(vectors.sparkSession) as held:
        found = _by_trees(held, small.select("row", "vec_id", F.coalesce(asked, F.lit(False)).alias("asked"), v), k, tree_vectors)
    order = [F.desc("score")]
    if large.limit(1).count():
        exact = "q_row long, query_id long, vec_id long, score long, place binary"
        of_scans = [df.select("row", "vec_id", F.col("x").alias("v")) for df in (rows, large, small)]
        both = [(of_scans[0].where(asked), of_scans[1]), (of_scans[1].where(asked), of_scans[2])]
        digits = F.when(F.col("score") >= 0, F.concat(F.lit("80000008"), F.lpad(F.hex("score"), 16, "0"))).otherwise(F.concat(F.lit("7FFFFFF7"), F.hex(F.col("score") - 1)))
        found = found.withColumn("place", F.unhex(digits))
        for q, c in both:
            found = found.union(_meet(q, c, np.float64).mapInArrow(_scan(k, scale), exact))
        order = [F.desc("place")]
    window = Window.partitionBy("q_row").orderBy(*order, F.col("vec_id").asc_nulls_last())
    ranked = found.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _meet(queries: DataFrame, vectors: DataFrame, kind: type) -> DataFrame:
    """Each block of queries with each tree's vectors, both packed; (row, vec_id, v) on either side."""
    spark = vectors.sparkSession
    packed = "rows array<long>, ids array<long>, vectors binary"
    trees = vectors.repartition(_groups(vectors, TREE_VECTORS), F.xxhash64("row")).mapInArrow(lambda b: _pack(b, TREE_VECTORS, kind), packed)
    numbered = trees.withColumn("tree", F.monotonically_increasing_id()).withColumn("bucket", F.spark_partition_id())
    trees = materialize(numbered, "trees")
    last = trees.agg(F.max("bucket")).first()[0] or 0
    blocks = queries.repartition(_groups(queries, BLOCK), F.xxhash64("row")).mapInArrow(lambda b: _pack(b, BLOCK, kind), packed)
    blocks = materialize(blocks.toDF("q_rows", "q_ids", "q_vectors"), "blocks")

    # Each block is sent to each bucket of one or a few trees; a row of the join holds one of either, a few MB.
    to_trees = blocks.withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(last))))
    met = to_trees.join(trees, "bucket").repartition(max(1, spark.sparkContext.defaultParallelism), "tree", F.xxhash64("q_rows"))
    return met.select("tree", "rows", "ids", "vectors", "q_rows", "q_ids", "q_vectors")


def _groups(df: DataFrame, size: int) -> int:
    return max(1, -(-df.count() // size))


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), 20, lambda i: i % 20 == 0)


OP6_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
