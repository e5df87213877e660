"""Nearest neighbours by vantage-point trees, one per shard.

Vectors are scaled to length one, where the Euclidean distance is a metric that orders like cosine.
Each shard's distinct vectors form a vantage-point tree: a node splits its vectors at the median
distance from one of them. A query that has its k-th best at distance t skips the side that the
triangle inequality says is farther than t: where ``factor`` times the distance to the border
exceeds t. A factor over one prunes more and may miss some; factor one (the default) is exact.
What the trees propose is scored again in double precision, component by component, on the original
vectors, which also decides ties.

Scale: a tree holds at most about ``SHARD_ROWS`` vectors, is built once and written to the shared
folder, and so are the queries, in blocks of about ``QUERY_BLOCK``; a task takes one tree and reads the
blocks one by one from that folder, so neither is shuffled for their pairs, and neither comes to the
driver. (Where Arrow can't open the folder, trees and blocks meet in a join, which copies them.) Each
search returns k rows a query, which are merged by query. Equal vectors are one entry of a tree, with
their k + 1 smallest ids, which is all that an answer can need. Where an id has several vectors, a
search takes as many times more entries.

Defined results: vectors that are null, empty, zero or hold a null or a non-finite component take no
part; of vectors of different lengths only equal lengths are compared; null ids take no part; equal rows
count once, an id with several vectors is a query and a candidate with each of them, the better score
of a pair counts, and never is an id its own neighbour; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm import common as C

SHARD_ROWS = 16_384
QUERY_BLOCK = 16_384
#: Vectors of a node that isn't split any more.
LEAF = 256
#: Error of a distance from rounding; what is this near to the k-th is kept and scored exactly.
SLACK = 1e-7
FACTOR = 1.0
#: Proposals that a search holds before it drops those that nearer ones have replaced.
MAX_PAIRS = 1_000_000


def cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, each sum from the first component to the last."""
    dot, aa, bb = (np.zeros(len(a)) for _ in range(3))
    for j in range(a.shape[1]):
        dot += a[:, j] * b[:, j]
        aa += a[:, j] * a[:, j]
        bb += b[:, j] * b[:, j]
    return dot / (np.sqrt(aa) * np.sqrt(bb))


class Tree:
    """Vantage-point tree over distinct vectors of one length."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, keep: int):
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        _, first, group = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_index=True, return_inverse=True)
        by = np.argsort(group, kind="stable")  # within a vector by id
        rank = np.arange(len(by)) - np.searchsorted(group[by], group[by])
        by = by[rank < keep]
        self.owner_ids, owner = ids[by], group[by]
        self.owner_at = np.searchsorted(owner, np.arange(len(first) + 1))
        self.vectors = vectors[first]
        self.unit = self.vectors / np.linalg.norm(self.vectors, axis=1, keepdims=True)
        self.members = np.arange(len(first))
        self.nodes: list[tuple] = []
        if len(first):
            self._split(0, len(first))

    def _split(self, lo: int, hi: int) -> int:
        """The node of members[lo:hi]: (lo, hi, vantage, radius, inner, outer); vantage -1 for a leaf."""
        at = len(self.nodes)
        self.nodes.append((lo, hi, -1, 0.0, -1, -1))
        if hi - lo > LEAF:
            m = self.members[lo:hi]
            # the member farthest from the first one sees the others at the most different distances
            v = m[np.argmin(self.unit[m] @ self.unit[m[0]])]
            d = self._distance(self.unit[m], self.unit[v])
            order = np.argsort(d, kind="stable")
            mid = (hi - lo) // 2
            self.members[lo:hi] = m[order]
            inner, outer = self._split(lo, lo + mid), self._split(lo + mid, hi)
            self.nodes[at] = (lo, hi, int(v), (float(d[order[mid - 1]]), float(d[order[mid]])), inner, outer)
        return at

    @staticmethod
    def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b)))

    def search(self, q: np.ndarray, k: int, factor: float = FACTOR) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, vector) that hold each query's k nearest entries, of equal vectors one for all."""
        unit = q / np.linalg.norm(q, axis=1, keepdims=True)
        best = np.full((len(q), k), np.inf)
        pairs: list[tuple[np.ndarray, ...]] = []

        def compact() -> tuple[np.ndarray, ...]:
            i, j, d = map(np.concatenate, zip(*pairs, strict=True))
            near = d <= best[i, -1] + SLACK
            return i[near], j[near], d[near]

        def visit(node: int, who: np.ndarray, bound: np.ndarray) -> None:
            near = bound * factor <= best[who, -1] + SLACK
            who = who[near]
            if not len(who):
                return
            lo, hi, v, radius, inner, outer = self.nodes[node]
            if v < 0:
                m = self.members[lo:hi]
                d = np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (unit[who] @ self.unit[m].T)))
                both = np.concatenate([best[who], d], axis=1)
                both.partition(k - 1, axis=1)
                top = np.sort(both[:, :k], axis=1)
                best[who] = top
                i, j = np.nonzero(d <= top[:, -1:] + SLACK)
                pairs.append((who[i], m[j], d[i, j]))
                if sum(len(p[0]) for p in pairs) > MAX_PAIRS:
                    pairs[:] = [compact()]
                return
            d = self._distance(unit[who], self.unit[v])
            b = bound[near]
            inside = d <= (radius[0] + radius[1]) / 2
            to_inner, to_outer = np.maximum(b, d - radius[0]), np.maximum(b, radius[1] - d)
            for sel, order in ((inside, (inner, outer)), (~inside, (outer, inner))):
                if sel.any():
                    for child in order:
                        visit(child, who[sel], (to_inner if child == inner else to_outer)[sel])

        if len(self.members):
            visit(0, np.arange(len(q)), np.full(len(q), -np.inf))
        return compact()[:2] if pairs else (np.zeros(0, dtype=int), np.zeros(0, dtype=int))


def top(tree: Tree, ids: np.ndarray, q: np.ndarray, k: int, factor: float, per_id: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query number, vec_id, score) of each query's k best ids in the tree, itself left out.

    per_id: how many different vectors an id may have.
    """
    # one id more, since a query's own vectors may be among them
    i, j = tree.search(q, (k + 1) * per_id, factor)
    score = cosine(q[i], tree.vectors[j])
    n = tree.owner_at[j + 1] - tree.owner_at[j]
    at = np.repeat(tree.owner_at[j] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
    i, score, found = np.repeat(i, n), np.repeat(score, n), tree.owner_ids[at]
    other = found != ids[i]
    i, score, found = i[other], score[other], found[other]
    order = np.lexsort((found, -score, i))
    if per_id > 1:  # of an id's vectors the best
        order = order[np.lexsort((np.arange(len(order)), found[order], i[order]))]
        same = np.concatenate(([False], (i[order][1:] == i[order][:-1]) & (found[order][1:] == found[order][:-1])))[: len(order)]
        order = order[~same]
        order = order[np.lexsort((found[order], -score[order], i[order]))]
    i, score, found = i[order], score[order], found[order]
    first = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[first], found[first], score[first]


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v, the vector, of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("v")).filter("vec_id is not null and v is not null")
    square = lambda x: x.cast("double") * x.cast("double")
    finite = F.forall("v", lambda x: F.coalesce(square(x) - square(x) == 0.0, F.lit(False)))
    return rows.filter(finite & F.exists("v", lambda x: square(x) > 0.0))


def build(vectors: DataFrame, k: int, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row a tree, pickled by numpy: dim, shard, tree."""
    spark = vectors.sparkSession
    rows = usable(vectors).withColumn("dim", F.size("v"))
    dims = {r[0]: r[1] for r in rows.groupBy("dim").count().collect()}  # as many rows as there are vector lengths
    # by the vector, so that equal ones meet in one tree and are one entry there
    shards = F.element_at(F.create_map(*[F.lit(x) for d, n in dims.items() for x in (d, -(-n // shard_rows))]), F.col("dim")) if dims else F.lit(1)
    # each task leaves k + 1 ids of a vector before anything is shuffled, so a frequent one is no hot key
    few = rows.dropDuplicates(["vec_id", "v"]).withColumn("r", F.row_number().over(Window.partitionBy("dim", "v").orderBy("vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    keyed = few.withColumn("shard", F.pmod(F.xxhash64("v"), shards).cast("int"))
    schema = "dim int, shard int, tree binary"
    arrow = C.arrow_schema(spark, schema)

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        v = pa.compute.list_flatten(table.column("v")).to_numpy().astype(np.float64).reshape(-1, dim)
        t = Tree(table.column("vec_id").to_numpy(), v, k + 1)
        return pa.table({"dim": [dim], "shard": [key[1].as_py()], "tree": [pickle.dumps(t, protocol=5)]}, schema=arrow)

    return keyed.groupBy("dim", "shard").applyInArrow(one, schema)


def blocks(queries: DataFrame, query_block: int) -> DataFrame:
    """The queries as rows of dim, block, ids and v, the vectors one after another as doubles."""
    rows = usable(queries).withColumn("dim", F.size("v"))
    sizes = rows.groupBy("dim").agg(F.ceil(F.count("*") / query_block).alias("blocks"))
    dealt = rows.join(F.broadcast(sizes), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    schema = "dim int, block int, ids array<long>, v binary"
    arrow = C.arrow_schema(queries.sparkSession, schema)

    def one(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        v = pa.compute.list_flatten(table.column("v")).to_numpy().astype(np.float64)
        return pa.table({"dim": [key[0].as_py()], "block": [key[1].as_py()], "ids": [table.column("vec_id").to_numpy()], "v": [v.tobytes()]}, schema=arrow)

    return dealt.select("dim", "block", "vec_id", "v").groupBy("dim", "block").applyInArrow(one, schema)


def opens(path: str) -> bool:
    """Whether tasks can read a folder by Arrow's file systems."""
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return False
    return True


def stored_blocks(path: str, dim: int) -> Iterator[tuple[list[int], bytes]]:
    """The written query blocks of one vector length, one at a time and in one order for all tasks."""
    store, root = fs.FileSystem.from_uri(path)
    for f in sorted(store.get_file_info(fs.FileSelector(root)), key=lambda f: f.path):
        if f.is_file and f.base_name.startswith("part-"):
            with store.open_input_file(f.path) as opened:
                for b in pq.ParquetFile(opened).iter_batches(batch_size=1, columns=["dim", "ids", "v"]):
                    if b.column(0)[0].as_py() == dim:
                        yield b.column(1)[0].values.to_numpy(), b.column(2)[0].as_py()


def nearest(queries: DataFrame, vectors: DataFrame, k: int = 5, factor: float = FACTOR, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest vectors but its own."""
    spark = vectors.sparkSession
    C.small_batches(spark)
    per_id = usable(vectors).dropDuplicates(["vec_id", "v"]).groupBy("vec_id").count().agg(F.max("count")).first()[0] or 1
    trees = C.materialise(build(vectors, k, shard_rows), "trees")
    asked = C.materialise(blocks(queries, query_block), "queries")
    schema = "query_id long, vec_id long, score double"
    arrow = C.arrow_schema(spark, schema)

    stored = asked._gridloom_path

    def searched(tree: bytes | Tree, dim: int, ids: list[int] | np.ndarray, v: bytes) -> pa.RecordBatch:
        own = np.array(ids, dtype=np.int64)
        i, found, s = top(tree if isinstance(tree, Tree) else pickle.loads(tree), own, np.frombuffer(v).reshape(-1, dim), k, factor, per_id)
        return pa.RecordBatch.from_arrays([pa.array(own[i]), pa.array(found), pa.array(s)], schema=arrow)

    def fetched(batches):
        """A tree with each of its share of the blocks, which are read here one at a time."""
        for batch in batches:
            for dim, packed, share, shares in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tree = pickle.loads(packed)
                for n, block in enumerate(stored_blocks(stored, dim)):
                    if n % shares == share:
                        yield searched(tree, dim, *block)

    def moved(batches):
        for batch in batches:
            for dim, tree, ids, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield searched(tree, dim, ids, v)

    if opens(stored):
        # trees stay whole and blocks are read where they are needed; few trees are dealt out several times, each time for some of the blocks
        n_trees, n_blocks = max(1, trees.count()), max(1, asked.count())
        shares = max(1, min(n_blocks, -(-spark.sparkContext.defaultParallelism // n_trees)))
        dealt = trees.select("dim", "tree", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"), F.lit(shares).alias("shares"))
        each = (dealt.repartition(n_trees * shares, "share", "tree") if shares > 1 else dealt).mapInArrow(fetched, schema)
    else:
        # one row for each tree and block of one vector length
        pairs = trees.select("dim", "shard").join(asked.select("dim", "block"), "dim")
        n = max(1, min(10_000, pairs.count()))
        each = pairs.join(trees, ["dim", "shard"]).join(asked, ["dim", "block"]).select("dim", "tree", "ids", "v").repartition(n).mapInArrow(moved, schema)
    found = each.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
