"""Exact top-k search with M-trees (operator 4).

The vectors are cut into shards by hash and every shard is bulk-loaded into an M-tree: pages of at most
`PAGE` entries with a pivot, a covering radius and the distance to the parent's pivot.  An inner product is
turned into a metric by one more coordinate that gives all vectors of a shard the same length, so that the
nearest are those of the highest product.  A query visits pages by their least possible distance; stored
distances to the parent rule out entries by the triangle inequality before any distance is computed.  Products
of the entries left are exact integers.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from atril.llm.common import materialise
from atril.operators.scale import top_n, union_all

SHARD_ROWS = 4096
PAGE = 64
#: Bytes of the queries sent to the tasks at once.
QUERY_BYTES = 16 << 20


def usable(vector: str = "embedding") -> F.Column:
    """Not null, and all components are finite numbers."""
    limit = F.lit(float("inf")).cast("double")
    return F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < limit))


def quantise(vectors: DataFrame, scale: int = 1024) -> DataFrame:
    """vec_id and `v`, the components as floor(scale * x)."""
    return vectors.where(F.col("vec_id").isNotNull() & usable()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


class MTree:
    """Pages in arrays.  Node 0 is the root; entries of a leaf are rows, those of an inner node are nodes."""

    def __init__(self, points: np.ndarray, page: int = PAGE):
        self.points, self.page = points, page
        self.pivot: list[int] = []
        self.radius: list[float] = []
        self.leaf: list[bool] = []
        self.entries: list[np.ndarray] = []
        self.to_parent: list[np.ndarray] = []  # distances of the entries' (pivots') to this node's pivot
        self._load(np.arange(len(points)), 0)

    def _distance(self, rows: np.ndarray, pivot: int) -> np.ndarray:
        return np.sqrt(((self.points[rows] - self.points[pivot]) ** 2).sum(axis=1))

    def _load(self, rows: np.ndarray, depth: int) -> int:
        node = len(self.pivot)
        centre = self.points[rows].mean(axis=0)
        pivot = int(rows[((self.points[rows] - centre) ** 2).sum(axis=1).argmin()])
        far = self._distance(rows, pivot)
        self.pivot.append(pivot)
        self.radius.append(float(far.max()))
        self.leaf.append(len(rows) <= self.page)
        self.entries.append(rows)
        self.to_parent.append(far)
        if self.leaf[node]:
            return node
        fan = min(self.page, math.ceil(len(rows) / self.page))
        seeds = [int(far.argmax())]  # farthest-first seeds; the rows go to the nearest, and full groups overflow evenly
        nearest = self._distance(rows, int(rows[seeds[0]]))
        while len(seeds) < fan:
            seeds.append(int(nearest.argmax()))
            nearest = np.minimum(nearest, self._distance(rows, int(rows[seeds[-1]])))
        to_seed = np.stack([self._distance(rows, int(rows[s])) for s in seeds])
        group = to_seed.argmin(axis=0)
        if len(np.unique(group)) == 1 or np.bincount(group).max() > 0.9 * len(rows):  # ties, copies: any even split is right
            group = np.argsort(np.argsort(to_seed[0], kind="stable"), kind="stable") * fan // len(rows)
        children = [self._load(rows[group == g], depth + 1) for g in range(fan) if (group == g).any()]
        self.entries[node] = np.array(children)
        self.to_parent[node] = self._distance(np.array([self.pivot[c] for c in children]), pivot)
        return node

    def pages(self) -> dict[str, list]:
        return {
            "pivot": self.pivot, "radius": self.radius, "leaf": self.leaf,
            "entries": [e.tolist() for e in self.entries], "to_parent": [d.tolist() for d in self.to_parent],
        }


class Shard:
    """A stored tree: ids, integer vectors, metric coordinates and pages."""

    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.vectors = np.frombuffer(row["vectors"], np.int64).reshape(len(self.ids), row["width"])
        self.length2 = row["length2"]
        self.points = lengthened(self.vectors, self.length2)
        self.pivot, self.radius, self.leaf = np.array(row["pivot"]), np.array(row["radius"]), row["leaf"]
        self.entries = [np.array(e, np.int64) for e in row["entries"]]
        self.to_parent = [np.array(d, float) for d in row["to_parent"]]

    def search(self, query_id: int, query: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Heap `best` of (score, -vec_id), at most k, after this shard.

        Squared distance = |q|² + length² - 2 q.x, so a bound on the score bounds the distance.  A page or entry is passed over
        only if its score must be below the k-th; `slack` covers rounding.
        """
        q = np.append(query.astype(float), 0.0)
        whole = float(q @ q) + self.length2
        slack = 1e-9 * (math.sqrt(whole) + 1)

        def reach() -> float:
            if len(best) < k:
                return math.inf
            return math.sqrt(max(0.0, whole - 2.0 * best[0][0])) + slack

        first = float(np.sqrt(((self.points[self.pivot[0]] - q) ** 2).sum()))
        todo = [(max(0.0, first - self.radius[0]), 0, first)]
        while todo:
            least, node, own = heapq.heappop(todo)
            limit = reach()
            if least > limit:
                break
            entries, stored = self.entries[node], self.to_parent[node]
            apart = np.abs(own - stored)
            if self.leaf[node]:
                rows = entries[apart <= limit]
                scores = self.vectors[rows] @ query
                ids = self.ids[rows]
                keep = ids != query_id
                if len(best) >= k:
                    keep &= scores >= best[0][0]
                for s, i in zip(scores[keep].tolist(), ids[keep].tolist(), strict=True):
                    if len(best) < k:
                        heapq.heappush(best, (s, -i))
                    elif (s, -i) > best[0]:
                        heapq.heapreplace(best, (s, -i))
            else:
                near = entries[apart - self.radius[entries] <= limit]
                if len(near):
                    d = np.sqrt(((self.points[self.pivot[near]] - q) ** 2).sum(axis=1))
                    for e, x in zip(near.tolist(), d.tolist(), strict=True):
                        bound = max(0.0, x - self.radius[e])
                        if bound <= limit:
                            heapq.heappush(todo, (bound, e, x))
        return best


def lengthened(vectors: np.ndarray, length2: float) -> np.ndarray:
    points = vectors.astype(float)
    rest = np.sqrt(np.maximum(0.0, length2 - (points**2).sum(axis=1)))
    return np.column_stack([points, rest])


_SHARD = pa.schema([
    ("shard", pa.int64()), ("width", pa.int32()), ("ids", pa.binary()), ("vectors", pa.binary()), ("length2", pa.float64()),
    ("pivot", pa.list_(pa.int32())), ("radius", pa.list_(pa.float64())), ("leaf", pa.list_(pa.bool_())),
    ("entries", pa.list_(pa.list_(pa.int32()))), ("to_parent", pa.list_(pa.list_(pa.float64()))),
])


def build(vectors: DataFrame, shard_rows: int = SHARD_ROWS, page: int = PAGE) -> DataFrame:
    """M-trees of the vectors (vec_id, v), one row per shard and vector width, written to the shared folder."""
    rows = max(1, vectors.count())
    sharded = vectors.withColumn("width", F.size("v")).withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(math.ceil(rows / shard_rows))))

    def load(table: pa.Table) -> pa.Table:
        ids = table["vec_id"].to_numpy()
        order = np.argsort(ids, kind="stable")
        width = table["width"][0].as_py()
        flat = table["v"].combine_chunks().flatten().to_numpy().reshape(len(ids), width)[order]
        length2 = float((flat.astype(float) ** 2).sum(axis=1).max()) if width else 0.0
        tree = MTree(lengthened(flat, length2), page)
        row = {"shard": table["shard"][0].as_py(), "width": width, "ids": ids[order].tobytes(), "vectors": np.ascontiguousarray(flat).tobytes(), "length2": length2}
        return pa.Table.from_pylist([row | tree.pages()], schema=_SHARD)

    return materialise(sharded.groupBy("shard", "width").applyInArrow(load, from_arrow_schema(_SHARD)), "mtree")


def search(queries: DataFrame, trees: DataFrame, k: int = 10, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """The k highest integer products for each query (vec_id, v): query_id, rank, vec_id, score.

    Ties go to the smaller vec_id.  A candidate with the query's own vec_id is the query itself; vectors of another width
    have no product with it.  Queries go to the tasks in blocks of at most `query_bytes`; a task carries the k best of
    a query from shard to shard, so later shards are cut by earlier ones and k rows per task and query are shuffled.
    Products must fit in a long.  Repeated query ids are searched once, by their smallest vector; repeated rows among the
    candidates each count.
    """
    spark = trees.sparkSession
    once = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    size = once.agg(F.sum(F.size("v") * 8 + 16).alias("b")).first().b or 0
    blocks = math.ceil(size / query_bytes)
    if not blocks:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    part = once.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    found = []
    for b in range(blocks):
        own = spark.sparkContext.broadcast([(r.vec_id, np.array(r.v, np.int64)) for r in part.where(F.col("block") == b).collect()])

        def run(batches: Iterator[pa.RecordBatch], own=own) -> Iterator[pa.RecordBatch]:
            best: list[list] = [[] for _ in own.value]
            for batch in batches:
                for i in range(batch.num_rows):
                    tree = Shard(batch.slice(i, 1).to_pylist()[0])
                    for (query_id, q), heap in zip(own.value, best, strict=True):
                        if len(q) == tree.vectors.shape[1]:
                            tree.search(query_id, q, k, heap)
            rows = [(q[0], -i, s) for q, heap in zip(own.value, best, strict=True) for s, i in heap]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_pydict({"query_id": pa.array(a, pa.int64()), "vec_id": pa.array(b, pa.int64()), "score": pa.array(c, pa.int64())})

        found.append(trees.mapInArrow(run, "query_id long, vec_id long, score long"))
    return top_n(union_all(found), ["query_id"], [F.desc("score"), F.asc("vec_id")], k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
