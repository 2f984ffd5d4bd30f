"""Near-duplicate vectors by navigable small-world graphs (operator 5).

Equal vectors of a label are one point with a count.  The points of a label are cut into shards by hash, each
shard gets a hierarchical navigable small-world graph, and every shard is searched for the points of every
shard of its label.  A search keeps a beam of the best points met; a query whose beam holds only links is
searched again with a wider one, and the beam of a whole search is doubled until an audit by brute force on
every `AUDIT`-th query finds `RECALL` of the true links.  Links are verified by their cosine in double
precision.  Tasks return counts and a spanning forest of the links they found, never the pairs of a group.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from atril.llm.common import components, materialise
from atril.llm.mtree import usable

SHARD_ROWS = 2048
LINKS, LINKS_0, BUILD_BEAM, BEAM = 12, 24, 48, 48
AUDIT, RECALL = 16, 0.999
BLOCK = 512


class Graph:
    """Layers of neighbours; layer 0 holds all points, each higher one a twelfth of the one below."""

    def __init__(self, points: np.ndarray, layers: list[np.ndarray], entry: int):
        self.points, self.layers, self.entry = points, layers, entry

    @classmethod
    def build(cls, points: np.ndarray, seed: int = 7) -> Graph:
        n = len(points)
        drawn = -np.log(1.0 - np.random.default_rng(seed).random(n)) / math.log(LINKS)
        level = np.minimum(drawn.astype(int), 4)
        order = np.argsort(-level, kind="stable")  # the highest layers first, so every layer is entered from above
        layers = [np.full((n, LINKS if k else LINKS_0), -1, np.int32) for k in range(int(level.max()) + 1)]
        graph = cls(points, layers, int(order[0]))
        done = 1
        while done < n:
            new = order[done : done + min(max(done, 8), 256)]
            graph._insert(new, level)
            done += len(new)
        return graph

    def _insert(self, new: np.ndarray, level: np.ndarray) -> None:
        entry = np.full(len(new), self.entry)
        for k in range(len(self.layers) - 1, -1, -1):
            here = level[new] >= k
            beam = BUILD_BEAM if here.any() else 1
            ids, sims = self._beam(self.points[new], entry[:, None], k, beam)
            entry = ids[:, 0]
            rows = np.flatnonzero(here)
            if not len(rows):
                continue
            among = self.points[new[rows]] @ self.points[new[rows]].T
            np.fill_diagonal(among, -2)
            back: dict[int, list[int]] = {}
            width = self.layers[k].shape[1]
            for place, row in enumerate(rows):
                own = [(s, i) for s, i in zip(sims[row].tolist(), ids[row].tolist(), strict=True) if i >= 0]
                near = np.argsort(-among[place])[:LINKS]
                own += [(float(among[place][j]), int(new[rows[j]])) for j in near if j != place]
                chosen = self._spread(own, LINKS)
                self.layers[k][new[row], : len(chosen)] = chosen
                for c in chosen:
                    back.setdefault(c, []).append(int(new[row]))
            for node, more in back.items():
                have = [int(i) for i in self.layers[k][node] if i >= 0]
                both = list(dict.fromkeys(have + more))
                if len(both) > width:
                    near = self.points[both] @ self.points[node]
                    both = self._spread(list(zip(near.tolist(), both, strict=True)), width)
                self.layers[k][node] = -1
                self.layers[k][node, : len(both)] = both

    def _spread(self, found: list[tuple[float, int]], limit: int) -> list[int]:
        """Nearest first, leaving out points nearer to one taken than to the node; then the nearest left out."""
        found.sort(reverse=True)
        ids = [i for _, i in found]
        if len(ids) <= limit:
            return list(dict.fromkeys(ids))
        among = self.points[ids] @ self.points[ids].T
        taken, left = [], []
        for place, (sim, _) in enumerate(found):
            if len(taken) < limit and (not taken or among[place, taken].max() < sim):
                taken.append(place)
            else:
                left.append(place)
        return list(dict.fromkeys(ids[p] for p in [*taken, *left]))[:limit]

    def _beam(self, queries: np.ndarray, entry: np.ndarray, k: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Best `width` points met for every query (ids, similarities; -1 where fewer), all queries in step."""
        n, links = len(queries), self.layers[k]
        ids = np.full((n, width), -1, np.int64)
        sims = np.full((n, width), -np.inf)
        opened = np.ones((n, width), bool)
        seen = np.zeros((n, len(self.points)), bool)
        start = entry.shape[1]
        take = min(start, width)
        first = np.einsum("qd,qed->qe", queries, self.points[entry])
        ids[:, :take], sims[:, :take], opened[:, :take] = entry[:, :take], first[:, :take], False
        seen[np.arange(n)[:, None], entry] = True
        active = np.arange(n)
        step = 1 if width < 8 else 4
        while len(active):
            rank = np.where(opened[active], -np.inf, sims[active])
            pick = np.argsort(-rank, axis=1)[:, :step]
            open_ = np.take_along_axis(rank, pick, 1) > -np.inf
            going = open_.any(axis=1)
            active, pick, open_ = active[going], pick[going], open_[going]
            if not len(active):
                break
            opened[active[:, None], pick] = True
            nodes = np.where(open_, ids[active[:, None], pick], -1)
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(active), -1)
            near.sort(axis=1)
            fresh = near >= 0
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[active[:, None], near]
            rows, cols = np.nonzero(fresh)
            seen[active[rows], near[rows, cols]] = True
            value = np.full(near.shape, -np.inf)
            value[rows, cols] = np.einsum("rd,rd->r", queries[active[rows]], self.points[near[rows, cols]])
            all_ids = np.concatenate([ids[active], near], axis=1)
            all_sims = np.concatenate([sims[active], value], axis=1)
            all_open = np.concatenate([opened[active], np.zeros(near.shape, bool)], axis=1)
            keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width] if all_sims.shape[1] > width else np.argsort(-all_sims, axis=1)
            sims[active] = np.take_along_axis(all_sims, keep, 1)
            ids[active] = np.where(sims[active] > -np.inf, np.take_along_axis(all_ids, keep, 1), -1)
            opened[active] = np.take_along_axis(all_open, keep, 1) | (sims[active] == -np.inf)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry)
        for k in range(len(self.layers) - 1, 0, -1):
            entry = self._beam(queries, entry, k, 1)[0]
        return self._beam(queries, entry, 0, width)


def links_of(graph: Graph, queries: np.ndarray, least: float, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, point) places with similarity of at least `least` found with this beam; full beams are widened."""
    out_q, out_p = [], []
    n = len(graph.points)
    for start in range(0, len(queries), BLOCK):
        rows, wide = np.arange(start, min(start + BLOCK, len(queries))), width
        while len(rows):
            if wide * 2 >= n:
                q, p = np.nonzero(queries[rows] @ graph.points.T >= least)
                out_q.append(rows[q])
                out_p.append(p)
                break
            ids, sims = graph.search(queries[rows], wide)
            full = sims[:, -1] >= least
            q, c = np.nonzero((sims >= least) & ~full[:, None])
            out_q.append(rows[q])
            out_p.append(ids[q, c])
            rows, wide = rows[full], wide * 4
    return np.concatenate(out_q or [np.empty(0, int)]), np.concatenate(out_p or [np.empty(0, int)])


def audited_links(graph: Graph, queries: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links found with the narrowest beam whose audit passes."""
    asked = np.arange(0, len(queries), AUDIT)
    truth = int((queries[asked] @ graph.points.T >= least).sum())
    width = BEAM
    while width * 2 < len(graph.points) and len(links_of(graph, queries[asked], least, width)[0]) < RECALL * truth:
        width *= 2
    return links_of(graph, queries, least, width)


def forest(a: np.ndarray, b: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links of a spanning forest of places 0..n-1."""
    root = list(range(n))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        p, q = find(x), find(y)
        if p != q:
            root[max(p, q)] = min(p, q)
            out.append((x, y))
    return out


def _unit(flat: np.ndarray) -> np.ndarray:
    return flat / np.sqrt((flat * flat).sum(axis=1))[:, None]


_GRAPH = pa.schema([
    ("label", pa.int32()), ("width", pa.int32()), ("shard", pa.int64()), ("points", pa.binary()), ("ids", pa.binary()), ("copies", pa.binary()),
    ("links", pa.binary()), ("links_0", pa.int32()), ("layers", pa.int32()), ("entry", pa.int32()),
])


def _build(shard: pa.Table) -> pa.Table:
    width = shard["width"][0].as_py()
    order = np.argsort(shard["id"].to_numpy(), kind="stable")
    flat = shard["v"].combine_chunks().flatten().to_numpy().reshape(shard.num_rows, width)[order]
    graph = Graph.build(_unit(flat))
    upper = [layer.tobytes() for layer in graph.layers]
    return pa.Table.from_pylist([{
        "label": shard["label"][0].as_py(), "width": width, "shard": shard["shard"][0].as_py(), "points": np.ascontiguousarray(flat).tobytes(),
        "ids": shard["id"].to_numpy()[order].tobytes(), "copies": shard["copies"].to_numpy()[order].tobytes(), "links": b"".join(upper),
        "links_0": len(upper[0]), "layers": len(upper), "entry": graph.entry,
    }], schema=_GRAPH)


def _search_pairs(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                ids_a, ids_b = (np.frombuffer(row[k], np.int64) for k in ("ids", "ids_b"))
                copies_a, copies_b = (np.frombuffer(row[k], np.int64) for k in ("copies", "copies_b"))
                raw_a, raw_b = (np.frombuffer(row[k], np.float64).reshape(-1, row["width"]) for k in ("points", "points_b"))
                size, n = row["links_0"], len(ids_a)
                layers = [np.frombuffer(row["links"][:size], np.int32).reshape(n, LINKS_0)]
                layers += [np.frombuffer(row["links"][size + k * 4 * n * LINKS : size + (k + 1) * 4 * n * LINKS], np.int32).reshape(n, LINKS) for k in range(row["layers"] - 1)]
                q, p = audited_links(Graph(_unit(raw_a), layers, row["entry"]), _unit(raw_b), least - 1e-9)
                exact = (raw_b[q] * raw_a[p]).sum(axis=1) / (np.sqrt((raw_b[q] ** 2).sum(axis=1)) * np.sqrt((raw_a[p] ** 2).sum(axis=1))) >= least
                q, p = q[exact], p[exact]
                same = row["shard"] == row["shard_b"]
                if same:  # either direction may have found a link; it counts once
                    pair = np.unique(np.minimum(p, q) * n + np.maximum(p, q))
                    p, q = pair // n, pair % n
                    p, q = p[p != q], q[p != q]
                counts_a, counts_b = np.zeros(n, np.int64), np.zeros(len(ids_b), np.int64)
                np.add.at(counts_a, p, copies_b[q])
                np.add.at(counts_b, q, copies_a[p])
                links = forest(p, q if same else q + n, n if same else n + len(ids_b))
                both = np.concatenate([ids_a, ids_b])
                ids, counts = np.concatenate([ids_a, ids_b]), np.concatenate([counts_a, counts_b])
                some = counts > 0
                a = ids[some].tolist() + [int(both[x]) for x, _ in links]
                b = [None] * int(some.sum()) + [int(both[y]) for _, y in links]
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(counts[some].tolist() + [0] * len(links), pa.int64())})

    return run


def near_duplicates(vectors: DataFrame, least: float = 0.93, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest vec_id reachable by links), kept.

    Vectors are compared if their labels are equal and not null and they have as many components.  Null, zero and
    empty vectors and those with null or non-finite components link with nothing.  Rows that repeat a vec_id
    are vectors of their own, in components by their vec_id.  An empty table gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    fit = F.col("label").isNotNull() & usable("v") & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("id", F.when(fit, F.xxhash64("label", "v")))
    points = rows.where("id IS NOT NULL").groupBy("id").agg(
        F.first("label").alias("label"), F.first("v").alias("v"), F.count(F.lit(1)).alias("copies"), F.min("vec_id").alias("least")
    )
    points = materialise(points.withColumn("width", F.size("v")), "points")
    shards = points.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / shard_rows).alias("shards"))
    cut = points.join(shards, ["label", "width"]).withColumn("shard", F.pmod("id", F.col("shards")))
    graphs = materialise(cut.select("label", "width", "shard", "id", "copies", "v").groupBy("label", "width", "shard").applyInArrow(_build, from_arrow_schema(_GRAPH)), "graphs")
    names = graphs.select("label", "width", "shard")
    pairs = names.join(names.withColumnRenamed("shard", "shard_b"), ["label", "width"]).where("shard <= shard_b")
    other = graphs.select("label", "width", F.col("shard").alias("shard_b"), F.col("points").alias("points_b"), F.col("ids").alias("ids_b"), F.col("copies").alias("copies_b"))
    both = pairs.join(graphs, ["label", "width", "shard"]).join(other, ["label", "width", "shard_b"])
    found = materialise(both.mapInArrow(_search_pairs(least), "a long, b long, n long"), "links")
    classes = components(found.where("b IS NOT NULL"))
    classes = classes.join(points.select(F.col("id").alias("node"), "least"), "node")
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    of_point = points.select("id", "copies", "least").join(
        found.where("b IS NULL").groupBy(F.col("a").alias("id")).agg(F.sum("n").alias("n")), "id", "left"
    ).join(classes.join(smallest, "component").select(F.col("node").alias("id"), "component_id"), "id", "left")
    of_point = of_point.select("id", (F.col("copies") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"))
    joined = rows.select("vec_id", "id").join(of_point, "id", "left")
    return joined.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"),
        F.col("vec_id").eqNullSafe(F.coalesce("component_id", "vec_id")).alias("kept"),
    )
