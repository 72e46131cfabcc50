"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spendtrail.llm.common import written

ROUND = 256  # vectors inserted, or queries searched, side by side


@dataclass
class Graph:
    """Layers of flat neighbour arrays over unit vectors: row i of a layer has the neighbours of node i, -1 where there are fewer."""

    unit: np.ndarray
    layers: list[np.ndarray]
    level: np.ndarray
    entry: int

    def search(self, queries: np.ndarray, beam: int, ready: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(node, cosine) of up to ``beam`` near nodes of each query, nearest first; -1 where there are fewer.

        ``ready``: nodes that layer 0 links so far, if not all.
        """
        start = np.full(len(queries), self.entry)
        for above in range(len(self.layers) - 1, 0, -1):
            start = self._search(queries, start[:, None], above, 1)[0][:, 0]
        if ready is not None:
            start = np.where(ready[start], start, self.entry)
        return self._search(queries, start[:, None], 0, beam)

    def _search(self, queries: np.ndarray, start: np.ndarray, layer: int, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all queries in step: each opens its nearest unopened node until none in its beam is unopened."""
        q, edges = len(queries), self.layers[layer]
        seen = np.zeros((q, len(self.unit)), bool)
        node = np.full((q, beam), -1)
        near = np.full((q, beam), -np.inf)
        opened = np.ones((q, beam), bool)
        w = start.shape[1]
        node[:, :w], opened[:, :w] = start, False
        near[:, :w] = np.einsum("qd,qwd->qw", queries, self.unit[start])
        np.put_along_axis(seen, start, True, axis=1)
        live = np.arange(q)
        while len(live):
            waits = np.where(opened[live], -np.inf, near[live])
            pick = np.argmax(waits, axis=1)
            open_to = waits[np.arange(len(live)), pick] > -np.inf
            live, pick = live[open_to], pick[open_to]
            if not len(live):
                break
            opened[live, pick] = True
            found = edges[node[live, pick]]
            fresh = (found >= 0) & ~seen[live[:, None], found]
            seen[live[:, None], np.where(found >= 0, found, node[live, pick][:, None])] = True
            score = np.where(fresh, np.einsum("qd,qwd->qw", queries[live], self.unit[found]), -np.inf)
            all_near = np.concatenate((near[live], score), axis=1)
            keep = np.argsort(-all_near, axis=1, kind="stable")[:, :beam]
            near[live] = np.take_along_axis(all_near, keep, 1)
            node[live] = np.take_along_axis(np.concatenate((node[live], np.where(fresh, found, -1)), axis=1), keep, 1)
            opened[live] = np.take_along_axis(np.concatenate((opened[live], ~fresh), axis=1), keep, 1)
        return node, near


def build(unit: np.ndarray, links: int = 12, beam: int = 48, seed: int = 7) -> Graph:
    """Vectors are inserted in rounds, each as large as the graph before it up to ROUND; members of a round see each other too.

    Levels fall off geometrically. A node's neighbours are those of its candidates that are nearer to it than to a neighbour
    already taken, filled up with the nearest of the others; layer 0 holds twice ``links``.
    """
    n = len(unit)
    level = np.minimum((-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(links)).astype(np.int64), 8)
    graph = Graph(unit, [], level, 0)
    order = np.argsort(-level, kind="stable")  # upper layers first: a layer's nodes are a prefix of this order
    graph.entry = int(order[0])
    for layer in range(int(level.max()), -1, -1):
        width = links * (2 if layer == 0 else 1)
        edges = np.full((n, width), -1)
        graph.layers.insert(0, edges)
        members = order[: int((level >= layer).sum())]
        ready = np.zeros(n, bool)
        ready[graph.entry], done = True, 1
        while done < len(members):
            some = members[done : done + min(done, ROUND)]
            found, _ = graph.search(unit[some], beam, ready)
            own = unit[some] @ unit[some].T
            np.fill_diagonal(own, -np.inf)
            peers = np.argsort(-own, axis=1, kind="stable")[:, : min(links, len(some) - 1)]
            found = np.concatenate((found, some[peers]), axis=1)
            edges[some] = _choose(unit, some, found, width)
            _link_back(unit, edges, some, width)
            ready[some] = True
            done += len(some)
    return graph


def _choose(unit: np.ndarray, nodes: np.ndarray, found: np.ndarray, width: int) -> np.ndarray:
    """The neighbours of each node out of its candidates (-1: none): those nearer to it than to a nearer one taken, then others."""
    by = np.argsort(found, axis=1)
    found = np.take_along_axis(found, by, 1)
    again = np.concatenate((np.zeros((len(found), 1), bool), found[:, 1:] == found[:, :-1]), axis=1)
    valid = (found >= 0) & ~again & (found != nodes[:, None])
    near = np.where(valid, np.einsum("rd,rcd->rc", unit[nodes], unit[found]), -np.inf)
    by = np.argsort(-near, axis=1, kind="stable")[:, : 2 * width]
    found, near, valid = (np.take_along_axis(x, by, 1) for x in (found, near, valid))
    vectors = unit[found]
    between = vectors @ vectors.transpose(0, 2, 1)
    taken = np.zeros(found.shape, bool)
    for j in range(found.shape[1]):
        blocked = (taken & (between[:, j] >= near[:, j, None])).any(axis=1)
        taken[:, j] = valid[:, j] & ~blocked & (taken.sum(axis=1) < width)
    rank = np.where(taken, 0, np.where(valid, 1, 2))
    by = np.argsort(rank, axis=1, kind="stable")[:, :width]
    chosen = np.where(np.take_along_axis(rank, by, 1) < 2, np.take_along_axis(found, by, 1), -1)
    return np.pad(chosen, ((0, 0), (0, width - chosen.shape[1])), constant_values=-1)


def _link_back(unit: np.ndarray, edges: np.ndarray, some: np.ndarray, width: int) -> None:
    """Each new node becomes a neighbour of its neighbours, which choose anew among old and new ones."""
    to = edges[some]
    source, target = np.repeat(some, width)[to.reshape(-1) >= 0], to[to >= 0]
    by = np.argsort(target, kind="stable")
    source, target = source[by], target[by]
    nodes, starts, new = np.unique(target, return_index=True, return_counts=True)
    by = np.argsort(new, kind="stable")
    for part in np.array_split(by, max(1, len(by) // 128)):
        if len(part):
            cols = np.arange(int(new[part].max()))
            at = np.minimum(starts[part, None] + cols, len(source) - 1)
            fresh = np.where(cols < new[part, None], source[at], -1)
            edges[nodes[part]] = _choose(unit, nodes[part], np.concatenate((edges[nodes[part]], fresh), axis=1), width)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    size = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return F.coalesce(finite & (size > 0), F.lit(False))


def nearest(
    vectors: DataFrame,
    is_query: Column,
    k: int = 5,
    shard_rows: int = 8192,
    links: int = 12,
    build_beam: int = 48,
    search_beam: int = 96,
    block_queries: int = 4096,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: each query's ``k`` nearest rows found, itself left out, all if there are fewer.

    Nearness is the cosine in double precision of the vectors as given; ties go to the smaller id. Vectors that are null, zero
    or hold null or non-finite components take no part. Vectors of different lengths have no cosine: each length is searched
    by itself. Equal vectors are ties. Rows that share an id are one row
    to the search: the first of them in the order of their components. No rows: no rows. Other columns are ignored.

    Rows are dealt by hash of id into shards of about ``shard_rows``, whatever their values, so none is crowded. Each shard
    builds its graph and searches it for every query; a query brings its vector, and takes home its best few of each shard.
    Queries meet shards as rows of the table, in blocks of about ``block_queries``, never in the driver. Identical vectors are one node, as many copies of
    one vector would cut a graph into islands; of each vector's rows only the ``k`` + 1 of smallest id can be among the
    ``k`` nearest of any query, so no more are carried.
    """
    rows = vectors.where(usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = written(rows.where("vec_id is not null").groupBy("vec_id").agg(F.min("v").alias("v"), F.max("is_query").alias("is_query")))
    copies = Window.partitionBy("v").orderBy("vec_id")
    members = rows.withColumn("n", F.row_number().over(copies)).where(F.col("n") <= k + 1)
    members = written(members.select("vec_id", "v", "n", F.min("vec_id").over(Window.partitionBy("v")).alias("node")))
    distinct = members.where("n = 1")
    shards = max(1, math.ceil(distinct.count() / shard_rows))
    nodes = distinct.select(F.size("v").alias("width"), F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int").alias("shard"), "node", "v")
    queries = rows.where("is_query").select("vec_id", "v")

    def index(key, table):
        table = table.sort_by("node")
        unit = _unit(table["v"])
        graph = build(unit, links, build_beam)
        flat = [x.astype("<i4").tobytes() for x in graph.layers]
        return pa.table({"width": pa.array([key[0].as_py()], pa.int32()), "shard": pa.array([key[1].as_py()], pa.int32()), "nodes": [table["node"].to_numpy().astype("<i8").tobytes()], "unit": [unit.astype("<f8").tobytes()], "level": [graph.level.astype("<i8").tobytes()], "entry": pa.array([graph.entry], pa.int32()), "layers": [flat]})

    graphs = written(nodes.groupBy("width", "shard").applyInArrow(index, "width int, shard int, nodes binary, unit binary, level binary, entry int, layers array<binary>"))

    def search(key, left, right):
        empty = pa.table({"query_id": pa.array([], pa.int64()), "node": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        if not len(left) or not len(right):
            return empty
        row = left.to_pylist()[0]
        ids = np.frombuffer(row["nodes"], "<i8")
        unit = np.frombuffer(row["unit"], "<f8").reshape(len(ids), -1)
        graph = Graph(unit, [np.frombuffer(x, "<i4").reshape(len(ids), -1).astype(np.int64) for x in row["layers"]], np.frombuffer(row["level"], "<i8"), row["entry"])
        asked, q = right["vec_id"].to_numpy(), _unit(right["v"])
        out = []
        for at in range(0, len(asked), ROUND):
            node, near = graph.search(q[at : at + ROUND], min(search_beam, len(ids)))
            node, near = node[:, : k + 1], near[:, : k + 1]  # a query's own vector may be among them
            ok = node >= 0
            out.append(pa.table({"query_id": np.repeat(asked[at : at + ROUND], node.shape[1])[ok.reshape(-1)], "node": ids[node[ok]], "score": near[ok]}))
        return pa.concat_tables(out)

    blocks = max(1, math.ceil(queries.count() / block_queries))
    block = F.pmod(F.xxhash64("vec_id", F.lit("block")), F.lit(blocks)).cast("int").alias("block")
    every_shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = queries.select("vec_id", "v", F.size("v").alias("width"), block, every_shard)
    graphs = graphs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    place = ["width", "shard", "block"]
    met = graphs.groupBy(*place).cogroup(asked.groupBy(*place)).applyInArrow(search, "query_id long, node long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "node")
    few = written(met.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).select("query_id", "node"))
    pairs = few.join(members, "node").where("query_id <> vec_id").join(queries.select(F.col("vec_id").alias("query_id"), F.col("v").alias("q")), "query_id")
    scored = pairs.select("query_id", "vec_id", _cosine(F.col("q"), F.col("v")).alias("score"))
    nearest_first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return scored.withColumn("rank", F.row_number().over(nearest_first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _unit(column) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    a = flat.flatten().to_numpy().reshape(len(flat), -1)
    a = a / np.abs(a).max(axis=1, keepdims=True)
    return a / np.linalg.norm(a, axis=1, keepdims=True)


def _cosine(a: Column, b: Column) -> Column:
    """Of two arrays of doubles, without overflow."""

    def length(x: Column) -> Column:
        return F.sqrt(F.aggregate(x, F.lit(0.0), lambda s, v: s + v * v))

    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)
    return dot / (length(a) * length(b))
