"""Approximate nearest neighbours: a navigable small-world graph per shard, shard results merged.

Distinct vectors are dealt to shards by a hash. Each shard becomes one row: vectors and the neighbour lists of every layer
as flat arrays. A node's top layer falls geometrically; above it the graph is sparse and leads to an entry near the query, below
a beam follows the nearest unvisited neighbours. Nodes are inserted in batches whose searches run in step as
arrays; members of a batch see each other through their own distances. Lists keep neighbours that are nearer to the node
than to any neighbour kept before, so links leave dense places.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelfolio.llm.common import parts, stage

LINKS = 16  # neighbours of a node in a layer, twice as many in the lowest
BEAM = 96  # nodes kept by a search while building
STEP = 4  # nodes of the beam followed at once
BATCH = 256
INDEX = "size int, shard int, vectors array<double>, ids array<long>, many array<int>, tops array<int>, links array<int>, entry int"
NO_ID = np.iinfo(np.int64).max


@dataclass
class Graph:
    """``layers[l]``: the neighbours in layer l of every node, -1 where there are fewer; rows of nodes below layer l stay empty.

    ``vectors`` are as a ``Frame`` returns them: enough to steer by, while results are ranked on the original ones.
    """

    vectors: np.ndarray
    tops: np.ndarray
    layers: list[np.ndarray] = field(default_factory=list)
    entry: int = 0

    def distances(self, queries: np.ndarray, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        d = queries[row] - self.vectors[node]
        return np.einsum("ij,ij->i", d, d)

    def beam(self, queries: np.ndarray, nodes: np.ndarray, dist: np.ndarray, layer: int, width: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``width`` nearest nodes found for each query in a layer, nearest first (-1 and inf where fewer), from the given ones."""
        links = self.layers[layer]
        n_q = len(queries)
        fill = max(0, width - nodes.shape[1])
        nodes = np.pad(nodes, ((0, 0), (0, fill)), constant_values=-1)
        dist = np.pad(dist, ((0, 0), (0, fill)), constant_values=np.inf)
        seen = np.zeros((n_q, len(self.vectors)), bool)
        at, _ = np.nonzero(nodes >= 0)
        seen[at, nodes[nodes >= 0]] = True
        done = nodes < 0
        step = min(STEP, width)
        active = np.arange(n_q)
        while len(active):
            order = np.argsort(np.where(done[active], np.inf, dist[active]), axis=1, kind="stable")[:, :step]
            fresh = ~np.take_along_axis(done[active], order, 1)
            left = fresh.any(axis=1)
            active, order, fresh = active[left], order[left], fresh[left]
            if not len(active):
                break
            picked = np.where(fresh, np.take_along_axis(nodes[active], order, 1), -1)
            done[active[:, None], order] = True
            around = np.where(picked[:, :, None] >= 0, links[picked], -1).reshape(len(active), -1)
            row, col = np.nonzero(around >= 0)
            node = around[row, col]
            new = ~seen[active[row], node]
            row, node = row[new], node[new]
            seen[active[row], node] = True
            pair = np.sort(row * len(self.vectors) + node)  # two picked nodes may share a neighbour
            row, node = np.divmod(pair[np.diff(pair, prepend=-1) > 0], len(self.vectors))
            if not len(row):
                continue
            d = self.distances(queries, active[row], node)
            worst = dist[active, -1][row]
            row, node, d = row[d < worst], node[d < worst], d[d < worst]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            more = np.full((len(active), (place.max() + 1) if len(place) else 0), -1, np.int64)
            more_d = np.full(more.shape, np.inf)
            more[row, place], more_d[row, place] = node, d
            all_n, all_d = np.hstack([nodes[active], more]), np.hstack([dist[active], more_d])
            all_done = np.hstack([done[active], more < 0])
            best = np.argsort(all_d, axis=1, kind="stable")[:, :width]
            nodes[active], dist[active] = np.take_along_axis(all_n, best, 1), np.take_along_axis(all_d, best, 1)
            done[active] = np.take_along_axis(all_done, best, 1)
        return nodes, dist

    def descend(self, queries: np.ndarray, down_to: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest node found for each query in the layers above ``down_to``."""
        nodes = np.full((len(queries), 1), self.entry, np.int64)
        dist = self.distances(queries, np.arange(len(queries)), nodes[:, 0])[:, None]
        for layer in range(len(self.layers) - 1, down_to, -1):
            nodes, dist = self.beam(queries, nodes, dist, layer, 1)
        return nodes, dist

    def nearest(self, queries: np.ndarray, width: int) -> np.ndarray:
        """``width`` nodes for each query, the nearest first; -1 where the graph is smaller."""
        n = len(self.vectors)
        if n <= width:  # the beam would hold the whole graph
            return np.pad(np.tile(np.arange(n), (len(queries), 1)), ((0, 0), (0, width - n)), constant_values=-1)
        nodes, _ = self.beam(queries, *self.descend(queries, 0), 0, width)
        for short in np.flatnonzero(nodes[:, -1] < 0):  # the part of the graph that was reached is too small
            nodes[short] = np.argsort(self.distances(queries, np.full(n, short), np.arange(n)), kind="stable")[:width]
        return nodes


@dataclass
class Frame:
    """How vectors are shifted and scaled into single precision; not at all where some lie too far from the rest."""

    middle: np.ndarray
    scale: float
    single: bool

    def __call__(self, vectors: np.ndarray) -> np.ndarray:
        return np.clip((vectors - self.middle) / self.scale, -1e15, 1e15).astype(np.float32) if self.single else vectors


def frame(vectors: np.ndarray) -> Frame:
    middle = np.median(vectors, axis=0)
    away = np.abs(vectors - middle)
    scale = max(float(np.median(away)), np.finfo(float).tiny)
    return Frame(middle, scale, bool(away.max() <= 1e4 * scale))


def _spread(vectors: np.ndarray, nodes: np.ndarray, dist: np.ndarray, keep: int) -> np.ndarray:
    """Of each row of candidates the ``keep`` nearest that are nearer to the node than to any kept one; then the nearest of the rest."""
    order = np.argsort(dist, axis=1, kind="stable")
    nodes, dist = np.take_along_axis(nodes, order, 1), np.take_along_axis(dist, order, 1)
    v = vectors[nodes]
    norm = np.einsum("ijk,ijk->ij", v, v)
    between = norm[:, :, None] + norm[:, None, :] - 2 * v @ v.transpose(0, 2, 1)
    kept = np.zeros(nodes.shape, bool)
    for j in range(nodes.shape[1]):
        close = (kept & (between[:, j] < dist[:, j, None])).any(axis=1)
        kept[:, j] = (nodes[:, j] >= 0) & ~close & (kept.sum(axis=1) < keep)
    rank = np.argsort(np.where(kept, 0, np.where(nodes >= 0, 1, 2)), axis=1, kind="stable")[:, :keep]
    return np.take_along_axis(nodes, rank, 1)


def build_graph(vectors: np.ndarray, seed: int = 7) -> Graph:
    """The graph of distinct vectors, inserted in the order given."""
    n = len(vectors)
    rng = np.random.default_rng(seed)
    tops = np.minimum((-np.log(rng.random(n)) / np.log(LINKS)).astype(np.int32), 12)
    g = Graph(vectors, tops, [])
    for layer in range(int(tops.max(initial=0)) + 1):
        g.layers.append(np.full((n, LINKS * (2 if layer == 0 else 1)), -1, np.int32))
    order = np.arange(n)
    entry_top, start = -1, 0
    while start < n:
        batch = order[start : start + min(BATCH, max(1, start))]  # the first batches are no larger than the graph
        inserted = start
        start += len(batch)
        _insert(g, batch, inserted, entry_top)
        first = int(batch[np.argmax(tops[batch])])
        if tops[first] > entry_top:
            entry_top, g.entry = int(tops[first]), first
    return g


def _insert(g: Graph, batch: np.ndarray, inserted: int, entry_top: int) -> None:
    q = g.vectors[batch]
    mates = ((q[:, None, :] - q[None, :, :]) ** 2).sum(axis=2)
    np.fill_diagonal(mates, np.inf)
    nodes = dist = None
    if inserted:
        nodes = np.full((len(batch), 1), g.entry, np.int64)
        dist = g.distances(q, np.arange(len(batch)), nodes[:, 0])[:, None]
    for layer in range(max(entry_top, int(g.tops[batch].max())), -1, -1):
        member = g.tops[batch] >= layer
        if inserted and layer <= entry_top:
            found, far = g.beam(q, nodes, dist, layer, BEAM if member.all() else max(1, BEAM * int(member.any())))
            nodes, dist = found, far
        if not member.any():
            nodes, dist = nodes[:, :1], dist[:, :1]
            continue
        mine = np.flatnonzero(member)
        near = np.where(member[None, :], mates[mine], np.inf)
        peers = np.argsort(near, axis=1, kind="stable")[:, : min(LINKS, len(batch))]
        peer_d = np.take_along_axis(near, peers, 1)
        peers = np.where(np.isfinite(peer_d), batch[peers], -1)
        if inserted and layer <= entry_top:
            peers, peer_d = np.hstack([nodes[mine], peers]), np.hstack([dist[mine], peer_d])
        width = g.layers[layer].shape[1]
        chosen = _spread(g.vectors, peers, np.where(peers >= 0, peer_d, np.inf), LINKS)
        g.layers[layer][batch[mine], : chosen.shape[1]] = chosen
        source, target = np.repeat(batch[mine], chosen.shape[1]), chosen.ravel()
        _link_back(g, layer, source[target >= 0], target[target >= 0], width)


def _link_back(g: Graph, layer: int, source: np.ndarray, target: np.ndarray, width: int) -> None:
    """Every target gets its sources as neighbours; a list that is too long is chosen anew."""
    order = np.argsort(target, kind="stable")
    target, source = target[order], source[order]
    touched, first, many = np.unique(target, return_index=True, return_counts=True)
    lists = np.full((len(touched), width + many.max(initial=0)), -1, np.int64)
    lists[:, :width] = g.layers[layer][touched]
    lists[np.repeat(np.arange(len(touched)), many), width + np.arange(len(target)) - np.repeat(first, many)] = source
    lists.sort(axis=1)
    lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1  # a link that both ends chose
    full = (lists >= 0).sum(axis=1) > width
    lists = -np.sort(-lists, axis=1)
    g.layers[layer][touched[~full]] = lists[~full, :width]
    for at in range(0, int(full.sum()), BATCH):
        some = np.flatnonzero(full)[at : at + BATCH]
        nodes = lists[some]
        row = np.repeat(np.arange(len(some)), nodes.shape[1])
        dist = g.distances(g.vectors[touched[some]], row, nodes.ravel()).reshape(nodes.shape)
        g.layers[layer][touched[some]] = _spread(g.vectors, nodes, np.where(nodes >= 0, dist, np.inf), width)


def flat_links(g: Graph) -> np.ndarray:
    """The lists of layer 0 for all nodes, then those of layer 1 for the nodes that reach it, and so on."""
    return np.concatenate([layer[g.tops >= i].ravel() for i, layer in enumerate(g.layers)]).astype(np.int32)


def graph_of(vectors: np.ndarray, tops: np.ndarray, links: np.ndarray, entry: int) -> Graph:
    g, at = Graph(vectors, tops, [], entry), 0
    for layer in range(int(tops.max()) + 1):
        members = np.flatnonzero(tops >= layer)
        width = LINKS * (2 if layer == 0 else 1)
        lists = np.full((len(tops), width), -1, np.int32)
        lists[members] = links[at : at + len(members) * width].reshape(-1, width)
        at += len(members) * width
        g.layers.append(lists)
    return g


def _flat(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), float).reshape(-1, size)


def usable(vector: Column) -> Column:
    """The vector as doubles; null where it is null, empty or zero, or holds null or non-finite components."""
    doubles = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(doubles, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists(doubles, lambda x: x != 0), doubles)


def members(rows: DataFrame, k: int) -> DataFrame:
    """``rows`` (vec_id, vector) -> a row for each distinct vector with the k + 1 smallest ids that carry it, a repeated id k times at most.

    No other row of the vector can be among the k nearest of any query, since ties go to smaller ids and a query leaves out one id.
    """
    counted = rows.groupBy("vector", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    first = counted.withColumn("at", F.row_number().over(Window.partitionBy("vector").orderBy(F.asc_nulls_last("vec_id")))).where(F.col("at") <= k + 1)
    ids = F.array_sort(F.collect_list(F.struct(F.coalesce("vec_id", F.lit(NO_ID)).alias("id"), F.least("copies", F.lit(k)).cast("int").alias("copies"))))
    return first.groupBy("vector").agg(ids.alias("ids")).select("vector", F.flatten(F.transform("ids", lambda m: F.array_repeat(m["id"], m["copies"]))).alias("ids"))


def build(nodes: DataFrame) -> DataFrame:
    """``nodes`` (size, shard, vector, ids; distinct vectors) -> the graph of each size and shard as one row."""

    def index(rows: pa.Table) -> pa.Table:
        size = rows["size"][0].as_py()
        v = _flat(rows["vector"], size)
        order = np.lexsort(v.T)  # the same graph however rows arrive
        order = order[np.random.default_rng(len(v)).permutation(len(v))]
        v = v[order]
        g = build_graph(frame(v)(v))
        ids = rows["ids"].combine_chunks().take(pa.array(order))
        many = np.diff(np.asarray(ids.offsets))
        one = lambda x, t: pa.array([x], pa.list_(t))
        return pa.table({"size": pa.array([size], pa.int32()), "shard": rows["shard"].slice(0, 1), "vectors": one(v.ravel(), pa.float64()),
                         "ids": one(np.asarray(ids.flatten()), pa.int64()), "many": one(many, pa.int32()), "tops": one(g.tops, pa.int32()),
                         "links": one(flat_links(g), pa.int32()), "entry": pa.array([g.entry], pa.int32())})

    return nodes.groupBy("size", "shard").applyInArrow(index, INDEX)


def search(index: DataFrame, queries: DataFrame, k: int, beam: int, blocks: int) -> DataFrame:
    """``queries`` (size, shard, block, query_id, vector), once in every shard -> query_id, vec_id, score; the k nearest of each shard."""
    def ask(asked: pa.Table, shard: pa.Table) -> pa.Table:
        if not asked.num_rows or not shard.num_rows:
            return pa.table({n: pa.array([], t) for n, t in (("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64()))})
        size = shard["size"][0].as_py()
        flat = lambda c: np.asarray(shard[c].combine_chunks().flatten())
        v = flat("vectors").reshape(-1, size)
        fit = frame(v)
        g = graph_of(fit(v), flat("tops"), flat("links"), shard["entry"][0].as_py())
        ids, many = flat("ids"), flat("many")
        first = np.cumsum(many) - many
        asking, q = np.asarray(asked["query_id"].combine_chunks()), _flat(asked["vector"], size)
        out = []
        for at in range(0, len(q), BATCH):
            mine, own = q[at : at + BATCH], asking[at : at + BATCH]
            nodes = g.nearest(fit(mine), max(beam, k + 1))
            row, col = np.nonzero(nodes >= 0)
            node = nodes[row, col]
            score = np.sqrt(((mine[row] - v[node]) ** 2).sum(axis=1))
            each = np.repeat(np.arange(len(node)), many[node])
            found = ids[first[node][each] + np.arange(len(each)) - np.repeat(np.cumsum(many[node]) - many[node], many[node])]
            row, score = row[each], score[each]
            other = found != own[row]
            row, score, found = row[other], score[other], found[other]
            order = np.lexsort((found, score, row))
            row, score, found = row[order], score[order], found[order]
            best = np.arange(len(row)) - np.searchsorted(row, row) < k
            out.append((own[row[best]], found[best], score[best]))
        query, found, score = (np.concatenate(c) for c in zip(*out))
        return pa.table({"query_id": pa.array(query, pa.int64()), "vec_id": pa.array(found, pa.int64(), mask=found == NO_ID), "score": pa.array(score, pa.float64())})

    asking = queries.groupBy("size", "shard", "block")
    keyed = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    return asking.cogroup(keyed.groupBy("size", "shard", "block")).applyInArrow(ask, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, beam: int = 160, shard_rows: int = 8192, shard_bytes: int = 64 << 20, query_block: int = 8192) -> DataFrame:
    """``vectors`` (vec_id, embedding; other columns are ignored) -> query_id, rank from 1, vec_id, score (Euclidean distance).

    Vectors that are null, empty or zero or hold null or non-finite components take no part. Vectors of another length than the
    query's share no space and are no candidates. A query's own id is none either. Equal vectors are one node of the graph,
    so large groups of copies keep no links to themselves. Repeated rows are candidates each; a repeated query is
    asked once for each different vector, and the answers are ranked together. A null id is never a query; as a candidate it
    comes after all others of its distance. Distances beyond the range of doubles are infinite and equal. Fewer than k candidates: all. Empty table: no rows.

    A shard holds about ``shard_rows`` vectors and ``shard_bytes`` of them; every query block meets every shard.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), usable(F.col("embedding")).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    rows = rows.where("vector is not null")
    n = rows.agg(F.count(F.lit(1)).alias("all"), F.sum(F.size("vector").cast("long")).alias("numbers"), F.count_if("asks").alias("asking")).first()
    shards = max(parts(n["all"], shard_rows), parts(8 * (n["numbers"] or 0), shard_bytes))
    blocks = parts(n["asking"] or 0, query_block)
    deal = lambda count: F.pmod(F.xxhash64("vector"), F.lit(count)).cast("int")
    nodes = members(rows.select("vec_id", "vector"), k).withColumns({"size": F.size("vector"), "shard": deal(shards)})
    index = stage(build(nodes), "hnsw-index")
    queries = rows.where("asks and vec_id is not null").select(F.col("vec_id").alias("query_id"), "vector").distinct()
    queries = queries.withColumns({"size": F.size("vector"), "block": F.pmod(F.xxhash64("query_id", "vector"), F.lit(blocks)).cast("int")})
    queries = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    ranked = Window.partitionBy("query_id").orderBy("score", F.asc_nulls_last("vec_id"))
    best = search(index, queries, k, beam, blocks).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
