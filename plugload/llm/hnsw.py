"""Near-duplicate vectors by hierarchical navigable small-world graphs, one per shard."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plugload.llm.common import released
from plugload.llm.components import components
from plugload.session import materialized

#: Links per node on the upper layers; the ground layer has twice as many.
DEGREE = 16
BUILD_BEAM = 48
FIRST_BEAM = 16
SHARD_ROWS = 65_536
#: A shard of long vectors has fewer rows: its graph must fit into one binary value and a task.
SHARD_BYTES = 512 << 20
MIN_SHARDS = 8
#: Points that ask one copy of a graph; they come to it in batches.
BLOCK_ROWS = 65_536
#: A graph travels and is stored in parts, so no row is large; so are the row groups that a reader takes at once.
PART_BYTES = 256 << 10
GROUP_BYTES = 16 << 20
_ASKS = (1 << 31) - 1
#: Points drawn for the audit, and how many of them should have links.
AUDIT_ROWS = 256
AUDIT_LINKED = 64
#: The first beam where too few points with links were found to audit it.
UNSURE_BEAM = 128
TARGET_RECALL = 0.97
_TOGETHER = 256
_STEP = 4
#: Places of beams or of a node's candidates that are held at once, whatever the widest of them is.
_PLACES = 1 << 18
#: Vectors that are scaled at once.
_CHUNK = 4096


class Graph:
    """Layered graph over unit vectors. Nodes are in falling order of their top layer, so layer k is a prefix.

    Nodes are inserted in batches; all searches of a batch advance together, in numpy.
    """

    def __init__(self, vectors: np.ndarray, layers: list[np.ndarray]):
        self.vectors, self.layers = vectors, layers

    @staticmethod
    def build(vectors: np.ndarray, seed: int = 0) -> tuple[Graph, np.ndarray]:
        """The graph and the order of the given rows in it."""
        rng = np.random.default_rng(seed)
        n = len(vectors)
        level = np.floor(-np.log(1 - rng.random(n)) / np.log(DEGREE)).astype(int)
        order = np.argsort(-level, kind="stable")
        level = level[order]
        sizes = [int((level >= k).sum()) for k in range(int(level.max(initial=0)) + 1)]
        layers = [np.full((size, DEGREE * (2 if k == 0 else 1)), -1, np.int32) for k, size in enumerate(sizes)]
        graph = Graph(np.ascontiguousarray(vectors[order]), layers)
        done = 0
        while done < n:
            batch = np.arange(done, min(n, done + min(512, max(done, 32))))
            for k, size in enumerate(sizes):
                if len(new := batch[batch < size]):
                    graph._insert(k, new, done)
            done = int(batch[-1]) + 1
        return graph, order

    def _insert(self, k: int, new: np.ndarray, done: int) -> None:
        """Link the nodes ``new`` on layer k, where nodes below ``done`` are linked already."""
        x = self.vectors[new]
        old, sims = (self._descend(x, k, BUILD_BEAM, done) if done else (np.full((len(new), 1), -1), np.full((len(new), 1), -np.inf)))
        among = x @ x.T
        among[np.triu_indices(len(new))] = -np.inf  # a node links to those before it
        width = min(len(new), BUILD_BEAM)
        near = np.argpartition(-among, width - 1, axis=1)[:, :width]
        ids = np.concatenate([old, np.where(np.isfinite(np.take_along_axis(among, near, 1)), new[near], -1)], axis=1)
        sims = np.concatenate([sims, np.take_along_axis(among, near, 1)], axis=1)
        degree = DEGREE
        chosen = self._spread(ids, sims, degree)
        self.layers[k][new, :degree] = chosen
        # Each link also runs back; a node that has more than its share then chooses again among all.
        source, target = np.repeat(new, degree), chosen.ravel()
        source, target = source[target >= 0], target[target >= 0]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        nodes, first, count = np.unique(target, return_index=True, return_counts=True)
        wide = self.layers[k].shape[1] + int(count.max(initial=0))
        for some in np.array_split(np.arange(len(nodes)), -(-len(nodes) // max(1, min(1024, _PLACES // wide))) or 1):
            if not len(some):
                continue
            most = int(count[some].max())
            back = first[some][:, None] + np.arange(most)
            inside = np.arange(most) < count[some][:, None]
            back = np.where(inside, source[np.minimum(back, len(source) - 1)], -1)
            ids = np.concatenate([self.layers[k][nodes[some]], back], axis=1)
            sims = np.einsum("ijd,id->ij", self.vectors[ids], self.vectors[nodes[some]])
            self.layers[k][nodes[some]] = self._spread(ids, np.where(ids >= 0, sims, -np.inf), self.layers[k].shape[1])

    def _spread(self, ids: np.ndarray, sims: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates those closer to the node than to any already chosen, then the closest others."""
        width = min(ids.shape[1], 3 * keep)
        best = np.argsort(-sims, axis=1, kind="stable")[:, :width]
        ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
        mutual = np.einsum("ikd,ijd->ikj", self.vectors[ids], self.vectors[ids])
        order = np.full((len(ids), width), 2 * width)
        free = np.isfinite(sims)
        shadow = np.full_like(sims, -np.inf)
        for j in range(width):
            good = free[:, j] & (sims[:, j] > shadow[:, j])
            order[:, j] = np.where(good, j, np.where(free[:, j], width + j, 3 * width))
            shadow = np.where(good[:, None], np.maximum(shadow, mutual[:, :, j]), shadow)
        first = np.argsort(order, axis=1, kind="stable")[:, :keep]
        chosen = np.where(np.take_along_axis(order, first, 1) < 3 * width, np.take_along_axis(ids, first, 1), -1)
        return np.pad(chosen, ((0, 0), (0, keep - chosen.shape[1])), constant_values=-1)

    def _descend(self, x: np.ndarray, k: int, beam: int, done: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        ids = np.zeros((len(x), 1), np.int64)
        sims = x @ self.vectors[0][:, None]
        for layer in range(len(self.layers) - 1, k - 1, -1):
            width = beam if layer == k else max(8, beam // 8)
            limit = min(len(self.layers[layer]), done or len(self.vectors))
            ids, sims = self._beam(x, layer, ids, sims, width, limit)
        return ids, sims

    def _beam(self, x, layer, ids, sims, beam, limit) -> tuple[np.ndarray, np.ndarray]:
        """Best-first search of all rows of x together, the _STEP best open nodes of each at a time."""
        n, links = len(x), self.layers[layer]
        seen = np.zeros((n, limit), bool)
        pad = max(0, beam - ids.shape[1])
        rows = np.arange(n)[:, None]
        seen[np.broadcast_to(rows, ids.shape)[ids >= 0], ids[ids >= 0]] = True
        ids = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1)
        sims = np.pad(sims, ((0, 0), (0, pad)), constant_values=-np.inf)
        open_ = ids >= 0
        step = min(_STEP, ids.shape[1])
        while True:
            live = np.flatnonzero(open_.any(axis=1))
            if not len(live):
                return ids, sims
            at = live[:, None]
            pick = np.argpartition(np.where(open_[live], -sims[live], np.inf), step - 1, axis=1)[:, :step]
            nodes = np.where(np.take_along_axis(open_[live], pick, 1), np.take_along_axis(ids[live], pick, 1), -1)
            open_[at, pick] = False
            near = np.where(nodes[:, :, None] >= 0, links[nodes], -1).reshape(len(live), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & (near < limit)
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            fresh &= ~seen[at, np.where(fresh, near, 0)]
            r, c = np.nonzero(fresh)
            node = near[r, c]
            seen[live[r], node] = True
            value = np.full(near.shape, -np.inf, np.float32)
            value[r, c] = np.einsum("ij,ij->i", self.vectors[node], x[live[r]])
            all_sims = np.concatenate([sims[live], value], axis=1)
            top = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
            sims[at, np.arange(beam)] = np.take_along_axis(all_sims, top, 1)
            ids[at, np.arange(beam)] = np.take_along_axis(np.concatenate([ids[live], np.where(fresh, near, -1)], axis=1), top, 1)
            open_[at, np.arange(beam)] = np.take_along_axis(np.concatenate([open_[live], fresh], axis=1), top, 1)

    def links(self, x: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
        """(row of x, nodes of similarity ``least`` or more). A beam that is full of links is widened for its row."""
        for start in range(0, len(x), _TOGETHER):
            rows = np.arange(start, min(len(x), start + _TOGETHER))
            width = min(beam, len(self.vectors))
            while len(rows):
                wider = []
                for some in np.split(rows, range(0, len(rows), max(1, _PLACES // width))[1:]):
                    ids, sims = self._descend(x[some], 0, width)
                    hit = (sims >= least) & (ids >= 0)
                    full = hit.all(axis=1) & (width < len(self.vectors))
                    for i in np.flatnonzero(~full):
                        yield int(some[i]), ids[i][hit[i]]
                    wider.append(some[full])
                rows, width = np.concatenate(wider), min(4 * width, len(self.vectors))

    def to_bytes(self, **more: np.ndarray) -> bytes:
        """The graph and more arrays. Its vectors are those of ``exact`` in single precision if that is given."""
        own = {} if "exact" in more else {"vectors": self.vectors}
        out = io.BytesIO()
        np.savez(out, **own, **{f"layer{k}": v for k, v in enumerate(self.layers)}, **more)
        return out.getvalue()

    @staticmethod
    def from_bytes(data: bytes) -> tuple[Graph, dict[str, np.ndarray]]:
        found = dict(np.load(io.BytesIO(data)))
        layers = [found[f"layer{k}"] for k in range(sum(k.startswith("layer") for k in found))]
        return Graph(found["exact"].astype(np.float32) if "exact" in found else found["vectors"], layers), found


def _unit(vectors: np.ndarray) -> np.ndarray:
    out = np.empty(vectors.shape)
    for start in range(0, len(vectors), _CHUNK):
        some = vectors[start : start + _CHUNK].astype(np.float64)
        some /= np.abs(some).max(axis=1, keepdims=True, initial=1e-300)
        out[start : start + _CHUNK] = some / np.linalg.norm(some, axis=1, keepdims=True)
    return out


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(-1, dim)


def _units(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    """Unit vectors of a column, without a second copy of it."""
    out, at = np.empty((len(column), dim)), 0
    for chunk in column.chunks:
        out[at : at + len(chunk)] = _unit(_matrix(chunk, dim))
        at += len(chunk)
    return out


def _verified(graph: Graph, exact: np.ndarray, x: np.ndarray, least: float, beam: int) -> Iterator[tuple[int, np.ndarray]]:
    for i, nodes in graph.links(x.astype(np.float32), least - 1e-4, beam):
        yield i, nodes[exact[nodes] @ x[i] >= least]


def build_shards(points: DataFrame, least: float, beam: int) -> DataFrame:
    """(dim, shard, part, graph, linked): the graph of each shard, with ids, copies and the least id that links inside it reach.

    A graph is cut into parts of PART_BYTES. linked has at most AUDIT_ROWS ids of points that have a link inside the
    shard, in the first part.
    """
    size = PART_BYTES

    def run(key: tuple, table: pa.Table) -> pa.Table:
        dim = key[0].as_py()
        exact = _units(table.column("vector"), dim)
        graph, order = Graph.build(exact.astype(np.float32), seed=key[1].as_py())
        exact, ids = exact[order], np.asarray(table.column("rep"))[order]
        root, linked = np.arange(len(ids)), np.zeros(len(ids), bool)

        def find(a: int) -> int:
            while root[a] != a:
                root[a] = root[root[a]]
                a = root[a]
            return a

        for i, nodes in _verified(graph, exact, exact, least, beam):
            for j in nodes:
                linked[[i, j]] |= i != j
                a, b = find(i), find(int(j))
                if a != b:
                    root[max(a, b, key=lambda k: ids[k])] = min(a, b, key=lambda k: ids[k])
        group = ids[[find(i) for i in range(len(ids))]]
        packed = memoryview(graph.to_bytes(exact=exact, ids=ids, copies=np.asarray(table.column("copies"))[order], group=group))
        parts = [packed[i : i + size] for i in range(0, len(packed), size)]
        return pa.table({
            "dim": pa.array([dim] * len(parts), pa.int32()), "shard": pa.array([key[1].as_py()] * len(parts), pa.int32()),
            "part": pa.array(range(len(parts)), pa.int32()), "graph": pa.array(parts, pa.binary()),
            "linked": pa.array([np.sort(ids[linked])[:AUDIT_ROWS].tolist()] + [[]] * (len(parts) - 1), pa.list_(pa.int64())),
        })

    return points.groupBy("dim", "shard").applyInArrow(run, "dim int, shard int, part int, graph binary, linked array<bigint>")


def search_shards(
    points: DataFrame, graphs: DataFrame, shards: int, least: float, beam: int, block_rows: int
) -> DataFrame:
    """(rep, n, back, groups): per point and shard the number of linked vectors there and the groups they belong to.

    Points go to every shard of their dimension, in blocks of about block_rows; a task gets the parts of one graph, then
    the points of one block in batches, so it holds a graph and a batch. A second row per block and point of the shard
    has in back by how many vectors of the block it was found, so that a link counts at both ends without a row per pair.
    """
    blocks = max(1, -(-points.count() // block_rows))
    block = F.pmod(F.xxhash64("rep", F.lit(3)), F.lit(blocks)).cast("int").alias("block")
    shard = F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard")
    asked = points.select("dim", F.lit(_ASKS).alias("part"), F.lit(None).cast("binary").alias("graph"), "rep", "copies", "vector", block, shard)
    part = F.col("part") if "part" in graphs.columns else F.lit(0)
    every = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block")
    empty = [F.lit(None).cast(points.schema[c].dataType).alias(c) for c in ("rep", "copies", "vector")]
    rows = graphs.select("dim", part.cast("int").alias("part"), "graph", *empty, every, "shard").unionByName(asked)
    rows = rows.repartitionById(shards * blocks, F.col("shard") * blocks + F.col("block")).sortWithinPartitions("dim", "part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer(rep, n, back, groups) -> pa.RecordBatch:
            types = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((rep, n, back, groups), types)], ["rep", "n", "back", "groups"])

        def found_of() -> Iterator[pa.RecordBatch]:
            if net is not None and len(hit := np.flatnonzero(back)):
                yield answer(more["ids"][hit], np.zeros(len(hit), np.int64), back[hit], [[]] * len(hit))

        dim, parts, net, more, back = None, [], None, {}, None
        for batch in batches:
            dims, asks = np.asarray(batch.column(0)), np.asarray(batch.column(1)) == _ASKS
            edges = np.flatnonzero(np.append(True, (dims[1:] != dims[:-1]) | (asks[1:] != asks[:-1]))).tolist() if len(dims) else []
            for first, after in zip(edges, [*edges[1:], len(dims)]):
                some = batch.slice(first, after - first)
                if dims[first] != dim:
                    yield from found_of()
                    dim, parts, net = int(dims[first]), [], None
                if not asks[first]:
                    parts += [value.as_buffer() for value in some.column(2)]
                    continue
                if net is None and parts:
                    net, more = Graph.from_bytes(b"".join(parts))
                    parts, back = [], np.zeros(len(more["ids"]), np.int64)
                if net is None:
                    continue
                ids, copies, x = np.asarray(some.column(3)), np.asarray(some.column(4)), _unit(_matrix(some.column(5), dim))
                found = []
                for i, nodes in _verified(net, more["exact"], x, least, beam):
                    nodes = nodes[more["ids"][nodes] != ids[i]]
                    if len(nodes):
                        back[nodes] += copies[i]
                        found.append((ids[i], int(more["copies"][nodes].sum()), 0, np.unique(more["group"][nodes]).tolist()))
                if found:
                    yield answer(*zip(*found))
        yield from found_of()

    columns = ["dim", "part", "graph", "rep", "copies", "vector"]
    return rows.select(*columns).mapInArrow(released(run), "rep bigint, n bigint, back bigint, groups array<bigint>")


def _true_counts(points: DataFrame, sample: list, least: float) -> dict[int, int]:
    """Links of the sampled points by comparing each with all points; the sample is bounded."""
    by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in {r["dim"] for r in sample}:
        own = [r for r in sample if r["dim"] == dim]
        by_dim[dim] = np.array([r["rep"] for r in own]), _unit(np.array([r["vector"] for r in own], np.float64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            table = pa.table(batch)
            for dim, (ids, x) in by_dim.items():
                rows = table.filter(pa.compute.equal(table.column("dim"), dim))
                if not rows.num_rows:
                    continue
                hit = _units(rows.column("vector"), dim) @ x.T >= least
                hit &= np.asarray(rows.column("rep"))[:, None] != ids[None, :]
                n = (hit * np.asarray(rows.column("copies"))[:, None]).sum(axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(n.astype(np.int64))], ["rep", "n"])

    rows = points.select("dim", "rep", "copies", "vector").mapInArrow(run, "rep bigint, n bigint")
    return {r["rep"]: r["n"] for r in rows.groupBy("rep").agg(F.sum("n").alias("n")).collect()}


def audited_beam(
    points: DataFrame, graphs: DataFrame, shards: int, least: float, block_rows: int, target: float = TARGET_RECALL
) -> int:
    """The first beam, doubled from FIRST_BEAM, with which a bounded sample finds its links, compared with brute force.

    Both the share of all links and the mean share per point must reach the target. AUDIT_ROWS points are drawn by a
    hash. Where links are rare these hardly have any; then as many points that have a link inside their own shard are
    audited too, with all their links in all shards. If still fewer than AUDIT_LINKED points have links, the beam starts
    at UNSURE_BEAM. The driver gets at most 2 * AUDIT_ROWS points.
    """
    share = max(1, points.count() // AUDIT_ROWS)
    sample = points.where(F.pmod(F.xxhash64("rep", F.lit(5)), F.lit(share)) == 0).orderBy(F.xxhash64("rep", F.lit(6)), "rep").limit(AUDIT_ROWS).collect()
    truth = _true_counts(points, sample, least)
    if sum(n > 0 for n in truth.values()) < AUDIT_LINKED:
        drawn = graphs.select(F.explode("linked").alias("rep")).orderBy(F.xxhash64("rep", F.lit(7)), "rep").limit(AUDIT_ROWS)
        known = {r["rep"] for r in sample}
        more = [r for r in points.join(F.broadcast(drawn), "rep", "left_semi").collect() if r["rep"] not in known]
        truth |= _true_counts(points, more, least) if more else {}
        sample += more
    linked = [r for r in sample if truth.get(r["rep"])]
    beam = FIRST_BEAM if len(linked) >= AUDIT_LINKED else UNSURE_BEAM
    asked = points.sparkSession.createDataFrame(linked, points.schema) if linked else None
    while linked:
        found = search_shards(asked, graphs, shards, least, beam, block_rows).groupBy("rep").agg(F.sum("n").alias("n")).where("n > 0")
        asked_ids = {r["rep"] for r in linked}
        got = {r["rep"]: r["n"] for r in found.join(F.broadcast(asked.select("rep")), "rep", "left_semi").collect()}
        shares = [got.get(k, 0) / truth[k] for k in asked_ids]
        if min(sum(shares) / len(shares), sum(got.values()) / sum(truth[k] for k in asked_ids)) >= target or beam >= SHARD_ROWS:
            break
        beam *= 2
    return beam


def near_vectors(
    vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", least: float = 0.9,
    shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS, target: float = TARGET_RECALL,
) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: links have a cosine of at least ``least``, in doubles.

    Equal vectors are one point with a number of copies, combined before the shuffle, so thousands of copies cost
    nothing in the search. A link that the search finds from one end only joins both ends into a component; n_links is
    the larger of the numbers found from a vector and found of it, so no link is counted that is none. Points are dealt into shards by a hash; each shard is a graph in the shared folder. A point
    gives one row per shard, with the groups that its links belong to, so a group of near copies makes no pairs.
    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, and so do rows
    without id, whose component is null; vectors of different lengths never link. Repeated rows count as vectors of
    their own with the same id. An empty table stays empty. Other columns are ignored.
    """
    rows = vectors.select(F.col(vec_id).cast("bigint").alias("vec_id"), F.col(vector).cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    zero = ~F.exists("vector", lambda v: v != 0)
    usable = F.coalesce(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~bad & ~zero, F.lit(False))
    rows = rows.withColumn("vector", F.when(usable, F.col("vector")))
    points = rows.where("vector is not null").groupBy("vector").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"))
    points = materialized(points.select("rep", "copies", F.size("vector").alias("dim"), "vector"))
    size = points.agg(F.count("*").alias("n"), F.coalesce(F.max("dim"), F.lit(0)).alias("dim")).first()
    # Doubles, floats and links of a point.
    shard_rows = max(1, min(shard_rows, SHARD_BYTES // (12 * size["dim"] + 5 * 4 * DEGREE)))
    shards = max(MIN_SHARDS, -(-size["n"] // shard_rows))
    dealt = points.withColumn("shard", F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int"))
    graphs = materialized(build_shards(dealt, least, FIRST_BEAM), **{"parquet.block.size": GROUP_BYTES})
    beam = audited_beam(points, graphs, shards, least, block_rows, target)
    found = materialized(search_shards(points, graphs, shards, least, beam, block_rows))
    links = found.select(F.col("rep").alias("a"), F.explode("groups").alias("b")).where("a <> b")
    joined = components(links).withColumnRenamed("node", "_node")
    counted = found.groupBy("rep").agg(F.greatest(F.sum("n"), F.sum("back")).alias("n"))
    per_point = points.join(counted, "rep", "left").join(joined, F.col("rep") == F.col("_node"), "left").select(
        F.col("vector").alias("_vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component", "rep").alias("component"),
    )
    out = rows.where("vector is not null").join(per_point, F.col("vector") == F.col("_vector"))
    lone = rows.where("vector is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    every = out.select("vec_id", "n_links", F.col("component").alias("component_id")).union(lone)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
