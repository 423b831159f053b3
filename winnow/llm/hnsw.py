"""Near-duplicate vectors: a navigable small-world graph per shard, audited searches, exact cosine, linked components."""

from __future__ import annotations

import math
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from winnow.llm.kneser import mounted
from winnow.llm.shared import components, discard_folder, split_by_keys, stars, store
from winnow.session import scratch_path

THRESHOLD = 0.9
DEGREE = 16
BUILD_BEAM = 48
BEAM = 32
EXPAND = 4
MIN_SHARDS = 6
SHARD_VECTORS = 200_000
SHARD_BYTES = 1 << 27
BLOCK = 2048
BLOCKS_PER_TASK = 8
MAX_TASKS = 10_000
AUDITED = 16
RECALL = 0.99
VISITED = 1 << 25
WIDEST = 1024
COMPARED = 256
HELD = 1 << 20
GATHERED = 64
FIRST = 1024


# --- one graph ----------------------------------------------------------------------------------------------------


@dataclass
class Graph:
    """Unit vectors, highest level first, with the neighbour lists of each layer (-1 for none); layer 0 is the last."""

    vectors: np.ndarray
    layers: list[np.ndarray]


def levels_of(ids: np.ndarray) -> np.ndarray:
    """Level of each id, falling by `DEGREE` from layer to layer; drawn from a hash of the id."""
    z = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        z = (z ^ (z >> np.uint64(shift))) * np.uint64(factor)
    u = ((z ^ (z >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return np.minimum(8, (-np.log(np.maximum(u, 1e-18)) / math.log(DEGREE)).astype(int))


def search_layer(vectors: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams (ids, similarities) of all queries at once, best first; -1 where a beam is not full.

    Each round expands the best few members of every beam that have not been expanded yet, until none is left.
    """
    n, b = len(links), len(queries)
    ids = np.full((b, beam), -1, np.int64)
    sims = np.full((b, beam), -np.inf, np.float32)
    done = np.ones((b, beam), bool)
    seen = np.zeros((b, n), bool)
    rows = np.arange(b)
    ids[:, 0] = entry
    sims[:, 0] = np.einsum("bd,bd->b", queries, vectors[entry])
    done[:, 0] = False
    seen[rows, entry] = True
    while len(rows):
        own = np.where(done[rows], -np.inf, sims[rows])
        k = min(EXPAND, beam)
        pick = np.argpartition(-own, k - 1, axis=1)[:, :k]
        good = np.take_along_axis(own, pick, 1) > -np.inf
        active = good.any(axis=1)
        rows, pick, good = rows[active], pick[active], good[active]
        if not len(rows):
            break
        done[rows[:, None], pick] = True
        near = links[np.where(good, ids[rows[:, None], pick], 0)]
        near = np.where(good[:, :, None], near, -1).reshape(len(rows), -1)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        near[(near >= 0) & seen[rows[:, None], near]] = -1
        r, c = np.nonzero(near >= 0)
        seen[rows[r], near[r, c]] = True
        new = np.empty(near.shape, np.float32)
        for at in range(0, len(rows), GATHERED):
            part = near[at : at + GATHERED]
            new[at : at + GATHERED] = (vectors[np.maximum(part, 0)] @ queries[rows[at : at + GATHERED], :, None])[:, :, 0]
        new[near < 0] = -np.inf
        all_sims = np.concatenate([sims[rows], new], axis=1)
        keep = np.argpartition(-all_sims, beam - 1, axis=1)[:, :beam]
        sims[rows] = np.take_along_axis(all_sims, keep, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], axis=1), keep, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], near < 0], axis=1), keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    sims = np.take_along_axis(sims, order, 1)
    return np.where(np.isneginf(sims), -1, np.take_along_axis(ids, order, 1)), sims


def _diverse(vectors: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours out of candidates sorted by similarity: those nearer to the node than to a chosen one, then the rest."""
    out = np.full((len(cand), degree), -1, np.int64)
    for at in range(0, len(cand), FIRST):
        c, s = cand[at : at + FIRST], sims[at : at + FIRST]
        v = vectors[np.maximum(c, 0)]
        between = v @ v.transpose(0, 2, 1)
        chosen = np.zeros(c.shape, bool)
        for k in range(c.shape[1]):
            closest = np.where(chosen, between[:, k], -np.inf).max(axis=1)
            chosen[:, k] = (c[:, k] >= 0) & (closest < s[:, k]) & (chosen.sum(axis=1) < degree)
        rank = np.where(chosen, 0, np.where(c >= 0, 1, 2)) * c.shape[1] + np.arange(c.shape[1])
        best = np.argsort(rank, axis=1)[:, :degree]
        out[at : at + FIRST, : best.shape[1]] = np.take_along_axis(c, best, 1)
    return out


def _add_links(vectors: np.ndarray, links: np.ndarray, new: np.ndarray, chosen: np.ndarray) -> None:
    """Set the links of new nodes and the links back; lists that would be too long are chosen anew."""
    degree = links.shape[1]
    links[new] = chosen
    r, c = np.nonzero(chosen >= 0)
    if not len(r):
        return
    to, back = chosen[r, c], new[r]
    touched = np.unique(to)
    old_r, old_c = np.nonzero(links[touched] >= 0)
    node = np.concatenate([to, touched[old_r]])
    other = np.concatenate([back, links[touched][old_r, old_c]])
    once = np.unique(node * len(links) + other)
    node, other = once // len(links), once % len(links)
    sims = np.empty(len(node), np.float32)
    for at in range(0, len(node), BLOCK):
        part = slice(at, at + BLOCK)
        sims[part] = np.einsum("ij,ij->i", vectors[node[part]], vectors[other[part]])
    order = np.lexsort((-sims, node))
    node, other, sims = node[order], other[order], sims[order]
    starts = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
    place = np.arange(len(node)) - np.repeat(starts, np.diff(np.append(starts, len(node))))
    width = degree + degree // 2
    fits = place < width
    row = np.cumsum(np.concatenate(([False], node[1:] != node[:-1])))
    cand = np.full((len(starts), width), -1, np.int64)
    near = np.full((len(starts), width), -np.inf, np.float32)
    cand[row[fits], place[fits]] = other[fits]
    near[row[fits], place[fits]] = sims[fits]
    over = cand[:, degree] >= 0
    links[node[starts]] = cand[:, :degree]
    links[node[starts[over]]] = _diverse(vectors, cand[over], near[over], degree)


def _top(sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    k = min(k, sims.shape[1])
    at = np.argpartition(-sims, k - 1, axis=1)[:, :k]
    s = np.take_along_axis(sims, at, 1)
    order = np.argsort(-s, axis=1, kind="stable")
    return np.take_along_axis(at, order, 1), np.take_along_axis(s, order, 1)


def _nearest_beside(vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k others most similar to each vector, best first."""
    parts = []
    for at in range(0, len(vectors), COMPARED):
        own = vectors[at : at + COMPARED] @ vectors.T
        own[np.arange(len(own)), np.arange(at, at + len(own))] = -np.inf
        parts.append(_top(own, k))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def build(vectors: np.ndarray, levels: np.ndarray) -> Graph:
    """Graph of unit vectors that are sorted by level, highest first.

    Layer by layer from the top: the nodes of a layer are a prefix, and enter in growing batches. A batch searches the
    nodes before it, starting from the layer above, and compares its own members directly. A search may start at any node
    of the layer above, so where that has more nodes than a first batch, they bring their links from it.
    """
    graph = Graph(vectors, [])
    for level in range(int(levels.max()) if len(levels) else 0, -1, -1):
        n = int((levels >= level).sum())
        if not n:
            continue
        degree = 2 * DEGREE if level == 0 else DEGREE
        links = np.full((n, degree), -1, np.int64)
        at = 0
        if graph.layers and len(graph.layers[-1]) > FIRST:
            at = len(graph.layers[-1])
            links[:at, :DEGREE] = graph.layers[-1]
        while at < n:
            size = min(n - at, max(FIRST, min(at, 2 * BLOCK)))
            new = np.arange(at, at + size)
            cand, sims = _nearest_beside(vectors[at : at + size], BUILD_BEAM)
            cand = np.where(np.isneginf(sims), -1, cand + at)
            if at:
                found, near = _search(graph, links, vectors[new], BUILD_BEAM, at)
                cand, sims = np.concatenate([cand, found], axis=1), np.concatenate([sims, near], axis=1)
                best, sims = _top(sims, BUILD_BEAM)
                cand = np.take_along_axis(cand, best, 1)
            _add_links(vectors, links, new, _diverse(vectors, cand, sims, degree))
            at += size
        graph.layers.append(links.astype(np.int32))
    return graph


def _search(graph: Graph, links: np.ndarray, queries: np.ndarray, beam: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Beams at a layer among its first n nodes; the entry comes from the layers above."""
    size = max(1, min(BLOCK, VISITED // n))
    parts = []
    for at in range(0, len(queries), size):
        q = queries[at : at + size]
        entry = np.zeros(len(q), np.int64)
        for layer in graph.layers:
            if layer is not links:
                entry = search_layer(graph.vectors, layer, q, entry, 1)[0][:, 0]
        parts.append(search_layer(graph.vectors, links[:n], q, entry, beam))
    return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def search(graph: Graph, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    return _search(graph, graph.layers[-1], queries, beam, len(graph.vectors))


def _worth(beam: int, n: int) -> bool:
    """Whether a search with this beam costs less than comparing with all n nodes; the first beam is left out in small shards only."""
    return beam < n // 8 and (beam <= BEAM or beam < n // WIDEST)


def within(graph: Graph, queries: np.ndarray, least: float, beam: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Parts of (query, node) of everything a search finds at or above `least`.

    Beams whose last member is still at or above it are widened fourfold; a query whose next beam costs more than the
    shard is compared with all of it.
    """
    n, todo = len(graph.vectors), np.arange(len(queries))
    while len(todo) and _worth(beam, n):
        ids, sims = search(graph, queries[todo], beam)
        full = (ids[:, -1] >= 0) & (sims[:, -1] >= least)
        r, c = np.nonzero((sims >= least) & (ids >= 0) & ~full[:, None])
        yield todo[r], ids[r, c]
        todo, beam = todo[full], beam * 4
    yield from _compare(graph, queries, todo, least)


def all_within(graph: Graph, queries: np.ndarray, least: float, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts of `within` in one."""
    return _joined(within(graph, queries, least, beam))


def _joined(parts) -> tuple[np.ndarray, np.ndarray]:
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64)), *parts]
    return np.concatenate([q for q, _ in parts]), np.concatenate([x for _, x in parts])


def _compare(graph: Graph, queries: np.ndarray, todo: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) at or above `least` by comparing all, in tiles that bound the memory."""
    wide = VISITED // 16 // COMPARED
    for at in range(0, len(todo), COMPARED):
        part = queries[todo[at : at + COMPARED]]
        for first in range(0, len(graph.vectors), wide):
            r, c = np.nonzero(part @ graph.vectors[first : first + wide].T >= least)
            yield todo[at + r], first + c


# --- shards in Spark ----------------------------------------------------------------------------------------------


def unit(values: np.ndarray) -> np.ndarray:
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def usable(vectors: DataFrame, vector: str, vec_id: str) -> DataFrame:
    """(vec_id, v array of doubles, or of floats as they are) of vectors that are not null, empty or zero and hold finite numbers only."""
    single = vectors.select(vector).schema[0].dataType.simpleString() == "array<float>"
    v = F.col(vector) if single else F.col(vector).cast("array<double>")
    good = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(F.coalesce(x, F.lit(0.0))))
    return vectors.select(F.col(vec_id).alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & good & F.exists("v", lambda x: x != 0))


def _singles(values: np.ndarray, order: np.ndarray | None = None) -> np.ndarray:
    """Unit vectors in single precision, in an order."""
    out = np.empty(values.shape, np.float32)
    for at in range(0, len(out), BLOCK):
        part = slice(at, at + BLOCK)
        out[part] = unit(values[part if order is None else order[part]].astype(np.float64))
    return out


@dataclass
class Shard:
    """A graph's file, mapped: nodes by level with their ids, copies and vectors as given, and the links of each layer."""

    reps: np.ndarray
    weights: np.ndarray
    values: np.ndarray
    layers: list[np.ndarray]

    def graph(self) -> Graph:
        return Graph(_singles(self.values), self.layers)

    def exact(self, nodes: np.ndarray | slice) -> np.ndarray:
        return unit(self.values[nodes].astype(np.float64))


def _path(folder: str, shard: int, dim: int) -> str:
    return f"{folder}/graph-{shard}-{dim}"


def _build_shards(folder: str):
    """Build the graph of a shard and write it under its final name at once, so that a repeated task leaves the same file."""

    def run(key, table):
        shard, dim = key[0].as_py(), key[1].as_py()
        rep, weight = (table.column(c).to_numpy().astype(np.int64) for c in ("rep", "weight"))
        values = table.column("v").combine_chunks().flatten().to_numpy().reshape(-1, dim)
        levels = levels_of(rep)
        order = np.lexsort((rep, -levels))
        graph = build(_singles(values, order), levels[order])
        head = [len(rep), values.itemsize, len(graph.layers), *(x for layer in graph.layers for x in layer.shape)]
        os.makedirs(folder, exist_ok=True)
        draft = f"{folder}/.{uuid.uuid4().hex}"
        with open(draft, "wb") as out:
            for x in (np.array(head, np.int64), rep[order], weight[order]):
                out.write(x.tobytes())
            for at in range(0, len(order), BLOCK):
                out.write(values[order[at : at + BLOCK]].tobytes())
            for layer in graph.layers:
                out.write(layer.tobytes())
        size = os.path.getsize(draft)
        os.replace(draft, _path(folder, shard, dim))
        return pa.table({"shard": pa.array([shard], pa.int32()), "dim": pa.array([dim], pa.int32()), "nodes": pa.array([len(rep)]), "size": pa.array([size])})

    return run


def open_shard(folder: str, shard: int, dim: int, size: int) -> Shard:
    """The mapped file of a shard, an error where it is gone or has another size."""
    path = _path(folder, shard, dim)
    found = os.path.getsize(path) if os.path.exists(path) else None
    if found != size:
        raise RuntimeError(f"{path} should have {size} bytes but {'is missing' if found is None else f'has {found}'}; is the shared folder mounted here?")
    data, at = np.memmap(path, np.uint8, "r").view(np.ndarray), 0

    def take(kind, *shape):
        nonlocal at
        begin, at = at, at + math.prod(shape) * np.dtype(kind).itemsize
        return data[begin:at].view(kind).reshape(shape)

    n, item, depth = take(np.int64, 3).tolist()
    sizes = take(np.int64, depth, 2).tolist()
    return Shard(take(np.int64, n), take(np.int64, n), take(f"f{item}", n, dim), [take(np.int32, *x) for x in sizes])


def _audited(graph: Graph, queries: np.ndarray, least: float) -> int:
    """A beam, doubled until the links of some audited queries are found at the wanted recall."""
    audit = np.unique(np.linspace(0, len(queries) - 1, AUDITED).astype(int))
    truth = sum(len(c) for _, c in _compare(graph, queries, audit, least))
    beam = BEAM
    while truth and _worth(beam, len(graph.vectors)):
        if sum(len(c) for _, c in within(graph, queries[audit], least, beam)) >= RECALL * truth:
            break
        beam *= 2
    return beam


class _Links:
    """Link counts of some queries and the groups of linked nodes, which never hold more than some of the pairs."""

    def __init__(self, queries: int):
        self.counts = np.zeros(queries, np.int64)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        self.pairs.append((a, b))
        self.held += len(a)
        if self.held >= HELD:
            self.pairs = [self.groups()]
            self.held = 0

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """(node, smallest node of its group) of every node that is not the smallest."""
        a, b = _joined(self.pairs)
        nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
        label = stars(place[: len(a)], place[len(a) :], len(nodes))
        far = np.flatnonzero(label != np.arange(len(nodes)))
        return nodes[far], nodes[label[far]]


def _links_between(own: Shard, other: Shard, same: bool, first: int, last: int, threshold: float, block: int) -> pa.RecordBatch:
    """Link counts of some nodes of a shard with another shard (or the same), and one star per linked group."""
    graph, n = other.graph(), len(other.reps)
    begin = first if same else n  # the first query's number beside those of the other shard's nodes
    found = _Links(last - first)
    for at in range(first, last, block):
        exact = own.exact(slice(at, min(last, at + block)))
        queries = exact.astype(np.float32)
        least = threshold - 1e-4
        for q, x in within(graph, queries, least, _audited(graph, queries, least)):
            for k in range(0, len(q), 65536):
                i, j = q[k : k + 65536], x[k : k + 65536]
                near = (np.einsum("ij,ij->i", exact[i], other.exact(j)) >= threshold) & (own.reps[at + i] != other.reps[j])
                i, j = i[near] + at - first, j[near]
                found.counts += np.bincount(i, weights=other.weights[j], minlength=last - first).astype(np.int64)
                found.add(begin + i, j)
    far, least_node = found.groups()
    ids = other.reps if same else np.concatenate([other.reps, own.reps[first:last]])
    some = np.flatnonzero(found.counts)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([own.reps[first + some], ids[far]])),
            pa.array(np.concatenate([np.zeros(len(some), np.int64), ids[least_node]]), mask=np.arange(len(some) + len(far)) < len(some)),
            pa.array(np.concatenate([found.counts[some], np.zeros(len(far), np.int64)])),
        ],
        ["a", "b", "links"],
    )


def _query_shards(folder: str, threshold: float, step: int, block: int):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                own, other = (open_shard(folder, row[s], row["dim"], row[f"{s}_size"]) for s in ("q", "x"))
                first = row["first"]
                yield _links_between(own, other, row["q"] == row["x"], first, min(first + step, len(own.reps)), threshold, block)

    return run


def near_vectors(vectors: DataFrame, threshold: float = THRESHOLD, vector: str = "embedding", vec_id: str = "vec_id", min_shards: int = MIN_SHARDS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every vector.

    Equal vectors form one node. Nodes are dealt to shards by hash, each small enough for one task, whose graphs are
    written once below the shared folder (mounted on all machines) and mapped in the tasks; every shard's nodes query
    every shard, some blocks of them in a task. A task gets names of files and sends link counts and one star per linked
    group, never vectors or pairs. Null, zero and non-finite vectors link with nothing; vectors of other lengths do not
    meet; repeated ids count as vectors of their own but share one row of the result's key; an empty table gives an empty
    result.
    """
    spark = vectors.sparkSession
    good = usable(vectors, vector, vec_id).filter("vec_id IS NOT NULL")
    nodes = store(good.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight")), "vectors")
    total, numbers = nodes.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    shards = max(min_shards, -(-total // SHARD_VECTORS), -(-8 * numbers // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("rep"), F.lit(shards)).cast("int")
    dealt = nodes.select(shard.alias("shard"), F.size("v").alias("dim"), "rep", "weight", "v")
    dealt = dealt.repartitionByRange(4 * shards, "shard").groupBy("shard", "dim")
    folder = mounted(scratch_path(spark, "graphs"))
    graphs = store(dealt.applyInArrow(_build_shards(folder), "shard int, dim int, nodes long, size long"), "graphs")
    step = BLOCK * BLOCKS_PER_TASK
    firsts = F.explode(F.expr(f"sequence(0L, nodes - 1, {step}L)")).alias("first")
    own = graphs.select("dim", F.col("shard").alias("q"), F.col("size").alias("q_size"), firsts)
    tasks = store(own.join(graphs.select("dim", F.col("shard").alias("x"), F.col("size").alias("x_size")), "dim"), "graph-pairs")
    met = tasks.repartition(max(1, min(MAX_TASKS, tasks.count())))
    found = store(met.mapInArrow(_query_shards(folder, threshold, step, BLOCK), "a long, b long, links long"), "vector-links")
    discard_folder(spark, folder)
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    classes = components(found.filter("b IS NOT NULL").select("a", "b"))
    # only vectors with copies have to meet their node; of the others the node has the id
    copied = nodes.filter("weight > 1")
    maybe, _ = split_by_keys(good, F.xxhash64("v"), copied.select(F.xxhash64("v")))
    members = nodes.filter("weight = 1").select(F.col("rep").alias("vec_id"), "rep", "weight").unionByName(maybe.join(copied, "v").select("vec_id", "rep", "weight"))
    members = members.join(counts, "rep", "left").join(classes.withColumnRenamed("node", "rep"), "rep", "left")
    links = F.coalesce("links", F.lit(0)) + F.col("weight") - 1
    linked = members.select(F.col("vec_id").alias("_id"), links.alias("n"), F.coalesce("component", "rep").alias("c")).distinct()
    every = vectors.select(F.col(vec_id).alias("vec_id"))
    joined = every.join(linked, F.col("vec_id") == F.col("_id"), "left")
    component = F.coalesce("c", "vec_id")
    return joined.select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept")
    )
