"""Embedding near-dedup with navigable small-world graphs, one per shard.

Vectors are made distinct first, by their bytes; copies join their first one
again at the end. Distinct vectors go to shards by hash, and each shard's task builds
a hierarchical navigable small-world graph, in batches so that numpy does the work. It then
audits itself: vectors at the threshold's angle to a sample of its own are searched,
and the beam is doubled until the links that a full comparison finds are found to
``RECALL``; a shard that no beam up to ``WIDEST`` satisfies is always scanned in full. Graphs and
blocks of query vectors are files in the folder that all executors share, so that
a graph is not shuffled for each block that asks it.

Every vector queries its own shard and all shards after it, which covers each pair of shards once; links to another shard
count for both ends. Found neighbours are verified in double
precision. A search whose whole beam lies over the threshold may have missed some: its beam is
doubled until one falls below, and then the shard is scanned in full for it. Found pairs are
counted and joined a stripe of queries at a time and then forgotten, however many there are. A task
returns the number of links of each vector and, for each group, links that join it; components join those.

Vectors that are null, zero, or hold null or non-finite components link with nothing, as do
vectors of different length. Rows that repeat an id are one vector each, and link if their
components do; ties have no order that matters. A null id is a component's id only if it has no other. An empty table gives no rows. Only the
two columns named are read, so others may have any names; there are no texts.
"""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, fresh_path, written
from .components import Forest, components
from .warc import filesystem

THRESHOLD = 0.95
#: Distinct vectors in a shard and in a block, on average.
SHARD, BLOCK = 16_384, 2_048
#: Neighbours chosen for a vector, and kept in the lowest layer; beam while building.
CHOSEN, KEPT, BUILDING = 16, 32, 32
FIRST_BEAM, WIDEST, RECALL, AUDITED = 8, 256, 0.99, 256
#: Queries searched at a time, and compared with a whole shard at a time.
_QUERIES, _STRIPE = 512, 128


def beam_search(x: np.ndarray, edges: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and their cosines, (queries, width), of a best-first search from ``entry`` (queries, k)."""
    n, q, slots = len(x), len(queries), edges.shape[1]
    seen = np.zeros(q * n, bool)
    out_nodes, out_sims = np.empty((q, width), np.int32), np.empty((q, width), np.float32)
    # The beam and, behind it, room for one node's neighbours; distances are cosines with their sign changed.
    nodes, far, done = np.full((q, width + slots), -1, np.int32), np.full((q, width + slots), np.inf, np.float32), np.ones((q, width + slots), bool)
    entry = entry[:, :width]
    k = entry.shape[1]
    ok = entry >= 0
    nodes[:, :k] = entry
    far[:, :k] = np.where(ok, -np.einsum("qkd,qd->qk", x[np.maximum(entry, 0)], queries), np.inf)
    done[:, :k] = ~ok
    r, c = np.nonzero(ok)
    seen[r * n + entry[r, c]] = True
    row, all_ = np.arange(q), np.arange(q)
    while True:
        open_ = np.where(done[:, :width], np.inf, far[:, :width])
        best = open_.argmin(axis=1)
        ended = open_[all_, best] == np.inf
        if ended.any():
            out_nodes[row[ended]], out_sims[row[ended]] = nodes[ended, :width], -far[ended, :width]
            live = ~ended
            nodes, far, done, queries, row, best = nodes[live], far[live], done[live], queries[live], row[live], best[live]
            all_ = all_[: len(row)]
            if not len(row):
                return out_nodes, out_sims
        done[all_, best] = True
        around = edges[nodes[all_, best]]
        flat = around + (row * n)[:, None]
        fresh = ~seen[flat]
        fresh &= around >= 0
        r, c = np.nonzero(fresh)
        seen[flat[r, c]] = True
        found = -np.einsum("id,id->i", x[around[r, c]], queries[r])
        nearer = found < far[:, :width].max(axis=1)[r]
        r, c, found = r[nearer], c[nearer], found[nearer]
        if not len(r):
            continue
        grow = np.unique(r)
        at = np.empty(len(row), np.int64)
        at[grow] = np.arange(len(grow))
        own_far, own_nodes, own_done = far[grow], nodes[grow], done[grow]
        own_far[:, width:] = np.inf
        own_far[at[r], width + c] = found
        own_nodes[:, width:] = around[grow]
        own_done[:, width:] = False
        top = np.argpartition(own_far, width - 1, axis=1)[:, :width]
        rows = np.arange(len(grow))[:, None]
        kept = own_far[rows, top]
        far[grow, :width], nodes[grow, :width] = kept, own_nodes[rows, top]
        done[grow, :width] = own_done[rows, top] | (kept == np.inf)


def choose(x: np.ndarray, base: np.ndarray, nodes: np.ndarray, most: int) -> np.ndarray:
    """Of candidate nodes (rows, c; -1: none), up to ``most``: those closer to the row's vector than to one chosen before, then the closest others."""
    sims = np.where(nodes >= 0, np.einsum("rcd,rd->rc", x[np.maximum(nodes, 0)], base), -np.inf)
    order = np.argsort(-sims, axis=1, kind="stable")
    nodes, sims = np.take_along_axis(nodes, order, 1), np.take_along_axis(sims, order, 1)
    own = x[np.maximum(nodes, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken = np.zeros(nodes.shape, bool)
    near, count = np.full(nodes.shape, -np.inf, np.float32), np.zeros(len(nodes), np.int64)
    for c in range(nodes.shape[1]):
        pick = np.flatnonzero((nodes[:, c] >= 0) & (near[:, c] < sims[:, c]) & (count < most))
        taken[pick, c] = True
        count[pick] += 1
        near[pick, c + 1 :] = np.maximum(near[pick, c + 1 :], between[pick, c, c + 1 :])
    rest = (nodes >= 0) & ~taken
    taken |= rest & (np.cumsum(rest, axis=1) <= (most - count)[:, None])
    out = np.full((len(nodes), most), -1, np.int64)
    r, c = np.nonzero(taken)
    out[r, (np.cumsum(taken, axis=1) - 1)[r, c]] = nodes[r, c]
    return out


class Graph:
    """A graph over unit vectors (float32 for search; the verification has its own)."""

    def __init__(self, x: np.ndarray, seed: int = 9):
        self.x = x
        n = len(x)
        levels = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / math.log(CHOSEN)).astype(np.int64)
        top = int(levels.max(initial=0))
        self.layers = [np.full((n, KEPT if k == 0 else CHOSEN), -1, np.int32) for k in range(top + 1)]
        self.entry, self.width, self.full = 0, FIRST_BEAM, False
        highest, start, size = int(levels[0]) if n else 0, 0, 32
        while start < n:
            self._insert(np.arange(start, stop := min(n, start + size)), levels, start, highest)
            if (own := int(levels[start:stop].max())) > highest or start == 0:
                highest, self.entry = own, start + int(levels[start:stop].argmax())
            start, size = stop, min(2 * size, _QUERIES)

    def _insert(self, new: np.ndarray, levels: np.ndarray, before: int, highest: int) -> None:
        q = self.x[new]
        among = q @ q.T
        np.fill_diagonal(among, -np.inf)
        entry = np.full((len(new), 1), self.entry)
        for layer in range(len(self.layers) - 1, -1, -1):
            at = np.flatnonzero(levels[new] >= layer)
            candidates = np.full((len(new), 1), -1)
            if before and layer <= highest:
                width = BUILDING if layer == 0 else 8
                found, sims = beam_search(self.x, self.layers[layer], q, entry, width)
                entry = np.take_along_axis(found, np.argsort(-sims, axis=1), 1)
                candidates = found
            if not len(at):
                continue
            k = min(CHOSEN, len(at) - 1)
            mates = np.zeros((len(at), 0), np.int64)
            if k:
                mates = new[at[np.argpartition(-among[np.ix_(at, at)], k - 1, axis=1)[:, :k]]]
            picked = choose(self.x, q[at], np.concatenate([candidates[at], mates], axis=1), CHOSEN)
            self.layers[layer][new[at], : picked.shape[1]] = picked
            self._connect(layer, np.repeat(new[at], picked.shape[1]), picked.ravel())

    def _connect(self, layer: int, source: np.ndarray, target: np.ndarray) -> None:
        """Edges back from each target; where there are too many, the best spread ones stay."""
        edges = self.layers[layer]
        ok = target >= 0
        source, target = source[ok], target[ok]
        order = np.argsort(target, kind="stable")
        source, target = source[order], target[order]
        to, first, count = np.unique(target, return_index=True, return_counts=True)
        rank = np.arange(len(target)) - np.repeat(first, count)
        wide = np.full((len(to), min(int(count.max(initial=0)), 4 * KEPT)), -1, np.int64)
        keep = rank < wide.shape[1]
        wide[np.repeat(np.arange(len(to)), count)[keep], rank[keep]] = source[keep]
        old = edges[to]
        wide[(wide[:, :, None] == old[:, None, :]).any(axis=2)] = -1
        both = np.concatenate([old, wide], axis=1)
        slots = edges.shape[1]
        total = (both >= 0).sum(axis=1)
        some = total <= slots
        packed = np.take_along_axis(both[some], np.argsort(both[some] < 0, axis=1, kind="stable"), 1)[:, :slots]
        edges[to[some], : packed.shape[1]] = packed
        for k in range(0, len(many := np.flatnonzero(~some)), _QUERIES):
            own = many[k : k + _QUERIES]
            edges[to[own]] = choose(self.x, self.x[to[own]], both[own], slots)

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.full((len(queries), 1), self.entry)
        for layer in range(len(self.layers) - 1, 0, -1):
            found, sims = beam_search(self.x, self.layers[layer], queries, entry, 4)
            entry = np.take_along_axis(found, np.argsort(-sims, axis=1), 1)
        return beam_search(self.x, self.layers[0], queries, entry, width)

    def audit(self, threshold: float, seed: int = 11) -> float:
        """Widen the beam until links at the threshold's angle are found; the recall reached."""
        rng = np.random.default_rng(seed)
        own = self.x[rng.permutation(len(self.x))[:AUDITED]].astype(np.float64)
        aside = rng.standard_normal(own.shape)
        aside -= (aside * own).sum(axis=1)[:, None] * own
        aside /= np.maximum(np.linalg.norm(aside, axis=1), 1e-12)[:, None]
        cosine = threshold + 0.1 * (1 - threshold)
        queries = (cosine * own + math.sqrt(1 - cosine**2) * aside).astype(np.float32)
        truth = queries @ self.x.T >= threshold
        while True:
            nodes, _ = self.search(queries, min(self.width, len(self.x)))
            r = np.repeat(np.arange(len(nodes)), nodes.shape[1])[nodes.ravel() >= 0]
            hit = np.zeros(truth.shape, bool)
            hit[r, nodes.ravel()[nodes.ravel() >= 0]] = True
            # A search that fills its beam with links is widened when it is asked; it counts as far as its beam goes.
            recall = np.minimum((hit & truth).sum(axis=1), nodes.shape[1]).sum() / max(1, np.minimum(truth.sum(axis=1), nodes.shape[1]).sum())
            if recall >= RECALL or self.width >= len(self.x):
                return float(recall)
            if self.width >= WIDEST:
                self.full = True
                return float(recall)
            self.width *= 2


def links(graph: Graph, unit: np.ndarray, queries: np.ndarray, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) pairs with a cosine of at least the threshold, in stripes of bounded size: a group in which all
    are near all never has its pairs in one place. ``unit`` and ``queries`` are double."""
    n = len(unit)
    for k in range(0, len(queries), _QUERIES):
        own = queries[k : k + _QUERIES]
        left, width = np.arange(len(own)), min(graph.width, n)
        while len(left) and not graph.full and width < n:
            nodes, sims = graph.search(own[left].astype(np.float32), width)
            full = ((nodes >= 0) & (sims >= threshold)).all(axis=1)
            r, c = np.nonzero((nodes >= 0) & (sims >= threshold - 1e-4) & ~full[:, None])
            to = nodes[r, c]
            good = np.einsum("id,id->i", unit[to], own[left[r]]) >= threshold
            yield k + left[r[good]], to[good].astype(np.int64)
            left = left[full]
            width *= 2
            if width > WIDEST:
                break
        for s in range(0, len(left), _STRIPE):
            r, to = np.nonzero(own[left[s : s + _STRIPE]] @ unit.T >= threshold)
            yield k + left[s + r], to


def _answer(graph: Graph, unit: np.ndarray, ids: np.ndarray, copies: np.ndarray, block: dict[str, np.ndarray], own: bool, threshold: float) -> pa.RecordBatch:
    """Rows (node, other, links) of a block that asks a shard (``own``: its own one): links of each node, and links that join each group."""
    m, n = len(block["ids"]), len(ids)
    asked, answered, groups = np.zeros(m, np.int64), np.zeros(n, np.int64), Forest(m + n)
    if own:  # a vector of the block is in the shard too
        order = np.argsort(ids)
        groups.join(np.arange(m), m + order[np.searchsorted(ids, block["ids"], sorter=order)])
    for q, to in links(graph, unit, _unit(block["raw"]), threshold):
        if own:
            other = block["ids"][q] != ids[to]
            q, to = q[other], to[other]
        asked += np.bincount(q, copies[to], minlength=m).astype(np.int64)
        if not own:
            answered += np.bincount(to, block["copies"][q], minlength=n).astype(np.int64)
        groups.join(q, m + to)
    every, counts = np.concatenate([block["ids"], ids]), np.concatenate([asked, answered])
    at = np.flatnonzero(counts)
    a, b = every, every[groups.label]
    joined = np.flatnonzero(a != b)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.concatenate([every[at], a[joined]])), pa.array(np.concatenate([np.zeros(len(at), np.int64), b[joined]]), mask=np.arange(len(at) + len(joined)) < len(at)),
            pa.array(np.concatenate([counts[at], np.zeros(len(joined), np.int64)]), mask=np.arange(len(at) + len(joined)) >= len(at)),
        ],
        names=["node", "other", "links"],
    )


def _unit(raw: np.ndarray) -> np.ndarray:
    raw = raw.astype(np.float64)
    return raw / np.linalg.norm(raw, axis=1)[:, None]


def _write(path: str, **arrays: np.ndarray) -> str:
    """Write a file under a name of this attempt's own; the name."""
    fs, own = filesystem(path)
    fs.create_dir(own.rsplit("/", 1)[0], recursive=True)
    held = io.BytesIO()
    np.savez(held, **arrays)
    tail = f"-{uuid.uuid4().hex}.npz"
    with fs.open_output_stream(own + tail) as out:
        out.write(held.getbuffer())
    return path + tail


def _load(path: str) -> dict[str, np.ndarray]:
    fs, own = filesystem(path)
    with fs.open_input_stream(own) as f:
        return dict(np.load(io.BytesIO(f.read())))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, copies and vectors of a group, in an order that does not depend on how it came."""
    ids, copies = table["node"].to_numpy(), table["copies"].to_numpy()
    raw = np.frombuffer(b"".join(table["raw"].to_pylist()), "<f8").reshape(len(ids), -1)
    order = np.argsort(ids, kind="stable")
    mixed = order[np.random.default_rng(3).permutation(len(order))]
    return ids[mixed], copies[mixed], raw[mixed]


_KEY = T.StructType([T.StructField("key", T.StringType()), T.StructField("raw", T.BinaryType()), T.StructField("dim", T.IntegerType())])


@F.arrow_udf(_KEY)
def _keys(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of vectors that can link: a digest of the components as doubles, those, and how many."""
    kind = pa.struct([("key", pa.string()), ("raw", pa.binary()), ("dim", pa.int32())])
    for batch in batches:
        out = []
        for v in batch:
            row = None
            if v.is_valid and len(v.values) and not v.values.null_count:
                x = v.values.to_numpy(zero_copy_only=False).astype("<f8") + 0.0
                if np.isfinite(x).all() and x.any():
                    raw = x.tobytes()
                    row = {"key": hashlib.blake2b(raw, digest_size=16).hexdigest(), "raw": raw, "dim": len(x)}
            out.append(row)
        yield pa.array(out, kind)


def near_duplicates(vectors: DataFrame, *, id: str = "vec_id", vector: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """One row per row: id, n_links, component_id (the smallest id reachable), recall audited in its shard."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id).alias("id"), _keys(F.col(vector)).alias("v")).select("id", "v.*")
    rows = cut(rows)
    grouped = rows.filter("key IS NOT NULL").groupBy("dim", "key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies"), F.first("raw").alias("raw"))
    distinct = cut(grouped.withColumn("node", F.monotonically_increasing_id()))
    n = distinct.count()
    shards = max(1, -(-n // SHARD))
    blocks = max(1, -(-n // (shards * BLOCK)))  # of each shard
    folder = fresh_path(spark, "hnsw")
    hashed = F.xxhash64(F.lit(1), "node")
    placed = distinct.withColumn("shard", F.pmod(hashed, F.lit(shards)).cast("int")).withColumn("block", F.pmod(F.xxhash64(F.lit(2), "node"), F.lit(blocks)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        ids, copies, raw = _matrix(table)
        graph = Graph(_unit(raw).astype(np.float32))
        recall = graph.audit(threshold)
        dim, shard = table["dim"][0].as_py(), table["shard"][0].as_py()
        layers = {f"layer{k}": x.astype(np.int32) for k, x in enumerate(graph.layers)}
        path = _write(f"{folder}/shard-{dim}-{shard}", ids=ids, copies=copies, raw=raw, state=np.array([graph.entry, graph.width, graph.full, len(graph.layers)]), **layers)
        return pa.table({"dim": [dim], "shard": [shard], "file": [path], "width": [graph.width], "recall": [recall]}, pa.schema([("dim", pa.int32()), ("shard", pa.int32()), ("file", pa.string()), ("width", pa.int32()), ("recall", pa.float64())]))

    def pack(table: pa.Table) -> pa.Table:
        ids, copies, raw = _matrix(table)
        dim, shard, block = (table[c][0].as_py() for c in ("dim", "shard", "block"))
        path = _write(f"{folder}/block-{dim}-{shard}-{block}", ids=ids, copies=copies, raw=raw)
        return pa.table({"dim": [dim], "home": [shard], "block": [block], "asks": [path]}, pa.schema([("dim", pa.int32()), ("home", pa.int32()), ("block", pa.int32()), ("asks", pa.string())]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = ("", None)
        for batch in batches:
            for file, asks, own in zip(*(batch.column(c).to_pylist() for c in ("file", "asks", "own")), strict=True):
                if held[0] != file:
                    data = _load(file)
                    unit = _unit(data["raw"])
                    graph = Graph.__new__(Graph)
                    graph.x = unit.astype(np.float32)
                    entry, width, full, count = data["state"].tolist()
                    graph.entry, graph.width, graph.full = entry, width, bool(full)
                    graph.layers = [data[f"layer{k}"] for k in range(count)]
                    held = file, (data["ids"], data["copies"], unit, graph)
                ids, copies, unit, graph = held[1]
                block = _load(asks)
                yield _answer(graph, unit, ids, copies, block, own, threshold)

    built = written(placed.groupBy("dim", "shard").applyInArrow(build, "dim int, shard int, file string, width int, recall double"), "shards")
    packed = written(placed.groupBy("dim", "shard", "block").applyInArrow(pack, "dim int, home int, block int, asks string"), "blocks")
    cells = built.join(packed, "dim").filter("home <= shard").select("file", "asks", (F.col("home") == F.col("shard")).alias("own"))
    # A few blocks of one shard to a task: the graph is loaded once for them.
    cells = cells.withColumn("part", F.pmod(F.xxhash64("asks"), F.lit(max(1, shards * blocks // 4)))).repartition(max(8, min(4096, shards * shards * blocks // 4)), "file", "part")
    cells = cells.sortWithinPartitions("file")
    found = written(cells.mapInArrow(ask, "node long, other long, links long"), "links")
    counts = found.filter("other IS NULL").groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(found.filter("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")))
    of = distinct.select("key", "node", "first", "copies").join(counts, "node", "left").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    of = cut(of)
    least = cut(of.groupBy("root").agg(F.min("first").alias("component")))
    of = cut(of.join(least, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"))
    return rows.select("id", "key").join(of, "key", "left").select("id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
