"""Most similar vectors for every vector: robust-pruned directed graphs over shards.

Vectors are routed to the cells of centroids; a cell that got too many is cut again
by centroids of its own.  In each shard a directed graph is built in batches: the
next points search the graph that stands so far, their finds are pruned so that kept
edges point in different directions (an edge is dropped where a kept neighbour is
nearer to its end by a factor), and reverse edges are added under the same rule.  Every
vector then searches its own cell, starting at its own node, and other cells from an
entry layer of about the square root of the shard.  All searches of a shard advance in
step as array operations.  Equal vectors are one node.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.session import salted_join

DIMENSIONS = 64
#: Vectors that the centroids of a level, or of a cell, are fitted on, at most; all vectors are indexed.
SAMPLE_VECTORS = 20_000
#: Vectors a cell should hold, and the centroids of a level at most.
CELL_ROWS, MOST_CELLS = 4096, 1024
#: How many times ``CELL_ROWS`` a cell may hold before it is cut by centroids of its own.
CUT_AT = 4
#: A vector also searches the cells whose border it is no farther from than this, see `_cells`.
MARGIN = 0.1
#: The entry layer has this many times the square root of a shard's nodes; a search starts from the best few.
ENTRY_FACTOR, ENTRIES = 8, 16
#: Out-degree, beam width of the build, nodes a search expands at once, and the relaxation of the pruning rule.
DEGREE, BEAM, EXPAND, ALPHA = 24, 28, 6, 1.2
#: Nodes that are compared with each other on their insertion, how much a graph grows before reverse edges are added,
#: and how far a node's edges may exceed the degree before they are pruned; candidates that are pruned, as a multiple of the degree.
BATCH, GROWTH, SLACK_FACTOR, PRUNE_FACTOR, PRUNE_BLOCK = 512, 1.12, 1.25, 1.5, 512
#: Beam width of the searches that tell which vectors have a similar one; from other cells twice that.
PROBE_BEAM = 12
QUERY_BLOCK = 128
#: Products that are formed, and rows that are pruned, at once: about what a core's cache holds.
DOT_BLOCK, PRUNE_ROWS = 1024, 128
#: Single precision may miss the threshold by this much.
SLACK = 1e-4
#: Candidate pairs that are held at once when all above a threshold are wanted.
PAIR_BLOCK = 1 << 16
MOST_TASKS = 20_000
#: Rows of a cell that one task cuts into its finer cells.
CUT_ROWS = 200_000


def usable(column: pa.Array, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """Rows with a vector of the right length, finite and not zero, and these vectors as they are."""
    column = column.cast(pa.list_(pa.float32()))
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    rows = np.flatnonzero((sizes == dimensions) & column.is_valid().to_numpy(zero_copy_only=False))
    flat = column.values.to_numpy(zero_copy_only=False)
    x = flat[offsets[rows][:, None] + np.arange(dimensions)].astype(np.float32) if len(rows) else np.zeros((0, dimensions), np.float32)
    norm = np.sqrt((x.astype(np.float64) ** 2).sum(1))
    ok = np.isfinite(norm) & (norm > 0)
    return rows[ok], x[ok]


def unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    return (wide / np.sqrt((wide**2).sum(1, keepdims=True))).astype(np.float32)


def fit_centroids(sample: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Spherical k-means of unit vectors; deterministic."""
    rng = np.random.default_rng(3)
    cells = max(1, min(cells, len(sample)))
    centers = sample[rng.choice(len(sample), cells, replace=False)].copy()
    for _ in range(rounds):
        owner = (sample @ centers.T).argmax(1)
        sums = np.zeros_like(centers)
        np.add.at(sums, owner, sample)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centers = np.where(norm > 1e-9, sums / np.maximum(norm, 1e-9), centers)
    return centers


def _top(ids: np.ndarray, sims: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(-sims, axis=1)[:, :k]
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1), order


#: A place of a beam that holds no node: last in order, and nothing to expand.
_EMPTY = np.iinfo(np.int64).max


def _keys(sims: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    """A beam's entries: integers whose order is that of the similarities, greatest first, and then of the nodes; even until a node is expanded."""
    bits = (-sims).view(np.int32)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | (nodes << 1)


def _nodes(keys: np.ndarray) -> np.ndarray:
    return (keys & 0xFFFFFFFF) >> 1


def _sims(keys: np.ndarray) -> np.ndarray:
    bits = (keys >> 32).astype(np.int32)
    return -(bits ^ ((bits >> 31) & 0x7FFFFFFF)).view(np.float32)


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of ``x`` and ``j`` of ``y``, by blocks that stay in the cache."""
    out = np.empty(len(i), np.float32)
    a, b = np.empty((2, min(len(i), DOT_BLOCK), x.shape[1]), np.float32)
    for lo in range(0, len(i), DOT_BLOCK):
        n = len(i[lo : lo + DOT_BLOCK])
        x.take(i[lo : lo + n], 0, a[:n], "clip")
        y.take(j[lo : lo + n], 0, b[:n], "clip")
        np.einsum("nd,nd->n", a[:n], b[:n], out=out[lo : lo + n])
    return out


def beam_search(x: np.ndarray, graph: np.ndarray, queries: np.ndarray, starts: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """The ``beam`` best nodes found for each query, best first; -1 where fewer were found.

    ``starts`` are nodes per query (-1 for none).  Each step expands the ``EXPAND`` best
    nodes not yet expanded, until the beam holds none.  A bitmap per query tells what it
    has seen, so a node is compared once; only what is better than a beam's last entry is
    sorted into it.
    """
    n, width = len(queries), len(x) + 1
    seen = np.zeros(n * width, bool)
    seen[::width] = True  # a row's first place is that of -1
    held = np.full((n, beam), _EMPTY)
    live, rows, near = np.arange(n), np.arange(n), starts
    while len(live):
        place = (rows[:, None] * width + 1 + near).ravel()
        place = place[~seen.take(place)]
        place.sort()
        place = place[np.concatenate([[True], place[1:] != place[:-1]])[: len(place)]]
        seen[place] = True
        r = place // width
        node = place - r * width - 1
        keys = _keys(_dots(x, node, queries, r), node)
        better = np.flatnonzero(keys < held[:, -1].take(r))
        if len(better):
            r, keys = r[better], keys[better]
            count = np.bincount(r, minlength=n)
            line = np.flatnonzero(count)
            first = np.cumsum(count) - count
            merged = np.full((len(line), beam + count.max()), _EMPTY)
            merged[:, :beam] = held[line]
            merged[np.repeat(np.arange(len(line)), count[line]), np.arange(beam, beam + len(r)) - first[r]] = keys
            merged.sort(1)
            held[line] = merged[:, :beam]
        own = held[live]
        open_ = own & 1 == 0
        pick = open_ & (np.cumsum(open_, 1) <= EXPAND)
        held[live] = own | pick
        rows, at = np.nonzero(pick)
        near = graph.take(_nodes(own[rows, at]), 0)
        rows, live = live[rows], live[pick.any(1)]
    return np.where(held < _EMPTY, _nodes(held), -1), np.where(held < _EMPTY, _sims(held), np.float32(-np.inf))


def robust_prune(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Up to ``degree`` diverse neighbours per row of candidates (best first, -1 for none)."""
    return np.concatenate([_pruned(x, cand[lo : lo + PRUNE_ROWS], sims[lo : lo + PRUNE_ROWS], degree, alpha) for lo in range(0, max(1, len(cand)), PRUNE_ROWS)])


def _pruned(x: np.ndarray, cand: np.ndarray, sims: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    n, k = cand.shape
    v = x.take(np.maximum(cand, 0), 0)
    # the candidates that are left, and those that each of them drops: bits in 64-bit words, with the rows along the last axis
    drops = _bits(alpha * (1 - np.matmul(v, v.transpose(0, 2, 1))) <= (1 - sims)[:, None, :]).transpose(1, 2, 0).copy()
    alive, kept, count = _bits(cand >= 0).T.copy(), np.zeros((k, n), bool), np.zeros(n, np.int64)
    for i in range(k):
        take = (alive[i // 64] >> np.uint64(i % 64)).astype(np.uint8) & 1 & (count < degree)
        kept[i] = take
        count += take
        alive &= ~(drops[i] * take)
    out = np.full((n, degree), -1, np.int64)
    r, c = np.nonzero(kept.T)
    out[r, np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)] = cand[r, c]
    return out


def _bits(flags: np.ndarray) -> np.ndarray:
    """Flags along the last axis as 64-bit words, the first flag lowest."""
    packed = np.packbits(flags, axis=-1, bitorder="little")
    words = np.zeros((*flags.shape[:-1], -(-flags.shape[-1] // 64) * 8), np.uint8)
    words[..., : packed.shape[-1]] = packed
    return words.view("<u8")


def build_graph(x: np.ndarray, degree: int = DEGREE, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours of each node, -1 where there are fewer, and the best similarity that each met on its insertion.

    Nodes are inserted in the order of ``x``: each searches the graph that stands so far
    and is compared with its batch; the reverse edges come when the graph has grown by
    ``GROWTH``.
    """
    n = len(x)
    graph, best = np.full((n, int(SLACK_FACTOR * degree)), -1, np.int32), np.full(n, -np.inf, np.float32)
    done = 0
    while done < n:
        end = min(n, max(BATCH, int(done * GROWTH)))
        for at in range(done, end, BATCH):
            block = x[at : min(end, at + BATCH)]
            s = block @ block.T
            np.fill_diagonal(s, -np.inf)
            ids, sims = np.broadcast_to(np.arange(at, at + len(block)), s.shape), s
            if done:
                found = [beam_search(x, graph, block[lo : lo + QUERY_BLOCK], entries(x[:done], block[lo : lo + QUERY_BLOCK]), beam) for lo in range(0, len(block), QUERY_BLOCK)]
                ids, sims = np.concatenate([np.concatenate([f[0] for f in found]), ids], 1), np.concatenate([np.concatenate([f[1] for f in found]), sims], 1)
            ids, sims, _ = _top(ids, sims, min(ids.shape[1], max(beam, int(PRUNE_FACTOR * degree))))
            best[at : at + len(block)] = sims[:, 0]
            keep = min(ids.shape[1], int(PRUNE_FACTOR * degree))
            graph[at : at + len(block), :degree] = robust_prune(x, np.where(sims > -np.inf, ids, -1)[:, :keep], sims[:, :keep], degree)
        _add_reverse(x, graph, np.arange(done, end), degree)
        done = end
    return graph, best


def entries(x: np.ndarray, queries: np.ndarray, keep: int = ENTRIES) -> np.ndarray:
    """The best few nodes of the entry layer, about ``ENTRY_FACTOR`` times the root of all, to start each query from."""
    nodes = np.arange(0, len(x), max(1, int(len(x) / (ENTRY_FACTOR * np.sqrt(len(x))))))
    s = queries @ x[nodes].T
    k = min(keep, len(nodes))
    return nodes[np.argpartition(-s, k - 1, axis=1)[:, :k]]


def _add_reverse(x: np.ndarray, graph: np.ndarray, fresh: np.ndarray, degree: int) -> None:
    """Add the edges back from the neighbours of ``fresh`` nodes; only nodes that get too many are pruned."""
    source = np.repeat(fresh, graph.shape[1])
    target = graph[fresh].ravel()
    source, target = source[target >= 0], target[target >= 0]
    width_of = graph.shape[1]
    held = (graph[target] == source[:, None]).any(1)
    source, target = source[~held], target[~held]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    nodes, first, count = np.unique(target, return_index=True, return_counts=True)
    have = (graph[nodes] >= 0).sum(1)
    room = have + count <= width_of
    place = np.arange(len(target)) - np.repeat(first, count) + np.repeat(have, count)
    ok = np.repeat(room, count)
    graph[target[ok], place[ok]] = source[ok]
    full = np.flatnonzero(~room)
    for lo in range(0, len(full), PRUNE_BLOCK):
        part = full[lo : lo + PRUNE_BLOCK]
        width = int(count[part].max())
        added = np.full((len(part), width), -1, np.int32)
        rows = np.repeat(np.arange(len(part)), count[part])
        step = np.arange(len(rows)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
        added[rows, step] = source[np.repeat(first[part], count[part]) + step]
        cand = np.concatenate([graph[nodes[part]], added], 1)
        s = np.where(cand >= 0, np.matmul(x.take(np.maximum(cand, 0), 0), x[nodes[part]][:, :, None])[:, :, 0], -np.inf)
        cand, s, _ = _top(cand, s, min(cand.shape[1], int(PRUNE_FACTOR * degree)))
        kept = robust_prune(x, np.where(s > -np.inf, cand, -1), s, degree)
        graph[nodes[part]] = np.pad(kept, ((0, 0), (0, width_of - degree)), constant_values=-1)


def search_shard(x: np.ndarray, home: np.ndarray, queries: np.ndarray, beam: int = BEAM, degree: int = DEGREE) -> tuple[np.ndarray, np.ndarray]:
    """Build a shard's graph and search it for all ``queries``.

    ``home`` is the node of each query that is itself in the shard, else -1: such a
    search starts at its own node, whose neighbours the build has found; all others
    start at the entry layer.
    """
    graph, _ = build_graph(x, degree, beam)
    ids, sims = np.full((len(queries), beam), -1, np.int64), np.full((len(queries), beam), -np.inf, np.float32)
    for own in (True, False):
        asked = np.flatnonzero((home >= 0) == own)
        for lo in range(0, len(asked), QUERY_BLOCK):
            at = asked[lo : lo + QUERY_BLOCK]
            ids[at], sims[at] = beam_search(x, graph, queries[at], home[at][:, None] if own else entries(x, queries[at]), beam)
    return ids, sims


def with_similar(x: np.ndarray, home: np.ndarray, queries: np.ndarray, least: float, beam: int = BEAM, degree: int = DEGREE) -> np.ndarray:
    """The queries for which a greedy search finds another node of at least ``least``, on their insertion or in the whole graph."""
    grown = max(1.0, (len(x) / CELL_ROWS) ** 0.35)  # a greater shard takes a wider beam
    graph, best = build_graph(x, degree, int(beam * grown))
    width = int(PROBE_BEAM * grown)
    top = np.where(home >= 0, best[home], -np.inf)
    for own in (True, False):
        asked = np.flatnonzero(((home >= 0) == own) & (top < least))
        for lo in range(0, len(asked), QUERY_BLOCK):
            at = asked[lo : lo + QUERY_BLOCK]
            ids, sims = beam_search(x, graph, queries[at], home[at][:, None] if own else entries(x, queries[at]), width if own else 2 * width)
            top[at] = np.where(ids == home[at][:, None], -np.inf, sims).max(1)
    return np.flatnonzero(top >= least)


@dataclass(frozen=True)
class Routing:
    """Centroids and about how many vectors each has; the sizes only decide which cells are cut again and into how many tasks."""

    centers: np.ndarray
    sizes: np.ndarray


def _sample(rows: DataFrame, n: int, key: str, most: int) -> DataFrame:
    """About ``most`` of ``n`` rows, drawn by a hash of the key."""
    return rows.where(F.pmod(F.xxhash64(key, F.lit(5)), F.lit(1_000_000)) < int(min(1.0, most / max(1, n)) * 1_000_000) + 1)


def fit_routing(vectors: DataFrame, key: str = "chunk_id", column: str = "embedding", cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS) -> Routing:
    """Fit centroids on at most ``SAMPLE_VECTORS`` rows drawn by a hash of the key; the sizes of the cells are estimated from the same rows."""
    n = vectors.count()
    table = _sample(vectors, n, key, SAMPLE_VECTORS).select(key, column).limit(SAMPLE_VECTORS).toArrow().sort_by(key).combine_chunks()
    chunk = table[column].combine_chunks() if len(table) else pa.array([], pa.list_(pa.float32()))
    x = unit(usable(chunk)[1])
    if not len(x):
        return Routing(np.zeros((0, DIMENSIONS), np.float32), np.zeros(0, np.int64))
    x = x[np.lexsort(x.T[:4])]
    centers = fit_centroids(x, min(most_cells, -(-n // cell_rows)))
    share = np.bincount((x @ centers.T).argmax(1), minlength=len(centers)) / len(x)
    return Routing(centers, np.ceil(share * n).astype(np.int64))


def _cells(u: np.ndarray, centers: np.ndarray, margin: float, probes: int) -> tuple[np.ndarray, np.ndarray]:
    """Which vectors search which cells, as (vector, cell), each vector's own cell first.

    A cell is searched if its border with the own cell is within ``margin``: for a
    vector u, own centre a and other centre b that distance is u(a - b) / |a - b|.  At
    least ``probes`` cells are searched, those of the nearest borders.
    """
    s = u @ centers.T
    own, at = s.argmax(1), np.arange(len(u))
    square = (centers**2).sum(1)
    apart = np.sqrt(np.maximum(square[:, None] + square[None, :] - 2 * (centers @ centers.T), 1e-6))
    gap = (s[at, own][:, None] - s) / apart[own]
    gap[at, own] = -1.0
    if len(u) and probes > 1:
        k = min(probes, len(centers))
        margin = np.maximum(margin, np.partition(gap, k - 1, axis=1)[:, k - 1 : k])
    r, c = np.nonzero(gap <= margin)
    order = np.lexsort((c, gap[r, c], r))
    return r[order], c[order]


_ROWS = "cell bigint, id string, v binary, h bigint, home boolean"


def _emit(cell: np.ndarray, ids: pa.Array, v: pa.Array, h: np.ndarray, home: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
    at = pa.array(row)
    return pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), ids.take(at).cast(pa.string()), v.take(at).cast(pa.binary()), pa.array(h[row]), pa.array(home)], ["cell", "id", "v", "h", "home"])


def _routed(vectors: DataFrame, routing: Routing, margin: float, probes: int, key: str, column: str) -> DataFrame:
    """(cell, id, v, h, home): a row for the cell that indexes a vector and for each that it searches besides."""
    held = vectors.sparkSession.sparkContext.broadcast(routing.centers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, raw = usable(b.column(1))
            rows, raw = _first_of_equal(b.column(0), rows, raw)
            for lo in range(0, len(rows), 4096):
                part = raw[lo : lo + 4096]
                r, c = _cells(unit(part), held.value, margin, probes)
                packed = pa.array([v.tobytes() for v in part], pa.binary())
                h = b.column(2).to_numpy(zero_copy_only=False)[rows[lo : lo + 4096]]
                yield _emit(c, b.column(0).take(pa.array(rows[lo : lo + 4096])), packed, h, np.concatenate([[True], r[1:] != r[:-1]]), r)

    return vectors.select(F.col(key).alias("id"), column, F.pmod(F.xxhash64(column), F.lit(1 << 30)).alias("h")).mapInArrow(run, _ROWS)


def _first_of_equal(ids: pa.Array, rows: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows with equal vectors the one with the smallest key: of a batch's copies one goes on."""
    if not len(rows):
        return rows, x
    order = np.argsort(np.array(ids.take(pa.array(rows)).to_pylist(), object), kind="stable")
    _, first = np.unique(_bytes(x[order]), return_index=True)
    keep = np.sort(order[first])
    return rows[keep], x[keep]


def _bytes(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.dtype((np.void, x.shape[1] * x.itemsize))).ravel()


def _unpack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, DIMENSIONS)


def _refined(routed: DataFrame, routing: Routing, margin: float, probes: int, cell_rows: int) -> DataFrame:
    """``routed`` with every cell of more than ``CUT_AT`` times ``cell_rows`` vectors cut by centroids of its own.

    The centroids of such a cell are fitted on a sample of at most ``SAMPLE_VECTORS`` of
    its vectors in one task, and its rows are cut in as many tasks as it has
    ``CUT_ROWS``; nothing goes to the driver.  What even they can't cut (vectors of one
    direction) is spread over shards by hash, all of which are searched.
    """
    limit = CUT_AT * cell_rows
    big = np.flatnonzero(routing.sizes > limit)
    if not len(big):
        return routed
    spark = routed.sparkSession
    plan = spark.createDataFrame([(int(c), int(routing.sizes[c]), float(min(1.0, SAMPLE_VECTORS / routing.sizes[c])), int(-(-routing.sizes[c] // CUT_ROWS))) for c in big], "cell bigint, n bigint, share double, tasks int")
    mine = routed.join(F.broadcast(plan), "cell")  # at most MOST_CELLS rows

    def fit(table: pa.Table) -> pa.Table:
        n = table["n"][0].as_py()
        x = unit(_unpack(table["v"]))
        x = x[np.lexsort(x.T[:4])]
        centers = fit_centroids(x, min(MOST_CELLS, -(-n // cell_rows)))
        share = np.bincount((x @ centers.T).argmax(1), minlength=len(centers)) / len(x)
        shards = np.maximum(1, np.ceil(share * n / limit)).astype(np.int64)
        return pa.table({"cell": [table["cell"][0].as_py()], "centers": [centers.tobytes()], "shards": [shards.tolist()]}, pa.schema([("cell", pa.int64()), ("centers", pa.binary()), ("shards", pa.list_(pa.int64()))]))

    drawn = mine.where("home").where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < F.col("share") * 1_000_000).select("cell", "n", "v")
    fitted = drawn.groupBy("cell").applyInArrow(fit, "cell bigint, centers binary, shards array<bigint>")

    def cut(rows: pa.Table, finer: pa.Table) -> pa.Table:
        out = []
        if len(rows) and len(finer):
            centers, shards, base = np.frombuffer(finer["centers"][0].as_py(), np.float32).reshape(-1, DIMENSIONS), np.array(finer["shards"][0].as_py()), rows["cell"][0].as_py()
            first = np.concatenate([[0], np.cumsum(shards)])
            for b in rows.combine_chunks().to_batches(max_chunksize=4096):
                own, h = b.column("home").to_numpy(zero_copy_only=False), b.column("h").to_numpy()
                r, c = _cells(unit(_unpack(b.column("v"))), centers, margin, probes)
                lead = np.concatenate([[True], r[1:] != r[:-1]])
                parts = shards[c]
                again = np.repeat(np.arange(len(r)), parts)
                shard = first[c][again] + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
                home = lead[again] & own[r[again]] & (shard == (first[c] + h[r] % parts)[again])
                out.append(_emit((base + 1 << 32) + shard, b.column("id"), b.column("v"), h, home, r[again]))
        schema = pa.schema([("cell", pa.int64()), ("id", pa.string()), ("v", pa.binary()), ("h", pa.int64()), ("home", pa.bool_())])
        return pa.Table.from_batches(out).cast(schema) if out else schema.empty_table()

    parted = mine.withColumn("task", F.pmod("h", "tasks"))
    copies = fitted.join(F.broadcast(plan), "cell").withColumn("task", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tasks").cast("bigint") - 1))).select("cell", "task", "centers", "shards")
    finer = parted.select("cell", "task", "id", "v", "h", "home").groupBy("cell", "task").cogroup(copies.groupBy("cell", "task")).applyInArrow(cut, _ROWS)
    return routed.join(F.broadcast(plan.select("cell")), "cell", "left_anti").select("cell", "id", "v", "h", "home").unionByName(finer)


def _candidates(u: np.ndarray, nodes: np.ndarray, home: np.ndarray, beam: int, degree: int, least: float | None, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a query and a node, both as places in ``u``, without a vector's pair with itself; a query's pairs come together.

    With ``least``, a beam can't hold every node above it: each query for which the
    search found any such node is compared with the whole shard.
    """
    if least is None:
        found, _ = search_shard(u[nodes], home, u, max(beam, 2 * k), degree)
        left, at = np.nonzero((found >= 0) & (found != home[:, None]))
        yield left, nodes[found[left, at]]
        return
    near = with_similar(u[nodes], home, u, least - SLACK, beam, degree)
    rows = max(1, (1 << 22) // len(nodes))
    for lo in range(0, len(near), rows):
        q = near[lo : lo + rows]
        r, c = np.nonzero(u[q] @ u[nodes].T >= least - SLACK)
        other = c != home[q][r]
        for at in range(0, int(other.sum()), PAIR_BLOCK):
            yield q[r[other]][at : at + PAIR_BLOCK], nodes[c[other]][at : at + PAIR_BLOCK]


def _shard_pairs(table: pa.Table, beam: int, degree: int, least: float | None, k: int) -> Iterator[pa.RecordBatch]:
    """A shard's finds as (a, b, similarity): the k best per query, or all at or above ``least``."""
    table = table.sort_by("id").combine_chunks()  # a shard's graph doesn't depend on the order of its rows
    _, first = np.unique(_bytes(_unpack(table["v"])), return_index=True)  # equal vectors are named by their smallest key
    table = table.take(pa.array(np.sort(first)))
    ids = table["id"].combine_chunks()
    wide = _unpack(table["v"]).astype(np.float64)
    indexed = table["home"].to_numpy(zero_copy_only=False)
    norm = np.sqrt((wide**2).sum(1))
    u = (wide / norm[:, None]).astype(np.float32)
    nodes = np.random.default_rng(1).permutation(np.flatnonzero(indexed))
    if not len(nodes):
        return
    home = np.full(len(u), -1, np.int64)
    home[nodes] = np.arange(len(nodes))
    for left, right in _candidates(u, nodes, home, beam, degree, least, k):
        exact = np.clip(np.einsum("nd,nd->n", wide[left], wide[right]) / (norm[left] * norm[right]), -1, 1)
        if least is not None:
            ok = exact >= least
            left, right, exact = left[ok], right[ok], exact[ok]
        else:
            by = np.lexsort((-exact, left))
            left, right, exact = left[by], right[by], exact[by]
            start = np.flatnonzero(np.concatenate([[True], left[1:] != left[:-1]])) if len(left) else np.zeros(0, np.int64)
            place = np.arange(len(left)) - np.repeat(start, np.diff(np.concatenate([start, [len(left)]])))
            # a tie at the k-th place is kept for the keys to decide
            last = np.repeat(exact[np.minimum(start + k, np.concatenate([start[1:], [len(left)]])) - 1], np.diff(np.concatenate([start, [len(left)]]))) if len(left) else exact
            ok = (place < k) | (exact >= last)
            left, right, exact = left[ok], right[ok], exact[ok]
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(left)), ids.take(pa.array(right)), pa.array(exact)], ["a", "b", "similarity"])


_PAIRS = "a string, b string, similarity double"


def _usable_rows(vectors: DataFrame, key: str, column: str) -> DataFrame:
    """(id, v) of rows with a key and a vector of the right length; what else is unusable is left out when it is read."""
    return vectors.where(F.col(key).isNotNull() & (F.size(column) == DIMENSIONS)).select(F.col(key).cast("string").alias("id"), F.col(column).cast("array<float>").alias("v"))


def _members(rows: DataFrame) -> DataFrame:
    """(rep, id): the rows of every vector that several keys have, named by the smallest of them.

    Vectors meet by 128 bits of hash, so they themselves aren't shuffled.
    """
    low, high, inf = F.array_min("v"), F.array_max("v"), float("inf")  # NaN is the greatest
    keyed = rows.where((high < inf) & (low > -inf) & ((low != 0) | (high != 0)) & (F.size(F.array_compact("v")) == DIMENSIONS)).select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7), "v").alias("h2"))
    groups = keyed.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.max("id").alias("last")).where("last > rep")
    return salted_join(keyed, groups.drop("last"), ["h1", "h2"], how="inner", on="id").select("rep", "id").distinct()


def _search(rows: DataFrame, margin: float, probes: int, beam: int, degree: int, least: float | None, k: int, cell_rows: int = CELL_ROWS, most_cells: int = MOST_CELLS) -> DataFrame:
    routing = fit_routing(rows, "id", "v", cell_rows, most_cells)
    if not len(routing.centers):
        return rows.sparkSession.createDataFrame([], _PAIRS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _shard_pairs(pa.Table.from_batches(list(batches)), beam, degree, least, k)

    # as many tasks as shards: a task's input doesn't grow with the table
    shards = np.where(routing.sizes > CUT_AT * cell_rows, -(-routing.sizes // cell_rows), 1)
    tasks = int(min(MOST_TASKS, shards.sum()))
    routed = _refined(_routed(rows, routing, margin, probes, "id", "v"), routing, margin, probes, cell_rows)
    return routed.repartition(tasks, "cell").groupBy("cell").applyInArrow(run, _PAIRS)


def similar_links(vectors: DataFrame, least: float = 0.9, margin: float = MARGIN, beam: int = BEAM, degree: int = DEGREE, key: str = "chunk_id", column: str = "embedding", **cells: int) -> DataFrame:
    """Links between different vectors with cosine similarity of at least ``least``: (a, b), smaller key first.

    Each distinct vector is named by its smallest key; `vector_groups` tells which other
    rows have it.  The graphs tell which vectors have a similar one; these are compared
    with their whole shards, and each cosine is checked in double precision.
    """
    rows = _usable_rows(vectors, key, column)
    found = _search(rows, margin, 1, beam, degree, least, 1, **cells)
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def vector_groups(vectors: DataFrame, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """(rep, id): membership of every row whose vector another key has too; ``rep`` is the smallest of their keys."""
    rows = _usable_rows(vectors, key, column)
    return _members(rows)


def similar_pairs(vectors: DataFrame, least: float = 0.9, margin: float = MARGIN, beam: int = BEAM, degree: int = DEGREE, key: str = "chunk_id", column: str = "embedding", **cells: int) -> DataFrame:
    """Pairs of different rows with cosine similarity of at least ``least``: (chunk_id_a, chunk_id_b), smaller first.

    Vectors that are null, empty, zero, not finite or of another length take no part;
    rows that repeat a key and its vector count once; rows with a null key are dropped.
    The links of `similar_links` are expanded to all rows of the two vectors, and the
    rows of one vector are paired among themselves, by joins on the groups: pairs of
    equal rows are part of this result by definition.  Where groups of copies are large,
    take links and groups instead.
    """
    links, members = similar_links(vectors, least, margin, beam, degree, key, column, **cells), vector_groups(vectors, key, column)
    of = lambda end: members.select(F.col("rep").alias(end), F.col("id").alias(f"{end}_row"))
    across = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("a_row", "a").alias("a"), F.coalesce("b_row", "b").alias("b"))
    within = members.join(members.withColumnRenamed("id", "other"), "rep").where("id < other").select(F.col("id").alias("a"), F.col("other").alias("b"))
    return across.where("a <> b").unionByName(within).select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()


def nearest(vectors: DataFrame, k: int = 10, probes: int = 6, margin: float = MARGIN, beam: int = 64, degree: int = 32, key: str = "chunk_id", column: str = "embedding") -> DataFrame:
    """The k most similar other rows of every usable row: (chunk_id, neighbor_id, similarity, rank).

    Ties go to the smaller key.  Vectors are searched once each; of a vector's rows only
    the k + 1 of smallest key can be a neighbour, so no more are expanded.  Accuracy: see
    the README for recall against brute force.
    """
    rows = _usable_rows(vectors, key, column)
    found = _search(rows, margin, probes, beam, degree, None, k)
    first = lambda df, by, order: df.withColumn("_r", F.row_number().over(W.partitionBy(by).orderBy(*order)))
    best = first(found.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "a", [F.desc("similarity"), F.asc("b")]).where(F.col("_r") <= k).select("a", "b", "similarity")
    members = _members(rows)
    few = first(members, "rep", [F.asc("id")]).where(F.col("_r") <= k + 1).groupBy("rep").agg(F.collect_list("id").alias("ids"))  # at most k + 1 each
    own = few.select(F.col("rep").alias("a"), F.col("ids").alias("near"), F.lit(1.0).alias("similarity"))
    other = best.join(few.select(F.col("rep").alias("b"), "ids"), "b", "left").select("a", F.coalesce("ids", F.array("b")).alias("near"), "similarity")
    listed = other.unionByName(own).select("a", F.explode("near").alias("b"), "similarity")
    asked = listed.join(members.withColumnRenamed("rep", "a"), "a", "left").select(F.coalesce("id", "a").alias("a"), "b", "similarity").where("a <> b")
    rank = first(asked.groupBy("a", "b").agg(F.max("similarity").alias("similarity")), "a", [F.desc("similarity"), F.asc("b")])
    return rank.where(F.col("_r") <= k).select(F.col("a").alias("chunk_id"), F.col("b").alias("neighbor_id"), "similarity", F.col("_r").alias("rank"))
