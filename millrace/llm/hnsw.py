"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard.

Shards hold a bounded number of vectors of like length: lengths are parted in
bands, so that one very long vector does not make all others of its shard look
alike.  Inner product becomes Euclidean distance by one more component that
gives all vectors of the shard one length.
Equal vectors of a shard are one node with all their ids.  Each layer's graph is
made in bulk: candidates of every node from blocks of products with the layer,
kept by the usual diversity rule and linked both ways, stored as flat neighbour
arrays.  A search descends greedily from the top layer and then keeps the best
``beam`` nodes of the bottom layer; all queries of a block walk together.
Every vector is indexed, and every shard answers every query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored
from .topk import _matrix

SHARD, QUERY_BLOCK = 8192, 1024
#: Queries that walk together; a band of lengths spans so many powers of two.
TOGETHER, BAND = 256, 4
#: Neighbours on upper layers (twice as many at the bottom), candidates when linking, beam when searching.
LINKS, CANDIDATES, BEAM = 16, 64, 96


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v as doubles): no null, zero or empty vectors, none with null or non-finite components."""
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)) & ~F.isnan(c)) & F.exists(x, lambda c: c != 0)
    return vectors.where(good & F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("v"))


def _link(x: np.ndarray, members: np.ndarray, most: int) -> np.ndarray:
    """Neighbours (node numbers, -1 for none) of each member among the members; x has rows of one length."""
    n = len(members)
    out = np.full((n, most), -1, np.int32)
    if n < 2:
        return out
    own = x[members]
    c = min(CANDIDATES, n - 1)
    chosen = np.full((n, most), -1, np.int64)
    count = np.zeros(n, np.int64)
    near = np.empty((n, c), np.int64)
    for at in range(0, n, 512):
        sims = own[at : at + 512] @ own.T
        sims[np.arange(len(sims)), np.arange(at, at + len(sims))] = -np.inf
        got = np.argpartition(sims, n - c, axis=1)[:, n - c :] if c < n else np.argsort(sims, axis=1)
        sim = np.take_along_axis(sims, got, 1)
        order = np.argsort(-sim, axis=1, kind="stable")
        near[at : at + 512] = np.take_along_axis(got, order, 1)
    half = most // 2
    for at in range(0, n, 256):
        block = near[at : at + 256]
        rows = np.arange(at, at + len(block))
        vecs = own[block]
        mutual = vecs @ vecs.transpose(0, 2, 1)
        base = np.einsum("ij,ikj->ik", own[rows], vecs)
        taken = np.zeros(block.shape, bool)
        for j in range(c):  # a candidate stays unless one kept before is nearer to it than the node itself
            blocked = (taken & (mutual[:, j, :] > base[:, j][:, None])).any(1)
            taken[:, j] = ~blocked & (taken.sum(1) < half)
        for j in range(c):  # free places go to the nearest others
            taken[:, j] |= taken.sum(1) < half
        for r, (b, t) in enumerate(zip(block, taken)):
            kept = b[t]
            chosen[at + r, : len(kept)] = kept
            count[at + r] = len(kept)
    # links back, nearest first, where there is room
    src, dst = np.repeat(np.arange(n), count), chosen[chosen >= 0]
    sim = np.einsum("ij,ij->i", own[src], own[dst])
    order = np.lexsort((-sim, dst))
    src, dst = src[order], dst[order]
    for d, s in zip(dst.tolist(), src.tolist()):
        if count[d] < most and s not in chosen[d, : count[d]]:
            chosen[d, count[d]] = s
            count[d] += 1
    has = chosen >= 0
    out[has] = members[chosen[has]]
    return out


def build(ids: np.ndarray, v: np.ndarray) -> dict[str, bytes]:
    """The index of one shard as flat arrays."""
    nodes, inverse = np.unique(v, axis=0, return_inverse=True)
    order = np.lexsort((ids, inverse.ravel()))
    bounds = np.concatenate(([0], np.cumsum(np.bincount(inverse.ravel(), minlength=len(nodes)))))
    scaled = nodes / np.abs(nodes).max(initial=1e-300)  # squares neither overflow nor vanish
    square = (scaled**2).sum(1)
    x = np.concatenate((scaled, np.sqrt(np.maximum(square.max() - square, 0))[:, None]), 1)
    x = (x / np.sqrt(square.max())).astype(np.float32)
    seeds = np.random.default_rng(len(nodes)).random(len(nodes))
    levels = np.minimum((-np.log(np.maximum(seeds, 1e-12)) / np.log(LINKS)).astype(np.int64), 6)
    levels[0] = max(levels.max(), levels[0])
    layers = []
    for level in range(int(levels.max()) + 1):
        members = np.flatnonzero(levels >= level)
        layers.append((members.astype(np.int32), _link(x, members, 2 * LINKS if level == 0 else LINKS)))
    return {
        "ids": ids[order].tobytes(),
        "bounds": bounds.astype(np.int64).tobytes(),
        "nodes": nodes.tobytes(),
        "x": x.tobytes(),
        "members": [m.tobytes() for m, _ in layers],
        "neighbours": [a.tobytes() for _, a in layers],
    }


def _walk(q: np.ndarray, x: np.ndarray, member: np.ndarray, links: np.ndarray, start: np.ndarray, beam: int) -> np.ndarray:
    """For each query the best ``beam`` nodes of a layer, nearest first (-1 for none); start is one node per query."""
    n, rows = len(q), np.arange(len(q))
    place = np.full(len(x), -1, np.int64)
    place[member] = np.arange(len(member))
    seen = np.zeros((n, len(x)), bool)
    seen[rows, start] = True
    best = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, np.float32)
    done = np.ones((n, beam), bool)
    best[:, 0], sim[:, 0], done[:, 0] = start, np.einsum("ij,ij->i", q, x[start]), False
    active = rows
    while len(active):
        open_sim = np.where(done[active], -np.inf, sim[active])
        k = open_sim.argmax(1)
        going = open_sim[np.arange(len(active)), k] > -np.inf
        active, k = active[going], k[going]
        if not len(active):
            break
        done[active, k] = True
        around = links[place[best[active, k]]].astype(np.int64)
        new = (around >= 0) & ~seen[active[:, None], np.maximum(around, 0)]
        who, what = np.nonzero(new)
        seen[active[who], around[who, what]] = True
        found = np.full(around.shape, -np.inf, np.float32)
        found[who, what] = np.einsum("ij,ij->i", q[active[who]], x[around[who, what]])
        all_sim = np.concatenate((sim[active], found), 1)
        keep = np.argpartition(-all_sim, beam - 1, axis=1)[:, :beam]
        sim[active] = np.take_along_axis(all_sim, keep, 1)
        best[active] = np.take_along_axis(np.concatenate((best[active], around), 1), keep, 1)
        done[active] = np.take_along_axis(np.concatenate((done[active], ~new), 1), keep, 1)
    order = np.argsort(-sim, axis=1, kind="stable")
    best, sim = np.take_along_axis(best, order, 1), np.take_along_axis(sim, order, 1)
    return np.where(sim > -np.inf, best, -1)


class Index:
    """One shard's row, read."""

    def __init__(self, row: dict, dim: int):
        self.nodes = np.frombuffer(row["nodes"]).reshape(-1, dim)
        self.x = np.frombuffer(row["x"], np.float32).reshape(-1, dim + 1)
        self.ids, self.bounds = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["bounds"], np.int64)
        members = [np.frombuffer(m, np.int32) for m in row["members"]]
        self.layers = [(m, np.frombuffer(a, np.int32).reshape(len(m), -1)) for m, a in zip(members, row["neighbours"])]


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row in doubles; where a sum overflows on its way, the end of the exact one."""
    with np.errstate(over="ignore", invalid="ignore"):
        out = np.einsum("ij,ij->i", q, x)
        if len(odd := np.flatnonzero(~np.isfinite(out))):
            out[odd] = np.einsum("ij,ij->i", q[odd].astype(np.longdouble), x[odd].astype(np.longdouble)).astype(float)
    return out


def search(index: Index, query_ids: np.ndarray, q: np.ndarray, k: int, beam: int):
    """(query number, vec_id, inner product) of the up to k best that the walk finds for each query."""
    nodes, x, ids, bounds = index.nodes, index.x, index.ids, index.bounds
    asked = q / np.abs(q).max(1)[:, None]
    asked = np.concatenate((asked / np.linalg.norm(asked, axis=1)[:, None], np.zeros((len(q), 1))), 1).astype(np.float32)
    at = np.full(len(q), index.layers[-1][0][0], np.int64)
    for level in range(len(index.layers) - 1, -1, -1):
        member, links = index.layers[level]
        found = _walk(asked, x, member, links, at, beam if level == 0 else 1)
        at = found[:, 0]
    who, col = np.nonzero(found >= 0)
    node = found[who, col]
    score = _products(q[who], nodes[node])
    size = np.minimum(bounds[node + 1] - bounds[node], k + 1)  # ids of a node are in order: no more can enter a result
    who, score, first = np.repeat(who, size), np.repeat(score, size), np.repeat(bounds[node], size)
    what = ids[first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)]
    other = what != query_ids[who]
    who, what, score = who[other], what[other], score[other]
    order = np.lexsort((what, -score, who))
    who, what, score = who[order], what[order], score[order]
    top = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
    return who[top], what[top], score[top]


def _banded(rows: DataFrame) -> DataFrame:
    """rows with band: the power of two of a vector's length, in steps of BAND."""
    most = F.array_max(F.transform("v", F.abs))

    def band(m: Column) -> Column:
        rest = F.aggregate("v", F.lit(0.0), lambda a, c: a + (c / m) * (c / m))
        return F.floor((F.log2(m) + F.log2(rest) / 2 + BAND / 2) / BAND).cast("int")

    return rows.withColumn("band", F.transform(F.array(most), band)[0])  # bound in an array, so that it is not computed for every component


def build_index(vectors: DataFrame, shard: int = SHARD) -> DataFrame:
    """One row per shard: shard, ids, bounds, nodes, x, members, neighbours."""
    rows = _banded(usable(vectors))
    bands = rows.groupBy("band").agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dim")).orderBy("band").collect()  # at most 526 bands
    dim, first, counts = max((r["dim"] for r in bands), default=1), 0, []
    for r in bands:
        counts.append((r["band"], first, -(-r["n"] // shard)))
        first += counts[-1][2]

    def make(rows: pa.Table) -> pa.Table:
        flat = rows.combine_chunks()
        index = build(flat.column("vec_id").to_numpy().astype(np.int64), _matrix(flat.column("v").combine_chunks(), dim))
        return pa.table({"shard": pa.array([flat.column("shard")[0].as_py()], pa.int32()), **{c: pa.array([index[c]], pa.binary()) for c in ("ids", "bounds", "nodes", "x")}, **{c: pa.array([index[c]], pa.list_(pa.binary())) for c in ("members", "neighbours")}})

    shards = vectors.sparkSession.createDataFrame(counts, "band int, first int, shards int")
    dealt = rows.join(F.broadcast(shards), "band").withColumn("shard", F.col("first") + F.pmod(F.xxhash64("vec_id"), F.col("shards")).cast("int"))
    return dealt.select("vec_id", "v", "shard").groupBy("shard").applyInArrow(make, "shard int, ids binary, bounds binary, nodes binary, x binary, members array<binary>, neighbours array<binary>")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found of every query, by inner product.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but those with the query's own id; ties go to the smaller vec_id.
    Vectors that are null, empty, zero or hold null or non-finite components,
    and rows without an id, take no part; shorter vectors count as ended by
    zeros.  Repeated rows are found once each; repeated query ids ask once.  A
    score beyond doubles is an infinity.
    """
    bound_batches(vectors.sparkSession)  # an index or two for a task at once
    rows = usable(vectors)
    dim = rows.agg(F.max(F.size("v"))).first()[0] or 1
    index = stored(build_index(vectors, shard), "hnsw")
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, QUERY_BLOCK) for at in range(0, batch.num_rows, QUERY_BLOCK)):
                yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_numpy(zero_copy_only=False).astype(np.int64).tobytes()], pa.binary()), pa.array([_matrix(part.column(1), dim).tobytes()], pa.binary())], names=["q_ids", "q_data"])

    numbers = [r["shard"] for r in index.select("shard").toLocalIterator()]  # a number for every SHARD vectors
    blocks = queries.mapInArrow(pack, "q_ids binary, q_data binary").withColumn("shard", F.explode(F.lit(numbers or [0])))

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                if (shard := batch.column("shard")[i].as_py()) != at:  # rows of a shard stand side by side
                    row = {c: memoryview(batch.column(c)[i].as_buffer()) for c in ("ids", "bounds", "nodes", "x")}
                    at, index = shard, Index(row | {c: [memoryview(x.as_buffer()) for x in batch.column(c)[i]] for c in ("members", "neighbours")}, dim)
                ids, q = (np.frombuffer(memoryview(batch.column(c)[i].as_buffer()), t) for c, t in (("q_ids", np.int64), ("q_data", float)))
                q = q.reshape(-1, dim)
                for a in range(0, len(ids), TOGETHER):
                    who, what, score = search(index, ids[a : a + TOGETHER], q[a : a + TOGETHER], k, max(beam, k + 1))
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a + who]), pa.array(what), pa.array(score)], names=["query_id", "vec_id", "score"])

    found = blocks.join(index, "shard").mapInArrow(answer, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
