"""Exact top-k inner products over norm-sorted vectors.

Vectors are rotated by the singular vectors of the whole table (from its Gram
matrix, a d x d sum), range-partitioned by descending length and packed into
blocks.  The longest block gives every query a first bound on its k-th score;
by Cauchy-Schwarz a query whose bound is t needs only vectors of length t / |q|
or more, so queries sorted by that need meet a prefix of the blocks.  Inside a
block the partial product of the leading rotated components plus the product of
the residual lengths bounds each score; what the bound can't rule out is scored
exactly in integers, of any size: a bound that overflows rules nothing out, and
products beyond 64 bits are taken with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stored

#: Vectors of a block of data, queries of a block of queries, leading components of the first bound.
BLOCK, QUERY_BLOCK, LEADING = 8192, 512, 16
#: Pairs scored at once; most of a score that 64-bit sums hold for sure.
PAIRS = 16_384
SAFE = 2.0**62
#: Scores beyond a long are given as its end; they are ordered by their digits after this is added, which makes them positive.
BEYOND = 10**660


def quantized(vectors: DataFrame, scale: float = 256.0) -> DataFrame:
    """(vec_id, v): v is floor(scale * x) as doubles.

    A null vector, or one with a component that is null or not finite (itself or
    times the scale), has no row.
    """
    x = F.col("embedding").cast("array<double>")
    good = x.isNotNull() & F.forall(x, lambda c: F.coalesce(F.abs(c * F.lit(scale)) < F.lit(float("inf")), F.lit(False)))
    rows = vectors.where(good)

    def whole(c: Column) -> Column:
        y = c * F.lit(scale)
        return F.when(F.abs(y) < F.lit(2.0**53), F.floor(y).cast("double")).otherwise(y)  # larger doubles are integers

    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, whole).alias("v"))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The lists as rows of equal length; missing components are zero."""
    bounds = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
    size = np.diff(bounds)
    if (size == dim).all():
        return values.reshape(-1, dim).astype(np.float64)
    out = np.zeros((len(size), dim))
    row = np.repeat(np.arange(len(size)), size)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)] = values
    return out


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of the table, the largest first."""

    def gram(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            m = _matrix(batch.column(0), dim)
            m = m[np.abs(m).max(1, initial=0) < 1e100]  # any rotation is right; this one has to be finite
            total += m.T @ m
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim * dim)), pa.array(total.ravel())], names=["i", "x"])

    sums = rows.select("v").mapInArrow(gram, "i long, x double").groupBy("i").agg(F.sum("x").alias("x")).collect()
    total = np.zeros(dim * dim)
    for i, x in sums:
        total[i] = x
    return np.ascontiguousarray(np.linalg.eigh(total.reshape(dim, dim))[1][:, ::-1])


def _packed(rows: DataFrame, order: list, block: int, partitions: int, dim: int, extra: str) -> DataFrame:
    """Rows range-partitioned by order and packed, block by block: (block, n, most, ids, data, extra) with raw int64 and float64."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made, held, n = TaskContext.get().partitionId() << 24, 0, [], 0

        def out(part: pa.Table) -> pa.RecordBatch:
            m = _matrix(part.column("v").combine_chunks(), dim)
            ids = part.column("vec_id").to_numpy().astype(np.int64)
            rank = part.column("rank").to_numpy()
            return pa.RecordBatch.from_arrays(
                [pa.array([base + made]), pa.array([len(ids)]), pa.array([float(rank.max())]), pa.array([float(rank.min())]), pa.array([ids.tobytes()], pa.binary()), pa.array([m.tobytes()], pa.binary()), pa.array([part.column(extra).to_numpy().astype(np.float64).tobytes()], pa.binary())],
                names=["block", "n", "most", "least", "ids", "data", "extra"],
            )

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            while n >= block:
                whole = pa.Table.from_batches(held)
                yield out(whole.slice(0, block))
                made += 1
                held, n = whole.slice(block).to_batches(), n - block
        if n:
            yield out(pa.Table.from_batches(held))

    columns = ["vec_id", "v", "rank"] + ([extra] if extra != "rank" else [])
    sorted_rows = rows.repartitionByRange(partitions, *order).sortWithinPartitions(*order).select(*columns)
    return sorted_rows.mapInArrow(pack, "block long, n long, most double, least double, ids binary, data binary, extra binary")


def _exact(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Row by row the integer inner products: int64 where that holds them for sure, else Python integers."""
    with np.errstate(over="ignore", invalid="ignore"):
        safe = np.abs(q).max(1, initial=0) * np.abs(x).max(1, initial=0) * max(1, q.shape[1]) < SAFE
    safe &= (np.abs(q).max(1, initial=0) < SAFE) & (np.abs(x).max(1, initial=0) < SAFE)
    if safe.all():
        return np.einsum("ij,ij->i", q.astype(np.int64), x.astype(np.int64))
    out = np.zeros(len(q), object)
    out[safe] = np.einsum("ij,ij->i", q[safe].astype(np.int64), x[safe].astype(np.int64))
    for i in np.flatnonzero(~safe):
        out[i] = sum(int(a) * int(b) for a, b in zip(q[i].tolist(), x[i].tolist()) if a and b)
    return out


def _turned(data: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(leading rotated components, residual length, length) of each row."""
    lead = min(LEADING, data.shape[1])
    with np.errstate(over="ignore", invalid="ignore"):
        r = data @ turn
        return np.ascontiguousarray(r[:, :lead]), np.linalg.norm(r[:, lead:], axis=1), np.linalg.norm(data, axis=1)


def _score(ids: np.ndarray, q: np.ndarray, bound: np.ndarray, data_ids: np.ndarray, data: np.ndarray, turned: tuple, own: tuple, k: int):
    """(query number, vec_id, score) of the pairs that may reach the query's bound, which rises with what is found."""
    (x_lead, x_rest, x_all), (q_lead, q_rest, q_all) = turned, own
    bound = bound.copy()
    with np.errstate(over="ignore", invalid="ignore"):
        whole = np.abs(q).max(initial=0) * np.abs(data).max(initial=0) * max(1, q.shape[1]) < 2.0**53  # products of doubles are exact integers
    for at in range(0, len(data), 1024):
        part = slice(at, at + 1024)
        with np.errstate(over="ignore", invalid="ignore"):
            slack = 1e-9 * (q_all[:, None] * x_all[None, part]) + 1e-6
            upper = q_lead @ x_lead[part].T + q_rest[:, None] * x_rest[None, part] + slack
        open_ = ~(upper < bound[:, None]) & (ids[:, None] != data_ids[None, part])  # what is not a number rules nothing out
        rows, cols = np.flatnonzero(open_.any(1)), np.flatnonzero(open_.any(0))
        if not len(rows):
            continue
        if whole:
            score = np.where(open_[np.ix_(rows, cols)], q[rows] @ data[part][cols].T, -np.inf)
            who, what = np.nonzero(score >= np.maximum(bound[rows], -(2.0**62))[:, None])
            yield rows[who], data_ids[part][cols[what]], score[who, what].astype(np.int64)
            if len(cols) >= k:
                bound[rows] = np.maximum(bound[rows], np.partition(score, len(cols) - k, axis=1)[:, len(cols) - k])
            continue
        who, what = np.nonzero(open_)
        for n in range(0, len(who), PAIRS):
            a, b = who[n : n + PAIRS], what[n : n + PAIRS]
            score = _exact(q[a], data[part][b])
            keep = score >= bound[a]
            yield a[keep], data_ids[part][b[keep]], score[keep]


def _top(found: list, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k best of each query, ties to the smaller id."""
    who, what, score = (np.concatenate(x) for x in zip(*found))
    if score.dtype == object:
        order = np.array(sorted(range(len(who)), key=lambda i: (who[i], -int(score[i]), what[i])), np.int64)
    else:
        order = np.lexsort((what, -score, who))
    who, what, score = who[order], what[order], score[order]
    top = np.arange(len(who)) - np.searchsorted(who, who, "left") < k
    return who[top], what[top], score[top]


def _beyond(score: int) -> str | None:
    """Digits that order scores at or beyond the ends of a long."""
    return None if -(2**63) < score < 2**63 - 1 else f"{score + BEYOND:0662d}"


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest integer inner products of every query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows but those with the query's own id.  Ties go to the smaller vec_id.
    Vectors that are null or hold null or non-finite components, and rows
    without an id, take no part; shorter vectors count as ended by zeros.  All
    finite vectors take part; a score beyond a long is ranked by its exact value
    and given as the largest or smallest long.
    Repeated rows are candidates once each; a repeated query is one query per
    distinct id.
    """
    spark = vectors.sparkSession
    bound_batches(spark)  # a block or two for a task at once
    result = "query_id long, vec_id long, score long, beyond string"
    rows = stored(quantized(vectors, scale).where("vec_id IS NOT NULL").withColumn("rank", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c * c))), "quantized")
    n, dim = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    if not n or not dim:
        dim = 1
    turn = _rotation(rows, dim)
    blocks = stored(_packed(rows, [F.desc("rank"), F.asc("vec_id")], BLOCK, max(1, -(-n // BLOCK)), dim, "rank"), "blocks")
    first = blocks.orderBy(F.desc("most"), "block").limit(1).collect()  # one block, of bounded size
    seed_ids, seed = (np.frombuffer(first[0]["ids"], np.int64), np.frombuffer(first[0]["data"]).reshape(-1, dim)) if first else (np.empty(0, np.int64), np.empty((0, dim)))

    with np.errstate(over="ignore"):
        seed_length = float(np.linalg.norm(seed, axis=1).max(initial=0))

    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0).dropDuplicates(["vec_id"])

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """need: the least length that a vector must have to enter the query's result; bound: its k-th score so far."""
        for batch in batches:
            for part in (batch.slice(at, QUERY_BLOCK) for at in range(0, batch.num_rows, QUERY_BLOCK)):
                ids, q, size = part.column(0).to_numpy(zero_copy_only=False), _matrix(part.column(1), dim), part.column(2).to_numpy(zero_copy_only=False)
                bound = np.full(len(ids), -np.inf)
                if len(seed_ids):
                    with np.errstate(over="ignore", invalid="ignore"):
                        scores = np.where(ids[:, None] == seed_ids[None, :], -np.inf, q @ seed.T)
                        if scores.shape[1] >= k:
                            bound = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
                            bound = bound - 1e-9 * size * seed_length - 1e-6  # products of doubles are this near to the exact ones
                        bound = np.where(np.isfinite(bound) & np.isfinite(scores).any(1), bound, -np.inf)
                        need = np.where((bound > 0) & (size > 0), bound / np.where(size > 0, size, 1.0) * (1 - 1e-9), 0.0)
                else:
                    need = np.zeros(len(ids))
                need = np.where(np.isfinite(need), need, 0.0)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(need), pa.array(bound)], names=["vec_id", "v", "rank", "bound"])

    asked = queries.select("vec_id", "v", "rank").mapInArrow(bounded, "vec_id long, v array<double>, rank double, bound double")
    asked = _packed(asked, [F.asc("rank"), F.asc("vec_id")], QUERY_BLOCK, max(1, -(-n // (every * QUERY_BLOCK))), dim, "bound")
    asked = stored(asked, "queries")
    # a block of queries meets the blocks that hold vectors as long as its least need; the list of blocks has 16 bytes for every BLOCK vectors
    listed = sorted(((r["most"], r["block"]) for r in blocks.select("most", "block").toLocalIterator()), reverse=True)
    lengths, numbers = np.array([-m for m, _ in listed]), np.array([b for _, b in listed], np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for q, least in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = numbers[: np.searchsorted(lengths, -least, "right")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), q, np.int64)), pa.array(own)], names=["q", "block"])

    pairs = asked.select("block", "least").mapInArrow(meet, "q long, block long")
    left = asked.select(F.col("block").alias("q"), F.col("ids").alias("q_ids"), F.col("data").alias("q_data"), F.col("extra").alias("q_bound"))
    met = pairs.join(left, "q").join(blocks.select("block", "ids", "data"), "block").drop("q")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turned = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: memoryview(batch.column(c)[i].as_buffer()) for c in batch.schema.names if c != "block"}
                ids, q, bound = np.frombuffer(row["q_ids"], np.int64), np.frombuffer(row["q_data"]).reshape(-1, dim), np.frombuffer(row["q_bound"])
                data_ids, data = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["data"]).reshape(-1, dim)
                if (block := batch.column("block")[i].as_py()) != at:  # rows of a block stand side by side
                    at, turned = block, _turned(data, turn)
                found = []
                for some in _score(ids, q, bound, data_ids, data, turned, _turned(q, turn), k):
                    found.append(some)
                    if sum(len(x[0]) for x in found) > 16 * PAIRS:
                        found = [_top(found, k)]
                if not found:
                    continue
                who, what, score = _top(found, k)
                ends = [max(-(2**63), min(2**63 - 1, int(x))) for x in score.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(what), pa.array(ends, pa.int64()), pa.array([_beyond(int(x)) for x in score.tolist()], pa.string())], names=["query_id", "vec_id", "score", "beyond"])

    found = met.mapInArrow(search, result)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), F.desc("beyond"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
) t WHERE rank <= 5
"""
