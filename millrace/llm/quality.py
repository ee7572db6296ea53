"""Document quality by Bradley-Terry pairwise ranking.

Every pair of a labelled better and a labelled worse document says P(better
wins) = sigmoid(s(better) - s(worse)) with s linear in the features.  All such
pairs of all lessons count, in time linear in the lessons: on the range of the
scores sigmoid(a - b) is a polynomial in a and b to 13 digits, so the sums over
pairs are made of each label's sums of Chebyshev polynomials of s times the
features.  Lessons stay in stored blocks; only such sums reach the driver.  The
threshold is the exact score quantile at the share of worse documents among the
labels; scores are given as a sigmoid around it.  Features come from the whole
text alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from numpy.polynomial import chebyshev
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_small, may_broadcast, stored

#: Lessons of a block, more only where the blocks would be more than BLOCKS.
BLOCK_ROWS, BLOCKS = 32_768, 1024
FEATURES = ("upper", "exclaim", "bar", "mark", "stop", "space", "line", "log_words", "distinct", "repeat", "bigram", "longest_run")

_UPPER, _EXCLAIM, _BAR, _MARK, _STOP, _SPACE, _LINE = range(1, 8)


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)  # zero: all else
    for chars, n in (("ABCDEFGHIJKLMNOPQRSTUVWXYZ", _UPPER), ("!", _EXCLAIM), ("|", _BAR), ("#$%&*@^~", _MARK), (".,;:?", _STOP), (" \t", _SPACE), ("\r\n", _LINE)):
        for c in chars:
            table[ord(c)] = n
    return table


def features(text: str | None, table: np.ndarray) -> np.ndarray:
    """The features of one text, each between 0 and about 1; of an empty one, zeros."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    out = np.zeros(len(FEATURES))
    if not words:
        return out
    n = len(words)
    counts = np.bincount(table[np.frombuffer(raw, np.uint8)], minlength=8)
    out[:7] = np.sqrt(counts[1:8] / len(raw))
    same = np.fromiter(map(eq, words, words[1:]), bool, n - 1)
    ends = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    out[7] = np.log1p(n) / 10
    out[8] = len(set(words)) / n
    out[9] = same.mean() if n > 1 else 0.0
    out[10] = len(set(zip(words, words[1:]))) / (n - 1) if n > 1 else 1.0
    out[11] = np.log1p(np.diff(ends).max()) / 5
    return out


def with_features(docs: DataFrame) -> DataFrame:
    """(doc_id, f): f is the array of features."""
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _classes()
        for batch in batches:
            found = np.array([features(t.as_py(), table) for t in batch.column("text")]).reshape(-1)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * len(FEATURES)), pa.array(found))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lists], names=["doc_id", "f"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, f array<double>")


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text leaves 1 when divided by 3; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Model:
    """Scores are sigmoid(slope * ((f - mean) / scale . weights - threshold))."""

    def __init__(self, mean, scale, weights, threshold: float, slope: float):
        self.mean, self.scale, self.weights, self.threshold, self.slope = mean, scale, weights, threshold, slope

    def score(self, f: np.ndarray) -> np.ndarray:
        s = ((f - self.mean) / self.scale) @ self.weights
        return 1 / (1 + np.exp(-np.clip(self.slope * (s - self.threshold), -50, 50)))


#: Takes a step, which makes an array of one block's features and labels, and gives the arrays of all blocks in order.
Each = Callable[[Callable[[np.ndarray, np.ndarray], np.ndarray]], list[np.ndarray]]


def _pair_sums(z: np.ndarray, low: np.ndarray, high: np.ndarray, kernel: np.ndarray) -> np.ndarray:
    """Sums over all pairs of kernel(s of the first, s of the second): kernel stands on the nodes z, low and high are each side's sums of Chebyshev polynomials times what is summed."""
    to = chebyshev.chebvander(z, len(z) - 1).T * (2 / len(z))
    to[0] /= 2
    return low.T @ (to @ kernel @ to.T) @ high


def learn(each: Each, ridge: float = 1e-3, steps: int = 60) -> Model:
    """Bradley-Terry weights by Newton steps on all pairs of a better and a worse lesson."""
    size = len(FEATURES)
    n, good, *total = sum(each(lambda f, y: np.concatenate(([len(y), y.sum()], f.sum(0)))), np.zeros(2 + size))
    bad = n - good
    if not good or not bad:  # nothing to prefer: one score for all, of the label there is
        return Model(np.zeros(size), np.ones(size), np.zeros(size), 1.0 if bad else -1.0, 5.0)
    mean = np.array(total) / n
    scale = np.maximum(np.sqrt(sum(each(lambda f, y: ((f - mean) ** 2).sum(0))) / n), 1e-6)

    def placed(f: np.ndarray) -> np.ndarray:
        return np.clip((f - mean) / scale, -8, 8)

    upper = np.triu_indices(size)
    w = np.zeros(size)
    for _ in range(steps):
        ends = np.array(each(lambda f, y: np.array([(s := placed(f) @ w).min(), s.max()])))
        low, high = ends[:, 0].min(), ends[:, 1].max()
        middle, half = (low + high) / 2, max((high - low) / 2, 1.0)
        terms = 8 + int(np.ceil(32 / np.arcsinh(np.pi / half)))  # sigmoid's poles are pi off the axis

        def moments(f: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros((2, terms, 1 + size + len(upper[0])))
            for at in range(0, len(y), 4096):
                x, own = placed(f[at : at + 4096]), y[at : at + 4096]
                t = chebyshev.chebvander((x @ w - middle) / half, terms - 1)
                of = np.concatenate((np.ones((len(x), 1)), x, x[:, upper[0]] * x[:, upper[1]]), 1)
                for label in (0, 1):
                    out[label] += t[own == label].T @ of[own == label]
            return out.ravel()

        worse, better = sum(each(moments)).reshape(2, terms, -1) / np.array([bad, good])[:, None, None]
        z = np.cos(np.pi * (np.arange(terms) + 0.5) / terms)
        p = 1 / (1 + np.exp(half * (z[None] - z[:, None])))  # chance that the worse one (rows) wins
        won = _pair_sums(z, worse[:, : 1 + size], better[:, : 1 + size], p)
        slope = won[1:, 0] - won[0, 1:] + ridge * w
        both = _pair_sums(z, worse, better, p * (1 - p))
        curve = np.zeros((size, size))
        curve[upper] = both[0, 1 + size :] + both[1 + size :, 0]
        curve = curve + np.triu(curve, 1).T
        cross = both[1 : 1 + size, 1 : 1 + size]
        move = np.linalg.solve(curve - cross - cross.T + ridge * np.eye(size), slope)
        w = w - move * min(1.0, 4 / max(np.abs(move).max(), 1e-300))
        if np.abs(move).max() < 1e-8:
            break
    threshold, bads, goods = _quantiles(each, lambda f: placed(f) @ w, [(None, int(n), bad / n), (0, int(bad), 0.5), (1, int(good), 0.5)])
    return Model(mean, scale, w, threshold, 6 / max(goods - bads, 1e-3))


def _ordered(s: np.ndarray) -> np.ndarray:
    """Unsigned numbers in the order of the doubles."""
    bits = np.ascontiguousarray(s + 0.0).view(np.uint64)
    return np.where(bits >> np.uint64(63), ~bits, bits | np.uint64(1 << 63))


def _quantiles(each: Each, score: Callable[[np.ndarray], np.ndarray], wanted: list[tuple[int | None, int, float]]) -> list[float]:
    """Exact quantiles, between two scores in proportion: wanted are (label or None for both, lessons of it, share).  Each pass over the lessons settles 11 bits of the scores asked for."""
    places = [q * (n - 1) for _, n, q in wanted]
    asked = [(label, k) for (label, n, _), at in zip(wanted, places) for k in (int(at), min(int(at) + 1, n - 1))]
    known, rank = [0] * len(asked), [k for _, k in asked]
    for shift in range(55, -1, -11):

        def count(f: np.ndarray, y: np.ndarray) -> np.ndarray:
            bits = _ordered(score(f))
            out = np.zeros((len(asked), 2048))
            for i, (label, _) in enumerate(asked):
                own = bits if label is None else bits[y == label]
                if shift < 55:
                    own = own[own >> np.uint64(shift + 11) == np.uint64(known[i])]
                out[i] = np.bincount((own >> np.uint64(shift) & np.uint64(2047)).astype(np.int64), minlength=2048)
            return out.ravel()

        for i, counts in enumerate(sum(each(count)).reshape(len(asked), -1)):
            upto = np.cumsum(counts)
            bin_ = int(np.searchsorted(upto, rank[i], side="right"))
            rank[i] -= int(upto[bin_ - 1]) if bin_ else 0
            known[i] = known[i] << 11 | bin_
    bits = np.array(known, np.uint64)
    found = np.where(bits >> np.uint64(63), bits ^ np.uint64(1 << 63), ~bits).view(np.float64)
    return [float(a + (b - a) * (at - int(at))) for a, b, at in zip(found[::2], found[1::2], places)]


def lessons(labels: DataFrame) -> DataFrame:
    """(doc_id, quality) to learn from, stored: all that are labelled 0 or 1 and not held out."""
    told = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality IN (0, 1)").where(~held_out(F.col("doc_id")))
    return stored(told.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality")), "lessons")


def train(rows: DataFrame, told: DataFrame) -> Model:
    """Learns from all (doc_id, f) rows that have a lesson, one for each id, in blocks by a hash of the id; a single block is learnt from on the driver."""
    groups = min(BLOCKS, max(1, -(-told.count() // BLOCK_ROWS)))
    own = join_small(rows, told, ["doc_id"], "inner").groupBy("doc_id").agg(F.min("f").alias("f"), F.min("quality").alias("quality"))  # an id may stand on many rows
    own = own.withColumn("g", F.pmod(F.xxhash64("doc_id"), F.lit(groups)).cast("int")).repartition(groups, "g")

    def block(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("doc_id").to_numpy(), kind="stable")
        f = table.column("f").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))[order]
        y = table.column("quality").to_numpy()[order].astype(np.int8)
        return pa.table({"g": table.column("g")[:1], "f": pa.array([f.tobytes()]), "y": pa.array([y.tobytes()])})

    blocks = stored(own.groupBy("g").applyInArrow(block, "g int, f binary, y binary"), "blocks")

    def read(f: bytes, y: bytes) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(f, np.float64).reshape(-1, len(FEATURES)), np.frombuffer(y, np.int8)

    if groups == 1:
        held = [read(r.f, r.y) for r in blocks.collect()]
        return learn(lambda step: [step(f, y) for f, y in held])

    def each(step: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for g, f, y in zip(*(batch.column(c).to_pylist() for c in ("g", "f", "y"))):
                    out = step(*read(f, y)).astype(np.float64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([out], pa.binary())], names=["g", "out"])

        return [np.frombuffer(r.out, np.float64) for r in sorted(blocks.mapInArrow(run, "g int, out binary").collect(), key=lambda r: r.g)]

    return learn(each)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Null and empty texts have features of zero and a score like any other; null
    ids are scored and never learnt from; of labels that disagree the larger
    counts; with no labels of one kind all documents score alike.
    """
    rows = stored(with_features(docs), "features")
    model = train(rows, lessons(labels))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            f = batch.column("f").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(f))], names=["doc_id", "score"])

    scored = rows.mapInArrow(score, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose text is predicted to be of quality, all columns as they were.

    Null and empty texts are judged by features of zero; null ids are judged and
    never learnt from; repeated rows are judged alike; an empty table stays
    empty; other columns stay, whatever their names.
    """
    bound_batches(docs.sparkSession)
    told = lessons(labels)
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(~held_out(F.col("doc_id")))
    if may_broadcast(told):
        taught = taught.join(F.broadcast(told), "doc_id", "left_semi")  # else the features meet the lessons, so texts are never shuffled
    model = train(with_features(taught), told)
    inner = [f"c{i}" for i in range(len(docs.columns))]
    at = docs.columns.index("text")
    rows = docs.toDF(*inner)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _classes()
        for batch in batches:
            if batch.num_rows:
                f = np.array([features(t.as_py(), table) for t in batch.column(at)])
                yield batch.filter(pa.array(model.score(f) >= 0.5))

    return rows.mapInArrow(judge, rows.schema).toDF(*docs.columns)
