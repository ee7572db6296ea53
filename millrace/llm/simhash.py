"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints at a distance of at most 4 have a middle within 2 of both, so
emitting every variant within 2 bits (2,081 of 64 bits) and meeting on equal
variants finds all pairs.  Here the 64 bits are first parted into three: the
two parts that differ least hold at most 2 of 4 differing bits.  For each of
the three pairs of parts every fingerprint emits the variants of those 42 or 43
bits within 1 bit, half of 2: 131 keys in all instead of 2,081, and still no
pair is missed.  Colliding fingerprints are verified on all 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles
from .common import bound_batches, col, fresh, join_small, new_path, scratch, stored
from .graph import components

#: Parts of a fingerprint, as (lowest bit, bits).
PARTS = ((0, 22), (22, 21), (43, 21))


def _lanes() -> np.ndarray:
    """For each byte its eight bits, a byte each, the highest first."""
    bits = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
    return np.ascontiguousarray(bits).view("<u8").ravel()


def fingerprint(text: str | None, width: int, hasher, lanes: np.ndarray) -> int:
    """The SimHash of one text as an unsigned number."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return hasher(joined, 42)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[: len(words) - width] + 1).tolist()]
    hashes = np.array([hasher(joined[a:b], 42) for a, b in zip(starts, ends[width - 1 :].tolist())], np.uint64)
    counts = np.zeros(64, np.int64)
    for k, column in enumerate(hashes.astype(">u8").view(np.uint8).reshape(-1, 8).T):
        spread = lanes[column]
        sums = np.add.reduceat(spread, np.arange(0, len(spread), 255))  # 255 ones fit in a lane
        counts[8 * k : 8 * k + 8] = sums.view(np.uint8).reshape(-1, 8).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp holds the 64 bits as a signed long."""
    bound_batches(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lanes, hasher = _lanes(), xxhash.xxh64_intdigest
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, hasher, lanes) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "doc_id long, fp long")


def _key_masks() -> list[tuple[int, int]]:
    """For each pair of parts its number and the mask of their bits."""
    mask = [((1 << bits) - 1) << low for low, bits in PARTS]
    return [(k, (mask[a] | mask[b])) for k, (a, b) in enumerate(((0, 1), (0, 2), (1, 2)))]


def variants(fps: DataFrame) -> DataFrame:
    """(k, key, fp): all keys of each distinct fingerprint."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                own = batch.column(0).slice(at, 4096).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
                for k, mask in _key_masks():
                    flips = np.array([0, *(1 << i for i in range(64) if mask >> i & 1)], np.uint64)
                    keys = (own & np.uint64(mask))[:, None] ^ flips[None, :]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(keys.size, k, np.int8)), pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(own, len(flips)).view(np.int64))],
                        names=["k", "key", "fp"],
                    )

    return fps.mapInArrow(emit, "k byte, key long, fp long")


def _links(members: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join what hangs together among the members, at most one less than they are; each member is expanded once."""
    out = []
    todo = members
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        while front and len(todo):
            a = front.pop()
            near = np.bitwise_count(todo ^ a) <= radius
            if near.any():
                got = todo[near]
                out.extend((int(a), int(b)) for b in got)
                front.extend(got)
                todo = todo[~near]
    return out


class _Forest:
    """Union-find over the fingerprints that one task links; only links between different trees are told on."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = up[y]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def links(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(u, v): fingerprints whose components are those of all pairs within the radius (at most 4)."""
    if not 0 <= radius <= 4:
        raise ValueError("the parts of a fingerprint are made for a radius of at most 4")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, left = _Forest(), None

        def settle(k: np.ndarray, key: np.ndarray, fp: np.ndarray) -> list[tuple[int, int]]:
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (k[1:] != k[:-1]), [True])))
            size = np.diff(edge)
            at = edge[:-1][size == 2]
            a, b = fp[at], fp[at + 1]
            near = (np.bitwise_count(a ^ b) <= radius) & (a != b)
            two = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1)[near], axis=0)
            found = [(u, v) for u, v in two.tolist() if forest.join(u, v)]
            seen = set()
            for s, n in zip(edge[:-1][size > 2].tolist(), size[size > 2].tolist()):
                members = np.unique(fp[s : s + n])
                if (name := members.tobytes()) not in seen:  # the same members meet on many keys
                    seen.add(name)
                    found += [(u, v) for u, v in _links(members, radius) if forest.join(u, v)]
            return found

        def told(found: list[tuple[int, int]]) -> pa.RecordBatch:
            pairs = np.array(found, np.uint64).reshape(-1, 2).view(np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            if not batch.num_rows:
                continue
            now = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(3)]
            now[2] = now[2].view(np.uint64)
            if left is not None:
                now = [np.concatenate(x) for x in zip(left, now)]
            k, key, fp = now
            last = int(np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (k[1:] != k[:-1]))))[-1])  # the last run may go on
            if last and (found := settle(k[:last], key[:last], fp[:last])):
                yield told(found)
            left = [k[last:].copy(), key[last:].copy(), fp[last:].copy()]
        if left is not None and (found := settle(*left)):
            yield told(found)

    met = variants(fps).repartition("k", "key").sortWithinPartitions("k", "key")
    return met.mapInArrow(verify, "u long, v long")


def _classes(each: DataFrame, radius: int, more: DataFrame | None = None) -> DataFrame:
    """(fp, component_id, root): each is (doc_id, fp), stored; more are further links (u, v) of fingerprints."""
    spark = each.sparkSession
    path = new_path(spark, "components")
    with scratch(spark, "classes"):
        return _stored_classes(each, radius, more, path)


def _stored_classes(each: DataFrame, radius: int, more: DataFrame | None, path: str) -> DataFrame:
    nodes = stored(each.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    near = stored(links(nodes.select("fp"), radius), "links")
    roots = components(near if more is None else near.unionByName(more))
    named = nodes.join(roots, nodes["fp"] == roots["node"], "left").withColumn("root", F.coalesce("root", "fp"))
    named = stored(named.select("fp", "root", "least"), "rooted")
    names = stored(named.groupBy("root").agg(F.min("least").alias("component_id")), "names")  # stored, so that the join can split a large class
    return stored(join_small(named, names, ["root"], "inner").select("fp", "component_id", "root"), "components", path)


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null, empty and blank texts have fingerprint zero and link like any other.
    Rows with equal texts or ids keep a row each.  A null doc_id stays null and
    never names a component unless all its documents have none.  Equal
    fingerprints are one node, so a group of copies costs one.
    """
    each = stored(fingerprints(docs, width), "fingerprints")
    named = _classes(each, radius)
    return each.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, width: int = 4, radius: int = 4, least: float | None = None) -> DataFrame:
    """One row of docs for each class of near-duplicates: that of the smallest doc_id, all columns as they were.

    Null ids come last, equal ids are told apart by a hash of their texts, and
    of rows equal in id and text one stays.  Null and empty texts are copies of
    one another; an empty table stays empty; other columns stay, whatever their
    names.  Only the rows that go are joined with the documents.  With ``least``
    documents whose five-word shingles are so similar are near-duplicates too,
    whatever their fingerprints.
    """
    own = dict(zip(("_i", "_n", "_h"), fresh(docs.columns, "i", "n", "h")))
    keys = {"_i": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "_n": F.col("doc_id").isNull(), "_h": F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))}
    spark = docs.sparkSession
    bound_batches(spark)
    path = new_path(spark, "going")
    with scratch(spark, "copies"):
        rows = _going(docs, keys, width, radius, least, path).withColumnsRenamed(own)
    marked, on = docs.withColumns({own[k]: x for k, x in keys.items()}), list(own.values())
    kept = join_small(marked, rows.select(*on), on, "left_anti")
    repeated = join_small(marked, rows.where("_stays").select(*on), on, "left_semi").dropDuplicates(on)
    return kept.union(repeated).select(*map(col, docs.columns))


def _going(docs: DataFrame, keys: dict[str, Column], width: int, radius: int, least: float | None, path: str) -> DataFrame:
    """(_i, _n, _h, _stays), stored at path: the rows that go, and those that stay once though they are repeated."""

    def each_row(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        lanes, hasher = _lanes(), xxhash.xxh64_intdigest
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), width, hasher, lanes) for t in batch.column("text")), np.uint64, batch.num_rows)
            sets = [None if least is None else shingles.shingles(t.as_py(), hasher) for t in batch.column("text")]
            bands = [(None,) * 5 if own is None else (*shingles.band_keys(own), len(own), shingles.parities(own), shingles.wide_parities(own)) for own in sets]
            own = [pa.array([x[i] for x in bands], kind) for i, kind in enumerate((pa.list_(pa.int64()), pa.binary(), pa.int32(), pa.binary(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("_i"), batch.column("_n"), batch.column("_h"), pa.array(found.view(np.int64)), *own], names=["_i", "_n", "_h", "fp", "keys", "sketch", "size", "parities", "wide"])

    texts = docs.select(*[x.alias(k) for k, x in keys.items()], F.col("text").cast("string").alias("text"))
    each = stored(texts.mapInArrow(each_row, "_i long, _n boolean, _h long, fp long, keys array<long>, sketch binary, size int, parities binary, wide binary"), "fingerprints")
    more = None
    if least is not None:
        found = stored(shingles.links(texts.select("_h", "text"), each.select("_h", "keys", "sketch", "size", "parities", "wide"), least), "similar")
        for c in ("u", "v"):
            prints = each.select(F.col("_h").alias(c), F.col("fp").alias(f"_{c}")).distinct()
            found = found.join(prints, c)
        more = stored(found.select(F.col("_u").alias("u"), F.col("_v").alias("v")), "similar")
    named = _classes(each.select(F.when(~F.col("_n"), F.col("_i")).alias("doc_id"), "fp"), radius, more)
    rows = each.groupBy("_i", "_n", "_h", "fp").agg(F.count("*").alias("_times")).join(named.select("fp", "root"), "fp")
    rows = stored(rows, "rows")
    first = stored(rows.groupBy("root").agg(F.min(F.struct("_n", "_i", "_h")).alias("_f")), "first")  # stored, so that the join can split a large class
    rows = join_small(rows, first, ["root"], "inner").withColumn("_stays", F.struct("_n", "_i", "_h") == F.col("_f"))
    return stored(rows.where(~F.col("_stays") | (F.col("_times") > 1)).select(*keys, "_stays"), "going", path)
