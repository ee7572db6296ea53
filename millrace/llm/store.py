"""Content-addressed store of token-id streams.

A rolling hash over the ids cuts every document's stream into chunks where its
top bits are zero, so equal passages give equal chunks wherever they stand.  A
chunk is named by the hash of its bytes and stored once.  A document is a
recipe: the names of its chunks in order.  Recipes lie in ascending doc_id
order; each part of them has a Merkle root in the manifest.  Layout under one
folder, all Parquet: ``objects`` (chunks and recipes as written), ``recipes``
(in order, with offsets), ``manifest``.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, input_bytes, join_small, new_path, stored
from .tok import WordEncoder, default_tokenizer_path, slices

#: Ids the rolling hash looks at; zero bits at a cut (a chunk has 2**9 ids on average); least and most ids of a chunk.
WINDOW, ZERO_BITS, LEAST, MOST = 16, 9, 128, 2048
NAME = 16
#: Names of chunks that one task remembers having sent.
SENT = 200_000
#: Bytes of the input for each partition of chunks: bounds the names that one task holds (about 26 MB of them).
PART_BYTES = 256 << 20
OBJECT = "key long, chunk binary, n long, payload binary, doc_id long, chunks binary"


class Chunker:
    """Cut points of id streams, by a polynomial rolling hash modulo 2**64."""

    def __init__(self) -> None:
        x = np.arange(1 << 17, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        self.of_id = x ^ (x >> np.uint64(31))
        self.base = 0x5851F42D4C957F2D
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def candidates(self, ids: np.ndarray) -> np.ndarray:
        """Positions after which the hash of the last WINDOW ids asks for a cut."""
        n = len(ids)
        if n > len(self.up):
            self.up = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n - 1, self.base, np.uint64)))) if n > 1 else self.up
            self.down = np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(n - 1, self.inverse, np.uint64)))) if n > 1 else self.down
        sums = np.cumsum(self.of_id[ids & 0x1FFFF] * self.down[:n])
        sums[WINDOW:] = sums[WINDOW:] - sums[:-WINDOW].copy()
        return np.flatnonzero((sums * self.up[:n]) >> np.uint64(64 - ZERO_BITS) == 0) + 1

    def cuts(self, ids: np.ndarray, bounds: np.ndarray) -> list[list[int]]:
        """For each stream ids[bounds[i]:bounds[i + 1]] the ends of its chunks."""
        found = self.candidates(ids)
        first = np.searchsorted(found, bounds)
        out = []
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            ends, last = [], a
            for c in found[first[i] : first[i + 1]].tolist():
                while c - last > MOST:
                    last += MOST
                    ends.append(last)
                if c - last >= LEAST and c < b:
                    ends.append(c)
                    last = c
            while b - last > MOST:
                last += MOST
                ends.append(last)
            if b > last:
                ends.append(b)
            out.append(ends)
        return out


def write_store(docs: DataFrame, path: str, end_id: int = 2, tokenizer: str | None = None) -> None:
    """Encodes every text of docs (null: empty), appends end_id, and writes the store at path."""
    tokenizer = tokenizer or default_tokenizer_path()
    spark = docs.sparkSession
    bound_batches(spark)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, chunker, sent = WordEncoder(tokenizer), Chunker(), set()
        row = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encoder.encode(part.column("text"))
                ids = np.insert(ids, bounds[1:], end_id)
                bounds = bounds + np.arange(len(bounds))
                if len(ids) and int(ids.max()) >= 1 << 16:
                    raise ValueError("ids above 65535 need a wider format")
                raw = memoryview(np.ascontiguousarray(ids, "<u2")).cast("B")
                out = {c: [] for c in ("key", "chunk", "n", "payload", "doc_id", "chunks")}
                for doc_id, a, b, ends in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), chunker.cuts(ids, bounds)):
                    names, at = [], a
                    for end in ends:
                        payload = raw[2 * at : 2 * end]
                        name = hashlib.blake2b(payload, digest_size=NAME).digest()
                        names.append(name)
                        if name not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(name)
                            for c, x in zip(out, (int.from_bytes(name[:8], "little", signed=True), name, end - at, bytes(payload), None, None)):
                                out[c].append(x)
                        at = end
                    for c, x in zip(out, (row, None, b - a, None, doc_id, b"".join(names))):
                        out[c].append(x)
                    row += 1
                yield pa.RecordBatch.from_arrays([pa.array(out[c], t) for c, t in zip(out, (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.binary()))], names=list(out))

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # names of one partition's chunks: PART_BYTES bounds them
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for i, name in enumerate(batch.column("chunk").to_pylist()):
                if name is not None:
                    keep[i] = name not in seen
                    seen.add(name)
            yield batch.filter(pa.array(keep))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = -(-input_bytes(docs) // PART_BYTES)
    more = [parts] if parts > int(spark.conf.get("spark.sql.shuffle.partitions")) else []  # else as the session has it
    objects = texts.mapInArrow(encode, OBJECT).repartition(*more, "key").mapInArrow(once, OBJECT)
    objects.write.option("compression", "zstd").parquet(f"{path}/objects")

    recipes = spark.read.parquet(f"{path}/objects").where("chunks IS NOT NULL").select("doc_id", F.col("n").alias("n_tokens"), "chunks")

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, at, row = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            n = batch.column("n_tokens").to_numpy(zero_copy_only=False)
            start = at + np.cumsum(n) - n
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(n), part, np.int32)), pa.array(row + np.arange(len(n))), pa.array(start.astype(np.int64))], names=["doc_id", "n_tokens", "chunks", "part", "row", "local"])
            at, row = at + int(n.sum()), row + len(n)

    order = ["doc_id", "n_tokens", "chunks"]
    ordered = recipes.repartitionByRange(*order).sortWithinPartitions(*order)
    ordered.mapInArrow(numbered, "doc_id long, n_tokens long, chunks binary, part int, row long, local long").write.parquet(f"{path}/recipes")
    manifest(spark.read.parquet(f"{path}/recipes")).write.parquet(f"{path}/manifest")


def _merkle(leaves: list[bytes]) -> bytes:
    """Root of a binary hash tree; a lone node goes up as it is."""
    while len(leaves) > 1:
        pairs = [hashlib.sha256(b"\1" + leaves[i] + leaves[i + 1]).digest() for i in range(0, len(leaves) - 1, 2)]
        leaves = pairs + leaves[2 * len(pairs) :]
    return leaves[0] if leaves else hashlib.sha256(b"").digest()


def manifest(recipes: DataFrame) -> DataFrame:
    """part, n_docs, n_tokens, root: one row for each part of the recipes."""

    def root(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("row")
        leaves = rows.column("leaf").to_pylist()
        return pa.table({"part": rows.column("part").slice(0, 1), "n_docs": pa.array([len(leaves)]), "n_tokens": pa.array([sum(rows.column("n_tokens").to_pylist())]), "root": pa.array([_merkle(leaves)], pa.binary())})

    leaf = F.unhex(F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("n_tokens").cast("string"), F.hex("chunks")).cast("binary"), 256))
    return recipes.select("part", "row", "n_tokens", leaf.alias("leaf")).groupBy("part").applyInArrow(root, "part int, n_docs long, n_tokens long, root binary")


def verified_recipes(spark: SparkSession, path: str) -> DataFrame:
    """The recipes with their start in the whole stream, after every part's Merkle root has been made anew and compared."""
    recipes, told = spark.read.parquet(f"{path}/recipes"), spark.read.parquet(f"{path}/manifest")
    made, same = manifest(recipes).withColumn("made", F.lit(1)), ["part", "n_docs", "n_tokens", "root"]
    if not made.join(told.withColumn("told", F.lit(1)), same, "full").where("made IS NULL OR told IS NULL").isEmpty():
        raise ValueError(f"recipes do not match their manifest in {path}")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each part
    offsets = told.select("part", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))
    return join_small(recipes, offsets, ["part"], "inner").select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "chunks")


def _references(recipes: DataFrame) -> DataFrame:
    """(start, pos, chunk) for every chunk of every document."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.column("chunks").to_pylist()
            counts = np.array([len(x) // NAME for x in names], np.int64)
            flat = b"".join(names)
            start = np.repeat(batch.column("start").to_numpy(zero_copy_only=False), counts)
            pos = np.arange(len(start)) - np.repeat(np.cumsum(counts) - counts, counts)
            chunk = pa.FixedSizeBinaryArray.from_buffers(pa.binary(NAME), len(start), [None, pa.py_buffer(flat)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(start), pa.array(pos), chunk], names=["start", "pos", "chunk"])

    return recipes.select("start", "chunks").mapInArrow(split, "start long, pos long, chunk binary")


def _check(name: bytes, payload: bytes) -> None:
    if hashlib.blake2b(payload, digest_size=NAME).digest() != name:
        raise ValueError(f"chunk {name.hex()} is damaged")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, ids: every document's ids put together from its chunks."""
    chunks = spark.read.parquet(f"{path}/objects").where("chunk IS NOT NULL").select("chunk", "payload")
    recipes = verified_recipes(spark, path)
    parts = _references(recipes).join(chunks, "chunk", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "chunk", "payload"))).alias("parts"))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for parts in batch.column("parts").to_pylist():
                for p in parts:
                    _check(p["chunk"], p["payload"] or b"")
                ids.append(np.frombuffer(b"".join(p["payload"] for p in parts), "<u2").astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(ids, pa.list_(pa.int32()))], names=["start", "ids"])

    return parts.mapInArrow(whole, "start long, ids array<int>").join(recipes.select("doc_id", "start"), "start").select("doc_id", "start", "ids")


#: The polynomial of the usual 32-bit cyclic redundancy check, bits reversed.
CRC_POLYNOMIAL = 0xEDB88320


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of polynomials over two elements modulo the check's polynomial."""
    a, b = np.broadcast_arrays(np.asarray(a, np.uint32), np.asarray(b, np.uint32))
    out = np.zeros(a.shape, np.uint32)
    for i in range(31, -1, -1):
        out ^= np.where(a >> np.uint32(i) & np.uint32(1), b, np.uint32(0))
        b = (b >> np.uint32(1)) ^ np.where(b & np.uint32(1), np.uint32(CRC_POLYNOMIAL), np.uint32(0))
    return out


def _shift(n_bytes: np.ndarray) -> np.ndarray:
    """x ** (8 n), for combining the checks of two strings of which the second has n bytes."""
    out, power = np.full(len(n_bytes), 1 << 31, np.uint32), np.array([1 << 30], np.uint32)
    for _ in range(3):
        power = _times(power, power)
    left = n_bytes.astype(np.uint64).copy()
    while left.any():
        out = np.where(left & np.uint64(1), _times(power, out), out)
        power, left = _times(power, power), left >> np.uint64(1)
    return out


def document_sums(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 from the files.

    Each stored chunk is read once, checked against its name and summed; a
    document's checksum over little-endian 32-bit ids is combined from those of
    its chunks, so no payload is shuffled.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sums = [], []
            for name, payload in zip(batch.column("chunk").to_pylist(), batch.column("payload").to_pylist()):
                _check(name, payload)
                ids = np.frombuffer(payload, "<u2")
                n.append(len(ids))
                sums.append(zlib.crc32(ids.astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column("chunk"), pa.array(n, pa.int64()), pa.array(sums, pa.int64())], names=["chunk", "n", "crc"])

    chunks = spark.read.parquet(f"{path}/objects").where("chunk IS NOT NULL").select("chunk", "payload")
    sums = chunks.mapInArrow(digest, "chunk binary, n long, crc long")
    recipes = stored(verified_recipes(spark, path), "starts")
    parts = _references(recipes).join(sums, "chunk", "left").groupBy("start").agg(F.sort_array(F.collect_list(F.struct("pos", "n", "crc"))).alias("parts"))

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("parts")
            bounds, flat = lists.offsets.to_numpy(), lists.values.flatten()
            if flat[2].null_count:
                raise ValueError(f"a chunk is missing in {path}")
            n, crc = flat[1].to_numpy(), flat[2].to_numpy().astype(np.uint32)
            shift = _shift(4 * n)
            first, count = bounds[:-1], np.diff(bounds)
            out, total = crc[first], n[first].copy()
            rows = np.arange(len(first))
            for j in range(1, int(count.max(initial=0))):
                rows = rows[count[rows] > j]
                at = first[rows] + j
                out[rows] = _times(shift[at], out[rows]) ^ crc[at]
                total[rows] += n[at]
            yield pa.RecordBatch.from_arrays([batch.column("start"), pa.array(total), pa.array(out.astype(np.int64))], names=["start", "n_read", "ids_crc32"])

    read = parts.mapInArrow(combine, "start long, n_read long, ids_crc32 long")
    return recipes.select("doc_id", "start").join(read, "start").select("doc_id", "start", F.col("n_read").alias("n_tokens"), "ids_crc32")


def round_trip(docs: DataFrame, end_id: int = 2, tokenizer: str | None = None, path: str | None = None) -> DataFrame:
    """Writes docs as a store and gives doc_id, start, n_tokens, ids_crc32 as read back.

    Null and empty texts are documents of the end id alone; rows with equal ids
    follow one another; null ids come first; repeated rows keep an entry each;
    an empty table makes an empty store.
    """
    path = path or new_path(docs.sparkSession, "store")
    write_store(docs, path, end_id, tokenizer)
    return document_sums(docs.sparkSession, path)
