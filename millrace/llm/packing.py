"""Sum-of-squares bin packing of token pieces into fixed-length sequences.

State per packer: N(g), the number of open sequences whose free room is g.  A
piece goes to the open sequence for which the sum of N(g)**2 becomes smallest;
a new sequence is opened only where none has room.  Pieces come longest first,
which lets short ones fill what is left.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, stored
from .tok import WordEncoder, default_tokenizer_path, slices

#: Pieces of one packer: its memory is bounded, and what it leaves open is a small share.
GROUP_PIECES = 65_536
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def pack(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece by the sum-of-squares rule; every length is 1 to capacity."""
    n = len(lengths)
    bins, offsets = np.empty(n, np.int64), np.zeros(n, np.int64)
    full = lengths == capacity
    made = int(full.sum())
    bins[full] = np.arange(made)
    count = np.zeros(capacity + 1, np.int64)
    opened: dict[int, list[int]] = {}
    never = np.int64(1) << 40
    order = np.flatnonzero(~full)
    for i in order[np.argsort(-lengths[order], kind="stable")]:
        s = int(lengths[i])
        room, left = count[s:capacity], count[: capacity - s].copy()
        left[0] = 0  # a closed sequence counts no more
        change = 2 * (left - room)  # of the sum of squares, but for the same 2 everywhere
        change[0] -= 1
        change[room == 0] = never
        k = int(change.argmin())
        if change[k] == never:
            gap, where = capacity, made
            made += 1
        else:
            gap = s + k
            count[gap] -= 1
            where = opened[gap].pop()
        bins[i], offsets[i] = where, capacity - gap
        if gap > s:
            count[gap - s] += 1
            opened.setdefault(gap - s, []).append(where)
    return bins, offsets


def token_pieces(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None) -> DataFrame:
    """The pieces of every document: its ids and the end id, cut every ``capacity`` ids; a null text is empty."""
    path = path or default_tokenizer_path()
    bound_batches(docs.sparkSession)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder(path)
        for batch in batches:
            for part in slices(batch):
                ids, bounds = encoder.encode(part.column("text"))
                sizes = np.diff(bounds) + 1
                pieces = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(capacity, sizes[doc] - start)
                sums, end = np.empty(len(doc), np.int64), np.array([end_id], "<u4").tobytes()
                raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                for k, (d, a, m) in enumerate(zip(doc.tolist(), start.tolist(), length.tolist())):
                    a += int(bounds[d])
                    b = min(a + m, int(bounds[d + 1]))
                    x = zlib.crc32(raw[4 * a : 4 * b])
                    sums[k] = zlib.crc32(end, x) if b - a < m else x
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(sums)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, PIECES)


def pack_documents(docs: DataFrame, capacity: int = 4096, end_id: int = 1, path: str | None = None, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    A null text is an empty one, so it still has its end id; a null doc_id
    stays null; repeated rows are packed once each; an empty table has no
    pieces.  Pieces are dealt to packers of about ``group_pieces`` by a hash
    that also takes the row's place, so equal rows part.  Each packer may leave
    its last sequences short, about one in several thousand.
    """
    pieces = stored(token_pieces(docs, capacity, end_id, path), "pieces")
    groups = max(1, -(-pieces.count() // group_pieces))

    def fill(rows: pd.DataFrame) -> pd.DataFrame:
        bins, offsets = pack(rows["length"].to_numpy(np.int64), capacity)
        return rows.assign(sequence_id=(int(rows["_g"].iloc[0]) << 32) + bins, offset=offsets).drop(columns="_g")

    dealt = pieces.withColumn("_g", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id()), F.lit(groups)))
    columns = [*pieces.columns, "sequence_id", "offset"]
    out = dealt.groupBy("_g").applyInPandas(lambda rows: _nullable(fill(rows))[columns], PACKED)
    return out.select(*columns)


def _nullable(rows: pd.DataFrame) -> pd.DataFrame:
    """A null doc_id has made its column floating; ids are given back whole."""
    return rows.assign(doc_id=rows["doc_id"].astype("Int64"))
