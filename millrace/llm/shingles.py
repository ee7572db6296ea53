"""Near copies by the exact Jaccard similarity of their five-word shingles.

First come quick links, by min-hashing: 32 bands of 8 minima.  Of what meets in a
band every text has one candidate: the band's smallest hash if their sketches (a
bit of each minimum) are alike, else the likest of those before it in the order
of the sketches.  So a band of n texts costs n comparisons, and copies fall into
classes.

Then come all other pairs, exactly.  In any one order of all shingles, here the
rarest first, two sets of n and m shingles with a similarity of at least 0.8 share
one of the first n - ceil(0.8 n) + 1 of one and of the first m - ceil(0.8 m) + 1 of
the other.  Texts of different classes that meet on such a shingle are candidates
unless a bound that holds for all similar pairs rules them out: their sizes, what
is left behind the shared shingle, the bits in which the parities of their
shingles differ.  No pair is capped or missed.

All candidates meet once more by parities of at least twice as many bits as they
have shingles, which rule nearly all dissimilar pairs out at a small part of the
texts' bytes.  Those left are verified on the whole shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, join_small, new_path, scratch, stored
from .graph import components

WIDTH, SIMILAR, BANDS, EACH = 5, 0.8, 32, 8
#: Texts compared with one other in one group; texts of one band in one run.
MEMBERS, RUN = 32, 256
#: Bits of two sketches that may differ: 26 are expected at a similarity of 0.8, 45 are four deviations more.  Texts before it that a text is held against.
APART, BEFORE = 45, 8
#: Bits of a text's parities; groups of shingles that are counted for their order, as bits of the hash.
PARITIES, GROUP_BITS = 512, 18
#: Texts on one shingle that are compared in one task; of more, each pair of such parts is a group of its own.
MEET = 2048
_RNG = np.random.default_rng(5)
_TIMES, _PLUS, _MIX = (_RNG.integers(0, 2**63, BANDS * EACH, np.uint64) << np.uint64(1) | np.uint64(1) for _ in range(3))


def shingles(text: str | None, hasher, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles; a shorter text is one shingle, an empty one has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(np.array([hasher(b" ".join(words[i : i + width]), 42) for i in range(max(1, len(words) - width + 1))], np.uint64))


def band_keys(own: np.ndarray) -> tuple[np.ndarray, bytes]:
    """(a key for each band, a bit of each minimum); none without shingles."""
    if not len(own):
        return np.empty(0, np.int64), b""
    least = np.full(BANDS * EACH, np.iinfo(np.uint64).max)
    for at in range(0, len(own), 1024):
        x = own[at : at + 1024, None] * _TIMES[None] + _PLUS[None]
        np.minimum(least, x.min(0), out=least)
    least ^= least >> np.uint64(32)
    mixed = least * _MIX
    return mixed.reshape(BANDS, EACH).sum(1, dtype=np.uint64).view(np.int64), np.packbits((mixed >> np.uint64(63)).astype(np.uint8)).tobytes()


def parities(own: np.ndarray) -> bytes:
    """For each of PARITIES groups of shingles whether their number is odd: sets that differ in d shingles differ in d bits at most."""
    return np.packbits(np.bincount((own >> np.uint64(55)).astype(np.int64), minlength=PARITIES).astype(np.uint8) & 1).tobytes()


def wide_parities(own: np.ndarray) -> bytes:
    """Parities of PARITIES groups, or of the power of two from twice the number of shingles on; a group is the hash's low bits."""
    bits = max(PARITIES, 1 << (2 * len(own)).bit_length())
    return np.packbits(np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def wide_apart(one: bytes, other: bytes) -> int:
    """Bits in which two wide parities differ, the longer one folded to the shorter: no more than the shingles in which the sets do."""
    a, b = sorted((np.frombuffer(one, np.uint8), np.frombuffer(other, np.uint8)), key=len)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count(a ^ b).sum(dtype=np.int64))


def similar(sets: list[np.ndarray], least: float = SIMILAR) -> list[tuple[int, int]]:
    """Links that join what hangs together by pairs at least so similar; each set is expanded once, over those that are not linked yet."""
    size = np.array([len(s) for s in sets])
    todo = np.arange(len(sets))
    out = []
    while len(todo) > 1:
        front, todo = [todo[0]], todo[1:]
        flat, owner = np.concatenate([sets[i] for i in todo]), np.repeat(todo, size[todo])
        while front and len(todo):
            a = front.pop()
            at = np.minimum(np.searchsorted(sets[a], flat), size[a] - 1)
            both = np.bincount(owner[sets[a][at] == flat], minlength=len(sets))[todo]
            near = both >= least * (size[a] + size[todo] - both) - 1e-9
            if near.any():
                got = todo[near]
                out += [(int(a), int(b)) for b in got]
                front.extend(got)
                todo = todo[~near]
                stay = np.isin(owner, todo)
                flat, owner = flat[stay], owner[stay]
    return out


def shared(own: np.ndarray, other: np.ndarray) -> float:
    """The similarity of two sets of shingles."""
    if not len(own) or not len(other):
        return 0.0
    at = np.minimum(np.searchsorted(own, other), len(own) - 1)
    both = int((own[at] == other).sum())
    return both / (len(own) + len(other) - both)


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """pairs (_h, rep) with ok: whether the two texts are so similar.  texts, stored, has one row for each _h.

    The members of a representative are dealt to groups of about MEMBERS; each
    group is read once in order, the representative's text first, so a task
    holds one set and the text at hand however many members there are.
    """
    groups = stored(pairs.groupBy("rep").agg(F.ceil(F.count("*") / MEMBERS).cast("int").alias("groups")), "groups")
    dealt = join_small(pairs, groups, ["rep"], "inner").select("_h", "rep", F.pmod(F.xxhash64("_h", F.lit(1)), F.col("groups")).cast("int").alias("salt"))
    heads = groups.select("rep", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("salt"))
    both = dealt.join(texts, "_h").select("rep", "salt", F.lit(1).alias("side"), "_h", "text")
    both = both.unionByName(heads.join(texts, heads["rep"] == texts["_h"]).select("rep", "salt", F.lit(0).alias("side"), "_h", "text"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        head, own = None, np.empty(0, np.uint64)
        for batch in batches:
            out = []
            for rep, salt, side, h, text in zip(*(batch.column(c).to_pylist() for c in ("rep", "salt", "side", "_h")), batch.column("text")):
                read = shingles(text.as_py(), xxhash.xxh64_intdigest)
                if side == 0:
                    head, own = (rep, salt), read
                elif head != (rep, salt):
                    raise ValueError("a representative has no text")
                else:
                    out.append((h, rep, shared(own, read) >= least - 1e-9))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.bool_()))], names=["_h", "rep", "ok"])

    return both.repartition("rep", "salt").sortWithinPartitions("rep", "salt", "side").mapInArrow(verify, "_h long, rep long, ok boolean")


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bits in which sketches, as rows of four numbers, differ."""
    return np.bitwise_count(a ^ b).sum(-1)


def candidates(own: DataFrame) -> DataFrame:
    """(_h, rep): for every text and band the candidate, if it has one.  own is (_h, keys, sketch), stored, with one row for each _h."""
    turned = F.concat(F.expr("substring(sketch, band + 1)"), F.expr("substring(sketch, 1, band)"))  # each band has an order of its own
    rows = own.select("_h", F.posexplode("keys").alias("band", "key"))
    met = rows.groupBy("key").agg(F.min("_h").alias("rep"), F.max("_h").alias("most"), F.count("*").alias("n")).where("rep < most")
    sketches = own.select("_h", "sketch")  # joined when the keys are few: most keys are of one text
    met = join_small(met.drop("most"), sketches.withColumnsRenamed({"_h": "rep", "sketch": "rep_sketch"}), ["rep"], "inner")
    met = stored(met, "met")  # stored, so that the join can split a hot key
    run = F.when(F.col("n") > RUN * 256, F.expr("substring(turned, 1, 2)")).when(F.col("n") > RUN, F.expr("substring(turned, 1, 1)"))  # a hot key's texts part where their order parts
    held = join_small(join_small(rows, met, ["key"], "inner"), sketches, ["_h"], "inner").withColumn("turned", turned).select("key", run.alias("run"), "turned", "_h", "sketch", "rep", "rep_sketch")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = pa.Table.from_batches([batch] if left is None else [left, batch]).combine_chunks()
            old = 0 if left is None else left.num_rows
            left = here.slice(max(0, here.num_rows - BEFORE)).to_batches()[0]
            h, key, rep = (here.column(c).to_numpy().astype(np.int64) for c in ("_h", "key", "rep"))
            run = here.column("run").combine_chunks().dictionary_encode("encode")
            run = run.indices.to_numpy(zero_copy_only=False)
            own, first = (np.frombuffer(b"".join(here.column(c).to_pylist()), "<u8").reshape(-1, BANDS * EACH // 64) for c in ("sketch", "rep_sketch"))
            best, apart = rep.copy(), np.where(h == rep, APART + 1, _apart(own, first))
            far = np.flatnonzero((apart > APART) & (h != rep))
            near = np.full(len(h), APART + 1)
            for w in range(1, BEFORE + 1):
                at = far[far >= w]
                d = np.where((key[at] == key[at - w]) & (run[at] == run[at - w]), _apart(own[at], own[at - w]), APART + 1)
                closer = d < near[at]
                near[at[closer]], best[at[closer]] = d[closer], h[at[closer] - w]
            apart[far] = near[far]
            good = np.flatnonzero(apart <= APART)
            good = good[good >= old]
            yield pa.RecordBatch.from_arrays([pa.array(h[good]), pa.array(best[good])], names=["_h", "rep"])

    dealt = held.repartition("key", "run").sortWithinPartitions("key", "run", "turned", "_h")
    return dealt.mapInArrow(choose, "_h long, rep long").distinct()


def _new_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
    """(_h, shingles) of each text that a task has not met before."""
    import xxhash

    seen = set()
    for batch in batches:
        for h, text in zip(batch.column("_h").to_pylist(), batch.column("text")):
            if h not in seen:
                seen.add(h)
                yield h, shingles(text.as_py(), xxhash.xxh64_intdigest)


def _order(docs: DataFrame) -> np.ndarray:
    """For each group of shingles the logarithm of their number: rare ones come first.  Any order is exact, this one makes few meetings."""
    size = 1 << GROUP_BITS - 6

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, n = np.zeros(1 << GROUP_BITS, np.int64), [], 0
        for _, own in _new_sets(batches):
            held.append((own >> np.uint64(64 - GROUP_BITS)).astype(np.int64))
            n += len(own)
            if n > 1 << 20:
                total += np.bincount(np.concatenate(held), minlength=len(total))
                held, n = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=len(total))
        yield pa.RecordBatch.from_arrays([pa.array(range(64), pa.int32()), pa.array([x.tobytes() for x in total.reshape(64, size)], pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"part": table.column("part")[:1], "counts": pa.array([sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()).tobytes()], pa.binary())})

    out = np.zeros((64, size), np.int64)
    for r in docs.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r.counts, np.int64)
    return np.log2(out.ravel() + 1).astype(np.uint8)


def _runs(batches: Iterator[pa.RecordBatch], on: int) -> Iterator[list[np.ndarray]]:
    """The columns of sorted batches as arrays, cut only where the first ``on`` columns change."""
    left = None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [np.array(c.to_pylist(), object) if pa.types.is_binary(c.type) else c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = now if left is None else [np.concatenate(x) for x in zip(left, now)]
        last = int(_starts(now[:on])[-1])
        if last:
            yield [x[:last] for x in now]
        left = [x[last:].copy() for x in now]
    if left is not None:
        yield left


def _starts(columns: list[np.ndarray]) -> np.ndarray:
    """Where runs of equal rows begin."""
    return np.flatnonzero(np.concatenate(([True], np.any([c[1:] != c[:-1] for c in columns], axis=0))))


def meetings(docs: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(token, _h, pos, n): the shingles that stand among the first of several texts, with their place in each and the number of these texts."""
    order, least = _order(docs), least - 2e-9

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(rows: list[tuple[int, np.ndarray]]) -> pa.RecordBatch:
            sizes = [len(x) for _, x in rows]
            at = [np.concatenate([np.arange(n) for n in sizes]).astype(np.int32), np.repeat(np.array([h for h, _ in rows], np.int64), sizes), np.concatenate([x for _, x in rows]).view(np.int64)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in at[::-1]], names=["token", "_h", "pos"])

        rows, n = [], 0
        for h, own in _new_sets(batches):
            if len(own):
                by = np.lexsort((own, order[(own >> np.uint64(64 - GROUP_BITS)).astype(np.int64)]))
                rows.append((h, own[by[: len(own) - int(np.ceil(least * len(own))) + 1]]))
                n += len(rows[-1][1])
                if n > 1 << 17:
                    yield told(rows)
                    rows, n = [], 0
        if rows:
            yield told(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, h, pos in _runs(batches, 1):
            once = _starts([token, h])  # copies of a text in several tasks
            token, h, pos = token[once], h[once], pos[once]
            at = _starts([token])
            n = np.diff(np.concatenate((at, [len(token)])))
            n = np.repeat(n, n)
            yield pa.RecordBatch.from_arrays([pa.array(x[n > 1]) for x in (token, h, pos, n)], names=["token", "_h", "pos", "n"])

    rows = docs.mapInArrow(first, "token long, _h long, pos int").repartition("token").sortWithinPartitions("token", "_h")
    return rows.mapInArrow(meet, "token long, _h long, pos int, n long")


def rest(met: DataFrame, own: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(_h, rep): all pairs of different roots that meet and are not ruled out.  met is that of meetings(), own, stored, (_h, root, size, parities)."""
    parts = F.ceil(F.col("n") / MEET).cast("int")
    held = join_small(met, own, ["_h"], "inner").withColumn("part", F.pmod(F.xxhash64("_h", F.lit(2)), parts).cast("int"))
    held = held.select("*", F.explode(F.sequence(F.lit(0), parts - 1)).alias("other")).select("token", F.least("part", "other").alias("a"), F.greatest("part", "other").alias("b"), "size", "_h", "root", "pos", "parities")
    least = least - 2e-9

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(found: list[np.ndarray]) -> pa.RecordBatch:
            two = np.unique(np.concatenate(found), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(two[:, 1]), pa.array(two[:, 0])], names=["_h", "rep"])

        for token, a, b, size, h, root, pos, bits in _runs(batches, 3):
            if len(h) < 2:
                continue
            size, pos = size.astype(np.int64), pos.astype(np.int64)
            bits = np.frombuffer(b"".join(bits), np.uint64).reshape(len(h), -1)
            start = _starts([token, a, b])
            group = np.repeat(np.arange(len(start)), np.diff(np.concatenate((start, [len(h)]))))
            at, apart, found, n = np.arange(len(h)), 0, [], 0
            while len(at):  # every row against the one so far behind it, while that is of its group and not too large
                apart += 1
                at = at[at + apart < len(h)]
                at = at[(group[at] == group[at + apart]) & (least * size[at + apart] <= size[at])]
                i, j = at, at + apart
                i, j = (x[(root[i] != root[j])] for x in (i, j))
                wanted = np.ceil(least / (1 + least) * (size[i] + size[j])).astype(np.int64)  # shingles that similar sets of these sizes share
                good = np.minimum(size[i] - pos[i], size[j] - pos[j]) >= wanted
                i, j, wanted = i[good], j[good], wanted[good]
                good = np.bitwise_count(bits[i] ^ bits[j]).sum(1, dtype=np.int64) <= size[i] + size[j] - 2 * wanted
                if good.any():
                    i, j = h[i[good]], h[j[good]]
                    found.append(np.stack((np.minimum(i, j), np.maximum(i, j)), 1))
                    n += len(i)
                    if n > 1 << 20:
                        yield told(found)
                        found, n = [], 0
            if found:
                yield told(found)

    dealt = held.repartition("token", "a", "b").sortWithinPartitions("token", "a", "b", "size")
    return dealt.mapInArrow(pairs, "_h long, rep long").distinct()


def not_ruled_out(pairs: DataFrame, wide: DataFrame, least: float = SIMILAR) -> DataFrame:
    """Those of the pairs (_h, rep) whose wide parities let them be so similar.  wide, stored, is (_h, size, wide) with one row for each _h."""
    both = join_small(pairs, wide, ["_h"], "inner")
    both = join_small(both, wide.withColumnsRenamed({"_h": "rep", "size": "rep_size", "wide": "rep_wide"}), ["rep"], "inner")
    least = least - 2e-9

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy().astype(np.int64) + batch.column("rep_size").to_numpy()
            most = sizes - 2 * np.ceil(least / (1 + least) * sizes).astype(np.int64)
            apart = np.array([wide_apart(x.as_py(), y.as_py()) for x, y in zip(batch.column("wide"), batch.column("rep_wide"))], np.int64)
            yield batch.select(["_h", "rep"]).filter(pa.array(apart <= most))

    return both.select("_h", "rep", "size", "rep_size", "wide", "rep_wide").mapInArrow(near, "_h long, rep long")


def _similar_pairs(docs: DataFrame, keys: DataFrame, pairs: DataFrame, least: float, path: str) -> DataFrame:
    """(u, v), stored at path: those of the pairs (_h, rep) that are so similar."""

    def of(pairs: DataFrame, df: DataFrame) -> DataFrame:
        """The rows of df whose text is in a pair, one for each text."""
        needed = stored(pairs.select("_h").union(pairs.select("rep")).distinct(), "needed")
        return join_small(df, needed, ["_h"], "left_semi").groupBy("_h").agg(*[F.first(c).alias(c) for c in df.columns if c != "_h"])

    with scratch(docs.sparkSession, "verify"):
        pairs = stored(pairs, "pairs")
        pairs = stored(not_ruled_out(pairs, stored(of(pairs, keys.select("_h", "size", "wide")), "wide"), least), "pairs")
        texts = stored(of(pairs, docs), "texts")
        return stored(_verified(pairs, texts, least).where("ok").select(F.col("_h").alias("u"), F.col("rep").alias("v")), "similar", path)


def links(docs: DataFrame, keys: DataFrame, least: float = SIMILAR) -> DataFrame:
    """(u, v): hashes of texts with a similarity of at least ``least``; the components are those of all such pairs.

    docs has _h, the hash of the text, and text; keys (_h, keys, sketch, size,
    parities, wide), stored, has what band_keys(), parities() and
    wide_parities() make of each text.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    first, second = new_path(spark, "similar"), new_path(spark, "similar")
    with scratch(spark, "links"):
        own = stored(keys.where(F.size("keys") > 0).groupBy("_h").agg(*[F.first(c).alias(c) for c in ("keys", "sketch", "size", "parities")]), "bands")
        quick = candidates(own).select(F.greatest("_h", "rep").alias("_h"), F.least("_h", "rep").alias("rep")).distinct()
        quick = _similar_pairs(docs, keys, quick, least, first)
        roots = stored(components(quick), "roots")
        own = own.select("_h", "size", "parities").join(roots.withColumnRenamed("node", "_h"), "_h", "left").withColumn("root", F.coalesce("root", "_h"))
        met = stored(meetings(docs, least), "meetings")
        return quick.unionByName(_similar_pairs(docs, keys, rest(met, stored(own, "classes"), least), least, second))
