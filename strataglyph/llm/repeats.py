"""Removal of long repeated byte strings by a bucketed suffix sort.

A string of SPAN bytes that occurs twice has the same leftmost least GRAM-byte
hash in both places, so only suffixes that start at such anchors need sorting,
and only with suffixes at anchors of the same hash. The starts that share an
anchor are a segment. Segments with equal digests are one class, repeated as a
whole: each text's runs of such segments are compared, byte by byte, with the
text that stands for their classes, and a difference ends the attempt, which is
made again with other hashes. Where an anchor has unlike segments, these are
sorted by the suffixes from the anchor on: a mergesort whose comparisons find
the common extension by binary search over prefix polynomial hashes. Extensions
to the right of sorted neighbours and to the left of the anchor bound which
strings two segments share; the bytes themselves confirm that before anything
is removed. Anchors with very many unlike segments, whose pairs would be too
many, are settled exactly by grouping 128-bit BLAKE2b digests of their strings
instead, which partial aggregation spreads over the cluster. Equal texts are
told by 120 bits of SHA-256.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .workspace import Workspace, table

SPAN, GRAM = 400, 200
WIDTH = SPAN - GRAM + 1
#: Starts of a text that are looked at together; positions must fit 24 bits.
CHUNK = 1 << 20
#: Unlike segments of an anchor up to which they are sorted in one task.
BUCKET = 32
#: Strings that are asked of a text in one row.
ASKED = 500
#: Rows up to which a table of longs is broadcast.
BROADCAST_ROWS = 1_000_000
_BASE = 0x9E3779B97F4A7C15 | 1
_LOW = np.uint64((1 << 24) - 1)
_powers: dict[str, np.ndarray] = {}
#: 16 bytes from a string and a seed.
Digest = Callable[[bytes, int], bytes]


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base modulo 2^64 and their inverses."""
    if not _powers:
        n = CHUNK + SPAN
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"], _powers["down"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _sliding_least(v: np.ndarray, width: int) -> np.ndarray:
    n = len(v)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = v
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def segments(data: bytes, seed: int = 0, digest: Digest = xxhash.xxh3_128_digest) -> tuple[np.ndarray, ...]:
    """Runs of starts with one anchor: anchor's hash, two words of digest, first start, last start, anchor. Together they hold every start of SPAN bytes once."""
    up, down = _tables()
    out: list[tuple[np.ndarray, ...]] = []
    view = memoryview(data)
    for begin in range(0, len(data) - SPAN + 1, CHUNK):
        part = np.frombuffer(view[begin : begin + CHUNK + SPAN - 1], np.uint8)
        n = len(part)
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum((part.astype(np.uint64) + np.uint64(1)) * up[:n], out=prefix[1:])
        grams = _mixed((prefix[GRAM:] - prefix[:-GRAM]) * down[: n - GRAM + 1])
        at = _sliding_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), WIDTH) & _LOW
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.append(first[1:], len(at)) - 1
        anchor = at[first].astype(np.int64)
        digests = np.frombuffer(b"".join(digest(view[begin + a : begin + b], seed) for a, b in zip(first.tolist(), (last + SPAN).tolist(), strict=True)), np.int64).reshape(-1, 2)
        place = _mixed((anchor - first).astype(np.uint64) << np.uint64(32) | (last - first).astype(np.uint64)).view(np.int64)
        out.append((grams[anchor].view(np.int64), digests[:, 0] ^ place, digests[:, 1], first + begin, last + begin, anchor + begin))
    if not out:
        return (np.empty(0, np.int64),) * 6
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


# The sort of suffixes -----------------------------------------------------------


class _Prefixes:
    """Prefix polynomial hashes of a byte array modulo two primes below 2^31."""

    def __init__(self, data: np.ndarray) -> None:
        self.data, self.n, self.parts = data, len(data), []
        for p, b in ((2147483629, 1000003), (2147483587, 754974721)):
            powers, inverse = np.ones(self.n + 1, np.uint64), np.ones(self.n + 1, np.uint64)
            for x, base in ((powers, b), (inverse, pow(b, -1, p))):
                size, step = 1, base
                while size < len(x):  # doubling: x[size:2*size] = x[:size] * base^size
                    x[size : 2 * size] = x[: min(size, len(x) - size)] * np.uint64(step) % np.uint64(p)
                    size, step = 2 * size, step * step % p
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers[: self.n] % np.uint64(p), out=sums[1:])
            self.parts.append((np.uint64(p), sums % np.uint64(p), inverse))

    def same(self, x: np.ndarray, y: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for p, sums, inverse in self.parts:
            out &= (sums[x + size] + p - sums[x]) % p * inverse[x] % p == (sums[y + size] + p - sums[y]) % p * inverse[y] % p
        return out

    def extension(self, x: np.ndarray, y: np.ndarray, most: np.ndarray, back: bool = False) -> np.ndarray:
        """How many bytes, most at most, agree from x and y on (or before them, if back)."""
        low, high = np.zeros(len(x), np.int64), most.astype(np.int64).copy()
        while (open_ := low < high).any():
            mid = np.where(open_, (low + high + 1) // 2, low)
            good = self.same(x - mid, y - mid, mid) if back else self.same(x, y, mid)
            low = np.where(good, mid, low)
            high = np.where(good | ~open_, high, mid - 1)
        return low


def suffix_order(bucket: np.ndarray, start: np.ndarray, end: np.ndarray, prefixes: _Prefixes) -> np.ndarray:
    """Indices that sort (bucket, bytes from start to end): a mergesort, bottom up, that merges all pairs of runs of a level at once."""
    n = len(bucket)
    order = np.arange(n)

    def less(i: np.ndarray, j: np.ndarray, ties: bool) -> np.ndarray:
        most = np.minimum(end[i] - start[i], end[j] - start[j])
        same = bucket[i] == bucket[j]
        common = prefixes.extension(start[i], start[j], np.where(same, most, 0))
        ended = common >= most
        at = lambda k: prefixes.data[np.minimum(start[k] + common, prefixes.n - 1)]
        shorter = end[i] - start[i] - (end[j] - start[j])
        inside = np.where(ended, (shorter < 0) | ((shorter == 0) & ties), at(i) < at(j))
        return np.where(same, inside, bucket[i] < bucket[j])

    width = 1
    while width < n:
        k = np.arange(n)
        run = k // width
        other = run ^ 1
        low = np.minimum(other * width, n)
        high = np.minimum(low + width, n)
        begin, left = low.copy(), run % 2 == 0
        while (open_ := low < high).any():  # where each row would go in the other run
            mid = (low + high) // 2
            i = np.flatnonzero(open_)
            before = np.where(left[i], less(order[mid[i]], order[i], False), less(order[mid[i]], order[i], True))
            low[i] = np.where(before, mid[i] + 1, low[i])
            high[i] = np.where(before, high[i], mid[i])
        place = (run // 2) * 2 * width + (k - run * width) + (low - begin)
        merged = np.empty(n, np.int64)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def shared_starts(bucket: np.ndarray, contexts: list[bytes], anchor: np.ndarray, starts: np.ndarray) -> list[tuple[int, int, int]]:
    """(row, first, last): starts of a context, from 0, whose SPAN bytes are also in another context of its bucket.

    anchor: its place in the context. starts: how many starts the context has.
    """
    sizes = np.array([len(c) for c in contexts], np.int64)
    base = np.concatenate(([0], np.cumsum(sizes)))[:-1]
    prefixes = _Prefixes(np.frombuffer(b"".join(contexts), np.uint8))
    at, end = base + anchor, base + sizes
    order = suffix_order(bucket, at, end, prefixes)
    out: list[tuple[int, int, int]] = []
    i, right = order, None
    neighbours = prefixes.extension(at[order[:-1]], at[order[1:]], np.where(bucket[order[:-1]] == bucket[order[1:]], np.minimum((end - at)[order[:-1]], (end - at)[order[1:]]), 0)) if len(order) > 1 else np.empty(0, np.int64)
    rows = np.arange(len(order) - 1)
    right = neighbours.copy()
    for step in range(1, BUCKET + 1):
        rows = rows[rows + step < len(order)]
        if step > 1:
            right = np.minimum(right[: len(rows)], neighbours[rows + step - 1])
        keep = bucket[order[rows]] == bucket[order[rows + step]]
        if not keep.any():
            break
        a, b, r = order[rows[keep]], order[rows[keep] + step], right[keep]
        left = prefixes.extension(at[a], at[b], np.minimum(anchor[a], anchor[b]), back=True)
        for x, y, fore, aft in zip(a.tolist(), b.tolist(), r.tolist(), left.tolist(), strict=True):
            # strings that begin d bytes before the anchor, SPAN - fore <= d <= aft
            for own, other in ((x, y), (y, x)):
                most = min(aft, int(anchor[own]))
                least = max(SPAN - fore, int(anchor[own]) - int(starts[own]) + 1, 0)
                if least <= most:
                    s, t = int(anchor[own]) - most, int(anchor[other]) - most
                    size = most - least + SPAN
                    if contexts[own][s : s + size] == contexts[other][t : t + size]:
                        out.append((own, s, s + most - least))
                    else:  # hashes collided: compare the strings one by one
                        out += [(own, s + d, s + d) for d in range(most - least + 1) if contexts[own][s + d : s + d + SPAN] == contexts[other][t + d : t + d + SPAN]]
    return out


# The operator --------------------------------------------------------------------

_SEGMENTS = "a long, g1 long, g2 long, k1 long, k2 long, first long, last long, at long"


def _segment_rows(batches: Iterator[pa.RecordBatch], seed: int, digest: Digest) -> Iterator[pa.RecordBatch]:
    names = [x.split()[0] for x in _SEGMENTS.split(", ")]
    for batch in batches:
        parts: list[list[np.ndarray]] = [[] for _ in names]
        held = 0
        for k1, k2, data in zip(*batch.columns, strict=True):
            value = data.as_py()
            if len(value) < SPAN:
                continue
            a, g1, g2, first, last, at = segments(value, seed, digest)
            n = len(a)
            for part, x in zip(parts, (a, g1, g2, np.full(n, k1.as_py()), np.full(n, k2.as_py()), first, last, at), strict=True):
                part.append(x)
            held += n
            if held > 60_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)
                parts, held = [[] for _ in names], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(p)) for p in parts], names=names)


#: What is asked of a text, all but k1 and k2: the bytes of an unlike segment (its anchor and digest), or those to be compared with a run of another text.
_ASKED = "unlike boolean, a long, g1 long, g2 long, many boolean, m1 long, m2 long, first long, last long, at long, begin long"
_CUT = "unlike boolean, a long, g1 long, g2 long, many boolean, k1 long, k2 long, first long, starts long, anchor long, bytes binary"


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes that are asked of each text: from begin to as far as the starts first to last reach."""
    names = [c.split()[0] for c in _CUT.split(", ")]
    kinds = [{"long": pa.int64(), "boolean": pa.bool_(), "binary": pa.binary()}[c.split()[1]] for c in _CUT.split(", ")]
    for batch in batches:
        rows: list[list] = [[] for _ in names]
        size = 0
        for data, found in zip(*batch.columns, strict=True):
            value = data.as_py()
            for x in found.as_py():
                starts = x["last"] - x["first"] + 1
                row = (x["unlike"], x["a"], x["g1"], x["g2"], x["many"], x["m1"], x["m2"], x["first"], starts, x["at"] - x["first"], value[x["begin"] : x["begin"] + starts - 1 + SPAN])
                size += len(row[-1])
                for column, v in zip(rows, row, strict=True):
                    column.append(v)
                if size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)
                    rows, size = [[] for _ in names], 0
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds, strict=True)], names=names)


def _sorted_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of repeated starts (k1, k2, first, last) of contexts that come sorted by anchor."""
    held: pa.Table | None = None

    def settle(rows: pa.Table) -> pa.RecordBatch:
        col = lambda c: rows.column(c).to_numpy()
        found = shared_starts(np.unique(col("a"), return_inverse=True)[1], rows.column("bytes").to_pylist(), col("anchor"), col("starts"))
        own = np.array([x[0] for x in found], np.int64)
        first = col("first")[own] if len(own) else own
        return pa.RecordBatch.from_arrays([pa.array(col("k1")[own]), pa.array(col("k2")[own]), pa.array(first + np.array([x[1] for x in found], np.int64)), pa.array(first + np.array([x[2] for x in found], np.int64))], names=["k1", "k2", "first", "last"])

    for batch in batches:
        if not len(batch):
            continue
        new = pa.Table.from_batches([batch])
        held = new if held is None else pa.concat_tables([held, new])
        if len(held) >= 1500:
            a = held.column("a").to_numpy()
            cut = int(np.flatnonzero(a == a[-1])[0])  # the last bucket may go on
            if cut:
                yield settle(held.slice(0, cut))
                held = held.slice(cut)
    if held is not None and len(held):
        yield settle(held)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each start of a context: the digest of its SPAN bytes."""
    for batch in batches:
        for k1, k2, first, starts, data in zip(*[batch.column(c) for c in ("k1", "k2", "first", "starts", "bytes")], strict=True):
            n, value = starts.as_py(), data.as_py()
            words = np.frombuffer(b"".join(hashlib.blake2b(value[i : i + SPAN], digest_size=16).digest() for i in range(n)), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(words[:, 0]), pa.array(words[:, 1]), pa.array(np.full(n, k1.as_py())), pa.array(np.full(n, k2.as_py())), pa.array(first.as_py() + np.arange(n))], names=["d1", "d2", "k1", "k2", "first"])


def _few(df: DataFrame, rows: int, nested: str | None = None) -> DataFrame:
    """df, to be broadcast if it has few rows, or few elements in all in its array ``nested``."""
    size = df.count() if nested is None else df.agg(F.sum(F.size(nested))).first()[0] or 0
    return F.broadcast(df) if size <= rows else df


def _islands(runs: DataFrame, by: list[str], gap: int) -> DataFrame:
    """Adds the number of the island that each run (first, last) of by lies in: runs that overlap, or are ``gap`` apart at most, share one."""
    order = Window.partitionBy(*by).orderBy("first", "last")
    before = runs.withColumn("before", F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    return before.withColumn("island", F.sum(F.coalesce((F.col("first") > F.col("before") + gap).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("before")


def removed(space: Workspace, texts: DataFrame, seed: int = 0, digest: Digest = xxhash.xxh3_128_digest) -> tuple[DataFrame, DataFrame]:
    """(k1, k2, spans): for each text (k1, k2, data) with repeats, its maximal runs of bytes to remove, sorted; and (k1, k2, same): what the bytes of some of them have to be for that."""
    every = space.save(texts.mapInArrow(lambda batches: _segment_rows(batches, seed, digest), _SEGMENTS), "segments")
    common = space.save(every.groupBy("a").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("a"), "anchors")
    rows = space.save(every.join(_few(common, BROADCAST_ROWS), "a"), "shared")
    space.drop("segments")
    key = ["a", "g1", "g2"]
    classes = space.save(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("k1", "k2", "first", "last", "at")).alias("x")), "classes")
    # runs of starts that are repeated as a whole, and where the text that stands for their classes has them
    stands = classes.filter("c > 1").select(*key, F.col("x.k1").alias("r1"), F.col("x.k2").alias("r2"), F.col("x.first").alias("rfirst"))
    whole = rows.join(stands, key).select("k1", "k2", "r1", "r2", (F.col("rfirst") - F.col("first")).alias("shift"), "first", "last").distinct()
    by = ["k1", "k2", "r1", "r2", "shift"]
    whole = space.save(_islands(whole, by, 1).groupBy(*by, "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island"), "whole")
    kinds = classes.groupBy("a").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("a", (F.col("kinds") > BUCKET).alias("many"))
    none = F.lit(None).cast("long")
    unlike = classes.join(kinds, "a").select("x.k1", "x.k2", F.struct(F.lit(True).alias("unlike"), *key, "many", F.col("x.k1").alias("m1"), F.col("x.k2").alias("m2"), "x.first", "x.last", "x.at", F.col("x.first").alias("begin")).alias("s"))
    other = whole.filter("r1 <> k1 or r2 <> k2 or shift <> 0")
    compare = other.select(F.col("r1").alias("k1"), F.col("r2").alias("k2"), F.struct(F.lit(False).alias("unlike"), *[none.alias(c) for c in key], F.lit(False).alias("many"), F.col("k1").alias("m1"), F.col("k2").alias("m2"), "first", "last", F.col("first").alias("at"), (F.col("first") + F.col("shift")).alias("begin")).alias("s"))
    asked = space.save(unlike.unionByName(compare), "asked")
    # a text that stands for very many others is asked in parts
    sizes = asked.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("n"))
    dealt = asked.join(sizes, ["k1", "k2"]).withColumn("part", F.pmod(F.xxhash64("s.m1", "s.first", "s.a"), F.ceil(F.col("n") / ASKED)).cast("int"))
    lists = dealt.groupBy("k1", "k2", "part").agg(F.collect_list("s").alias("found"))
    # copies of one text would give the same bytes; one of each is enough
    wanted = space.save(asked.select("k1", "k2").distinct(), "wanted")
    one = texts.join(_few(wanted, BROADCAST_ROWS), ["k1", "k2"], "left_semi").groupBy("k1", "k2").agg(F.first("data").alias("data"))
    contexts = space.save(lists.join(one, ["k1", "k2"]).select("data", "found").mapInArrow(_contexts, _CUT), "contexts")
    space.drop("asked")
    segments_ = contexts.filter("unlike").drop("unlike")
    bucketed = segments_.filter("not many").repartition("a").sortWithinPartitions("a").mapInArrow(_sorted_buckets, "k1 long, k2 long, first long, last long")
    strings = segments_.filter("many").mapInArrow(_digests, "d1 long, d2 long, k1 long, k2 long, first long")
    twice = strings.groupBy("d1", "d2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("d1", "d2")
    crowded = strings.join(twice, ["d1", "d2"]).select("k1", "k2", "first", F.col("first").alias("last"))
    runs = whole.select("k1", "k2", "first", "last").unionByName(bucketed).unionByName(crowded).distinct()
    ends = runs.select("k1", "k2", "first", (F.col("last") + SPAN).alias("last"))
    merged = _islands(ends, ["k1", "k2"], 0).groupBy("k1", "k2", "island").agg(F.min("first").alias("first"), F.max("last").alias("last"))
    spans = space.save(merged.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("spans")), "spans")
    space.drop("anchors", "shared", "classes", "whole", "wanted")
    return spans, contexts.filter("not unlike").groupBy("k1", "k2").agg(F.collect_list(F.struct("first", "bytes")).alias("same"))


class Collision(RuntimeError):
    """Strings of equal digests differ."""


def dedup(docs: DataFrame, keep_text: bool = False, seed: int = 0, digest: Digest = xxhash.xxh3_128_digest) -> DataFrame:
    """One row a row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the remaining text (bytes).

    A null text is empty, and a null doc_id stays null. Rows that repeat are
    copies of each other, so texts of SPAN bytes or more lose everything. Texts
    shorter than SPAN stay whole, and longer ones are taken whole, CHUNK by
    CHUNK. Which of equal strings comes first makes no difference, as all go. An
    empty table gives no rows. Other columns play no part, whatever their names.
    """
    for turn in range(seed, seed + 4):
        space = Workspace(docs.sparkSession, "repeats")
        try:
            return space.save(_dedup(space, docs, keep_text, turn, digest), "result")
        except Exception as error:
            if Collision.__name__ not in str(error):
                raise
    raise Collision("four sets of hashes collided")


def _dedup(space: Workspace, docs: DataFrame, keep_text: bool, seed: int, digest: Digest) -> DataFrame:
    data = F.coalesce(F.col("text").cast("string"), F.lit(""))
    name = F.sha2(data, 256)
    number = lambda at: F.conv(F.substring(name, at, 15), 16, 10).cast("long")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), number(1).alias("k1"), number(16).alias("k2"), data.cast("binary").alias("data"))
    spans, same = removed(space, texts.select("k1", "k2", "data"), seed, digest)
    joined = texts.join(_few(spans, BROADCAST_ROWS // 2, "spans"), ["k1", "k2"], "left").join(same, ["k1", "k2"], "left").select("doc_id", "data", "spans", "same")
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * keep_text)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, value, found, expected in zip(*batch.columns, strict=True):
                whole, cut = value.as_py(), found.as_py() or []
                for x in expected.as_py() or []:
                    if whole[x["first"] : x["first"] + len(x["bytes"])] != x["bytes"]:
                        raise Collision(doc_id.as_py())
                kept, at = [], 0
                for x in cut:
                    kept.append(whole[at : x["first"]])
                    at = x["last"]
                left = b"".join([*kept, whole[at:]]) if cut else whole
                for column, v in zip(rows, (doc_id.as_py(), len(whole), len(whole) - len(left), len(cut), hashlib.sha256(left).hexdigest(), *[left] * keep_text), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return joined.mapInArrow(each, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * keep_text)


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))
