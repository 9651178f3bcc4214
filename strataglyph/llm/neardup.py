"""Near-duplicates by an LSH forest, confirmed on full shingle sets.

A document's set is its distinct five-word shingles. Each tree of the forest is
one sorted order of the documents by their own sequence of minhashes. A
document's candidates are its neighbours there, longest common prefix first:
the walk goes on while the prefix is shared at all. A sketch that travels with
the row keeps neighbours that merely share a passage from becoming pairs. Equal
sets are one class before the forest, and pairs are confirmed on whole texts in
rounds: each component's most alike partners first, then only pairs that would
still join two components, until none is left.

A walk may end early, at a sure partner or after many steps. Such a row is open
in that region (the rows of a tree with one first minhash), and a link can be
lost only between two rows that are open in the same one. So open rows of
different components are compared region by region, whatever its size: rows of
a region's main component not with each other, the others with all, by bounds
that a linked pair cannot fail (sizes, parities of hashed shingles). Regions in
which that would be very many comparisons are deepened first: rows that are
open in several of them meet where they share two, and then three. What is left
is confirmed in the same rounds.

Two sets of similarity 0.75 share no first minhash in any of 12 trees once in
10^7 times; fewer than two of them three times in 10^6, and fewer than three
four times in 10^5, which matters in crowded regions only. Nothing else loses a
link.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .graph import components
from .memory import cache, turn_to
from .workspace import Workspace, fresh, known_few, light, table

WORDS = 5
#: Linked: 100 * intersection >= SIMILAR * union.
SIMILAR = 75
TREES, DEPTH = 12, 8
#: Bytes of a tree's order: four of the first minhash, two of each other.
ORDER = 4 + 2 * (DEPTH - 1)
SKETCH = TREES * DEPTH // 2
#: Neighbours that a walk sees each way, what it asks of a sketch (of 1) to emit a pair (five deviations below a linked one), and the most alike ones that it emits.
WALK, MAYBE, BEST = 96, 0.55, 3
#: The walk ends at one partner with the first agreement, or at the third with the second.
SURE, LIKELY = 0.86, 0.8
#: Pairs of a component that a round confirms, best first; the last round takes all that are left, and so does the first one if there are few.
ROUNDS, FEW_PAIRS = (2, None), 50_000
#: Bits of a set's parities: least and most, powers of two.
LEAST_BITS, MOST_BITS = 512, 16_384
#: Rows of a region that one block holds; larger regions are compared block by block.
BLOCK = 1024
#: Comparisons beyond which a region is deepened, and the first minhashes that rows share at most then.
CROWDED, DEEPEST = 1 << 24, 3
#: Pairs that wait for one leading set.
BATCH = 64
#: Rows of the orders that one range holds.
RANGE_ROWS = 400_000
#: Borders of ranges that one task walks across.
BORDERS = 16
#: Pairs of rows that are compared at once.
AT_ONCE = 50_000
_FACTORS = np.random.default_rng(20240607).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Equal half bytes of a byte, by the exclusive or of two bytes.
_EQUAL = np.array([(x & 15 == 0) + (x >> 4 == 0) for x in range(256)], np.uint8)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 64:  # so that the cache's bytes are bounded too
            if len(self) >= 100_000:
                self.clear()
            self[word] = h
        return h


_hashes = _Hashes()
cache("words", _hashes.clear)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles: none without words, one for a text shorter than a shingle."""
    found = (text or "").encode("utf-8", "replace").lower().split()  # bytes: A-Z and ASCII white space only
    if not found:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, found), np.uint64, len(found))
    size = min(words, len(found))
    out = np.full(len(found) - size + 1, size, np.uint64)
    for k in range(size):
        out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(found) - size + 1 + k])
    return np.unique(out)


def minhashes(s: np.ndarray) -> np.ndarray:
    least = np.full(len(_FACTORS), np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(s), 512):
        np.minimum(least, (s[k : k + 512, None] * _FACTORS).min(axis=0), out=least)
    return least >> np.uint64(32)


def _signature(s: np.ndarray) -> tuple[bytes, bytes]:
    """(the trees' orders one after the other, the sketch)."""
    m = minhashes(s).reshape(TREES, DEPTH)
    first, rest = m[:, :1].astype(">u4"), (m[:, 1:] & np.uint64(0xFFFF)).astype(">u2")
    orders = b"".join(a.tobytes() + b.tobytes() for a, b in zip(first, rest, strict=True))
    nibbles = (m.ravel() >> np.uint64(16) & np.uint64(15)).astype(np.uint8)
    return orders, (nibbles[::2] | nibbles[1::2] << 4).tobytes()


def parities(s: np.ndarray) -> bytes:
    """Of each hash value whether an odd number of shingles has it: two sets differ in as many shingles as they differ in bits, at least."""
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (2 * len(s) - 1).bit_length()))
    return np.packbits((np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2 (two hashes of the text) and text."""
    text = F.col("text").cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.lit(1), text).alias("t1"), F.xxhash64(F.lit(2), text).alias("t2"), text.alias("text"))


_SIGNED = "doc_id long, t1 long, t2 long, n_shingles long, f1 long, f2 long, orders binary, sketch binary, parities binary"


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, t1, t2, n_shingles, two words of fingerprint of the set, orders, sketch, parities; the last five null without words."""
    kinds = {"long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, kinds[kind]) for name, kind in map(str.split, _SIGNED.split(", "))])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("words")
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for doc_id, t1, t2, text in zip(*batch.columns, strict=True):
                s = shingles(text.as_py())
                if len(s):
                    digest = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), np.int64)
                    row = (len(s), int(digest[0]), int(digest[1]), *_signature(s), parities(s))
                else:
                    row = (0, *[None] * 5)
                for column, value in zip(rows, (doc_id.as_py(), t1.as_py(), t2.as_py(), *row), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    return _keyed(docs).mapInArrow(each, _SIGNED)


def _fixed(column: pa.Array, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def walk(tree: np.ndarray, order: np.ndarray, sketch: np.ndarray, ids: np.ndarray, fresh: int = 0, ends: tuple[int, int] = (0, 0)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, agreement in millionths) among sorted rows, only those with a row at fresh or beyond; and rows that end early, as (a, a, region).

    Every row walks both ways, as its neighbour may have ended before it. ends:
    rows before the first number that run into the end of what is here, and
    rows from the second on that run into its beginning, have ended early too.
    """
    n = len(ids)
    key = tree.astype(np.uint64) << np.uint64(32) | np.ascontiguousarray(order[:, :4]).view(">u4").ravel().astype(np.uint64)
    rows, others, agreements = [], [], []
    early = np.zeros(n, bool)
    for way in (1, -1):
        at, likely = np.arange(n), np.zeros(n, np.int8)
        for step in range(way, way * (WALK + 1), way):
            inside = (at + step < n) & (at + step >= 0)
            out = at[~inside]
            early[out[out < ends[0]] if way == 1 else out[out >= n - ends[1]]] = True
            at = at[inside]
            at = at[key[at] == key[at + step]]
            if not len(at):
                break
            agree = _EQUAL[sketch[at] ^ sketch[at + step]].sum(axis=1) / (2 * SKETCH)
            found = (agree >= MAYBE) & (np.maximum(at, at + step) >= fresh)
            rows.append(at[found])
            others.append(at[found] + step)
            agreements.append(agree[found])
            likely[at] += 3 * (agree >= SURE) + (agree >= LIKELY)
            early[at[likely[at] >= 3]] = True
            at = at[likely[at] < 3]
        early[at] = True  # the last step was within the region
    empty = (np.empty(0, np.int64),) * 3
    row, other, agree = (np.concatenate(x) for x in (rows, others, agreements)) if rows else empty
    best = np.lexsort((other, -agree, row))
    row, other, agree = row[best], other[best], agree[best]
    rank = np.arange(len(row)) - np.searchsorted(row, row)  # among the row's own pairs, most alike first
    near = rank < BEST
    early[row[~near]] = True
    a, b, open_ = ids[row[near]], ids[other[near]], ids[early]
    return np.concatenate([np.minimum(a, b), open_]), np.concatenate([np.maximum(a, b), open_]), np.concatenate([(agree[near] * 1e6).astype(np.int64), key[early].view(np.int64)])


_WALKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("w", pa.int64()), ("border", pa.int32()), ("side", pa.int32()), ("tree", pa.int32()), ("order", pa.binary()), ("sketch", pa.binary())])
_WALKED_SQL = "a long, b long, w long, border int, side int, tree int, order binary, sketch binary"


def _walk_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs within a range of an order, and its first and last rows for the walks that cross its borders."""
    part = TaskContext.get().partitionId()
    held: tuple | None = None
    seen = 0

    def rows(x: tuple, border: int, side: int) -> pa.RecordBatch:
        n = len(x[3])
        return pa.RecordBatch.from_arrays([pa.array(x[3]), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), pa.array([border] * n, pa.int32()), pa.array([side] * n, pa.int32()), pa.array(x[0].astype(np.int32)), pa.array([r.tobytes() for r in x[1]], pa.binary()), pa.array([r.tobytes() for r in x[2]], pa.binary())], schema=_WALKED)

    for batch in batches:
        if not len(batch):
            continue
        new = (batch.column(0).to_numpy(zero_copy_only=False), _fixed(batch.column(1), ORDER), _fixed(batch.column(2), SKETCH), batch.column(3).to_numpy(zero_copy_only=False))
        if seen < WALK:
            yield rows(tuple(x[: WALK - seen] for x in new), part - 1, 1)
        seen += len(new[3])
        both = new if held is None else tuple(np.concatenate(x) for x in zip(held, new, strict=True))
        a, b, w = walk(*both, fresh=0 if held is None else len(held[3]))
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(w), *[pa.nulls(n, f.type) for f in list(_WALKED)[3:]]], schema=_WALKED)
        held = tuple(x[-WALK:] for x in both)
    if held is not None:
        yield rows(held, part, 0)


def candidates(space: Workspace, reps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct pairs (a, b, w, ca, cb) of ids in reps (id, orders, sketch) that meet in any tree, and the regions (id, key) in which a row ended early.

    w: how far sketches agree; ca, cb: their components so far, themselves.
    """
    spark = reps.sparkSession
    trees = reps.select("id", "sketch", F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.expr(f"substring(orders, {t * ORDER + 1}, {ORDER})").alias("order")) for t in range(TREES)])).alias("x")).select("x.tree", "x.order", "sketch", "id")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), reps.count() * TREES // RANGE_ROWS)
    ordered = trees.repartitionByRange(parts, "tree", "order", "id").sortWithinPartitions("tree", "order", "id")
    walked = space.save(ordered.mapInArrow(_walk_partition, _WALKED_SQL), "walked")

    def across(rows):  # noqa: ANN001, ANN202
        import pandas as pd

        rows = rows.sort_values(["side", "tree", "order", "a"], kind="stable")
        before = int((rows["side"] == 0).sum())
        a, b, w = walk(rows["tree"].to_numpy(), np.frombuffer(b"".join(rows["order"]), np.uint8).reshape(-1, ORDER), np.frombuffer(b"".join(rows["sketch"]), np.uint8).reshape(-1, SKETCH), rows["a"].to_numpy(), before, (before, len(rows) - before))
        return pd.DataFrame({"a": a, "b": b, "w": w})

    # at most 2 x WALK rows at each border
    borders = walked.filter("border is not null").groupBy("border").applyInPandas(across, "a long, b long, w long").coalesce(max(1, parts // BORDERS))
    met = space.save(walked.filter("border is null").select("a", "b", "w").unionByName(borders), "walks")
    size = met.count()
    pairs = met.filter("a <> b").groupBy("a", "b").agg(F.max("w").alias("w")).select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb"))
    opened = met.filter("a = b").select(F.col("a").alias("id"), F.col("w").alias("key")).distinct()
    return space.save(light(pairs, size), "pairs"), space.save(light(opened, size), "opened")


def best_of_each(pairs: DataFrame, most: int, size: int) -> DataFrame:
    """Those of ``size`` pairs (a, b, w, ca, cb) that are among the ``most`` most alike of either of their components. The best are found within parts of a component first, as one may have very many."""
    ends = pairs.select("a", "b", "w", F.explode(F.array("ca", "cb")).alias("c"), F.pmod(F.xxhash64("a", "b"), F.lit(16)).alias("part"))
    order = [F.desc("w"), "a", "b"]
    some = light(ends.withColumn("r", F.row_number().over(Window.partitionBy("c", "part").orderBy(*order))).filter(F.col("r") <= most), 2 * size)
    best = light(some.withColumn("r", F.row_number().over(Window.partitionBy("c").orderBy(*order))).filter(F.col("r") <= most), 2 * size)
    return light(best.select("a", "b").distinct(), size)


def confirmed(space: Workspace, pairs: DataFrame, texts: DataFrame, name: str) -> DataFrame:
    """The pairs (a, b) that are linked, by the whole sets of both texts (id, text).

    The one with more pairs leads; its text goes once with every BATCH of them.
    """
    size = pairs.count()
    ends = light(pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("n")), 2 * size)
    of = lambda c: known_few(ends.select(F.col("id").alias(c), F.col("n").alias(f"n{c}")), 2 * size)
    counted = light(light(pairs.select("a", "b").join(of("a"), "a"), size).join(of("b"), "b"), size)
    first = F.col("na") >= F.col("nb")
    led = counted.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("lead"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("other"), F.greatest("na", "nb").alias("n"))
    led = led.withColumn("part", F.pmod(F.xxhash64("other"), F.ceil(F.col("n") / BATCH)).cast("int"))
    led = space.save(led, f"led-{name}")
    leads = light(led.select("lead", "part", F.lit(0).alias("place"), F.col("lead").alias("id")).distinct(), size)
    wanted = leads.unionByName(led.select("lead", "part", F.lit(1).alias("place"), F.col("other").alias("id")))
    dealt = texts.join(known_few(wanted, 2 * size), "id").select("lead", "part", "place", "id", "text").repartition("lead", "part").sortWithinPartitions("lead", "part", "place", "id")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = np.empty(0, np.uint64)
        for batch in batches:
            found: tuple[list, list] = ([], [])
            for lead, place, other, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4), strict=True):
                t = shingles(text.as_py())
                if not place:
                    s = t
                    continue
                if 100 * min(len(s), len(t)) < SIMILAR * max(len(s), len(t)):
                    continue
                common = len(np.intersect1d(s, t, assume_unique=True))
                if 100 * common >= SIMILAR * (len(s) + len(t) - common) > 0:
                    found[0].append(min(lead, other))
                    found[1].append(max(lead, other))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["a", "b"])

    return dealt.mapInArrow(each, "a long, b long")


def within(group: np.ndarray, probe: np.ndarray, major: np.ndarray, ids: np.ndarray, component: np.ndarray, n: np.ndarray, parity: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (a, b, most similarity in millionths) of rows of one group and unlike components that can be linked.

    A group's rows are its probes, its other rows outside the major component, and those within that, in this
    order. Probes are not compared with each other, nor are rows of the major component.
    """
    words = np.array([len(p) // 8 for p in parity])
    folded = {}
    for w in np.unique(words):
        fit = np.flatnonzero((words == w) | (words == 2 * w))
        flat = np.empty((len(fit), w), np.uint64)
        for k, r in enumerate(fit):
            x = np.frombuffer(parity[r], np.uint64)
            flat[k] = x if len(x) == w else x[:w] ^ x[w:]
        at = np.full(len(words), -1)
        at[fit] = np.arange(len(fit))
        folded[int(w)] = (at, flat)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def compare(x: np.ndarray, y: np.ndarray) -> None:
        total = n[x] + n[y]
        fit = (component[x] != component[y]) & (100 * np.minimum(n[x], n[y]) >= SIMILAR * np.maximum(n[x], n[y]))
        x, y, total = x[fit], y[fit], total[fit]
        least = np.minimum(words[x], words[y])
        for w in np.unique(least):
            at, flat = folded[int(w)]
            some = np.flatnonzero(least == w)
            for k in range(0, len(some), max(1, AT_ONCE * 8 // int(w))):
                part = some[k : k + max(1, AT_ONCE * 8 // int(w))]
                u, v, t = x[part], y[part], total[part]
                apart = np.bitwise_count(flat[at[u]] ^ flat[at[v]]).sum(axis=1, dtype=np.int64)
                ok = 100 * (t - apart) >= SIMILAR * (t + apart)
                u, v, t, apart = u[ok], v[ok], t[ok], apart[ok]
                found.append((np.minimum(ids[u], ids[v]), np.maximum(ids[u], ids[v]), 1_000_000 * (t - apart) // (t + apart)))

    starts, ends = np.searchsorted(group, group), np.searchsorted(group, group, side="right")
    homes = starts + np.concatenate([[0], np.cumsum(probe)])[ends] - np.concatenate([[0], np.cumsum(probe)])[starts]
    row = np.flatnonzero(major == 0)
    first = np.maximum(row + 1, homes[row])
    many = ends[row] - first
    row, first, many = row[many > 0], first[many > 0], many[many > 0]
    upto = np.concatenate([[0], np.cumsum(many)])
    k = 0
    while k < len(row):
        last = max(k + 1, int(np.searchsorted(upto, upto[k] + AT_ONCE, side="right")) - 1)
        x = np.repeat(row[k:last], many[k:last])
        compare(x, np.repeat(first[k:last] - (upto[k:last] - upto[k]), many[k:last]) + np.arange(len(x)))
        k = last
    if not found:
        return (np.empty(0, np.int64),) * 3
    a, b, w = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((b, a))
    a, b, w = a[order], b[order], w[order]
    fresh = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])[: len(a)]
    return a[fresh], b[fresh], w[fresh]


def _within_partition(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of each group of rows; a group that goes on in the next batch waits for it."""

    def pairs(t: pa.Table) -> pa.RecordBatch:
        key, block, probe, major, ids, component, n = (t.column(k).to_numpy() for k in range(7))
        group = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (block[1:] != block[:-1]))])
        a, b, w = within(group, probe, major, ids, component, n, t.column(7).to_pylist())
        order = np.argsort(ids, kind="stable")
        own = [component[order[np.searchsorted(ids, x, sorter=order)]] for x in (a, b)]
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, w, *own)], names=["a", "b", "w", "ca", "cb"])

    held: list[pa.RecordBatch] = []  # rows of one group
    for batch in batches:
        if not len(batch):
            continue
        key, block = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        ending = np.flatnonzero((key != key[-1]) | (block != block[-1]))
        last = int(ending[-1]) + 1 if len(ending) else 0
        if held and (last or held[0].column(0)[0].as_py() != key[0] or held[0].column(1)[0].as_py() != block[0]):
            yield pairs(pa.Table.from_batches([*held, *([batch.slice(0, last)] if last else [])]))
            held = []
        elif last:
            yield pairs(pa.Table.from_batches([batch.slice(0, last)]))
        held.append(batch.slice(last))
    if held:
        yield pairs(pa.Table.from_batches(held))


def _few(df: DataFrame) -> DataFrame:
    return known_few(df, df.count())


def unmet(space: Workspace, sets: DataFrame, opened: DataFrame, found: DataFrame) -> DataFrame:
    """Distinct pairs (a, b, w, ca, cb) of unlike components that may be linked and that are open in one region.

    sets: id, n, parities; opened: id, key; found: the components (id,
    component) of the ids that have others.
    """
    component = F.coalesce("component", "id").alias("component")
    posts = opened.join(_few(found), "id", "left").select("id", component, "key", F.array("key").alias("path"))
    posts = space.save(light(posts, opened.count()), "posts1")
    ready, base = [], None
    for depth in range(1, DEEPEST + 1):
        # the component that most rows of a region have: they need not be compared with each other, so that a family that is one component already costs its rows once
        size = posts.count()
        counted = light(posts.groupBy("key", "component").count(), size).groupBy("key").agg(F.sum("count").alias("m"), F.max("count").alias("c"), F.max_by("component", F.struct("count", "component")).alias("chief")).filter("c < m")
        counted = space.save(light(counted.withColumn("crowded", (F.col("m") - F.col("c")) * F.col("m") > F.lit(CROWDED)), size), f"regions{depth}")
        live = light(posts.join(_few(counted), "key"), size)
        ready.append(live if depth == DEEPEST else live.filter("not crowded"))
        crowd = counted.filter("crowded").select("key")
        if depth == DEEPEST or crowd.isEmpty():
            break
        tight = space.save(live.filter("crowded").select("id", "component", "path"), f"crowded{depth}")
        # the regions of the first depth in which a row is open and crowded
        base = base or space.save(tight.groupBy("id").agg(F.sort_array(F.collect_set(F.col("path")[0])).alias("base")), "base")
        deeper = tight.join(base, "id").withColumn("next", F.explode(F.filter("base", lambda k: k > F.element_at("path", -1))))
        path = F.concat("path", F.array("next"))
        posts = space.save(deeper.select("id", "component", F.xxhash64(path).alias("key"), path.alias("path")), f"posts{depth + 1}")
    rows = space.save(reduce(DataFrame.unionByName, [r.select("key", "id", "component", "m", "chief") for r in ready]), "ready")
    # parities join the rows of live regions only
    rows = sets.join(_few(rows), "id")
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    major = (F.col("component") == F.col("chief")).cast("int")
    home = F.pmod(F.xxhash64("id"), blocks).cast("int")
    rows = rows.withColumn("major", major).withColumn("home", home).withColumn("block", F.explode(F.when(F.col("major") == 1, F.array("home")).otherwise(F.sequence(F.lit(0), blocks - 1))))
    dealt = rows.select("key", "block", (F.col("block") != F.col("home")).cast("int").alias("probe"), "major", "id", "component", "n", "parities")
    dealt = dealt.repartition("key", "block").sortWithinPartitions("key", "block", F.desc("probe"), "major", "id")
    pairs = space.save(dealt.mapInArrow(_within_partition, "a long, b long, w long, ca long, cb long"), "met")
    return space.save(light(pairs.groupBy("a", "b").agg(*[F.max(c).alias(c) for c in ("w", "ca", "cb")]), pairs.count()), "unmet")


def merged(space: Workspace, found: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """The components found so far (id, component), after links (a, b) between any ids."""
    size, nodes = links.count(), found.count()
    side = lambda c: known_few(found.select(F.col("id").alias(c), F.col("component").alias(f"c{c}")), nodes)
    # only components are contracted, so that no link is followed again
    ends = light(light(links.join(side("a"), "a", "left"), size).join(side("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")), size)
    contraction = Workspace(space.spark, "neardup-turn")
    moved = space.save(components(contraction, ends), f"moved-{name}")
    contraction.close()
    many = moved.count()
    new = light(moved.select("id").join(known_few(found.select("id"), nodes), "id", "left_anti"), many).select("id", F.col("id").alias("component"))
    to = known_few(moved.select(F.col("id").alias("component"), F.col("component").alias("to")), many)
    return space.save(light(found.unionByName(new).join(to, "component", "left").select("id", F.coalesce("to", "component").alias("component")), nodes + many), f"found-{name}")


def linked_components(space: Workspace, docs: DataFrame, classes: DataFrame, pairs: DataFrame, found: DataFrame, name: str) -> DataFrame:
    """The components found so far (id, component), after those of pairs (a, b, w, ca, cb) that are linked and join two components."""
    size = pairs.count()
    ids = space.save(light(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), 2 * size), f"ids-{name}")
    wanted = space.save(light(classes.select("id", "t1", "t2").join(_few(ids), "id", "left_semi"), classes.count()), f"wanted-{name}")
    texts = _keyed(docs).select("t1", "t2", "text").join(_few(wanted), ["t1", "t2"]).select("id", "text")
    texts = space.save(texts.dropDuplicates(["id"]), f"texts-{name}")
    left = pairs
    for turn, most in enumerate(ROUNDS if size > FEW_PAIRS else (None,)):
        chosen = left if most is None else best_of_each(left, most, size)
        chosen = space.save(chosen.select("a", "b"), f"chosen-{name}{turn}")
        links = space.save(confirmed(space, chosen, texts, f"{name}{turn}"), f"proven-{name}{turn}")
        found = merged(space, found, links, f"{name}{turn}")
        if most is None:
            break
        nodes = found.count()
        side = lambda c: known_few(found.select(F.col("id").alias(c), F.col("component").alias(f"n{c}")), nodes)  # noqa: E731, B023
        still = light(left.select("a", "b", "w").join(_few(chosen), ["a", "b"], "left_anti"), size)
        still = light(light(still.join(side("a"), "a", "left"), size).join(side("b"), "b", "left"), size)
        still = still.withColumn("ca", F.coalesce("na", "a")).withColumn("cb", F.coalesce("nb", "b")).filter("ca <> cb")
        left = space.save(still.select("a", "b", "w", "ca", "cb"), f"left-{name}{turn}")
        size = left.count()
        if not size:
            break
    space.drop(f"texts-{name}")
    return found


def groups(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, t1, t2, n_shingles, group (null without words), component_id (the group's least doc_id)."""
    space = Workspace(docs.sparkSession, "neardup")
    known = space.save(signatures(docs), "signatures")
    worded = known.filter("f1 is not null")
    size = known.count()
    key = ["f1", "f2", "n_shingles"]
    # equal sets are one class, with one text and, written down, one number
    one = F.min_by(F.struct("t1", "t2", "orders", "sketch", "parities"), F.struct("t1", "t2")).alias("x")
    classes = worded.groupBy(*key).agg(F.min("doc_id").alias("least"), one).select(*key, "least", "x.*", F.monotonically_increasing_id().alias("id"))
    classes = space.save(light(classes, 4 * size), "classes")  # with orders and parities a row takes as much as several of numbers
    names = classes.select(*key, "id")
    # rows that share a doc_id are one document, so their classes are linked
    several = worded.groupBy("doc_id").agg(*[f(c).alias(f"{f.__name__}{c}") for c in ("f1", "f2") for f in (F.min, F.max)]).filter("doc_id is not null and (minf1 <> maxf1 or minf2 <> maxf2)").select("doc_id")
    several = light(several, size)
    several = space.save(worded.select("doc_id", *key).join(_few(space.save(several, "several")), "doc_id", "left_semi").join(names, key).select("doc_id", "id"), "members")
    many = several.count()
    firsts = known_few(light(several.groupBy("doc_id").agg(F.min("id").alias("first")), many), many)
    shared = light(several.join(firsts, "doc_id"), many).select(F.col("first").alias("a"), F.col("id").alias("b")).filter("a <> b")
    contraction = Workspace(docs.sparkSession, "neardup-turn")
    found = space.save(components(contraction, space.save(shared, "shared")), "found")
    contraction.close()
    pairs, opened = candidates(space, classes.select("id", "orders", "sketch"))
    space.drop("walked", "walks")
    found = linked_components(space, docs, classes, pairs, found, "near")
    rest = unmet(space, classes.select("id", F.col("n_shingles").alias("n"), "parities"), opened, found)
    if not rest.isEmpty():
        found = linked_components(space, docs, classes, rest, found, "rest")
    grouped = classes.select(*key, "least", "id").join(_few(found), "id", "left").withColumn("group", F.coalesce("component", "id"))
    least = light(grouped.filter("component is not null").groupBy("component").agg(F.min("least").alias("_least")), size)
    final = space.save(grouped.join(_few(least), "component", "left").select(*key, "group", F.coalesce("_least", "least").alias("component_id")), "final")
    return known.select("doc_id", "t1", "t2", *key).join(final, key, "left").select("doc_id", "t1", "t2", "n_shingles", "group", F.coalesce("component_id", "doc_id").alias("component_id"))


def link(docs: DataFrame) -> DataFrame:
    """One row a row of docs: doc_id, n_shingles, component_id, kept.

    Null and empty texts, and texts without words, are linked with nothing.
    Rows that share a doc_id are one document, whatever their order, but for
    those without words. A row without a doc_id belongs to its group like any
    other; its component_id is the group's least doc_id, and it is kept only
    where the group has none. Equal and repeated rows are one class; ties cannot
    matter, as components don't depend on which pairs are tried first. Texts of
    any length are taken whole. An empty table gives no rows. Other columns
    play no part, whatever their names.
    """
    found = groups(docs)
    return found.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, with all its columns: of least doc_id, and of its rows that share text too, any least one. Rows without words all stay."""
    space = Workspace(docs.sparkSession, "neardup-gone")
    known = space.save(groups(docs).filter("group is not null").select("group", F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "t1", "t2").alias("row")), "known")
    counted = known.groupBy("group", "row").agg(F.count(F.lit(1)).alias("n"))
    counted = space.save(counted, "counted")
    first = counted.groupBy("group").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    gone = space.save(counted.join(first, "group").filter("row <> first").select("row.doc_id", "row.t1", "row.t2"), "gone")
    own = [c for c in docs.columns]
    names = dict(zip(("doc_id", "t1", "t2"), fresh(own, 3), strict=True))
    text = F.col("text").cast("string")
    tagged = docs.withColumns({names["doc_id"]: F.col("doc_id").cast("long"), names["t1"]: F.xxhash64(F.lit(1), text), names["t2"]: F.xxhash64(F.lit(2), text)})

    def matches(rows: DataFrame) -> tuple[DataFrame, list[Column]]:
        few = _few(rows)
        return few, [F.col(names[c]).eqNullSafe(few[c]) for c in names]

    kept = tagged.join(*matches(gone), "left_anti")
    repeated = space.save(counted.filter("n > 1").select("row.doc_id", "row.t1", "row.t2"), "repeated")
    if repeated.isEmpty():
        return kept.select(*[F.col(f"`{c}`") for c in own])
    rest = [F.col(f"`{c}`") for c in own]
    once = kept.join(*matches(repeated), "left_semi").groupBy(*names.values()).agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row")).select("row.*")
    return kept.join(*matches(repeated), "left_anti").select(*rest).unionByName(once)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
