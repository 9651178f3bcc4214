"""Best-fit packing in bulk-synchronous rounds.

Documents become pieces of at most ``capacity`` tokens. A piece longer than half
of that opens a sequence of its own, as no two of them share one. The others
are placed longest first, band by band: a band's lengths lie between half of a
bound and the bound. A round range-sorts the band's pieces and the gaps of all
sequences by size and sweeps each range for successors: a gap takes the largest
piece below it that no smaller gap has taken, which is a matching of brackets.
What a range leaves over is matched across its borders by rank, from one count
a range. Gaps that hold several pieces of the band whatever their lengths stand
for several slots. Then gaps are updated, and the round repeats. Pieces longer
than any gap that is left open as many sequences as their tokens fill at least,
the longest pieces first. When few pieces are left after a round, and few gaps that
hold any, one task places them.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .memory import turn_to
from .tokens import encoder, vocabulary
from .workspace import Workspace, table

CAPACITY = 2048
END_ID = 0
VOCABULARY = "word_bpe_49k.json"
#: Rows of a range that is swept in one task, and the last pieces and gaps of a band that one task takes at most.
RANGE_ROWS, TAIL, TAIL_GAPS = 250_000, 20_000, 100_000

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Token pieces of every row: doc_id, piece, start, length, ids_crc32.

    A null or empty text is one piece of the end id. Repeated rows give
    repeated pieces. A null doc_id stays null. Other columns play no part.
    """
    path = vocabulary_path or vocabulary(VOCABULARY)
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        encode, end, step = encoder(path), end_id.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                key, ids = doc_id.as_py(), encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    part = ids[k : k + step]
                    for column, value in zip(out, (key, k // step, k // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def brackets(gap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (pieces, gaps) matched in a sorted sequence: each gap takes the nearest piece before it that is left."""
    level = np.cumsum(np.where(gap, -1, 1)) + gap  # of a piece and of the gap that takes it alike
    order = np.lexsort((np.arange(len(gap)), level))
    first, second = order[:-1], order[1:]
    pair = ~gap[first] & gap[second] & (level[first] == level[second])
    return first[pair], second[pair]


def carried(counts: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Runs that match across ranges: (range of pieces, first, end, range of gaps, gap of the piece before the end).

    counts: (range, pieces left, gaps left) in order; in a range the gaps left
    are smaller than the pieces left. Places count from 0 by size.
    """
    open_: list[list[int]] = []
    runs = []
    for part, pieces_left, gaps_left in counts:
        used = 0
        while used < gaps_left and open_:
            other, end = open_[-1]
            n = min(end, gaps_left - used)
            runs.append((other, end - n, end, part, used))
            used += n
            open_[-1][1] -= n
            if not open_[-1][1]:
                open_.pop()
        if pieces_left:
            open_.append([part, pieces_left])
    return runs


_SWEPT = "part int, kind int, idx long, key long, length int, seq long, slot int, free int"


def _sweep_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Matches (kind 2) of one sorted range, the pieces (0) and the gaps (1) that it leaves over."""
    rows = pa.Table.from_batches(list(batches))  # a range has a bounded number of rows
    if not len(rows):
        return
    kind, key, length, seq, slot, free = (rows.column(c).to_numpy() for c in ("kind", "key", "length", "seq", "slot", "free"))
    pieces_, gaps_ = brackets(kind == 1)
    left = np.ones(len(kind), bool)
    left[pieces_] = left[gaps_] = False
    part = TaskContext.get().partitionId()

    def told(kind_: int, piece: np.ndarray, gap: np.ndarray) -> pa.RecordBatch:
        n = len(piece)
        columns = [np.full(n, part, np.int32), np.full(n, kind_, np.int32), np.arange(n), key[piece], length[piece], seq[gap], slot[gap], free[gap]]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[x.split()[0] for x in _SWEPT.split(", ")])

    yield told(2, pieces_, gaps_)
    for k in (0, 1):
        rest = np.flatnonzero(left & (kind == k))
        yield told(k, rest, rest)


def sequential(pieces_: list[tuple[int, int]], gaps: list[tuple[int, int]], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Best fit of few pieces (key, length) in gaps (free, seq) and new sequences, each named by its first piece: (key, length, seq, place in the gap, free of the gap as a whole)."""
    gaps = sorted(gaps)
    whole: dict[int, int] = {seq: free for free, seq in gaps}
    used: dict[int, int] = {}
    placed = []
    for key, length in sorted(pieces_, key=lambda x: (-x[1], x[0])):
        k = bisect.bisect_left(gaps, (length, -(1 << 63)))
        free, seq = gaps.pop(k) if k < len(gaps) else (capacity, key)
        placed.append((key, length, seq, used.get(seq, 0), whole.get(seq, capacity)))
        used[seq] = used.get(seq, 0) + length
        if free > length:
            bisect.insort(gaps, (free - length, seq))
    return placed


class _Rounds:
    """The rounds' state: gaps (seq, free), and what has been placed (key, seq, off)."""

    def __init__(self, space: Workspace, capacity: int, gaps: DataFrame) -> None:
        self.space, self.capacity, self.turn = space, capacity, 0
        self.placed: list[DataFrame] = []
        self.gaps = gaps

    def save(self, df: DataFrame, name: str) -> DataFrame:
        return self.space.save(df, f"{name}{self.turn}")

    def put(self, matches: DataFrame) -> None:
        """Takes matches (key, length, seq, slot, free: of the gap as a whole): pieces of one gap stand in the order of its slots."""
        before = Window.partitionBy("seq").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
        off = F.lit(self.capacity) - F.col("free") + F.coalesce(F.sum("length").over(before), F.lit(0))
        placed = self.save(matches.select("key", "length", "seq", off.cast("long").alias("off")), "placed")
        self.placed.append(placed.select("key", "seq", "off"))
        taken = placed.groupBy("seq").agg(F.sum("length").alias("taken"))
        left = self.gaps.join(taken, "seq", "left").select("seq", (F.col("free") - F.coalesce("taken", F.lit(0))).cast("int").alias("free"))
        self.gaps = self.save(left.filter("free > 0"), "gaps")

    def sweep(self, items: DataFrame, items_n: int, bound: int, rows: int) -> DataFrame:
        """Places what it can of the items_n items (key, length), of lengths beyond half of bound up to bound; gives the others."""
        parts = max(1, -(-rows // RANGE_ROWS))
        none = F.lit(None)
        wanted = items.select(F.lit(0).alias("kind"), F.col("length").alias("size"), "key", "length", none.cast("long").alias("seq"), none.cast("int").alias("slot"), none.cast("int").alias("free"))
        # a gap stands for no more slots than there are pieces
        n = F.least(F.greatest(F.floor(F.col("free") / bound), F.lit(1)), F.lit(items_n)).cast("int")
        fit = self.gaps.filter(F.col("free") > bound // 2).withColumn("n", n)
        several = fit.filter("n > 1").select("seq", "free", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("slot"))
        slots = fit.filter("n = 1").select("seq", "free", "n", F.lit(0).alias("slot")).unionByName(several)
        # all slots of a gap but the last hold any piece of the band
        size = F.when(F.col("slot") < F.col("n") - 1, F.lit(bound)).otherwise(F.col("free") - bound * (F.col("n") - 1))
        offered = slots.select(F.lit(1).alias("kind"), F.least(size, F.lit(bound)).cast("int").alias("size"), none.cast("long").alias("key"), none.cast("int").alias("length"), "seq", "slot", "free")
        # equal sizes: pieces first, then by number, so that they spread over ranges too
        both = wanted.unionByName(offered).withColumn("tie", F.coalesce("key", F.xxhash64("seq", "slot")))
        filled = both.select("kind", "size", "tie", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("key", "length", "seq", "slot", "free")])
        order = ["size", "kind", "tie"]
        swept = self.save(filled.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_sweep_range, _SWEPT), "swept")
        # one row a range
        counts = swept.filter("kind < 2").groupBy("part").agg(F.count(F.when(F.col("kind") == 0, 1)).alias("o"), F.count(F.when(F.col("kind") == 1, 1)).alias("c")).collect()
        runs = carried(sorted((r.part, r.o, r.c) for r in counts))
        matches = swept.filter("kind = 2").select("key", "length", "seq", "slot", "free")
        left = swept.filter("kind = 0").select("part", "idx", "key", "length")
        if runs:
            schema = T.StructType([T.StructField(n, T.LongType()) for n in ("part", "lo", "hi", "at", "used")])
            # at most two runs a range
            across = left.join(F.broadcast(self.space.spark.createDataFrame(runs, schema)), "part").filter((F.col("idx") >= F.col("lo")) & (F.col("idx") < F.col("hi")))
            wanted = across.select("key", "length", F.col("at").alias("part"), (F.col("used") + F.col("hi") - 1 - F.col("idx")).alias("idx"))
            more = self.save(wanted.join(swept.filter("kind = 1").select("part", "idx", "seq", "slot", "free"), ["part", "idx"]).select("key", "length", "seq", "slot", "free"), "across")
            matches = matches.unionByName(more)
            left = left.join(more.select("key"), "key", "left_anti")
        self.put(matches)
        return left.select("key", "length")

    def open(self, items: DataFrame, most: int) -> tuple[DataFrame, bool]:
        """Opens sequences with the longest of items (key, length), as many as those beyond ``most`` tokens need at least; gives the others, and whether any was opened."""
        beyond = items.filter(F.col("length") > most).agg(F.sum("length").alias("s"), F.count(F.lit(1)).alias("n")).first()
        if not beyond.n:
            return items, False
        wanted = -(-beyond.s // self.capacity)
        # of each length, how many are longer: a table of at most one row a length
        lengths = items.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
        longer = lengths.withColumn("longer", F.coalesce(F.sum("n").over(Window.orderBy(F.desc("length")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        edge = longer.filter(F.col("longer") < wanted).orderBy("length").first()
        # the shortest length that opens sequences may be one of very many pieces: its pieces are numbered part by part
        salts = max(1, edge.n // RANGE_ROWS)
        last_ones = items.filter(F.col("length") == edge.length).select("key", "length", F.pmod(F.xxhash64("key"), F.lit(salts)).alias("salt"))
        before = last_ones.groupBy("salt").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
        place = F.col("before") + F.row_number().over(Window.partitionBy("salt").orderBy("key"))
        some = last_ones.join(before, "salt").select("key", "length", (place <= wanted - edge.longer).alias("opens"))
        every = some.unionByName(items.filter(F.col("length") != edge.length).select("key", "length", (F.col("length") > edge.length).alias("opens")))
        every = self.save(every, "chosen")
        first, rest = every.filter("opens"), every.filter("not opens")
        self.placed.append(first.select("key", F.col("key").alias("seq"), F.lit(0).cast("long").alias("off")))
        fresh = first.select(F.col("key").alias("seq"), (F.lit(self.capacity) - F.col("length")).cast("int").alias("free"))
        self.gaps = self.gaps.unionByName(fresh)
        return rest.select("key", "length"), True

    def finish(self, items: DataFrame, bound: int) -> None:
        """Places all of items (key, length), which are TAIL at most, in gaps beyond half of bound, which are TAIL_GAPS at most, and in new sequences."""
        capacity = self.capacity

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = [r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            found = sequential([r[:2] for r in rows if r[0] is not None], [(r[3], r[2]) for r in rows if r[0] is None], capacity)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32()), strict=True)], names=["key", "length", "seq", "place", "free"])

        none = F.lit(None)
        rows = items.select("key", "length", none.cast("long").alias("seq"), none.cast("int").alias("free"))
        rows = rows.unionByName(self.gaps.filter(F.col("free") > bound // 2).select(none.cast("long").alias("key"), none.cast("int").alias("length"), "seq", "free"))
        placed = self.save(rows.coalesce(1).mapInArrow(place, "key long, length int, seq long, place long, free int"), "last")
        self.placed.append(placed.select("key", "seq", (F.lit(capacity) - F.col("free") + F.col("place")).cast("long").alias("off")))
        taken = placed.groupBy("seq").agg(F.sum("length").alias("taken"), F.max("free").alias("whole"))
        left = self.gaps.select("seq", F.col("free").alias("before")).join(taken, "seq", "full_outer")
        left = left.select("seq", (F.coalesce("before", "whole") - F.coalesce("taken", F.lit(0))).cast("int").alias("free"))
        self.gaps = self.save(left.filter("free > 0"), "gaps")

    def band(self, items: DataFrame, bound: int) -> None:
        """Places all of items (key, length), of lengths up to bound."""
        swept = False
        while True:
            self.turn += 1
            none = F.lit(None).cast("long")
            size = items.agg(F.count(F.lit(1)).alias("n"), F.min("length").cast("long").alias("least"), none.alias("slots"), none.alias("most"), none.alias("gaps"))
            free = F.when(F.col("free") > bound // 2, F.col("free"))
            fit = self.gaps.agg(none.alias("n"), none.alias("least"), F.sum(F.greatest(F.floor(free / bound), F.lit(1))).cast("long").alias("slots"), F.max(free).cast("long").alias("most"), F.count(free).alias("gaps"))
            size, fit = sorted(size.unionByName(fit).collect(), key=lambda r: r.n is None)
            if not size.n:
                return
            if size.n <= TAIL and fit.gaps <= TAIL_GAPS and (swept or not fit.gaps):
                return self.finish(items, bound)
            items, opened = self.open(items, fit.most or 0)
            if opened or (fit.most or 0) >= size.least:
                items, swept = self.sweep(items, size.n, bound, size.n + min(fit.slots or 0, fit.gaps * size.n)), True


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every piece with its sequence_id and offset; no rows for an empty table.

    Lengths that very many pieces share are dealt by number. A long text is
    many pieces, each placed for itself.
    """
    space = Workspace(docs.sparkSession, "pack")
    cut = space.save(pieces(docs, capacity, vocabulary_path, end_id).withColumn("key", F.monotonically_increasing_id()), "pieces")
    bounds = [b for b in (capacity >> k for k in range(1, capacity.bit_length())) if b]
    alone = F.col("length") > capacity // 2
    fit = cut.filter(alone & (F.col("length") < capacity)).select(F.col("key").alias("seq"), (F.lit(capacity) - F.col("length")).cast("int").alias("free"))
    rounds = _Rounds(space, capacity, fit)
    short = cut.filter(~alone).select("key", F.col("length").cast("int").alias("length"))
    # at most one row a bound
    band = reduce(lambda other, b: F.when(F.col("length") <= b, F.lit(b)).otherwise(other), bounds, F.lit(None))
    there = {r.band for r in short.select(band.alias("band")).distinct().collect()}
    for bound in bounds:
        if bound in there:
            rounds.band(short.filter((F.col("length") <= bound) & (F.col("length") > bound // 2)), bound)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    out = cut.filter(alone).select(*columns, F.col("key").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    if rounds.placed:
        places = space.save(reduce(DataFrame.unionByName, rounds.placed), "places")
        out = out.unionByName(cut.filter(~alone).join(places, "key").select(*columns, F.col("seq").alias("sequence_id"), F.col("off").alias("offset")))
    return out


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
