"""Packing by minimum bin slack.

A window starts with the longest piece that is left; a subset-sum over the
lengths that are left, as a bitset, finds the multiset that fills it closest to
its capacity, and is traced back to a count of each length. Lengths are at most
``capacity``, so the counts of all pieces by length are a table of at most that
many rows, whatever the corpus: windows are planned from it alone, and a
multiset is used as often as the counts allow before the next one is sought, so
a plan has few thousand rows at any size. Pieces are numbered within their
length by the tasks that cut them and one prefix sum over tasks; the plan maps
a number to its sequence and place by arithmetic.

Where no multiset fills a window, the longest piece left is cut to fill it, and
its rest goes back among the lengths. What is left at the very end is dealt to
sequences of powers of two.
"""

from __future__ import annotations

import bisect
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import turn_to
from .tokens import byte_encoder, vocabulary
from .workspace import Workspace, table

CAPACITY, END_ID, VOCABULARY = 2048, 1, "byte_bpe_50k.json"
#: Bytes of ids in a record batch, about; parts of cut pieces that are broadcast at most.
BATCH_BYTES, FEW_PARTS = 8 << 20, 100_000
#: Numbers of pieces of a kind are below it.
NUMBERS = 44

_PIECES = "key long, part int, nth long, doc_id long, start long, length int, ids_crc32 long, doc_tokens long, ids binary"
_PARTS = "key long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, begin int"


def closest(lengths: list[tuple[int, int, int]], target: int) -> tuple[int, dict[int, int]]:
    """The largest sum up to target of the multiset (kind, length, count), and how many of each kind make it. Kinds that come first are preferred."""
    reach, layers, within = 1, [], (1 << (target + 1)) - 1
    for kind, length, count in lengths:
        left, some = min(count, target // length), 1
        while left and not reach >> target:
            some = min(some, left)
            layers.append((kind, length, some, reach))
            reach |= (reach << (length * some)) & within
            left, some = left - some, some * 2
        if reach >> target:
            break
    best = at = reach.bit_length() - 1
    taken: dict[int, int] = {}
    for kind, length, some, before in reversed(layers):
        if not before >> at & 1:
            taken[kind] = taken.get(kind, 0) + some
            at -= length * some
    return best, taken


@dataclass
class Plan:
    """Where pieces go. A kind is a length (its own number) or the rests of cut pieces (numbers beyond capacity).

    A row: pieces of a kind numbered from first on go ``each`` to a sequence,
    from sequence base on, side by side from off on; the first ``take`` tokens
    of each, and what is left of a cut one is of kind rest.
    """

    capacity: int
    rows: list[tuple[int, int, int, int, int, int, int]] = field(default_factory=list)
    sequences: int = 0
    cut: int = 0

    @staticmethod
    def of(counts: dict[int, int], capacity: int) -> Plan:
        """counts: of pieces by length, from 1 to capacity."""
        plan = Plan(capacity)
        length, left, used = {n: n for n in counts}, dict(counts), dict.fromkeys(counts, 0)
        order = sorted((-n, n) for n in counts)  # longest first

        def put(kind: int, each: int, times: int, off: int, take: int) -> None:
            rest = -1
            if take < length[kind]:
                rest = max(capacity, max(length)) + 1
                length[rest], left[rest], used[rest] = length[kind] - take, times, 0
                bisect.insort(order, (take - length[kind], rest))
                plan.cut += times
            plan.rows.append((kind, used[kind], each, plan.sequences, off, take, rest))
            used[kind] += each * times
            left[kind] -= each * times

        while order:
            first = order[0][1]
            target = capacity - length[first]
            left[first] -= 1
            fit = [(k, length[k], left[k]) for _, k in order[bisect.bisect_left(order, (-target, -1)) :] if left[k]] if target else []
            best, need = closest(fit, target) if fit else (0, {})
            left[first] += 1
            need[first] = need.get(first, 0) + 1
            slack = target - best
            filler = next((k for _, k in order if left[k] > need.get(k, 0)), None) if slack else None
            if slack and filler is None:  # nothing else is left
                plan._last(need, length, left, put)
                break
            wanted = need | ({filler: need.get(filler, 0) + 1} if slack else {})
            times = min(left[k] // n for k, n in wanted.items())
            off = 0
            for kind in sorted(need, key=lambda k: (-length[k], k)):
                put(kind, need[kind], times, off, length[kind])
                off += need[kind] * length[kind]
            if slack:
                put(filler, 1, times, off, slack)
            plan.sequences += times
            order = [o for o in order if left[o[1]]]
        return plan

    def _last(self, need: dict[int, int], length: dict[int, int], left: dict[int, int], put) -> None:  # noqa: ANN001
        """One window's pieces, in sequences of powers of two."""
        todo = [k for k in sorted(need, key=lambda k: (-length[k], k)) for _ in range(need[k])]
        rest = sum(length[k] for k in todo)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            off = 0
            while off < size:
                kind = todo.pop(0)
                take = min(length[kind], size - off)
                put(kind, 1, 1, off, take)
                if take < length[kind]:
                    todo.insert(0, max(length))
                off += take
            self.sequences += 1
            rest -= size

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(kind and first number as one key, rows), sorted."""
        rows = np.array(sorted(self.rows), np.int64).reshape(-1, 7)
        return (rows[:, 0] << NUMBERS) + rows[:, 1], rows


def pieces(docs: DataFrame, capacity: int, vocabulary_path: str, end_id: int) -> DataFrame:
    """Every row's ids cut at multiples of capacity: key, the task that cut it, its number among the task's pieces of that length, doc_id, start, length, ids_crc32, doc_tokens, ids (of 2 bytes; null at full length, which is never cut again)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to("tokens")
        encode, end, step = byte_encoder(vocabulary_path), end_id.to_bytes(2, "little"), 2 * capacity
        part, made, seen = TaskContext.get().partitionId(), 0, [0] * (capacity + 1)
        names, kinds = zip(*(x.split() for x in _PIECES.split(", ")), strict=True)
        types = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]
        out: list[list] = [[] for _ in names]
        held = 0

        def flushed() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=list(names))
            for c in out:
                c.clear()
            return batch

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                key, ids = doc_id.as_py(), encode(text.as_py()) + end
                for k in range(0, len(ids), step):
                    own = ids[k : k + step]
                    n = len(own) // 2
                    row = (part << 40 | made, part, seen[n], key, k // 2, n, _crc(own), len(ids) // 2, None if n == capacity else own)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
                    made, seen[n], held = made + 1, seen[n] + 1, held + len(own)
                    if held > BATCH_BYTES:
                        yield flushed()
                        held = 0
        yield flushed()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, _PIECES)


def _crc(ids: bytes) -> int:
    """Of ids of 2 bytes, as ids of 4."""
    return zlib.crc32(np.frombuffer(ids, "<u2").astype("<u4").tobytes())


def pack(docs: DataFrame, capacity: int = CAPACITY, vocabulary_path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id and offset of every piece of every row; no rows for an empty table.

    A null or empty text is the end id alone. Repeated rows are packed as often
    as they come, and a null doc_id stays null. A longer text than capacity is
    cut at its multiples first. Every sequence has capacity tokens, but for
    the last few, whose lengths are powers of two: what is left over is
    written to as many as its binary digits. Other columns play no part.
    """
    spark = docs.sparkSession
    space = Workspace(spark, "slack")
    held = space.save(pieces(docs, capacity, vocabulary_path or vocabulary(VOCABULARY), end_id), "pieces")
    # a row for each length of each task
    by_task = space.save(held.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "by_task")
    plan = Plan.of({r.length: r.n for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, capacity)
    keys, rows = plan.arrays()
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    numbered = held.drop("ids").join(before, ["length", "part"]).select("key", "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("nth")).alias("number"))
    told = spark.sparkContext.broadcast((keys, rows))  # bounded by capacity

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        keys, rows = told.value
        names = [x.split()[0] for x in _PARTS.split(", ")]
        for batch in batches:
            of = {n: batch.column(n) for n in batch.schema.names}
            at = np.arange(len(batch))
            kind, number = (of[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "number"))
            begin = np.zeros(len(batch), np.int64)
            while len(at):
                row = rows[np.searchsorted(keys, (kind << NUMBERS) + number, "right") - 1]
                k = number - row[:, 1]
                take, rest = row[:, 5], row[:, 6]
                whole = (begin == 0) & (rest < 0)
                own = {n: of[n].take(pa.array(at)) for n in ("key", "doc_id", "start", "ids_crc32", "doc_tokens")}
                start = own["start"].to_numpy(zero_copy_only=False) + begin
                crc = pa.array(own["ids_crc32"].to_numpy(zero_copy_only=False), mask=~whole)
                columns = [own["key"], own["doc_id"], pa.array(start), pa.array(take), crc, own["doc_tokens"], pa.array(row[:, 3] + k // row[:, 2]), pa.array(row[:, 4] + k % row[:, 2] * take), pa.array(begin.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=names)
                more = rest >= 0
                at, begin, kind, number = at[more], (begin + take)[more], rest[more], k[more]

    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    parts = numbered.mapInArrow(place, _PARTS)
    if not plan.cut:
        return parts.select(*columns)
    parts = space.save(parts, "parts")
    lacking = parts.filter("ids_crc32 IS NULL").drop("ids_crc32")
    cut_lengths = sorted({r[0] for r in plan.rows if r[6] >= 0 and r[0] <= capacity})
    ids = held.filter(F.col("length").isin(cut_lengths)).select("key", "ids")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn_to(None)
        for batch in batches:
            crc = [_crc(i.as_py()[2 * b : 2 * (b + n)]) for i, b, n in zip(batch.column("ids"), batch.column("begin").to_pylist(), batch.column("length").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(crc, pa.int64()) if c == "ids_crc32" else batch.column(c) for c in columns], names=columns)

    # every cut makes at most two parts
    few = F.broadcast(lacking) if 2 * plan.cut <= FEW_PARTS else lacking
    digested = few.join(ids, "key").mapInArrow(digest, ", ".join(f"{c} long" for c in columns))
    return parts.filter("ids_crc32 IS NOT NULL").select(*columns).unionByName(digested)


def op11_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
