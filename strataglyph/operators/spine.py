"""Stable ids, spans and offsets, without a window over a whole table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.shared import kept, small


def ranges(spark: SparkSession) -> int:
    """Ranges that keep all cores busy, no more than a shuffle has partitions."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(32, 4 * spark.sparkContext.defaultParallelism))


def inranges(rows: DataFrame, order: Sequence[str], make: Callable[[DataFrame], DataFrame] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """rows, written in order: ``_at`` grows from row to row of a range, ``_part`` from range to range. Ranges follow the rows, whatever kind of values the order has; nulls come first. make is applied to the rows where they were dealt, once (borders are sampled from what comes before it), and keeps their order. keep writes them and gives them back, where they are to lie in a place of the caller's."""
    # make's work is not that of the bytes that it is given, so ranges are not merged for being small
    dealt = (rows.repartitionByRange(ranges(rows.sparkSession), *order) if make else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    placed = (make(dealt) if make else dealt).withColumn("_at", F.monotonically_increasing_id())
    # borders are sampled, so ranges are read twice from one table and never dealt again
    return (keep(placed) if keep else kept(placed, "ranges")).withColumn("_part", F.shiftright("_at", 33))


def _summed(batches: Iterator[pa.RecordBatch], group: str | None, value: str) -> Iterator[pa.RecordBatch]:
    """Batches with ``_run``: the sum of value over the rows before, since the group began."""
    carried, last = 0, None
    for batch in batches:
        own = batch.column(batch.schema.get_field_index(value)).fill_null(0).to_numpy(zero_copy_only=False)
        so_far = np.cumsum(own, dtype=np.int64)
        earlier = so_far - own
        begins = np.zeros(len(own), bool)
        if group is not None and len(own):
            names = batch.column(batch.schema.get_field_index(group))
            codes = pa.concat_arrays([names.slice(0, 1) if last is None else last, names]).dictionary_encode("encode").indices.to_numpy()
            begins, last = codes[1:] != codes[:-1], names.slice(len(names) - 1)
        at = np.maximum.accumulate(np.where(begins, np.arange(len(own)), -1))
        run = np.where(at < 0, carried + earlier, earlier - earlier[at])
        if len(own):
            carried = int(run[-1] + own[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(run, pa.int64())], names=[*batch.schema.names, "_run"])


def with_sums(rows: DataFrame, group: str | None, value: Column) -> DataFrame:
    """rows of a range in order, with _value and _run (what the rows before it come to)."""
    valued = rows.withColumn("_value", value.cast("long"))
    return valued.mapInArrow(lambda batches: _summed(batches, group, "_value"), StructType([*valued.schema.fields, StructField("_run", LongType())]))


def ids(rows: DataFrame, order: Sequence[str], ident: str, make: Callable[[DataFrame], DataFrame] | None = None, before: tuple[str, Column | None] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``ident``, from 1 in order, which should have no ties. Only the ranges' counts meet in one place. make and keep: see in_ranges. before: a name and a value; the value's sum over all earlier rows is added under that name; without a value, make gives _value and _run itself."""
    name, value = before or ("_none", None)
    ranged = inranges(rows, order, make if value is None else lambda r: with_sums(make(r) if make else r, None, value), keep)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"), F.sum("_value" if before else F.lit(0)).alias("_sum"))
    placed = ranged.join(small(counts.select("_part", "_first", so_far("_n").alias("_before"), so_far("_sum").alias("_total"))), "_part")
    out = placed.withColumn(ident, (F.col("_before") + F.col("_at") - F.col("_first") + 1).cast("long"))
    out = out.withColumn(name, (F.col("_total") + F.col("_run")).cast("long")).drop("_value", "_run") if before else out
    return out.drop("_part", "_at", "_first", "_before", "_total")


def running(rows: DataFrame, group: str, order: str | Sequence[str], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of value (an integer) over the rows of the group that come before in an order without ties.

    Rows are dealt by ranges of group and order, which are summed where they
    are, while they are written; a window holds one row a range.
    """
    columns = [order] if isinstance(order, str) else [*order]
    ranged = inranges(rows, [group, *columns], lambda r: with_sums(r, group, value))
    sums = ranged.groupBy(group, "_part").agg(F.sum("_value").alias("_sum"))
    earlier = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col(group).alias("_g"), F.col("_part").alias("_p"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    joined = ranged.join(small(before), F.col(group).eqNullSafe(F.col("_g")) & (F.col("_part") == F.col("_p")))
    return joined.withColumn(name, (F.col("_before") + F.col("_run")).cast("long")).drop("_g", "_p", "_part", "_at", "_value", "_run", "_before")


def dense_ids(rows: DataFrame, group: str, order: Sequence[str], number: str, ident: str, make: Callable[[DataFrame], DataFrame] | None = None, before: tuple[str, Column | None] | None = None, keep: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Adds ``number``, from 1 within each group in order, and ``ident``, from 1 over groups in their order. make, before and keep: see ids."""
    placed = ids(rows, [group, *order], ident, make, before, keep)
    starts = placed.groupBy(F.col(group).alias("_g")).agg(F.min(ident).alias("_start"))
    return placed.join(small(starts), F.col(group).eqNullSafe(F.col("_g"))).withColumn(number, (F.col(ident) - F.col("_start") + 1).cast("int")).drop("_g", "_start")


def before_groups(rows: DataFrame, group: str) -> DataFrame:
    """One row a group: its count, and how many rows the groups before it have."""
    counts = rows.groupBy(group).agg(F.count(F.lit(1)).alias("_count"))
    earlier = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("_before", F.coalesce(F.sum("_count").over(earlier), F.lit(0)))


def spans(rows: DataFrame, group: str, prefix: str) -> DataFrame:
    """One row a group: its count, and the first and last ident of its members."""
    return before_groups(rows, group).select(group, F.col("_count").alias(f"{prefix}_count"), (F.col("_before") + 1).alias(f"{prefix}_start"), (F.col("_before") + F.col("_count")).alias(f"{prefix}_end"))


def child_spans(children: DataFrame, parent: str, ident: str, prefix: str) -> DataFrame:
    """First and last child of each parent."""
    return children.groupBy(parent).agg(F.min(ident).alias(f"{prefix}_start"), F.max(ident).alias(f"{prefix}_end"))


def offsets(texts: DataFrame, edition: str, order: str, length: Column | None = None) -> DataFrame:
    """Adds char_start and char_end in the text of an edition whose units are joined by single newlines, in order (a column). length: of a unit's text, by default of ``plain``."""
    length = F.length("plain") if length is None else length
    placed = running(texts.withColumn("_length", length), edition, order, F.col("_length") + 1, "_earlier")
    return placed.withColumn("char_start", F.col("_earlier")).withColumn("char_end", F.col("_earlier") + F.col("_length")).drop("_earlier", "_length")


#: White space in the Unicode sense, a character each.
_SPACE = "[\\t-\\r \\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


@F.arrow_udf(ArrayType(StructType([StructField("token", StringType()), StructField("start", LongType())])))
def spots(texts: pa.Array) -> pa.Array:
    """The runs of anything but white space of each text, with the code points before them; a batch at a time, null for a null."""
    cut = pc.split_pattern_regex(texts, _SPACE)
    flat, ends = cut.flatten(), np.cumsum(pc.list_value_length(cut).fill_null(0).to_numpy(zero_copy_only=False))
    begins = np.concatenate([[0], ends]).astype(np.int64)
    sizes = pc.utf8_length(flat).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.concatenate([[0], np.cumsum(sizes + 1)])
    start = before[:-1] - np.repeat(before[begins[:-1]], np.diff(begins))
    word = sizes > 0
    kept_ = np.concatenate([[0], np.cumsum(word)])[begins].astype(np.int32)
    found = pa.StructArray.from_arrays([flat.filter(pa.array(word)), pa.array(start[word], pa.int64())], names=["token", "start"])
    return pa.ListArray.from_arrays(pa.array(kept_), found, mask=cut.is_null())


def token_rows(texts: DataFrame, keys: Sequence[str], text: str = "plain") -> DataFrame:
    """One row a token: keys, position (from 1), token, start in code points, whatever the white space between tokens."""
    rows = texts.select(*keys, F.posexplode(spots(F.col(text))).alias("_k", "_x"))
    return rows.select(*keys, (F.col("_k") + 1).alias("position"), "_x.token", "_x.start")


def resolve(refs: DataFrame, surahs: DataFrame, ayahs: DataFrame, most: int | None = None) -> DataFrame:
    """Adds first_id and last_id to rows with structs ``start`` and ``end``; words and segments don't count. Unknown places give null."""
    s = lambda p: surahs.select(F.col("number").alias(f"_{p}s"), "ayah_start", "ayah_end").withColumnsRenamed({"ayah_start": f"_{p}f", "ayah_end": f"_{p}l"})
    a = lambda p: ayahs.select(F.col("surah").alias(f"_{p}as"), F.col("number").alias(f"_{p}an"), F.col("id").alias(f"_{p}id"))
    out = refs
    for p in ("start", "end"):
        out = out.join(small(s(p)), F.col(f"{p}.surah") == F.col(f"_{p}s"), "left")
        out = out.join(a(p), (F.col(f"{p}.surah") == F.col(f"_{p}as")) & (F.col(f"{p}.ayah") == F.col(f"_{p}an")), "left")
    first = F.when(F.col("start.ayah").isNull(), F.col("_startf")).otherwise(F.col("_startid"))
    last = F.when(F.col("end.ayah").isNull(), F.col("_endl")).otherwise(F.col("_endid"))
    if most is not None:
        last = F.least(last, first + most - 1)
    return out.select(*[F.col(c) for c in refs.columns], first.alias("first_id"), last.alias("last_id"))


#: Widths of the intervals that a range of ids is cut into; each divides the next.
WIDTHS = (1, 64, 4096, 262_144)


def intervals(ranges: DataFrame, first: str = "first_id", last: str = "last_id") -> DataFrame:
    """ranges with level and node: the fewest aligned intervals of WIDTHS that make each of them up, one a row. Ranges that are empty or have a null end have none."""
    out = ranges.withColumn("_f", F.col(first).cast("long")).withColumn("_e", F.col(last).cast("long") + 1)
    found = []
    steps = lambda f, e, w: F.when(f < e, F.sequence(F.floor(f / w), F.floor(e / w) - 1)).otherwise(F.array().cast("array<bigint>"))
    node = lambda level, nodes: F.transform(nodes, lambda n: F.struct(F.lit(level).alias("level"), n.alias("node")))
    for level, (width, wider) in enumerate(zip(WIDTHS, WIDTHS[1:], strict=False)):
        f, e = F.col("_f"), F.col("_e")
        out = out.withColumn("_up", F.ceil(f / wider) * wider).withColumn("_down", F.floor(e / wider) * wider)
        inner = F.col("_up") < F.col("_down")
        ends = F.concat(steps(f, F.when(inner, F.col("_up")).otherwise(e), width), F.when(inner, steps(F.col("_down"), e, width)).otherwise(F.array().cast("array<bigint>")))
        out = out.withColumn(f"_n{level}", node(level, ends))
        found.append(f"_n{level}")
        out = out.withColumn("_f", F.when(inner, F.col("_up"))).withColumn("_e", F.when(inner, F.col("_down")))
    top = len(WIDTHS) - 1
    last_ones = node(top, F.coalesce(steps(F.col("_f"), F.col("_e"), WIDTHS[-1]), F.array().cast("array<bigint>")))
    every = F.concat(*[F.coalesce(F.col(n), F.array().cast("array<struct<level:int,node:bigint>>")) for n in found], last_ones)
    return out.withColumn("_x", F.explode(every)).select(*[ranges[c] for c in ranges.columns], F.col("_x.level").alias("level"), F.col("_x.node").alias("node"))


def within(ranges: DataFrame, members: DataFrame, ident: str = "id", first: str = "first_id", last: str = "last_id") -> DataFrame:
    """ranges beside the members whose ident lies in them, each once: an equality join of the intervals, of which a range has about 126 a width at most and a member one a width."""
    keyed = members.withColumn("_x", F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.floor(F.col(ident) / w).alias("node")) for k, w in enumerate(WIDTHS)])))
    return intervals(ranges, first, last).join(keyed.select("*", "_x.level", "_x.node").drop("_x"), ["level", "node"]).drop("level", "node")
