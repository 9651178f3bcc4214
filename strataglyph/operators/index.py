"""A positional index: a dictionary of terms, and their postings in blocks.

A block holds what one term has in one span of units (texts with an integer
id): its places, a number each of unit and position, as the differences of
their order. A frequent term has many blocks of bounded
size, never one list. Blocks lie sorted by term, in files that are ranges of
terms, with small pages, so a lookup reads the pages of its terms.

A phrase is sought from its rarest term on: the spans where that term occurs
are known before any other block is read, and only blocks of those spans are.
Blocks of one span meet and are intersected, rarest first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Units of a span, by their ids; positions in a unit are below PLACES; spans that are looked up by number at most; rows of a page.
SPAN, PLACES, FEW_SPANS, PAGE = 1024, 1 << 32, 2000, 64


def layout(page: int = PAGE, group: int = 8 << 20) -> dict[str, str]:
    """How files of blocks are written: pages of few rows, whose least and greatest terms a reader skips by, in row groups of so many bytes."""
    return {f"parquet.page.{name}": str(page) for name in ("row.count.limit", "size.row.check.min", "size.row.check.max")} | {"parquet.block.size": str(group)}


LAYOUT = layout()


def differences(c: Column) -> Column:
    """An ascending array as its first value and the steps from there."""
    return F.transform(c, lambda x, i: x - F.when(i == 0, F.lit(0)).otherwise(F.get(c, i - 1)))


def blocks(places: DataFrame, keys: Sequence[str], unit: str) -> DataFrame:
    """term, keys, span, size, n, places of rows (term, keys, unit, pos). keys: what units are told apart by besides (an edition, a rung)."""
    place = F.col(unit) % SPAN * PLACES + F.col("pos")  # one number a position, gathered where the text is read before it is moved
    told = places.groupBy("term", *keys, F.floor(F.col(unit) / SPAN).alias("span")).agg(F.array_sort(F.collect_list(place.cast("long"))).alias("l"))
    units = F.array_distinct(F.transform("l", lambda x: F.floor(x / PLACES)))
    return told.select("term", *keys, "span", F.size(units).alias("size"), F.size("l").alias("n"), differences(F.col("l")).alias("places"))


def _block_rows(texts: pa.ListArray, units: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, pa.ListArray]:
    """(terms, sizes, counts, places as differences) of the texts of one span, given as arrays of terms with their units in order."""
    flat, lengths = texts.flatten().dictionary_encode(), pc.list_value_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    codes, unit = flat.indices.to_numpy(), np.repeat(units, lengths)
    places = unit % SPAN * PLACES + np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    order = np.argsort(codes, kind="stable") if np.all(np.diff(units) > 0) else np.lexsort((places, codes))
    codes, unit, places = codes[order], unit[order], places[order]
    begins = np.diff(codes, prepend=-1) != 0
    ends = np.append(np.flatnonzero(begins), len(codes))
    steps = np.where(begins, places, np.diff(places, prepend=0))
    sizes = np.diff(np.append(0, np.cumsum(begins | (np.diff(unit, prepend=-1) != 0)))[ends])
    return flat.dictionary, sizes, np.diff(ends), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(steps, pa.int64()))


def blocks_of_texts(texts: DataFrame, keys: Sequence[str], unit: str, terms: dict[str, Column], label: str) -> DataFrame:
    """The blocks of rows (keys, unit, texts), of several columns: terms has the array of terms of each, by the name that it gets under label. A span's texts are moved once, as they are, and its blocks are made where they meet; a task holds one span."""
    kinds, named = dict(texts.dtypes), [*terms]
    dealt = texts.withColumn("_span", F.floor(F.col(unit) / SPAN)).repartition(*keys, "_span").sortWithinPartitions(*keys, "_span", unit)
    schema = ", ".join(["term string", f"{label} string", *[f"{k} {kinds[k]}" for k in keys], "span long, size int, n int, places array<bigint>"])

    def made(held: list[pa.RecordBatch], of: tuple) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        units = table[unit].to_numpy()
        for name in named:
            words, sizes, counts, places = _block_rows(pa.concat_arrays(table[name].chunks), units)
            if len(words):
                same = [pa.array([x] * len(words), table[k].type) for k, x in zip(keys, of, strict=False)]
                yield pa.RecordBatch.from_arrays([words, pa.array([name] * len(words)), *same, pa.array([of[-1]] * len(words), pa.int64()), pa.array(sizes, pa.int32()), pa.array(counts, pa.int32()), places], names=["term", label, *keys, "span", "size", "n", "places"])

    def by_span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None
        for batch in batches:
            of = list(zip(*(batch.column(batch.schema.get_field_index(k)).to_pylist() for k in (*keys, "_span")), strict=True))
            lo = 0
            for hi in [i for i in range(1, len(of)) if of[i] != of[i - 1]] + [len(of)]:
                if lo < hi:
                    if held and of[lo] != at:
                        yield from made(held, at)
                        held = []
                    held, at, lo = [*held, batch.slice(lo, hi - lo)], of[lo], hi
        if held:
            yield from made(held, at)

    return dealt.select(*keys, "_span", F.col(unit).cast("long").alias(unit), *[c.alias(name) for name, c in terms.items()]).mapInArrow(by_span, schema)


def dictionary(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """term, keys, units, positions and blocks: how much of each term there is."""
    return held.groupBy("term", *keys).agg(F.sum("size").alias("units"), F.sum("n").alias("positions"), F.count(F.lit(1)).alias("blocks"))


def laid_out(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks in ranges of terms; those of a frequent term are several ranges."""
    order = ["term", *keys, "span"]
    return held.repartitionByRange(*order).sortWithinPartitions(*order)


def _decoded(block: dict) -> dict[int, np.ndarray]:
    """Positions by unit of the span."""
    unit, pos = np.divmod(np.cumsum(np.asarray(block["places"], np.int64)), PLACES)
    units, begin = np.unique(unit, return_index=True)
    return dict(zip(units.tolist(), np.split(pos, begin[1:]), strict=True))


def _met(blocks_: list[dict], offsets: dict[str, list[int]]) -> list[tuple[int, int]]:
    """(unit, places) where all offsets of all terms meet, from the block with fewest units on."""
    found: dict[int, np.ndarray] | None = None
    for block in sorted(blocks_, key=lambda b: b["size"]):
        of = _decoded(block)
        for offset in offsets[block["term"]]:
            begins = {u: of[u] - offset for u in (of if found is None else found) if u in of}
            if found is not None:
                begins = {u: np.intersect1d(found[u], b, assume_unique=True) for u, b in begins.items()}
            found = {u: b for u, b in begins.items() if len(b)}
        if not found:
            return []
    return [(u, len(b)) for u, b in (found or {}).items()]


def phrase(held: DataFrame, words: DataFrame, wanted: Sequence[str], keys: Sequence[str], unit: str) -> DataFrame:
    """keys, unit and times: where the terms stand side by side, and how often. held: blocks; words: their dictionary. No terms match nothing, nor does one that is in no text."""
    kinds = dict(held.dtypes)
    columns = [*keys, unit, "times"]
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], f"{unit} long", "times int"])
    spark = held.sparkSession
    known = {r.term: r.n for r in words.filter(F.col("term").isin(*set(wanted))).groupBy("term").agg(F.sum("units").alias("n")).collect()} if wanted else {}  # a row a term of the phrase
    if not wanted or set(known) != set(wanted):
        return spark.createDataFrame([], schema)
    offsets = {w: [i for i, x in enumerate(wanted) if x == w] for w in wanted}
    rarest = min(known, key=lambda w: (known[w], w))
    own = held.filter(F.col("term") == rarest)
    of_terms = held.filter(F.col("term").isin(*known))
    if len(known) > 1:
        spans = own.select(*keys, "span").distinct()
        few = [r.span for r in spans.select("span").distinct().limit(FEW_SPANS + 1).collect()]
        # pages of other spans are not read where there are few
        of_terms = of_terms.filter(F.col("span").isin(few)) if len(few) <= FEW_SPANS else of_terms.join(spans, [*keys, "span"], "left_semi")
    met = of_terms.groupBy(*keys, "span").agg(F.collect_list(F.struct("term", "size", "places")).alias("b")).filter(F.size("b") == len(known))

    def intersect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in columns]
            for row in batch.to_pylist():
                for u, times in _met(row["b"], offsets):
                    for column, value in zip(out, (*(row[k] for k in keys), row["span"] * SPAN + u, times), strict=True):
                        column.append(value)
            types = [*(batch.schema.field(k).type for k in keys), pa.int64(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=columns)

    return met.mapInArrow(intersect, schema)
