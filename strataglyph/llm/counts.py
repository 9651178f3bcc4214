"""Token counts of the documents in flat, unindexed token files.

A flat file holds nothing but token ids of a fixed width, each document ended
by a separator id. The scan cuts files into blocks, searches each block for
separators with one vectorised comparison, and joins what the cuts separated by
a prefix scan over the blocks' summaries: how many documents ended before a
block, and where the last one did.

Files are written and read by Spark's own readers and writers alone, so they
may lie in any store that Spark reaches. Spark reads such a file whole before it
is cut; the writer therefore rolls to the next file before it has FILE_BYTES,
unless one document alone is longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .memory import turn_to
from .tokens import encoder, vocabulary
from .workspace import Workspace, table

VOCABULARY, SEPARATOR, WIDTH = "word_bpe_49k.json", 49407, 2
BLOCK = 1 << 17
FILE_BYTES = 1 << 24
#: Tokens at a document's head that name it, each below 2^15 and so never a separator of this vocabulary: whether there is an id, and the id's 64 bits.
HEAD = 5


def _head(doc_id: int | None) -> np.ndarray:
    bits = 0 if doc_id is None else (1 << 64) | (doc_id & (1 << 64) - 1)
    return np.array([bits >> 15 * k & 0x7FFF for k in range(HEAD)])


def write_flat(docs: DataFrame, path: str, vocabulary_path: str | None = None, separator: int = SEPARATOR, width: int = WIDTH) -> None:
    """Writes every row's head, token ids and separator.

    Null and empty texts have no ids between the two. Repeated rows are written
    again. A text of any length is written whole. An empty table gives a folder
    without documents. Other columns play no part, whatever their names.
    """
    name = vocabulary_path or vocabulary(VOCABULARY)
    mark = separator.to_bytes(width, "little")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row a file: documents with separators between them."""
        turn_to("tokens")
        encode, kind = encoder(name, width, False), np.dtype(f"<u{width}")
        held: list[bytes] = []
        size = 0
        for batch in batches:
            for i, t in zip(*batch.columns, strict=True):
                ids = _head(i.as_py()).astype(kind).tobytes() + encode(t.as_py())
                if held and size + len(ids) + width > FILE_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([mark.join(held)], pa.binary())], names=["ids"])
                    held, size = [], 0
                held.append(ids)
                size += len(ids) + width
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([mark.join(held)], pa.binary())], names=["ids"])

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(each, "ids binary")
    # Spark's text writer puts the bytes down as they are, and the separator's bytes behind each row
    ids.select(F.col("ids").cast("string").alias("value")).write.option("encoding", "ISO-8859-1").option("lineSep", mark.decode("latin-1")).option("maxRecordsPerFile", 1).mode("overwrite").text(path)


def scan(spark: SparkSession, path: str, separator: int = SEPARATOR, width: int = WIDTH, block: int = BLOCK, head: int = HEAD) -> DataFrame:
    """One row a document: file, ordinal in it (from 0), first token's place, n_tokens, and its first ``head`` tokens apart (not counted).

    A last document without a separator is one all the same. An empty file has
    no documents; two separators in a row hold an empty one.
    """
    step = block * width
    ahead = head * width  # so that heads are read where they begin
    files = spark.read.format("binaryFile").load(path).filter(F.col("length") > 0)
    cut = files.select(
        F.col("path").alias("file"), F.floor(F.col("length") / width).alias("size"),
        F.posexplode(F.expr(f"transform(sequence(0L, (length - 1) div {step}), i -> substring(content, cast(i * {step} + 1 as int), {step + ahead}))")).alias("block", "data"),
    )
    kind = f"<u{width}"
    schema = pa.schema([("file", pa.string()), ("block", pa.int32()), ("ends", pa.list_(pa.int64())), ("heads", pa.list_(pa.list_(pa.int64()))), ("opening", pa.list_(pa.int64()))])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[list] = [[] for _ in schema]
            for file, size, number, data in zip(*batch.columns, strict=True):
                ids = np.frombuffer(data.as_py(), kind, count=len(data.as_py()) // width)
                own = ids[:block]
                base, total = number.as_py() * block, size.as_py()
                ends = np.flatnonzero(own == separator)
                if base + len(own) == total and total and own[-1] != separator:
                    ends = np.append(ends, len(own))  # the file ends without one
                heads = [ids[e + 1 : e + 1 + head].astype(np.int64) for e in ends]
                opening = ids[:head].astype(np.int64) if number.as_py() == 0 else None
                for column, v in zip(rows, (file.as_py(), number.as_py(), ends + base, heads, opening), strict=True):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    found = cut.mapInArrow(search, "file string, block int, ends array<long>, heads array<array<long>>, opening array<long>")
    # the prefix scan: one summary a block
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    last = F.when(F.size("ends") > 0, F.struct(F.element_at("ends", -1).alias("end"), F.element_at("heads", -1).alias("head")))
    first = F.when(F.col("block") == 0, F.struct(F.lit(-1).cast("long").alias("end"), F.col("opening").alias("head")))
    carried = found.withColumn("count", F.coalesce(F.sum(F.size("ends")).over(before), F.lit(0))).withColumn("carry", F.coalesce(F.last(last, ignorenulls=True).over(before), F.first(first, ignorenulls=True).over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0))))
    each = carried.select("file", "count", "carry", "ends", "heads", F.posexplode("ends").alias("i", "end"))
    begin = F.when(F.col("i") == 0, F.col("carry.end")).otherwise(F.get("ends", F.col("i") - 1))
    named = F.when(F.col("i") == 0, F.col("carry.head")).otherwise(F.get("heads", F.col("i") - 1))
    return each.select("file", (F.col("count") + F.col("i")).alias("ordinal"), (begin + 1).alias("start"), (F.col("end") - begin - 1 - head).alias("n_tokens"), named.alias("head"))


def named(counted: DataFrame) -> DataFrame:
    """doc_id from the head that write_flat put before each document."""
    bits = [F.col("head")[k] for k in range(HEAD)]
    value = bits[0].bitwiseOR(F.shiftleft(bits[1], 15)).bitwiseOR(F.shiftleft(bits[2], 30)).bitwiseOR(F.shiftleft(bits[3], 45)).bitwiseOR(F.shiftleft(bits[4], 60))
    there = F.shiftright(bits[4], 4).bitwiseAND(1) == 1
    return counted.select(F.when(there, value).alias("doc_id"), "n_tokens", F.regexp_extract("file", "[^/]*$", 0).alias("file"), "ordinal", "start")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's count of tokens, by way of flat files of the whole table."""
    path = Workspace(spark, "tokens").path("flat")
    write_flat(table(spark, sf_dir, "documents"), path)
    return named(scan(spark, path))
