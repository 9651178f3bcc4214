"""Files read in splits, with numbers as if they were read from the beginning.

Spark's text source cuts a file into byte ranges, each read by a task of its
own. What depends on all that comes before (a line's number, an array element's
place, whether a brace stands inside a string) is counted split by split where
the rows are; only one row a split is summed over a file. Digests are taken by
chunks of records and meet in a tree, so a changed byte is told with its chunk,
and no row ever holds a whole file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import kept, small

#: Records of a chunk that has a digest, and digests of a node of the tree.
CHUNK, FAN = 4096, 1024
LINES, OBJECTS = "\n", "}"


def separator(path: str) -> str:
    """JSON may have no line feed at all, so it is cut behind closing braces."""
    return OBJECTS if path.endswith(".json") else LINES


def records(spark: SparkSession, paths: str | list[str], sep: str = LINES) -> DataFrame:
    """file, block (where its split begins), at (a number that grows within a split) and value of every record; sep is not part of it."""
    return spark.read.option("lineSep", sep).option("recursiveFileLookup", "true").text(paths).select(F.input_file_name().alias("file"), F.input_file_block_start().alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def numbered(rows: DataFrame, as_one: bool = False) -> DataFrame:
    """Adds line to records: its number in the file from 0, or, as_one, in all files of a folder in the order of their names, which then are one file, called like the folder.

    One scan counts, another numbers; splits of one DataFrame are the same in
    both, and a split that was not counted fails.
    """
    counts = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("at").alias("first"))
    earlier = (Window.orderBy("file", "block") if as_one else Window.partitionBy("file").orderBy("block")).rowsBetween(Window.unboundedPreceding, -1)
    before = kept(counts.select("file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "splits")
    line = F.coalesce(F.col("before"), F.raise_error(F.lit("a split that was not counted")).cast("long")) + F.col("at") - F.col("first")
    out = rows.join(small(before), ["file", "block"], "left").withColumn("line", line).drop("at", "first", "before")
    return out.withColumn("file", F.regexp_replace("file", "/[^/]*$", "")) if as_one else out


def _before(sums: DataFrame, value: str, name: str) -> DataFrame:
    """file, block and name: the sum of value over the file's splits before."""
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return small(sums.select("file", "block", F.coalesce(F.sum(value).over(earlier), F.lit(0)).alias(name)))


def lines(spark: SparkSession, paths: str | list[str], as_one: bool = False) -> DataFrame:
    """file, line (from 0) and value; a carriage return before the line feed goes."""
    return numbered(records(spark, paths), as_one).select("file", "line", F.regexp_replace("value", "\r$", "").alias("value"))


def elements(spark: SparkSession, paths: str | list[str], key: str) -> DataFrame:
    """file, pos (from 0) and json of every object in the array that is the file's only member, ``{"key": [{...}, ...]}``; the objects hold no others.

    A record ends at a closing brace. It ends an object if the quotes before it
    are even; braces inside strings are put back between the records they cut.
    """
    rows = numbered(records(spark, paths, OBJECTS))
    quotes = F.length(F.regexp_replace(F.regexp_replace("value", r"(?s)\\.", ""), '[^"]', "")) % 2
    rows = rows.withColumn("odd", quotes.cast("int"))
    inside = Window.partitionBy("file", "block").orderBy("line").rowsBetween(Window.unboundedPreceding, -1)
    entered = _before(rows.groupBy("file", "block").agg(F.sum("odd").alias("n")), "n", "entered")

    def told(of: DataFrame) -> DataFrame:
        """With the quotes of the file before each record, and whether it ends an object."""
        counted = of.join(entered, ["file", "block"]).withColumn("odd_before", F.col("entered") + F.coalesce(F.sum("odd").over(inside), F.lit(0)))
        return counted.withColumn("ends", ((F.col("odd_before") + F.col("odd")) % 2 == 0).cast("int"))

    # first over the counts alone, so that texts are moved once
    ended = _before(told(rows.select("file", "block", "line", "odd")).groupBy("file", "block").agg(F.sum("ends").alias("n")), "n", "ended")
    placed = told(rows).join(ended, ["file", "block"]).withColumn("pos", F.col("ended") + F.coalesce(F.sum("ends").over(inside), F.lit(0)))
    alone = (F.col("ends") == 1) & (F.col("odd_before") % 2 == 0)
    whole = placed.filter(alone).select("file", "pos", "value")
    pieces = placed.filter(~alone).groupBy("file", "pos").agg(F.array_sort(F.collect_list(F.struct("line", "value"))).alias("p"))  # the records of one object
    text = whole.unionByName(pieces.select("file", "pos", F.array_join(F.transform("p", lambda x: x["value"]), OBJECTS).alias("value")))
    opened = F.regexp_replace("value", rf'^\s*(\{{\s*"{key}"\s*:\s*\[|,)?\s*', "")
    return text.select("file", "pos", F.concat(opened, F.lit(OBJECTS)).alias("json")).filter(F.col("json").startswith("{"))


def chunks(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """file, chunk, records and digest: SHA-256 over the digests of size records in order. rows: numbered."""
    each = rows.select("file", "line", F.sha2(F.col("value").cast("binary"), 256).alias("d"))
    grouped = each.groupBy("file", F.floor(F.col("line") / size).alias("chunk")).agg(F.array_sort(F.collect_list(F.struct("line", "d"))).alias("l"))
    return grouped.select("file", "chunk", F.size("l").cast("long").alias("records"), _node(F.col("l")).alias("digest"))


def _node(ordered: Column) -> Column:
    return F.sha2(F.array_join(F.transform(ordered, lambda x: x["d"]), "").cast("binary"), 256)


def roots(leaves: DataFrame, sizes: DataFrame | None = None, fan: int = FAN) -> DataFrame:
    """file and root of chunks, level by level; sizes (file, bytes) takes the file's length in, which tells a last separator."""
    level = leaves.select("file", F.col("chunk").alias("k"), F.col("digest").alias("d"))
    most = leaves.agg(F.max("chunk").alias("m")).first().m or 0
    while True:
        grouped = level.groupBy("file", F.floor(F.col("k") / fan).alias("k")).agg(F.array_sort(F.collect_list(F.struct("k", "d"))).alias("l"))
        level = grouped.select("file", "k", _node(F.col("l")).alias("d"))
        most //= fan
        if not most:
            break
    if sizes is None:
        return level.select("file", F.col("d").alias("root"))
    return level.join(sizes, "file").select("file", F.sha2(F.concat_ws(":", F.col("bytes").cast("string"), "d").cast("binary"), 256).alias("root"))


def changed(found: DataFrame, locked: DataFrame) -> DataFrame:
    """file, chunk and problem (changed, missing, added) of chunks that are not as they were locked."""
    a, b = found.select("file", "chunk", F.col("digest").alias("_found")), locked.select("file", "chunk", F.col("digest").alias("_locked"))
    problem = F.when(F.col("_found").isNull(), "missing").when(F.col("_locked").isNull(), "added").when(F.col("_found") != F.col("_locked"), "changed")
    return a.join(b, ["file", "chunk"], "full_outer").select("file", "chunk", problem.alias("problem")).filter("problem is not null")
