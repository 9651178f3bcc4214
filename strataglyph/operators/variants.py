"""Word-level differences of editions, and the apparatus made from them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.ladder import letters_skeleton
from ..sources.shared import kept
from . import matching
from .spine import ids

_KEY = ("ayah_id", "edition_id")
#: Rounds that one job plans; what is still open then is written and read again.
ROUNDS = 3
#: Positions in a unit are below it. Of units with so many pairs of tokens at most, tokens are looked up within the row.
_PLACES, IN_ROW = 1 << 20, 1 << 20


def _with(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is worked out once."""
    return F.get(F.transform(F.array(value), use), 0)


def _once(df: DataFrame) -> DataFrame:
    """df, of which each row is worked out once: what is asked of the columns (a filter, an explode) is not asked of what they are made from, which would be worked out again for it."""
    return df.select(F.explode_outer(F.array(F.struct(*df.columns))).alias("_x")).select("_x.*")


def _exploded(df: DataFrame, array: Column, *along: str) -> DataFrame:
    """The fields of the structs of an array, a row each, beside along; no row for an empty one. An explode that isn't outer has the array's size worked out beforehand, and all that it is made from with it."""
    return df.select(*along, F.explode_outer(array).alias("_x")).filter("_x is not null").select(*along, "_x.*")


def blocks(pairs: DataFrame) -> DataFrame:
    """ayah_id, edition_id, i, j, n: the blocks of equal tokens of arrays a and b that recursive longest-match alignment finds.

    The longest common block of a stretch comes first (of equal ones the first
    in a, and of those the first in b), then what lies left of it in both and
    what lies right, until nothing is common. All stretches of all units take
    a step together: places where a and b have one token are runs on a
    diagonal, and the longest run of each stretch splits it. A unit is a verse
    or another text of bounded length; its repeated tokens meet pairwise.
    """
    places = lambda side, at: pairs.select(*_KEY, F.posexplode(side).alias(at, "token"))
    met = places("a", "i").join(places("b", "j"), [*_KEY, "token"]).select(*_KEY, "i", "j")
    open_ = met.withColumn("lo_i", F.lit(0)).withColumn("lo_j", F.lit(0))
    found: list[DataFrame] = []
    while True:
        at = open_.repartition(*_KEY)  # every window of the rounds keeps this partitioning
        done = None
        for _ in range(ROUNDS):
            best = _best_runs(at)
            split = best.filter("i = bi and j = bj").select(*_KEY, "i", "j", F.col("bn").alias("n"))
            done = split if done is None else done.unionByName(split)
            left, right = (F.col("i") < F.col("bi")) & (F.col("j") < F.col("bj")), (F.col("i") >= F.col("bi") + F.col("bn")) & (F.col("j") >= F.col("bj") + F.col("bn"))
            lo = lambda c: F.when(left, F.col(f"lo_{c}")).otherwise(F.col(f"b{c}") + F.col("bn")).alias(f"lo_{c}")  # noqa: B023, E731
            at = best.filter(left | right).select(*_KEY, "i", "j", lo("i"), lo("j"))
        # blocks and what is left of one evaluation, told apart by a null n
        none = F.lit(None).cast("int")
        both = kept(done.select(*_KEY, "i", "j", F.col("n").cast("int").alias("n"), none.alias("lo_i"), none.alias("lo_j")).unionByName(at.select(*_KEY, "i", "j", none.alias("n"), F.col("lo_i").cast("int").alias("lo_i"), F.col("lo_j").cast("int").alias("lo_j"))), "blocks")
        found.append(both.filter("n is not null").select(*_KEY, "i", "j", "n"))
        open_ = both.filter("n is null").select(*_KEY, "i", "j", "lo_i", "lo_j")
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _best_runs(at: DataFrame) -> DataFrame:
    """Places (i, j) of stretches (lo_i, lo_j) with the stretch's longest run: bi, bj and bn."""
    stretch = (*_KEY, "lo_i", "lo_j")
    diagonal = at.withColumn("d", F.col("i") - F.col("j"))
    run = diagonal.withColumn("run", F.col("i") - F.row_number().over(Window.partitionBy(*stretch, "d").orderBy("i")))
    of_run = Window.partitionBy(*stretch, "d", "run")
    sized = run.withColumn("n", F.count(F.lit(1)).over(of_run)).withColumn("from_", F.min("i").over(of_run))
    # one number that grows with the length and falls with the places
    rank = (F.col("n") * _PLACES + (_PLACES - 1 - F.col("from_"))) * _PLACES + (_PLACES - 1 - (F.col("from_") - F.col("d")))
    best = sized.withColumn("best", F.max(rank).over(Window.partitionBy(*stretch)))
    back = lambda c: (_PLACES - 1 - c % _PLACES).cast("int")
    first = F.floor(F.col("best") / _PLACES)
    return best.select(*stretch, "i", "j", back(first).alias("bi"), back(F.col("best")).alias("bj"), F.floor(first / _PLACES).cast("int").alias("bn"))


_BLOCKS = "array<struct<i:int,j:int,n:int>>"


def _chain(a: Column, b: Column) -> Column:
    """The blocks of arrays without repeated tokens whose common ones have the same order in both, as an array; null for any others.

    No block can then cut another off, so alignment finds them all, and they
    are the runs of common tokens.
    """
    small_enough = F.size(a).cast("long") * F.size(b) <= IN_ROW
    once = (F.size(F.array_distinct(a)) == F.size(a)) & (F.size(F.array_distinct(b)) == F.size(b))
    at = F.filter(F.transform(a, lambda x, i: F.struct(i.alias("i"), (F.array_position(b, x) - 1).cast("int").alias("j"))), lambda p: p["j"] >= 0)
    ordered = lambda x: F.array_sort(F.transform(x, lambda p: p["j"])) == F.transform(x, lambda p: p["j"])
    follows = lambda x, p, k: (k > 0) & (F.get(x, k - 1)["i"] == p["i"] - 1) & (F.get(x, k - 1)["j"] == p["j"] - 1)
    begins = lambda x: F.filter(F.transform(x, lambda p, k: F.struct(p["i"].alias("i"), p["j"].alias("j"), k.alias("k"), follows(x, p, k).alias("f"))), lambda p: ~p["f"])
    sized = lambda x, of: F.transform(x, lambda p, q: F.struct(p["i"].alias("i"), p["j"].alias("j"), (F.coalesce(F.get(x, q + 1)["k"], F.size(of)) - p["k"]).alias("n")))
    runs = lambda x: _with(begins(x), lambda y: F.when(ordered(x), sized(y, x)))
    return F.when(small_enough & once, _with(at, runs)).cast(_BLOCKS)


def _codes(found: Column, a: Column, b: Column) -> Column:
    """block, op, i1, i2, j1, j2 from blocks in order, as an array: what lies between blocks (replace, delete or insert), and the blocks (equal)."""
    end = F.struct(F.size(a).alias("i"), F.size(b).alias("j"), F.lit(0).alias("n"))
    code = lambda block, op, i1, i2, j1, j2: F.struct(block.cast("int").alias("block"), op.alias("op"), i1.alias("i1"), i2.alias("i2"), j1.alias("j1"), j2.alias("j2"))

    def around(every: Column, x: Column, k: Column) -> Column:
        last = F.get(every, k - 1)
        i, j = F.coalesce(last["i"] + last["n"], F.lit(0)), F.coalesce(last["j"] + last["n"], F.lit(0))
        gone, new = i < x["i"], j < x["j"]
        op = F.when(gone & new, "replace").when(gone, "delete").when(new, "insert")
        return F.array(code(2 * k, op, i, x["i"], j, x["j"]), code(2 * k + 1, F.when(x["n"] > 0, "equal"), x["i"], x["i"] + x["n"], x["j"], x["j"] + x["n"]))

    every = F.concat(found, F.array(end).cast(_BLOCKS))
    return F.filter(F.flatten(_with(every, lambda e: F.transform(e, lambda x, k: around(e, x, k)))), lambda c: c["op"].isNotNull())


def aligned(pairs: DataFrame) -> DataFrame:
    """pairs (with arrays a and b) and codes: how a becomes b, block by block. Units that are chains are done where they are; the others take rounds."""
    told = _once(pairs.withColumn("blocks", _chain(F.col("a"), F.col("b"))))
    chains = told.filter("blocks is not null")
    others = kept(told.filter("blocks is null").drop("blocks"), "units")
    if others.isEmpty():
        whole = chains
    else:
        found = blocks(others.select(*_KEY, "a", "b")).groupBy(*_KEY).agg(F.array_sort(F.collect_list(F.struct("i", "j", "n"))).cast(_BLOCKS).alias("blocks"))
        whole = chains.unionByName(others.join(found, [*_KEY], "left").withColumn("blocks", F.coalesce("blocks", F.array().cast(_BLOCKS))))
    return whole.withColumn("codes", _codes(F.col("blocks"), F.col("a"), F.col("b"))).drop("blocks")


def opcodes(pairs: DataFrame) -> DataFrame:
    """ayah_id, edition_id, block, op, i1, i2, j1, j2 of arrays a and b."""
    return _exploded(aligned(pairs.select(*_KEY, "a", "b")), F.col("codes"), *_KEY)


def _realigned(changed: DataFrame) -> DataFrame:
    """Rows of units whose rasm differs."""
    # a token without any rasm can't be aligned; the others keep their places
    zipped = lambda side: F.arrays_zip(F.col(f"{side}_plain").alias("p"), F.col(f"{side}_rasm").alias("r"))
    spelled = lambda side: F.filter(F.transform(zipped(side), lambda x, k: F.struct(x["p"].alias("p"), x["r"].alias("r"), k.alias("at"))), lambda x: x["r"] != "")
    units = _once(changed.select(*[F.col(c).cast("long").alias(c) for c in _KEY], F.size("ref_plain").alias("size"), spelled("ref").alias("ref"), spelled("var").alias("var")))
    codes = _exploded(aligned(units.withColumn("a", F.col("ref.r")).withColumn("b", F.col("var.r"))), F.col("codes"), *_KEY, "size", "ref", "var")
    cut = lambda side, k: F.slice(side, F.col(f"{k}1") + 1, F.col(f"{k}2") - F.col(f"{k}1"))
    text = lambda cut_, c: F.array_join(F.transform(cut_, lambda x: x[c]), " ")
    a, b = cut("ref", "i"), cut("var", "j")
    place = F.coalesce(F.get("ref", F.col("i1"))["at"], F.col("size")) + 1
    archi = (letters_skeleton(text(a, "r")) == letters_skeleton(text(b, "r"))).cast("int")
    number = lambda n: F.lit(n).cast("int")
    row = lambda k, op, at, x, y, rasm, archi_: F.struct(k.cast("int").alias("k"), op.alias("op"), at.cast("int").alias("ref_position"), x.alias("ref_text"), y.alias("var_text"), rasm.alias("same_rasm"), archi_.alias("same_archi"))
    whole = F.array(row(F.lit(0), F.col("op"), place, text(a, "p"), text(b, "p"), number(0), archi))
    beside = F.filter(F.transform(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x, k: F.struct(k.alias("k"), x["a"].alias("a"), x["b"].alias("b"))), lambda x: x["a"]["p"] != x["b"]["p"])
    tokens = F.transform(beside, lambda x: row(x["k"], F.lit("replace"), x["a"]["at"] + 1, x["a"]["p"], x["b"]["p"], number(1), number(1)))
    return _exploded(codes, F.when(F.col("op") == "equal", tokens).otherwise(whole), *_KEY, "block")


def differences(pairs: DataFrame) -> DataFrame:
    """Variant rows of pairs: ayah_id, edition_id, ref_plain, ref_rasm, var_plain, var_rasm (arrays, position by position).

    Units are aligned on their rasm. Inside an equal block each token spelled
    otherwise is a row with same_rasm = 1; any other block is one row. Units
    whose rasm is equal throughout, which most are, need no alignment.
    """
    changed = _once(pairs.select("ayah_id", "edition_id", "ref_plain", "ref_rasm", "var_plain", "var_rasm")).filter(F.col("ref_plain") != F.col("var_plain"))
    alike = F.col("ref_rasm") == F.col("var_rasm")
    zipped = F.arrays_zip(F.col("ref_plain").alias("a"), F.col("var_plain").alias("b"), F.col("ref_rasm").alias("r"))
    spelled = F.filter(F.transform(zipped, lambda x, i: F.struct((i + 1).alias("place"), x["a"].alias("a"), x["b"].alias("b"), x["r"].alias("r"))), lambda x: x["r"] != "")
    tokens = changed.filter(alike).select("ayah_id", "edition_id", F.posexplode(spelled).alias("k", "x")).filter("x.a <> x.b")
    vocalic = tokens.select(F.col("ayah_id").cast("long").alias("ayah_id"), F.col("edition_id").cast("long").alias("edition_id"), F.lit(0).alias("block"), "k", F.lit("replace").alias("op"), F.col("x.place").alias("ref_position"), F.col("x.a").alias("ref_text"), F.col("x.b").alias("var_text"), F.lit(1).alias("same_rasm"), F.lit(1).alias("same_archi"))
    return vocalic.unionByName(_realigned(changed.filter(~alike)))


def of_units(pairs: DataFrame, most: int | None = None) -> DataFrame:
    """differences of pairs, a batch of units at a time (matching.rows); what is asked of ayah_id and edition_id is asked of the pairs, before they are aligned. Units of more than IN_ROW pairs of tokens take the rounds of differences. most: the tokens that a unit is known to have at most, where such units needn't be looked for."""
    sides = ("ref_plain", "ref_rasm", "var_plain", "var_rasm")
    cast = pairs.select(*[F.col(c).cast("long").alias(c) for c in _KEY], *sides)
    longer = F.size("ref_rasm").cast("long") * F.size("var_rasm") > IN_ROW
    bounded = most is not None and most * most <= IN_ROW
    few = cast if bounded else cast.select(*_KEY, *[F.when(~longer, F.col(c)).alias(c) for c in sides])
    told = few.select(*_KEY, F.explode_outer(matching.rows(*sides)).alias("_x")).filter("_x is not null").select(*_KEY, "_x.*")
    rasm = F.col("ref_rasm").isNull()
    archi = F.when(rasm, 1).otherwise((letters_skeleton(F.col("ref_rasm")) == letters_skeleton(F.col("var_rasm"))).cast("int"))
    rows = told.select(*_KEY, "block", "k", "op", "ref_position", "ref_text", "var_text", rasm.cast("int").alias("same_rasm"), archi.alias("same_archi"))
    others = None if bounded else cast.filter(longer)
    return rows if others is None or others.isEmpty() else rows.unionByName(differences(others))


def counters(rows: DataFrame, editions: DataFrame) -> DataFrame:
    """How many consonantal and vocalic variants every edition (edition_id, slug) has."""
    of = lambda flag: F.count(F.when(F.col("same_rasm") == flag, 1))
    return editions.select("edition_id", "slug").join(rows.groupBy("edition_id").agg(of(0).alias("consonantal"), of(1).alias("vocalic")), "edition_id", "left").na.fill(0, ["consonantal", "vocalic"])


def numbered(rows: DataFrame) -> DataFrame:
    """Adds id in the order of edition, ayah, block and place."""
    return ids(rows, ["edition_id", "ayah_id", "block", "k"], "id").drop("block", "k")


def apparatus(rows: DataFrame, editions: DataFrame, reference: str) -> DataFrame:
    """Adds bucket: consonantal or vocalic against other readings, orthographic or orthographic_vocalic within the reference's own.

    editions: edition_id, slug, riwayah.
    """
    own = F.coalesce(F.col("riwayah") == reference, F.lit(False))
    bucket = F.when(~own & (F.col("same_rasm") == 0), "consonantal").when(~own, "vocalic").when(F.col("same_rasm") == 0, "orthographic").otherwise("orthographic_vocalic")
    return rows.join(F.broadcast(editions), "edition_id").withColumn("bucket", bucket)


def vocalic_counts(rows: DataFrame) -> DataFrame:
    return rows.filter("same_rasm = 1").groupBy("ayah_id").agg(F.count(F.lit(1)).alias("vocalic"))


def closest_edition(rows: DataFrame) -> DataFrame:
    """The edition with fewest consonantal variants."""
    return rows.filter("same_rasm = 0").groupBy("slug").agg(F.count(F.lit(1)).alias("variants")).orderBy("variants", "slug").limit(1)


def first_difference(a: Column, b: Column, before: int = 1, after: int = 3) -> Column:
    """Slices of two token arrays around the first place where they differ; null if they don't."""
    at = F.array_position(F.zip_with(a, b, lambda x, y: ~x.eqNullSafe(y)), True)
    begin = F.greatest(at - before, F.lit(1)).cast("int")
    cut = lambda x: F.slice(x, begin, (at + after - begin).cast("int"))
    return F.when(at > 0, F.struct(at.alias("position"), cut(a).alias("ref"), cut(b).alias("var")))


