"""Result-set normalization and bag comparison.

A result set is a table ``(query_key, cells array<string>)`` with one row per
result row. Two result sets match when they hold the same rows with the same
multiplicities, in any order; column names are ignored, column order is not;
two empty results match.

Numbers match up to rounding, for a sum of doubles depends on the order of its terms. A
cell that is the text of a double (with a point) is a number. Numbers agree if they round to
the same place (``DECIMALS`` decimals below 100, ``SIGNIFICANT`` digits beyond) or, where
rounding parts two numbers, if they are in the same or neighbouring places of a grid ten times
as fine. So sums that differ in their last digits match, and a changed digit doesn't. (Three and more
neighbouring fine places of one column, all of them taken, may part rows that agree.)

Many pairs are compared at once, and a query's rows are moved once, whatever the number of
pairs it is in:

1. One aggregate makes a fingerprint a query, combined map-side, and is written: the row
   count, two sums of row hashes with numbers rounded, a sum of row hashes without numbers,
   and the sum of the numbers' places. Queries with the same rounded rows form a class.
2. A pair of one class is alike; one whose other figures allow for rounding is close;
   any other differs.
3. One more pass verifies rows, dealt by (group, row): each class of several queries must
   hold every row equally often in each, and of close classes, one query each, the rows that
   don't cancel out are matched by neighbouring places.

No result set is ever sorted, collected or gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rewardloom.session import written_table

NULL_TEXT = "NULL"
#: Decimals of a number below 10^(SIGNIFICANT - DECIMALS), digits of a larger one.
DECIMALS, SIGNIFICANT = 10, 12
_ALIKE, _CLOSE, _DIFFERENT = 0, 1, 2


def cell_text(col: Column, dtype: T.DataType, float_digits: int | None = None) -> Column:
    """A2: one value as comparison text; NULL becomes 'NULL'.

    Booleans become 1/0 (integers in SQLite), floats and decimals go through
    double (optionally rounded for show; comparison rounds by itself), integers stay
    integers, binary becomes hex.
    A decimal of more than 15 significant digits keeps its exact digits
    without trailing zeros, since a double would merge neighbours.
    """
    if isinstance(dtype, T.BooleanType):
        txt = col.cast("int").cast("string")
    elif isinstance(dtype, (T.FloatType, T.DoubleType, T.DecimalType)):
        d = col.cast("double")
        if float_digits is not None:
            d = F.round(d, float_digits)
        txt = d.cast("string")
        if isinstance(dtype, T.DecimalType) and dtype.precision > 15:
            exact = col.cast("string")
            exact = F.when(exact.contains("."), F.regexp_replace(exact, r"\.?0+$", "")).otherwise(exact)
            digits = F.regexp_replace(F.regexp_replace(exact, r"[-.]", ""), "^0+", "")
            txt = F.when(F.length(digits) > 15, exact).otherwise(txt)
    elif isinstance(dtype, T.BinaryType):
        txt = F.hex(col)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType)):
        txt = F.to_json(col)
    else:
        txt = col.cast("string")
    return F.coalesce(txt, F.lit(NULL_TEXT))


def normalize_rows(df: DataFrame, columns: Sequence[str] | None = None, float_digits: int | None = None) -> Column:
    """A2: the row as ``array<string>`` in column order, for columns of distinct names."""
    names = list(columns) if columns is not None else df.columns
    types = dict((f.name, f.dataType) for f in df.schema.fields)
    return F.array(*[cell_text(F.col(_quoted(n)), types[n], float_digits) for n in names])


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def result_rows(df: DataFrame, query_key, columns: Sequence[str] | None = None, float_digits: int | None = None) -> DataFrame:
    """A query's result DataFrame -> ``(query_key, cells)`` rows.

    Without ``columns`` or a key column, cells are taken by position, so that
    result columns may share a name or have any name."""
    if columns is None and not isinstance(query_key, Column):
        cells = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
        return cells.select(F.lit(query_key).alias("query_key"), normalize_rows(cells, None, float_digits).alias("cells"))
    key = query_key if isinstance(query_key, Column) else F.lit(query_key)
    return df.select(key.alias("query_key"), normalize_rows(df, columns, float_digits).alias("cells"))


def number(cell: Column) -> Column:
    """The double whose text a cell is; null for any other cell."""
    value = cell.try_cast("double")
    return F.when(cell.contains("."), F.when(value.cast("string") == cell, value))


def number_place(value: Column, finer: int = 0) -> Column:
    """A number's place, as a long, on a grid of DECIMALS decimals and SIGNIFICANT digits
    (``finer`` more of both): it grows with the number, and places side by side differ by 1."""
    decimals, digits = DECIMALS + finer, SIGNIFICANT + finer
    size, whole = F.abs(value), digits - decimals
    exponent = F.floor(F.log10(size))
    scale = F.pow(F.lit(10.0), F.abs(F.lit(digits - 1) - exponent))
    mantissa = F.rint(F.when(exponent < digits, size * scale).otherwise(size / scale))
    far = F.lit(float(10**digits)) + (exponent - whole) * F.lit(float(9 * 10 ** (digits - 1))) + mantissa - F.lit(float(10 ** (digits - 1)))
    place = F.when(size < 10.0**whole, F.rint(size * 10.0**decimals)).otherwise(far)
    return F.when(value < 0, -place).otherwise(place).cast("long")


def rounded_rows(rows: DataFrame) -> DataFrame:
    """``rows`` with its cells' numbers taken apart: ``rounded`` (cells, numbers as their places),
    ``shape`` (cells, numbers as marks), ``places`` and ``fine`` (the numbers' places on both grids)."""
    kept = [c for c in rows.columns if c != "cells"]
    parted = rows.select(*kept, "cells", F.transform("cells", number).alias("_numbers"))
    present = F.filter("_numbers", lambda x: x.isNotNull())
    parted = parted.select(*kept, "cells", "_numbers", F.transform(present, lambda x: number_place(x)).alias("places"), F.transform(present, lambda x: number_place(x, 1)).alias("fine"))
    mark = lambda shown: F.when(F.size("places") == 0, F.col("cells")).otherwise(F.zip_with("cells", "_numbers", shown))
    return parted.select(
        *kept,
        mark(lambda c, x: F.when(x.isNull(), c).otherwise(F.concat(F.lit("~"), number_place(x).cast("string")))).alias("rounded"),
        mark(lambda c, x: F.when(x.isNull(), c).otherwise(F.lit("~"))).alias("shape"),
        "places", "fine",
    )


def fingerprints(rows: DataFrame) -> DataFrame:
    """Order-independent summary of each result set: row count ``n``, two sums
    of 64-bit row hashes (as decimal, so sums never overflow), the same of the rows'
    shapes, and the sum and count of the numbers' places. Bags of equal rounded rows
    have equal fingerprints; a per-query aggregate, combined map-side."""
    wide = lambda c: c.cast("decimal(38,0)")
    keys = [c for c in ("side", "query_key") if c in rows.columns]
    places = F.aggregate("places", F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x).cast("decimal(38,0)"))
    return rounded_rows(rows).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(wide(F.xxhash64("rounded"))).alias("h1"),
        F.sum(wide(F.xxhash64(F.lit("second"), "rounded"))).alias("h2"),
        F.sum(wide(F.xxhash64("shape"))).alias("shapes"),
        F.sum(places).alias("places"),
        F.sum(F.size("places")).alias("numbers"),
    )


_FIGURES = ("n", "h1", "h2", "shapes", "places", "numbers")


def _sided(gold_rows: DataFrame, cand_rows: DataFrame) -> tuple[DataFrame, int]:
    """Both sides' rows in one table, and the candidates' side."""
    rows = gold_rows.select(F.lit(0).alias("side"), "query_key", "cells")
    if gold_rows is cand_rows:
        return rows, 0
    return rows.unionByName(cand_rows.select(F.lit(1).alias("side"), "query_key", "cells")), 1


def bag_differences(pairs: DataFrame, gold_rows: DataFrame, cand_rows: DataFrame) -> DataFrame:
    """The ``pair_id`` of every pair whose two result sets differ.

    ``pairs(pair_id, gold_key, cand_key)`` must have unique ``pair_id``.
    ``gold_rows``/``cand_rows`` are ``(query_key, cells)`` tables; pass the same
    DataFrame for both where gold and candidate results share a table. Rows are
    read twice: for fingerprints, and to verify what they leave open. Both results
    are written to the shared scratch folder; a row a query, and the rows that don't cancel
    out. Pairs missing from the output are equal (two empty results included)."""
    rows, cand_side = _sided(gold_rows, cand_rows)
    prints = written_table(fingerprints(rows), "fingerprints")
    return _differences(pairs, rows, prints, cand_side)


def _differences(pairs: DataFrame, rows: DataFrame, prints: DataFrame, cand_side: int) -> DataFrame:
    keyed = pairs.select("pair_id", "gold_key", "cand_key")
    compared = written_table(_compared(keyed, prints, cand_side), "compared")
    members = _members(compared, cand_side)
    uneven = written_table(_uneven(rows, members), "uneven-rows")
    apart = _apart(uneven.filter("sign != 0"))
    certain = compared.filter(F.col("outcome") == _DIFFERENT).select("gold_key", "cand_key")
    close = compared.filter(F.col("outcome") == _CLOSE).withColumn("group", _close_group())
    unequal = certain.unionByName(close.join(apart, "group", "left_semi").select("gold_key", "cand_key"))
    broken = uneven.filter("sign = 0").select(F.col("group").alias("g_class")).distinct()
    if not broken.isEmpty():  # different rows with equal fingerprints: their pairs are compared one by one
        unequal = unequal.unionByName(_pairwise(compared.join(broken, "g_class", "left_semi").filter(F.col("outcome") == _ALIKE), rows, cand_side))
    unequal = unequal.select(F.col("gold_key").alias("_g"), F.col("cand_key").alias("_c"))
    same_keys = F.col("gold_key").eqNullSafe(F.col("_g")) & F.col("cand_key").eqNullSafe(F.col("_c"))
    return keyed.join(unequal, same_keys, "left_semi").select("pair_id")


def _compared(keyed: DataFrame, prints: DataFrame, cand_side: int) -> DataFrame:
    """(gold_key, cand_key, n, g_class, c_class, outcome): each distinct key pair, by fingerprints alone."""
    both = keyed.select("gold_key", "cand_key").distinct()
    if cand_side == 0:
        both = both.filter(~F.col("gold_key").eqNullSafe(F.col("cand_key")))

    def side(which: int, key: str, prefix: str) -> DataFrame:
        own = prints.filter(F.col("side") == which)
        return own.select(F.col("query_key").alias(key), *[F.col(c).alias(f"{prefix}{c}") for c in _FIGURES])

    joined = both.join(side(0, "gold_key", "g_"), "gold_key", "left").join(side(cand_side, "cand_key", "c_"), "cand_key", "left")
    figure = lambda name: F.coalesce(F.col(name), F.lit(0).cast("decimal(38,0)"))
    g, c = ({x: figure(f"{prefix}{x}") for x in _FIGURES} for prefix in ("g_", "c_"))
    as_class = lambda own: F.concat_ws(":", *[own[x].cast("string") for x in ("n", "h1", "h2")])
    same = lambda *names: F.lit(True) if not names else (g[names[0]] == c[names[0]]) & same(*names[1:])
    # Numbers that agree are at most a place apart, so the sums are apart by their count at most.
    rounded = same("n", "shapes", "numbers") & (F.abs(g["places"] - c["places"]) <= g["numbers"])
    outcome = F.when(as_class(g) == as_class(c), _ALIKE).when(rounded, _CLOSE).otherwise(_DIFFERENT)
    return joined.select("gold_key", "cand_key", g["n"].cast("long").alias("n"), as_class(g).alias("g_class"), as_class(c).alias("c_class"), outcome.alias("outcome"))


def _close_group() -> Column:
    return F.concat_ws("|", "g_class", "c_class")


def _members(compared: DataFrame, cand_side: int) -> DataFrame:
    """(group, side, query_key, sign): the queries whose rows are looked at, for each group.

    A class with all its queries (sign 0), or two close classes with one query each (1, -1)."""
    open_pairs = compared.filter((F.col("outcome") != _DIFFERENT) & (F.col("n") > 0))
    ends = open_pairs.select("outcome", F.explode(F.array(
        F.struct(F.col("g_class").alias("group"), F.lit(0).alias("side"), F.col("gold_key").alias("query_key")),
        F.struct(F.col("c_class").alias("group"), F.lit(cand_side).alias("side"), F.col("cand_key").alias("query_key")),
    )).alias("end")).select("outcome", "end.*")
    of_class = ends.select("group", "side", "query_key").distinct()
    one = of_class.groupBy("group").agg(F.min(F.struct("side", "query_key")).alias("one"))
    close = open_pairs.filter(F.col("outcome") == _CLOSE).select("g_class", "c_class").distinct()
    both = close.select(_close_group().alias("of"), F.explode(F.array(
        F.struct(F.col("g_class").alias("group"), F.lit(1).alias("sign")), F.struct(F.col("c_class").alias("group"), F.lit(-1).alias("sign")),
    )).alias("end")).select("of", "end.*")
    close_members = both.join(one, "group").select(F.col("of").alias("group"), "one.side", "one.query_key", "sign")
    return of_class.withColumn("sign", F.lit(0)).unionByName(close_members)


def _uneven(rows: DataFrame, members: DataFrame) -> DataFrame:
    """(group, sign, rounded, shape, fine, n): rows that a group's queries don't hold equally often."""
    counted = (
        rounded_rows(rows).join(members, ["side", "query_key"])
        .groupBy("group", "side", "query_key", "sign", "rounded", "shape", "fine").agg(F.count(F.lit(1)).alias("n"))
    )
    of_query = counted.groupBy("group", "side", "query_key", "sign", "rounded").agg(F.sum("n").alias("n"))
    of_row = of_query.groupBy("group", "rounded").agg(
        F.count(F.lit(1)).alias("holders"), F.min("n").alias("least"), F.max("n").alias("most")
    )
    sizes = members.groupBy("group").agg(F.count(F.lit(1)).alias("size"))
    # Every query of a group must hold the row, and as often as the others.
    off = of_row.join(sizes, "group").filter((F.col("holders") != F.col("size")) | (F.col("least") != F.col("most")))
    return counted.join(off.select("group", "rounded"), ["group", "rounded"], "left_semi").drop("side", "query_key")


def _apart(uneven: DataFrame) -> DataFrame:
    """The groups whose signed rows don't cancel out, with numbers in neighbouring fine places as one."""
    rows = uneven.select("group", "shape", "fine", (F.col("sign") * F.col("n")).alias("net")).groupBy("group", "shape", "fine").agg(F.sum("net").alias("net"))
    each = rows.filter(F.size("fine") > 0).select("group", "shape", "fine", F.posexplode("fine").alias("pos", "place"))
    taken = each.select("group", "pos", "place").distinct()
    below = taken.select("group", "pos", (F.col("place") + 1).alias("place"), F.lit(1).alias("has_below"))
    merged = taken.join(below, ["group", "pos", "place"], "left").withColumn("merged", F.col("place") - F.coalesce("has_below", F.lit(0)))
    whole = each.join(merged.drop("has_below"), ["group", "pos", "place"]).groupBy("group", "shape", "fine").agg(
        F.sort_array(F.collect_list(F.struct("pos", "merged"))).alias("numbers")
    )
    signed = rows.join(whole, ["group", "shape", "fine"], "left").groupBy("group", "shape", "numbers").agg(F.sum("net").alias("net"))
    return signed.filter(F.col("net") != 0).select("group").distinct()


def _pairwise(pairs: DataFrame, rows: DataFrame, cand_side: int) -> DataFrame:
    """Key pairs whose rounded rows, signed, don't cancel out."""
    wanted = pairs.select("gold_key", "cand_key", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("gold_key").alias("query_key"), F.lit(1).alias("sign")),
        F.struct(F.lit(cand_side).alias("side"), F.col("cand_key").alias("query_key"), F.lit(-1).alias("sign")),
    )).alias("w")).select("gold_key", "cand_key", "w.*")
    net = rounded_rows(rows).join(wanted, ["side", "query_key"]).groupBy("gold_key", "cand_key", "rounded").agg(F.sum("sign").alias("net"))
    return net.filter(F.col("net") != 0).select("gold_key", "cand_key").distinct()


def compare_bags(pairs: DataFrame, gold_rows: DataFrame, cand_rows: DataFrame) -> DataFrame:
    """``pairs(pair_id, gold_key, cand_key)`` (unique pair_id) ->
    ``(pair_id, matched)``."""
    return _matched(pairs, bag_differences(pairs, gold_rows, cand_rows))


def _matched(pairs: DataFrame, unequal: DataFrame) -> DataFrame:
    unequal = unequal.withColumn("_differs", F.lit(True))
    return pairs.select("pair_id").join(unequal, "pair_id", "left").select(
        "pair_id", F.col("_differs").isNull().alias("matched")
    )


def compare_result_sets(gold_rows: DataFrame, cand_rows: DataFrame) -> DataFrame:
    """A1 for keyed result sets sharing ``query_key``: ``(query_key, matched)``
    for every key present on either side."""
    rows, cand_side = _sided(gold_rows, cand_rows)
    prints = written_table(fingerprints(rows), "fingerprints")
    keys = prints.select("query_key").distinct()
    pairs = keys.select(
        F.col("query_key").alias("pair_id"), F.col("query_key").alias("gold_key"), F.col("query_key").alias("cand_key")
    )
    return _matched(pairs, _differences(pairs, rows, prints, cand_side)).withColumnRenamed("pair_id", "query_key")
