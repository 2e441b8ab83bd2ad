"""Scans in order that no group holds up: what a row needs from all rows before it, in two passes over ranges.

Rows are put in ranges of (group, order) by Spark's range partitioner and
stored once with the number of their range.  A first pass reduces each part of
a group in a range to one row; a window over those rows, of which a group has at
most one a range, carries what came before into each range; a second pass scans
each range by itself.  So a group that holds any share of all rows is spread
over as many tasks as there are ranges, whose number follows
spark.sql.shuffle.partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakframe.sources import shared

RANGE = "__range"


def ranged(df: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The rows, stored, with the number of their range; rows that are equal in the keys share one, and later ranges hold later rows."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The number is stored, since a range partitioner that runs again may cut elsewhere.
    return shared.stored(df.repartitionByRange(parts, *keys).withColumn(RANGE, F.spark_partition_id()))


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of both sides in which nulls are equal; the right side's are dropped."""
    named = right.select(*(F.col(c).alias(f"__r_{k}") for k, c in enumerate(on)), *(c for c in right.columns if c not in on))
    same = [F.col(c).eqNullSafe(F.col(f"__r_{k}")) for k, c in enumerate(on)]
    return left.join(named, same or F.lit(True), how).drop(*(f"__r_{k}" for k, _ in enumerate(on)))


def carried(rows: DataFrame, by: list[str], values: dict[str, Column], before: dict[str, Column]) -> DataFrame:
    """Adds to each row what earlier ranges of its group come to.

    values: aggregates of a part of a group in a range; before: of these, over the parts before (aggregates as well).
    """
    parts = rows.groupBy(*by, RANGE).agg(*(v.alias(n) for n, v in values.items()))
    earlier = Window.partitionBy(*by).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    return joined(rows, parts.select(*by, RANGE, *(v.over(earlier).alias(n) for n, v in before.items())), [*by, RANGE])


def merged(df: DataFrame, by: list[str], start: str, end: str) -> DataFrame:
    """Overlapping or touching intervals of each group as one: by, start, end, n.

    Intervals with one start count as the longest of them from the beginning, so that no start is hot.
    """
    keys = [f"__k{k}" for k, _ in enumerate(by)]
    first = df.groupBy(*(F.col(c).alias(k) for c, k in zip(by, keys)), F.col(start).alias("__s")).agg(F.max(end).alias("__e"), F.count("*").alias("__n"))
    rows = ranged(first, [*keys, "__s"])
    rows = carried(rows, keys, {"__top": F.max("__e")}, {"__reach": F.max("__top")})
    own = Window.partitionBy(*keys, RANGE).orderBy("__s")
    reach = F.greatest("__reach", F.max("__e").over(own.rowsBetween(Window.unboundedPreceding, -1)))  # nulls are passed over
    rows = rows.withColumn("__head", F.when(reach.isNull() | (F.col("__s") > reach), F.col("__s")))
    # An island is known by the start of its first interval: the last one at or before, here or in an earlier range.
    rows = carried(rows, keys, {"__first": F.max("__head")}, {"__before": F.max("__first")})
    island = F.coalesce(F.last("__head", ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0)), F.col("__before"))
    out = rows.withColumn("__island", island).groupBy(*keys, "__island").agg(F.max("__e").alias("end"), F.sum("__n").alias("n"))
    return out.select(*(F.col(k).alias(c) for k, c in zip(keys, by)), F.col("__island").alias("start"), "end", "n")


def runs(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Ranges [first, last] of consecutive integers in each group (gaps and islands), n of them; repeated numbers count once."""
    ones = df.select(*by, F.col(value).alias("__v"), (F.col(value) + 1).alias("__w")).where(F.col(value).isNotNull()).distinct()
    return merged(ones, by, "__v", "__w").select(*by, F.col("start").alias("first"), (F.col("end") - 1).alias("last"), "n")


def running_sums(df: DataFrame, order: str, sums: list[str], descending: bool = False) -> DataFrame:
    """Adds upto_c and all_c for each c of sums: its sum up to and with the row in the order of a column, and over all rows.

    Rows that share a value should be one row. The input is computed once.
    """
    rows = ranged(df, [F.desc(order) if descending else F.col(order)])
    parts = rows.groupBy(RANGE).agg(*(F.sum(c).alias(f"__{c}") for c in sums))
    # A row for each range.
    every, before = Window.partitionBy(F.lit(1)), Window.partitionBy(F.lit(1)).orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(RANGE, *(F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__before_{c}") for c in sums), *(F.sum(f"__{c}").over(every).alias(f"all_{c}") for c in sums))
    own = Window.partitionBy(RANGE).orderBy(F.desc(order) if descending else F.col(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.select("*", *(F.sum(c).over(own).alias(f"__own_{c}") for c in sums)).join(starts, RANGE)
    return out.select(*df.columns, *((F.col(f"__before_{c}") + F.col(f"__own_{c}")).alias(f"upto_{c}") for c in sums), *(f"all_{c}" for c in sums))


def _levels(start: Column, end: Column, finest: int) -> Column:
    """The level of an interval: the power of two that is not below its length, at least `finest`."""
    length = F.greatest(end.cast("long") - start.cast("long"), F.lit(1))
    bits = F.length(F.bin(length - 1))  # of 0 too it is one
    return F.greatest(F.when(length == 1, F.lit(0)).otherwise(bits), F.lit(finest)).cast("int")


def cells(df: DataFrame, start: str, end: str, finest: int = 0, levels: list[int] | None = None) -> DataFrame:
    """A row for each cell of an interval, with __level and __cell: the one or two of its own level, or (levels given) those of each of them above it.

    A cell of level l holds 2**l numbers, so an interval has two cells of a level that is not below its own.
    """
    s, e = F.col(start).cast("long"), F.greatest(F.col(start), F.col(end) - 1).cast("long")
    own = _levels(F.col(start), F.col(end), finest)
    at = F.array(own) if levels is None else F.filter(F.array(*map(F.lit, levels)).cast("array<int>"), lambda x: x > own)
    rows = df.select("*", F.explode(at).alias("__level"))
    low, high = (F.call_function("shiftright", x, F.col("__level")) for x in (s, e))
    return rows.select("*", F.explode(F.when(low == high, F.array(low)).otherwise(F.array(low, high))).alias("__cell"))


def overlap_semi(left: DataFrame, right: DataFrame, by: list[str], start: str, end: str, width: int = 1) -> DataFrame:
    """Left rows whose half-open interval overlaps one of right's in the same group; repeated rows stay.

    Intervals lie in cells of a hierarchy: of two that overlap, the shorter one shares a cell of the longer one's level
    with it. So an interval of any length has two cells of its own and at most two of each longer level that the other
    side has, and both joins are on equal cells. width: of the finest cells, for intervals that are all short.
    """
    finest = max(0, (width - 1).bit_length())
    keys = [f"__k{k}" for k, _ in enumerate(by)]

    def spans(df: DataFrame, s: str, e: str) -> DataFrame:
        cols = [F.col(c).alias(k) for c, k in zip(by, keys)]
        return df.select(*cols, F.col(start).alias(s), F.col(end).alias(e)).distinct()

    a, b = spans(left, "__s", "__e"), spans(right, "__t", "__u")
    # At most 64 numbers each come to the driver.
    used = [sorted(r[0] for r in x.select(_levels(F.col(s), F.col(e), finest)).distinct().collect() if r[0] is not None) for x, s, e in ((a, "__s", "__e"), (b, "__t", "__u"))]

    def met(mine: DataFrame, theirs: DataFrame) -> DataFrame:
        theirs = theirs.select(*(F.col(k).alias(f"{k}_") for k in keys), "__t", "__u", F.col("__level").alias("__level_"), F.col("__cell").alias("__cell_"))
        on = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in keys] + [F.col("__level") == F.col("__level_"), F.col("__cell") == F.col("__cell_")]
        return mine.join(theirs, [*on, F.col("__s") < F.col("__u"), F.col("__t") < F.col("__e")], "left_semi").select(*keys, "__s", "__e")

    longer = met(cells(a, "__s", "__e", finest, used[1]), cells(b, "__t", "__u", finest))
    shorter = met(cells(a, "__s", "__e", finest), cells(b, "__t", "__u", finest).unionByName(cells(b, "__t", "__u", finest, used[0])))
    found = longer.unionByName(shorter)
    on = [F.col(c).eqNullSafe(F.col(k)) for c, k in zip(by, keys)] + [F.col(start) == F.col("__s"), F.col(end) == F.col("__e")]
    return left.join(found, on, "left_semi")
