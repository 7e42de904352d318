"""Layout and sequences: islands, longest increasing runs, repairs. Groups are pages, so every window is by page; ``prefix`` has what groups of any size need."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from tessera.sources import written


def islands(df: DataFrame, by: list[str], x: str, gap: Column, name: str = "island", order: list[Column] | None = None) -> DataFrame:
    """Sorted by x within a group, a new island where the step to the next is more than gap. order: the whole order, which begins with x, where rows are taken one at a time: equal
    x that have no difference (infinities) are then islands of their own."""
    w = Window.partitionBy(*by).orderBy(*(order or [x]))
    step = F.when(F.col(x) - F.lag(x).over(w) > gap, 1).otherwise(0)
    running = w.rowsBetween(Window.unboundedPreceding, 0) if order else w
    return df.withColumn("step_", step).withColumn(name, F.sum("step_").over(running)).drop("step_")


def columns(df: DataFrame, by: list[str], x: str, width: Column, share: float = 0.15) -> DataFrame:
    """Left and right bounds of the columns of a page; one row for each column."""
    flat = island_spans(islands(df.withColumn("width_", width), by, x, F.col("width_") * share), by, x)
    return column_bounds(flat.withColumn("next_", F.lead("low").over(Window.partitionBy(*by).orderBy("island"))), by)


def island_spans(df: DataFrame, by: list[str], x: str) -> DataFrame:
    """A row for each island: where it begins and ends, its rows, and the width of its page."""
    return df.groupBy(*by, "island").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count("*").alias("n"), F.first("width_").alias("width_"))


def column_bounds(spans: DataFrame, by: list[str]) -> DataFrame:
    """Bounds of islands, of which each knows where the next begins (``next_``)."""
    left = F.when(F.col("island") == 0, F.lit(0.0)).otherwise(F.col("low") - 10)
    right = F.when(F.col("next_").isNull(), F.col("width_")).otherwise((F.col("high") + F.col("next_")) / 2)
    return spans.select(*by, "island", "n", "low", left.cast("double").alias("left"), right.cast("double").alias("right"))


def top_two(cols: DataFrame, by: list[str]) -> DataFrame:
    """The two fullest columns of a page, of equals the left one, from left to right."""
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "low")
    return cols.withColumn("r_", F.row_number().over(w)).where("r_ <= 2").withColumn("col", F.row_number().over(Window.partitionBy(*by).orderBy("low")) - 1).drop("r_")


def lis_of(values: Sequence[int | None]) -> list[int]:
    """Places of a longest strictly increasing run by patience: pile k holds, in order of place and of falling value, what ends a run of k + 1. An element goes on the first pile whose
    last value is not under it and follows the first of the pile before that is under it. Null values end runs of one and begin none."""
    tops: list[int] = []  # last value of each pile; these rise
    piles: list[list[int]] = []  # values with their signs turned, so that they rise within a pile
    places: list[list[int]] = []
    before: list[int] = [-1] * len(values)
    for i, v in enumerate(values):
        if v is None:
            continue
        k = bisect_left(tops, v)
        if k == len(piles):
            tops.append(v)
            piles.append([])
            places.append([])
        tops[k] = v
        piles[k].append(-v)
        places[k].append(i)
        if k:
            before[i] = places[k - 1][bisect_right(piles[k - 1], -v)]
    if len(piles) < 2:
        return [0] if len(values) else []
    out, at = [], places[-1][0]
    while at >= 0:
        out.append(at)
        at = before[at]
    return out[::-1]


@F.pandas_udf(ArrayType(IntegerType()))
def _lis(seqs: pd.Series) -> pd.Series:
    return seqs.map(lambda s: None if s is None else lis_of([None if x is None or x != x else int(x) for x in s]))


def lis(seq: Column) -> Column:
    """Places of a longest strictly increasing run; of equals that which ends first, each place's earliest best predecessor. A sequence of n takes n log n steps and memory for n; Spark's
    own folds would copy what they have gathered at each step."""
    return _lis(seq.cast("array<bigint>"))


def chain(seq: Column) -> Column:
    """Length of the longest run of successors n, n + 1, ... among the values in order."""

    def grow(acc: Column, x: Column) -> Column:
        x = x.cast("bigint")
        before = F.coalesce(F.element_at(F.map_filter(acc, lambda k, v: k == x - 1), x - 1), F.lit(0))
        own = F.coalesce(F.element_at(F.map_filter(acc, lambda k, v: k == x), x), F.lit(0))
        return F.map_concat(F.map_filter(acc, lambda k, v: k != x), F.create_map(x, F.greatest(before + 1, own)))

    start = F.create_map().cast("map<bigint,int>")
    return F.aggregate(seq, start, grow, lambda acc: F.coalesce(F.array_max(F.map_values(acc)), F.lit(0)))


def spaced(seq: Column, least: float) -> Column:
    """Values at least so far from the last one kept."""
    return F.aggregate(seq, F.array().cast("array<double>"), lambda acc, x: F.when((F.size(acc) == 0) | (x - F.element_at(acc, -1) >= least), F.concat(acc, F.array(x.cast("double")))).otherwise(acc))


def valid_islands(df: DataFrame, by: list[str], x: str, y: str, num: str, gap: Column) -> DataFrame:
    """Islands of two or more whose numbers rise with y by one to three each; rows of one y stand in order of x, then of number. Null comes last, as in SQL."""
    up = lambda *names: [F.col(c).asc_nulls_last() for c in names]
    df = islands(df, by, x, gap, order=up(x, num, y))
    w = Window.partitionBy(*by, "island").orderBy(*up(y, x, num))
    ok = F.lag(num).over(w).isNull() | (F.col(num) - F.lag(num).over(w)).between(1, 3)
    per = Window.partitionBy(*by, "island")
    return df.withColumn("ok_", ok).withColumn("all_", F.min("ok_").over(per)).withColumn("n_", F.count("*").over(per)).where("all_ AND n_ >= 2").drop("ok_", "all_", "n_")


def two_columns(by: list[str], col: str) -> Column:
    """Whether a row's page has exactly the columns 0 and 1."""
    w = Window.partitionBy(*by)
    return (F.min(col).over(w) == 0) & (F.max(col).over(w) == 1)


def drop_stragglers(df: DataFrame, by: list[str], col: str, num: str) -> DataFrame:
    """On pages with exactly the columns 0 and 1, right numbers not above the left column's largest go, unless all would."""
    w = Window.partitionBy(*by)
    left = F.max(F.when(F.col(col) == 0, F.col(num))).over(w)
    late = F.col("two_") & (F.col(col) == 1) & (F.col(num) <= F.col("left_"))
    df = df.withColumn("two_", two_columns(by, col)).withColumn("left_", left).withColumn("late_", F.coalesce(late, F.lit(False)))
    rights = F.sum(F.when(F.col(col) == 1, 1).otherwise(0)).over(w)
    lates = F.sum(F.when(F.col("late_"), 1).otherwise(0)).over(w)
    return df.withColumn("r_", rights).withColumn("l_", lates).where("NOT late_ OR l_ = r_").drop("two_", "left_", "late_", "r_", "l_")


def repair_sequence(df: DataFrame, by: list[str], col: str, y: str, num: str) -> DataFrame:
    """On pages with exactly the columns 0 and 1, where the left column's first number and its length give the right column's first, both are numbered through."""
    w = Window.partitionBy(*by)
    seq = F.row_number().over(Window.partitionBy(*by).orderBy(col, y))
    first = lambda k: F.min_by(F.when(F.col(col) == k, F.col(num)), F.when(F.col(col) == k, F.col(y))).over(w)
    n0 = F.sum(F.when(F.col(col) == 0, 1).otherwise(0)).over(w)
    return df.withColumn("f0_", first(0)).withColumn("f1_", first(1)).withColumn("n0_", n0).withColumn("repaired", F.when(two_columns(by, col) & (F.col("f0_") + F.col("n0_") == F.col("f1_")), F.col("f0_") + seq - 1).otherwise(F.col(num))).drop("f0_", "f1_", "n0_")


def extents(df: DataFrame, by: list[str], y: str, bottom: Column) -> DataFrame:
    """A box reaches to the next start in its column, the last to the bottom."""
    w = Window.partitionBy(*by).orderBy(y)
    return df.withColumn("y1", F.coalesce(F.lead(y).over(w), bottom))


def reading_order(df: DataFrame, by: list[str], col: str, y: str, x: str, band: float = 12.0) -> DataFrame:
    """Column, then band of y (halves to even), then x."""
    w = Window.partitionBy(*by).orderBy(col, F.bround(F.col(y) / band), x, y)
    return df.withColumn("ord", F.row_number().over(w))


def dedup_starts(df: DataFrame, page: list[str], num: str, y: str, body: str, *rest: str) -> DataFrame:
    """Bodied rows before bare ones, then the highest of each number and band of 20, with the rest of its columns."""
    any_page = F.max(F.col(body).cast("int")).over(Window.partitionBy(*page))
    kept = df.withColumn("p_", any_page).where((F.col("p_") == 0) | F.col(body)).withColumn("band", F.bround(F.col(y) / 20).cast("long"))
    return kept.groupBy(*page, num, "band").agg(F.min(F.struct(y, *rest)).alias("k_")).select(*page, num, "band", "k_.*")


def place(df: DataFrame, by: list[str], order: list[Column], name: str = "place") -> DataFrame:
    """Row numbers within groups of any size: rows are dealt out in ranges of (by, order) and written, numbered within a range, and raised by the counts of the
    ranges before (one row a range and group). No task gets a whole group."""
    spark = df.sparkSession
    keys = [F.col(c) for c in by]
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = written(df.repartitionByRange(n, *keys, *order).withColumn("part_", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(*by, "part_").orderBy(*order))
    before = F.coalesce(F.sum("n_").over(Window.partitionBy(*by).orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy(*by, "part_").agg(F.count("*").alias("n_")).withColumn("before_", before).drop("n_")
    return dealt.withColumn("own_", own).join(sizes, [*by, "part_"]).withColumn(name, F.col("own_") + F.col("before_")).drop("part_", "own_", "before_")


def sort_number(num: Column) -> Column:
    """Numbers as numbers, all else after them."""
    return F.coalesce(num.cast("string").try_cast("int"), F.lit(9999))
