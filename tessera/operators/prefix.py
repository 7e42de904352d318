"""Prefix scans: running values over groups of any size.

Rows are dealt out in ranges of (group, order) and written, so that no task needs a whole group. A running value is then made three times over: within
each range, where it is a window like any other; over the ranges of a group, of which each hands on one carry (its sum, least, greatest or last value); and for each row by
laying the carry of the ranges before it under its own. Rows that are equal in group and order are put in an order of their own, so even one key
that all rows share is split. A null in a group column is a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import layout
from tessera.sources import discard, written


class Ranges:
    """Rows dealt in ranges. ``running`` adds columns and returns the like, over the same ranges; ``rows`` are the rows as they stand."""

    def __init__(self, df: DataFrame, by: list[str], order: list[str]):
        self.df, self.by, self.order = df, by, [*order, "tie_"]

    def running(self, back: bool = False, **values: tuple[str, Column, bool]) -> Ranges:
        """name=(kind, column, whether the row itself counts); kind is sum, min, max or last (the last value that is not null). ``back`` runs from the end of each
        group. Before any value a sum is 0 and others are null."""
        way = [F.desc(c) if back else F.asc(c) for c in self.order]
        within = Window.partitionBy(*self.by, "part_").orderBy(*way)
        frames = {own: within.rowsBetween(Window.unboundedPreceding, 0 if own else -1) for own in (True, False)}
        # Columns that several values, or further scans, are made of.
        df = self.df.withColumns({f"in_{n}": c for n, (_, c, _) in values.items()})
        pick = F.min_by if back else F.max_by
        place = F.struct(*self.order)
        totals, befores, finals = [], [], {}
        before = Window.partitionBy(*self.by).orderBy(F.desc("part_") if back else F.asc("part_")).rowsBetween(Window.unboundedPreceding, -1)
        for n, (kind, _, own) in values.items():
            c, carry, local = F.col(f"in_{n}"), F.col(f"carry_{n}"), F.col(f"local_{n}")
            if kind == "last":
                totals.append(pick(c, F.when(c.isNotNull(), place)).alias(f"total_{n}"))
                befores.append(F.last(f"total_{n}", ignorenulls=True).over(before).alias(f"carry_{n}"))
                df = df.withColumn(f"local_{n}", F.last(c, ignorenulls=True).over(frames[own]))
                finals[n] = F.coalesce(local, carry)
            else:
                f = {"sum": F.sum, "min": F.min, "max": F.max}[kind]
                totals.append(f(c).alias(f"total_{n}"))
                befores.append(f(f"total_{n}").over(before).alias(f"carry_{n}"))
                df = df.withColumn(f"local_{n}", f(c).over(frames[own]))
                finals[n] = F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0)) if kind == "sum" else (F.least if kind == "min" else F.greatest)(local, carry)
        # A row for each range of each group.
        carries = df.groupBy(*self.by, "part_").agg(*totals).select(*[F.col(c).alias(f"c_{c}") for c in (*self.by, "part_")], *befores)
        on = F.col("part_") == F.col("c_part_")
        for c in self.by:
            on = on & F.col(c).eqNullSafe(F.col(f"c_{c}"))
        out = df.join(carries, on, "left").withColumns(finals)
        return Ranges(out.drop(*[f"{p}_{n}" for n in values for p in ("in", "local", "carry")], *[f"c_{c}" for c in (*self.by, "part_")]), self.by, self.order[:-1])

    def with_columns(self, **columns: Column) -> Ranges:
        return Ranges(self.df.withColumns(columns), self.by, self.order[:-1])

    def lag(self, name: str, value: Column, back: bool = False) -> Ranges:
        """The value of the row before (``back``: after), null values too, as a struct of ``v`` that is null where there is none."""
        return self.running(back=back, **{name: ("last", F.struct(value.alias("v")), False)})

    @property
    def rows(self) -> DataFrame:
        return self.df.drop("part_", "tie_")


def ranged(df: DataFrame, by: list[str], order: list[str]) -> Ranges:
    """``order`` are columns, ascending with null first."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tied = df.withColumn("tie_", F.monotonically_increasing_id())
    return Ranges(written(tied.repartitionByRange(n, *by, *order, "tie_").withColumn("part_", F.spark_partition_id())), by, order)


def islands(df: DataFrame, by: list[str], x: str, gap: Column, name: str = "island") -> DataFrame:
    """As ``layout.islands``, for groups of any size."""
    r = ranged(df, by, [x]).lag("before_", F.col(x))
    step = F.when(F.col(x) - F.col("before_.v") > gap, 1).otherwise(0)
    return r.running(**{name: ("sum", step, True)}).rows.drop("before_")


def columns(df: DataFrame, by: list[str], x: str, width: Column, share: float = 0.15) -> DataFrame:
    """As ``layout.columns``, for groups of any size and with any number of columns."""
    spans = layout.island_spans(islands(df.withColumn("width_", width), by, x, F.col("width_") * share), by, x)
    following = ranged(spans, by, ["island"]).lag("after_", F.col("low"), back=True).rows
    return layout.column_bounds(following.withColumn("next_", F.col("after_.v")).drop("after_"), by)


def runs(df: DataFrame, by: list[str], order: list[str], value: str, name: str = "run") -> DataFrame:
    """Number of the run of equal neighbours, from 1."""
    r = ranged(df, by, order).lag("before_", F.col(value))
    new = F.when(F.col("before_").isNotNull() & F.col(value).eqNullSafe(F.col("before_.v")), 0).otherwise(1)
    return r.running(**{name: ("sum", new, True)}).rows.drop("before_")


def best_so_far(df: DataFrame, by: list[str], order: str, value: str) -> DataFrame:
    """The least value of the rows before, and whether the row betters it; the first of a group does."""
    r = ranged(df, by, [order]).running(best=("min", F.col(value), False))
    return r.with_columns(kept=F.col("best").isNull() | (F.col(value) < F.col("best"))).rows


def asof_next(events: DataFrame, marks: DataFrame, by: str, at: str, mark: str) -> DataFrame:
    """The first mark after each event of the same key, null where there is none: one backward scan over the union, no pairs."""
    row = F.struct(*events.columns)
    both = events.select(by, F.col(at).alias("t_"), F.lit(1).alias("k_"), F.lit(None).cast(marks.schema[mark].dataType).alias("m_"), row.alias("row"))
    other = marks.select(by, F.col(mark).alias("t_"), F.lit(0).alias("k_"), F.col(mark).alias("m_"), F.lit(None).cast(both.schema["row"].dataType).alias("row"))
    r = ranged(both.union(other), [by], ["t_", "k_"]).running(back=True, next=("last", F.col("m_"), False))
    return r.rows.where("k_ = 1").select("row.*", "next")


def edges(df: DataFrame, by: list[str], order: str, node: str) -> DataFrame:
    """An edge from each node to the next, in order."""
    r = ranged(df, by, [order]).lag("before_", F.col(node))
    return r.rows.where("before_.v IS NOT NULL").select(*by, F.col("before_.v").alias("src"), F.col(node).alias("dst"))


def same(a: str, b: str, columns: list[str]) -> Column:
    """Whether two frames' rows, under these aliases, agree in columns, null with null."""
    test = F.lit(True)
    for c in columns:
        test = test & F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}"))
    return test


def spaced(df: DataFrame, by: list[str], x: str, least: float) -> DataFrame:
    """Of each group's values, in order, the first and each that is at least so far from the last one kept, as ``layout.spaced`` folds them, for groups of any size.

    Every value points to the next one far enough away, by a backward scan. Which values the first one leads to is found by doubling: after round k those within 2^k steps are known, and
    pointers lead 2^k steps on, so a group of n takes log n rounds of joins by value."""
    if least <= 0:
        return df.select(*by, x).where(F.col(x).isNotNull())
    nodes = written(df.select(*by, F.col(x).cast("double").alias("v")).where("v IS NOT NULL").distinct())
    marks = ranged(nodes, by, ["v"]).lag("after", F.col("v"), back=True).rows.select(*by, F.col("v").alias("t_"), F.lit(1).alias("k_"), F.struct("v", F.col("after.v").alias("after")).alias("m_"))
    # A sum is rounded, so the scan begins a little below it and the distance itself decides.
    near = F.col("v") + F.lit(least)
    points = nodes.select(*by, (near - F.abs(near) * 1e-12).alias("t_"), F.lit(0).alias("k_"), "v")
    both = points.unionByName(marks, allowMissingColumns=True)
    met = ranged(both, by, ["t_", "k_"]).running(back=True, to=("last", F.col("m_"), False)).rows.where("k_ = 0")
    to = F.when(F.col("to.v") - F.col("v") >= least, F.col("to.v")).otherwise(F.col("to.after"))
    jump = written(met.select(*by, "v", to.alias("to")).where("to IS NOT NULL"))
    reached = written(nodes.groupBy(*by).agg(F.min("v").alias("v")))
    discard(nodes)
    while True:
        new = written(reached.alias("r").join(jump.alias("j"), same("r", "j", [*by, "v"])).select(*[F.col(f"r.{c}") for c in by], F.col("j.to").alias("v")))
        if new.isEmpty():
            discard(jump, new)
            return reached.withColumnRenamed("v", x)
        before, twice = reached, jump
        reached = written(reached.union(new))
        groups = F.lit(True)
        for c in by:
            groups = groups & F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}"))
        jump = written(twice.alias("a").join(twice.alias("b"), groups & (F.col("a.to") == F.col("b.v"))).select(*[F.col(f"a.{c}") for c in by], F.col("a.v"), F.col("b.to").alias("to")))
        discard(before, twice, new)
