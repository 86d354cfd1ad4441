"""Operators over ordered rows: islands, spans, carried state, as-of lookup, ranges, gaps, positional zip, budgets.

Each takes the columns that partition the sequence and a total order, so that results don't depend on partitioning, and
plans as one shuffle on the partition columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F


def _over(keys, order, *frame):
    w = Window.partitionBy(*keys).orderBy(*order)
    return w.rowsBetween(*frame) if frame else w


def islands(df: DataFrame, keys, order, value: str, name: str = "island") -> DataFrame:
    """Number the runs of equal (null-safe) adjacent values from 1 on."""
    w = _over(keys, order)
    first = F.row_number().over(w) == 1
    new = (first | ~F.col(value).eqNullSafe(F.lag(value).over(w))).cast("int")
    return df.withColumn("_new", new).withColumn(name, F.sum("_new").over(_over(keys, order, Window.unboundedPreceding, 0)).cast("bigint")).drop("_new")


def spans(df: DataFrame, keys, order, value: str) -> DataFrame:
    """keys, span_no, value, start (ordinal from 0), length of each run of equal adjacent values."""
    numbered = islands(df, keys, order, value, "span_no").withColumn("_at", F.row_number().over(_over(keys, order)) - 1)
    return numbered.groupBy(*keys, "span_no", value).agg(F.min("_at").cast("bigint").alias("start"), F.count("*").alias("length"))


def carried(df: DataFrame, keys, order, value: Column, name: str) -> DataFrame:
    """The last non-null value up to and with each row: persistent state."""
    return df.withColumn(name, F.last(value, ignorenulls=True).over(_over(keys, order, Window.unboundedPreceding, 0)))


def running(df: DataFrame, keys, order, value: Column, name: str, with_current: bool = False, cell: Column | None = None) -> DataFrame:
    """The running sum, of the rows before each row unless with_current; 0 for the first.

    cell: a value that never falls along the order. With it a sequence is summed by cell in parallel, on top of the sums
    of the cells before: for few long sequences.
    """
    frame = (Window.unboundedPreceding, 0 if with_current else -1)
    if cell is None:
        return df.withColumn(name, F.coalesce(F.sum(value).over(_over(keys, order, *frame)), F.lit(0)))
    df = df.withColumn("_cell", cell)
    sums = df.groupBy(*keys, "_cell").agg(F.sum(value).alias("_sum"))
    before = sums.withColumn("_before", F.coalesce(F.sum("_sum").over(_over(keys, ["_cell"], Window.unboundedPreceding, -1)), F.lit(0))).drop("_sum")
    own = F.coalesce(F.sum(value).over(_over([*keys, "_cell"], order, *frame)), F.lit(0))
    return df.withColumn("_own", own).join(before, [*keys, "_cell"]).withColumn(name, F.col("_own") + F.col("_before")).drop("_cell", "_own", "_before")


def as_of(left: DataFrame, right: DataFrame, key: str, time: str, value: str, name: str, cell=None) -> DataFrame:
    """left with the value of right's latest row at or before `time` under the same key (the greatest value on ties).

    Both sides are put into one sequence: one shuffle and no row is compared with another by pairs. cell(time): a column
    that never falls in time; with it a key's sequence is cut into cells that are worked on in parallel, and the last
    value of each cell is carried to those after it: for few keys with many rows.
    """
    rest = [c for c in left.columns if c not in (key, time)]
    l_side = left.select(key, time, *rest, F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1).alias("_left"))
    r_side = right.select(key, time, *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in rest], F.col(value).alias("_v"), F.lit(0).alias("_left"))
    both = l_side.unionByName(r_side)
    order = [F.col(time), F.col("_left"), F.col("_v").asc_nulls_last()]
    if cell is None:
        return carried(both, [key], order, F.col("_v"), name).where("_left = 1").drop("_v", "_left")
    both = both.withColumn("_cell", cell(F.col(time)))
    last = both.groupBy(key, "_cell").agg(F.max(F.when(F.col("_left") == 0, F.struct(time, "_v"))).alias("_last"))
    w = _over([key], ["_cell"], Window.unboundedPreceding, -1)
    last = last.select(key, "_cell", F.last("_last", ignorenulls=True).over(w).alias("_last"))
    found = carried(both, [key, "_cell"], order, F.col("_v"), name).where("_left = 1").join(last, [key, "_cell"])
    return found.withColumn(name, F.coalesce(name, F.col("_last")["_v"])).drop("_v", "_left", "_cell", "_last")


def nearest(left: DataFrame, right: DataFrame, key: str, at: str, number: str, name: str, distance: str, cell=None) -> DataFrame:
    """left with the number of right's row nearest in `at` under the same key (the least number on ties), and its distance.

    One lookup to either side; right's column of numbers has the same name as `number`, its places the name `at`.
    """
    one = right.groupBy(key, at).agg(F.min(number).alias(number)).withColumn("_pair", F.struct(F.col(at).alias("at"), F.col(number).alias("no")))
    below = as_of(left, one, key, at, "_pair", "_below", cell)
    turned = as_of(below.withColumn(at, -F.col(at)), one.withColumn(at, -F.col(at)), key, at, "_pair", "_above", cell)
    sides = [F.when(F.col(s).isNotNull(), F.struct(F.abs(-F.col(at) - F.col(f"{s}.at")).alias("d"), F.col(f"{s}.no").alias("no"))) for s in ("_below", "_above")]
    best = turned.withColumn("_best", F.least(*sides)).withColumn(at, -F.col(at))
    return best.withColumn(name, F.col("_best.no")).withColumn(distance, F.col("_best.d")).drop("_below", "_above", "_best")


def in_range(df: DataFrame, keys, at: str, low: Column, high: Column, number: str, count: str, least: str) -> DataFrame:
    """keys and `at` of each distinct place, the count of df's rows with a place from low to high under the same keys, and
    the least number among them. low and high are whole numbers made of the place.

    Rows are counted by place, places by aligned blocks of 1, 2, 4, 8.. numbers, and a range is put together from at most
    two blocks of each size: no row is compared with another by pairs, however many are in range. Places without keys are
    left out. Blocks are joined by merging, as sizes estimated from files would have them broadcast.
    """
    places = df.groupBy(*keys, at).agg(F.count("*").alias("_n"), F.min(number).alias("_least"))
    asked = places.select(*keys, at, low.alias("_low"), (high + 1).alias("_end"))
    last = F.length(F.bin(F.col("_size"))) - 1  # the largest power of two in it
    top = df.agg(F.max(high + 1 - low).alias("_size")).select(last.alias("_top"))
    cut = asked.withColumn("_size", F.col("_end") - F.col("_low")).where("_size > 0").withColumn("_level", F.explode(F.sequence(F.lit(0), last)))
    cut = cut.withColumn("_from", F.expr("-shiftright(-_low, _level)")).withColumn("_to", F.expr("shiftright(_end, _level)")).where("_from < _to")
    ends = F.array(F.when(F.expr("_from & 1 = 1"), F.col("_from")), F.when(F.expr("_to & 1 = 1"), F.col("_to") - 1))
    cut = cut.select(*keys, at, "_level", F.explode(F.array_compact(ends)).alias("_block"))
    blocks = places.crossJoin(F.broadcast(top)).withColumn("_level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    blocks = blocks.groupBy(*keys, "_level", F.expr(f"shiftright({at}, _level)").alias("_block")).agg(F.sum("_n").alias("_n"), F.min("_least").alias("_least"))
    return cut.join(blocks.hint("merge"), [*keys, "_level", "_block"]).groupBy(*keys, at).agg(F.sum("_n").alias(count), F.min("_least").alias(least))


def gaps(df: DataFrame, keys, start: str, end: str, low: Column, high: Column) -> DataFrame:
    """keys, gap_start, gap_end: what the half-open intervals leave free of [low, high)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    covered = F.greatest(low, F.coalesce(F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1)), low))
    inner = df.select(*keys, covered.alias("gap_start"), F.least(F.col(start), high).alias("gap_end"))
    tail = df.groupBy(*keys).agg(F.greatest(low, F.max(end)).alias("gap_start")).withColumn("gap_end", high)
    return inner.unionByName(tail).where("gap_end > gap_start")


def zipped(left: DataFrame, right: DataFrame, keys, left_order, right_order, how: str = "inner") -> DataFrame:
    """The k-th row of left with the k-th row of right under the same keys, with the column `position` from 1 on."""
    a = left.withColumn("position", F.row_number().over(_over(keys, left_order)))
    b = right.withColumn("position", F.row_number().over(_over(keys, right_order)))
    return a.join(b, [*keys, "position"], how)


def first_match(left: DataFrame, right: DataFrame, key: str, order, how: str = "inner") -> DataFrame:
    """left joined with the first row of right under each key."""
    one = right.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_n = 1").drop("_n")
    return left.join(one, key, how)


def within_budget(df: DataFrame, keys, order, size: Column, budget: Column, cell: Column | None = None) -> DataFrame:
    """The rows before the first whose running size is above the budget, and the column used."""
    return running(df, keys, order, size, "used", True, cell).where(F.col("used") <= budget)


def top_n(df: DataFrame, keys, order, n: int) -> DataFrame:
    """The first n rows of each group, with their rank; order must be total."""
    return df.withColumn("rank", F.row_number().over(_over(keys, order)).cast("bigint")).where(F.col("rank") <= n)
