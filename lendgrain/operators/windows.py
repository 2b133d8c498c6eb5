"""Order-dependent operators that do not hold a whole group in one task.

A single member may own a large share of all rows, so a window over a member is avoided: where an
aggregate can give the answer it does, and where the previous row is needed the group is first cut
into pieces along its own order.
"""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.functions.columns import as_col
from lendgrain.operators.relational import hot_keys
from lendgrain.session import cut_lineage


def _names(keys):
    return [keys] if isinstance(keys, str) else list(keys)


def dedup_keep(df: DataFrame, keys, largest) -> DataFrame:
    """One row per key: the one with the largest `largest` (nulls last, further ties by the other
    columns). Combined before the shuffle."""
    keys = _names(keys)
    rest = [c for c in df.columns if c not in keys]
    if rest == [largest]:
        return df.groupBy(*keys).agg(F.max(largest).alias(largest)).select(*df.columns)
    order = [largest] + [c for c in rest if c != largest]
    best = F.max(F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_b")).select(*[
        F.col(c) if c in keys else F.col(f"_b.{c}").alias(c) for c in df.columns])


def first_last(df: DataFrame, key, date, amount, col, first="first_value", last="last_value") -> DataFrame:
    """Value on the oldest and the newest row; equal dates go by larger amount, then smaller value."""
    keys = _names(key)
    a, v = F.col(amount), F.col(col)
    at = df.groupBy(*keys, date).agg(
        F.min(F.struct(F.coalesce(-a, F.lit(float("inf"))).alias("a"), v.alias("v"))).alias("_x"))
    return at.groupBy(*keys).agg(F.max_by(F.col("_x.v"), F.col(date)).alias(last),
                                 F.min_by(F.col("_x.v"), F.col(date)).alias(first))


def latest_value(df: DataFrame, key, order, col, name=None) -> DataFrame:
    """Value of the newest row by the given order columns (all descending)."""
    keys = _names(key)
    top = F.max(F.struct(*[F.col(c) for c in order], F.col(col).alias("_v")))
    return df.groupBy(*keys).agg(top.getField("_v").alias(name or col))


def newest_per(df: DataFrame, keys, order, cols) -> DataFrame:
    """The newest row per key: several columns at once."""
    keys = _names(keys)
    top = F.max(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{c}") for c in cols])).alias("_t")
    return df.groupBy(*keys).agg(top).select(*keys, *[F.col(f"_t._{c}").alias(c) for c in cols])


def in_chunks(df: DataFrame, keys, order, chunk) -> DataFrame:
    """Adds `_chunk`, which does not decrease along `order` within keys: the given column, and for the few values of it
    that hold more rows than an eighth of a task's share, the place in a range partitioning by the whole order."""
    x = cut_lineage(df.withColumn("_at", as_col(chunk)))
    hot = hot_keys(x, [*keys, "_at"])
    if hot is None:
        return x.withColumn("_chunk", F.struct("_at", F.lit(0).alias("piece"))).drop("_at")
    names = [*keys, "_at"]
    big = F.broadcast(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(names)]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(names)])
    parts = 8 * int(x.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    inside = x.join(big, same, "left_semi").repartitionByRange(parts, *keys, *order)
    inside = cut_lineage(inside.withColumn("_chunk", F.struct("_at", F.spark_partition_id().alias("piece"))))
    rest = x.join(big, same, "left_anti").withColumn("_chunk", F.struct("_at", F.lit(0).alias("piece")))
    return rest.unionByName(inside).drop("_at")


def chunked_lag(df: DataFrame, keys, order, chunk, cols, prefix="prev_") -> DataFrame:
    """lag(1) of `cols` within keys by `order`, cut into chunks.

    `chunk` must not decrease along `order` (for example its leading date). Rows look
    back within their chunk; the first row of a chunk takes the last row of the chunk before it. A
    group of any size is spread over its chunks, a chunk with very many rows over ranges of the order;
    only one row per chunk is windowed over the whole group.
    """
    keys = _names(keys)
    x = in_chunks(df, keys, order, chunk)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    row = F.struct(*[F.col(c) for c in cols])
    x = x.withColumns({"_prev": F.lag(row).over(inside), "_rn": F.row_number().over(inside)})
    tail = x.groupBy(*keys, "_chunk").agg(
        F.max(F.struct(F.col("_rn"), *[F.col(c).alias(f"_{c}") for c in cols])).alias("_t"))
    last = F.struct(*[F.col(f"_t._{c}").alias(c) for c in cols])
    before = tail.select(*keys, F.col("_chunk"),
                         F.lag(last).over(Window.partitionBy(*keys).orderBy("_chunk")).alias("_before"))
    # same keys as the window above, so its partitioning is kept
    j = x.join(before, keys + ["_chunk"], "left")
    prev = F.coalesce(F.col("_prev"), F.when(F.col("_rn") == 1, F.col("_before")))
    return j.select(*[c for c in df.columns], *[prev.getField(c).alias(prefix + c) for c in cols])


def gap_table(df: DataFrame, keys, date, extra=()) -> DataFrame:
    """Gaps in days between consecutive rows of a group, as (keys, date, gap, n).

    Rows of one day are counted first: they stand one gap apart from the day before and zero days
    from each other. A group then holds at most one row per calendar day.
    """
    keys = _names(keys)
    days = df.groupBy(*keys, date, *extra).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys).orderBy(date)
    d = days.withColumn("_gap", F.datediff(F.col(date), F.lag(date).over(w)))
    parts = F.array(F.struct(F.col("_gap").alias("gap"), F.lit(1).cast("long").alias("n")),
                    F.struct(F.lit(0).alias("gap"), (F.col("_n") - 1).alias("n")))
    return (d.select(*keys, date, *extra, F.explode(parts).alias("p")).select(*keys, date, *extra, "p.gap", "p.n")
            .filter(F.col("gap").isNotNull() & (F.col("n") > 0)))


def mean_gap(date, cond=None):
    """Mean days between consecutive dates of a group: the gaps add up to the whole span."""
    d = as_col(date) if cond is None else F.when(cond, as_col(date))
    return F.try_divide(F.datediff(F.max(d), F.min(d)).cast("double"), (F.count(d) - 1).cast("double"))


def reopened(df: DataFrame, keys, opened, closed, account, windows=(1, 3, 6, 12)) -> DataFrame:
    """Marks trades opened after the previous trade of the group had closed, and how soon."""
    x = chunked_lag(df, keys, [opened, account], opened, [closed])
    prev, o = F.col(f"prev_{closed}"), F.col(opened)
    again = prev.isNotNull() & (o > prev)
    x = x.withColumn("reopened", F.when(again, 1).otherwise(0))
    return x.withColumns({f"reopen_{m}m": F.when(again & (F.months_between(o, prev) < m), 1).otherwise(0)
                          for m in windows})


def latest_event(df: DataFrame, key, date, cond) -> DataFrame:
    """Date of the newest row with `cond` per key."""
    return df.groupBy(*_names(key)).agg(F.max(F.when(cond, F.col(date))).alias("latest_event"))
