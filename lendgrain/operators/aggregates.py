"""Grouped aggregation."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.functions import history as H
from lendgrain.functions.columns import as_col, safe_ratio, settle
from lendgrain.operators.relational import is_small
from lendgrain.session import cut_lineage


def key_names(key) -> list:
    """A key is a name or several (member, or member and month)."""
    return [key] if isinstance(key, str) else list(key)


def group_agg(df: DataFrame, keys, aggs) -> DataFrame:
    """keys: a name or several (member, or member and month)."""
    return df.groupBy(*key_names(keys)).agg(*aggs)


def exprs(texts):
    """Expression text to Columns; each text carries its own name."""
    return [F.expr(t) for t in texts]


def count_if(cond):
    return f"sum(case when {cond} then 1 else 0 end)"


def sum_if(cond, measure, absent="null"):
    """Sum of a measure over the rows with cond; absent="zero" makes a group without any 0."""
    return f"sum(case when {cond} then {measure}{' else 0' if absent == 'zero' else ''} end)"


def cond_sum(cond, measure=1, absent="zero"):
    """Sum of measure where cond holds. absent="zero": rows that miss count 0;
    absent="null": a group with no hit is null."""
    m = F.lit(measure) if isinstance(measure, (int, float)) else as_col(measure)
    miss = F.lit(0) if absent == "zero" else F.lit(None)
    return F.sum(F.when(cond, m).otherwise(miss))


def cond_count(cond):
    return F.count(F.when(cond, F.lit(1)))


def cond_agg(fn, measure, cond, absent="null"):
    m = as_col(measure)
    x = F.when(cond, m) if absent == "null" else F.when(cond, m).otherwise(F.lit(0))
    return getattr(F, fn)(x)


def medians(df: DataFrame, keys, measures) -> DataFrame:
    """Exact medians of several measures (name: column) for each key. Equal values are counted first, combined before the
    shuffle; the counts are then added up in order of value, in a window that spills. No group is held in a buffer.
    A measure without values has a null median; a key without any has no row."""
    keys, names = key_names(keys), list(measures)
    long = df.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("_name"), as_col(c).cast("double").alias("_value")) for n, c in measures.items()])).alias("_m"))
    counts = long.select(*keys, "_m.*").where("_value is not null").groupBy(*keys, "_name", "_value").agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys, "_name")
    placed = counts.select("*", F.sum("_n").over(group.orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)).alias("_upto"), F.sum("_n").over(group).alias("_all"))
    at = lambda rank: F.max(F.when((F.col("_upto") >= rank) & (F.col("_upto") - F.col("_n") < rank), F.col("_value")))
    middle = (at(F.floor((F.col("_all") + 1) / 2)) + at(F.floor(F.col("_all") / 2) + 1)) / 2
    return placed.groupBy(*keys).pivot("_name", names).agg(middle).select(*keys, *[F.col(f"`{n}`") for n in names])


def with_medians(df: DataFrame, keys, aggs, measures) -> DataFrame:
    """group_agg with medians (name: column) as more columns, last."""
    keys = key_names(keys)
    side = medians(df, keys, measures).withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    both = group_agg(df, keys, aggs).join(side, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]), "left")
    return both.drop(*[f"_k{i}" for i in range(len(keys))])


def group_moments(df: DataFrame, keys, col, digits=4) -> DataFrame:
    """avg, max, min, stddev, skewness, kurtosis and median of a measure for each key."""
    out = with_medians(df, keys, [c.alias(n) for n, c in moments(col, digits).items()], {"median": col})
    return out.withColumn("median", settle(F.col("median"), digits))


def moments(col, digits=4):
    """avg, max, min, stddev, skewness, kurtosis (group_moments has the median too)."""
    c = as_col(col)
    return {"avg": settle(F.avg(c), digits), "max": settle(F.max(c), digits), "min": settle(F.min(c), digits),
            "stddev": settle(F.stddev(c), digits), "skewness": settle(F.skewness(c), digits),
            "kurtosis": settle(F.kurtosis(c), digits)}


def coef_var(stddev, mean, digits=4):
    """stddev/mean; null for a zero mean."""
    return settle(safe_ratio(stddev, mean, None, None, None), digits)


def constant_of(col):
    """The value of a column that is constant within the group."""
    return F.max(as_col(col))


def group_stats(df: DataFrame, keys, col, prefix="") -> DataFrame:
    """min, max, mean and median of a measure for each key."""
    c = as_col(col)
    return with_medians(df, keys, [F.min(c).alias(f"{prefix}min"), F.max(c).alias(f"{prefix}max"), F.avg(c).alias(f"{prefix}mean")], {f"{prefix}median": c})


def row_max(*cols):
    return F.greatest(*[as_col(c) for c in cols])


def group_count(df, keys):
    return df.groupBy(*key_names(keys)).agg(F.count(F.lit(1)).alias("n"))


def weighted_agg(df, keys, target, weight):
    t, w = as_col(target), as_col(weight)
    return group_agg(df, keys, [F.sum(w).alias("total"), F.sum(t * w).alias("events"),
                                F.sum((1 - t) * w).alias("non_events")])


def monthly_totals(df: DataFrame, key, arr, split, n=H.SLOTS) -> DataFrame:
    """(key, split) -> array of n monthly sums; null where nothing was reported.

    `split` is a column naming the part a row belongs to. One sum per slot keeps the row count and
    lets the sums be combined before the shuffle.
    """
    keys = key_names(key)
    sums = [F.sum(H.slot(arr, i)).alias(f"_s{i}") for i in range(1, n + 1)]
    g = df.groupBy(*keys, as_col(split).alias("part")).agg(*sums)
    return g.select(*keys, "part", F.array(*[f"_s{i}" for i in range(1, n + 1)]).alias("totals"))


def trend_counts(totals, horizons=(12, 24, 36), tol=500):
    out = []
    for n in horizons:
        out.append(H.rises(totals, n, tol).alias(f"rise_{n}m"))
        out.append(H.falls(totals, n, tol).alias(f"fall_{n}m"))
    return out


def distinct_within(df, key, col, age, windows):
    """Exact number of distinct values seen within each window: the newest age per (key, value) first,
    so each value is counted once per key without a distinct aggregate per window. A window of None
    is all time and also counts values whose age is unknown."""
    keys = key_names(key)
    newest = df.groupBy(*keys, col).agg(F.min(age).alias("_age")).filter(F.col(col).isNotNull())
    return newest.groupBy(*keys).agg(*[
        F.count(F.lit(1) if w is None else F.when(F.col("_age") <= w, 1)).alias(name) for name, w in windows.items()])


def sum_at_extreme(df: DataFrame, keys, measures) -> DataFrame:
    """For each (name, measure, which, take): the sum of `take` over all rows whose measure equals
    the group's max or min (ties are added up); null where no row has the measure.

    All extremes of a group come from one aggregate and are joined back, then the sums from a second one, so that
    every row is shuffled once as it is and a very large group is split.
    """
    keys = key_names(keys)
    columns, tops, sums = {}, {}, []
    for i, (name, measure, which, take) in enumerate(measures):
        m, t = columns.setdefault(str(measure), (f"_m{len(columns)}", measure))[0], f"_t{i}"
        tops.setdefault((m, which), f"_x{len(tops)}")
        sums.append((name, m, tops[m, which], t, take))
    x = df.select(*keys, *[as_col(m).cast("double").alias(c) for c, m in columns.values()], *[as_col(take).cast("double").alias(t) for *_, t, take in sums])
    # a group without any of the measures has no row; read twice below, so the input is computed once
    x = cut_lineage(x.where(F.coalesce(*[F.col(c) for c, _ in columns.values()]).isNotNull()))
    best = x.groupBy(*keys).agg(*[getattr(F, which)(m).alias(c) for (m, which), c in tops.items()])
    best = best.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(keys)})
    near = x.join(best, reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]))
    out = near.groupBy(*keys).agg(*[F.sum(F.when(F.col(m) == F.col(top), F.col(t))).alias(name) for name, m, top, t, _ in sums])
    return out


def _report(df, rows=10_000):
    """Tables of one row per bin or decile fit one task; anything else is refused."""
    if not is_small(df, rows):
        raise ValueError(f"a report table has at most {rows} rows")


def running_totals(df, order, cols, ascending=True, prefix="cum_"):
    """Running sums down a small table (one row per bin or decile)."""
    _report(df)
    o = as_col(order)
    w = Window.orderBy(o.asc() if ascending else o.desc()).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({prefix + c: F.sum(c).over(w) for c in cols})


def row_index(df, order, name="decile", ascending=True):
    """Row number down a small table."""
    _report(df)
    o = as_col(order)
    return df.withColumn(name, F.row_number().over(Window.orderBy(o.asc() if ascending else o.desc())))
