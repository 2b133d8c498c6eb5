"""Joins, set operations, sorting."""

from functools import reduce
from math import ceil

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions.columns import as_col
from lendgrain.session import cut_lineage


SMALL_ROWS = 100_000


def is_small(df: DataFrame, rows=SMALL_ROWS) -> bool:
    """Looks: has the frame at most so many rows."""
    return df.limit(rows + 1).count() <= rows


# ---- joins ---------------------------------------------------------------------------------------
def join(left: DataFrame, right: DataFrame, on, how="inner", small_right=False) -> DataFrame:
    """Equi join. With `small_right` the right side is counted and broadcast if it is a small lookup;
    otherwise the strategy (and the splitting of skewed keys) is Spark's to choose."""
    return left.join(F.broadcast(right) if small_right and is_small(right) else right, on, how)


def anti_join(left, right, on):
    return left.join(right, on, "left_anti")


def band_join(scored: DataFrame, bands: DataFrame, value, lo, hi) -> DataFrame:
    """Each row with the band whose [lo, hi] holds its value; rows in no band are dropped.
    The band table is one row per bin (looked at), so it is broadcast."""
    if not is_small(bands):
        raise ValueError(f"a band table has at most {SMALL_ROWS} rows")
    v = as_col(value)
    return scored.join(F.broadcast(bands), (v >= F.col(lo)) & (v <= F.col(hi)))


def cross_small(left: DataFrame, right: DataFrame) -> DataFrame:
    """All pairs with a small constant table on the right (one row per bin or window; looked at)."""
    if not is_small(right, 1000):
        raise ValueError("pairs are made with at most 1000 rows on the right")
    return left.join(F.broadcast(right), F.lit(True))


LEAST_HOT = 10_000


def key_counts(df: DataFrame, keys) -> DataFrame:
    """(keys, n), written once."""
    return cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")))


def hot_keys(df: DataFrame, keys, least=None, counts=None):
    """(keys, n, salts) of the keys with more rows than an eighth of a task's share of all rows, None where there are
    none. There are at most eight times as many as shuffle partitions. `least`: never fewer rows than these. counts: the
    rows of key_counts, if they are at hand."""
    counts = key_counts(df, keys) if counts is None else counts
    parts = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max((counts.agg(F.sum("n")).first()[0] or 0) / parts, LEAST_HOT if least is None else least)
    hot = counts.where(F.col("n") > share).withColumn("salts", F.ceil(F.col("n") / share).cast("int"))
    return hot if hot.take(1) else None


ROWS_A_TASK, FEWEST_ROWS = 100_000, 10_000


def dealt(df: DataFrame, keys, work) -> DataFrame:
    """work(rows) with the rows dealt out by keys first, at most some ROWS_A_TASK to a task. Aggregates by the keys, or by the keys
    and more, then stand where their rows are: the narrow rows are shuffled and not the wide results, and a task's memory
    does not grow with the table. The rows of a key that is hot stay where they are, so that they are aggregated before
    their shuffle."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    counts = key_counts(df, keys)
    rows = counts.agg(F.sum("n")).first()[0] or 0
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(usual, ceil(rows / FEWEST_ROWS)), ceil(rows / ROWS_A_TASK))
    hot = hot_keys(df, keys, counts=counts)
    if hot is None:
        return work(df.repartition(parts, *keys))
    hot = F.broadcast(hot.select(*[F.col(k).alias(f"_h{i}") for i, k in enumerate(keys)]))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_h{i}")) for i, k in enumerate(keys)])
    rest = work(df.join(hot, same, "left_anti").repartition(parts, *keys))
    return rest.unionByName(work(df.join(hot, same, "left_semi")))


def salted(left: DataFrame, right: DataFrame, keys, least=None):
    """Both sides with a column `_salt` for a join by keys and salt: the rows of a key that is hot on the left are dealt
    over several salts, and its rows on the right repeated for each. (left, right), or None where no key is hot."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    hot = hot_keys(left, keys, least)
    if hot is None:
        return None
    hot = F.broadcast(hot.select(*keys, "salts"))
    several = F.coalesce(F.col("salts"), F.lit(1))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in left.columns])
    a = left.join(hot, keys, "left").withColumn("_salt", F.pmod(row, several).cast("int")).drop("salts")
    b = right.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), several - 1))).drop("salts")
    return a, b


def asof_join(records: DataFrame, dates: DataFrame, key, record_date, asof, include=False, least_hot=None) -> DataFrame:
    """Records known at each member's own as-of date. The records of a member with very many are dealt out over several
    tasks, and its dates repeated there."""
    keys = [key] if isinstance(key, str) else list(key)
    dealt = salted(records, dates, keys, least_hot)
    j = records.join(dates, keys) if dealt is None else dealt[0].join(dealt[1], [*keys, "_salt"]).drop("_salt")
    known = F.col(record_date) <= F.col(asof) if include else F.col(record_date) < F.col(asof)
    return j.filter(known)


def keyed_join(left, right, key):
    """Columns of two frames side by side, by an explicit key (never by row position)."""
    dup = [c for c in right.columns if c in left.columns and c not in ([key] if isinstance(key, str) else key)]
    return left.join(right.drop(*dup), key)


def asof_filter(df, asof, not_after=(), before=()):
    """Keeps records with each `not_after` date <= as-of and each `before` date < as-of."""
    ref = as_col(asof)
    for c in not_after:
        df = df.filter(as_col(c) <= ref)
    for c in before:
        df = df.filter(as_col(c) < ref)
    return df


def quality_filter(df, not_null=(), text_length=None, exclude=None):
    """not_null columns; text_length=(col, lo, hi); exclude=(col, values) drops those values (and nulls)."""
    for c in not_null:
        df = df.filter(as_col(c).isNotNull())
    if text_length:
        c, lo, hi = text_length
        df = df.filter(F.length(as_col(c)).between(lo, hi))
    if exclude:
        c, values = exclude
        df = df.filter(~as_col(c).isin(list(values)))
    return df


# ---- sets ----------------------------------------------------------------------------------------
def stack(frames):
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_set(a, b):
    return a.union(b).distinct()


def intersect(a, b):
    return a.intersect(b)


def minus(a, b):
    return a.subtract(b)


def distinct(df, cols):
    return df.select(*cols).distinct()


def unpivot(df, ids, cols, var="variable", value="value"):
    """Long form in one pass; values become double unless they already share a type."""
    types = {dict(df.dtypes)[c] for c in cols}
    if len(types) > 1:
        df = df.withColumns({c: F.col(c).cast("double") for c in cols})
    return df.unpivot([F.col(c) for c in ids], [F.col(c) for c in cols], var, value)


def sort(df, *keys):
    return df.orderBy(*keys)


def head(df, n):
    return df.limit(n)
