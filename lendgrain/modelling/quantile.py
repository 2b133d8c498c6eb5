"""Exact quantiles and running sums over a whole column, without one task ever seeing the column.

Work is done on distinct values: rows are counted per value first (combined before the shuffle), the
values of all variables are dealt out by range into pieces of similar size, the small table of piece
totals gives each piece its starting rank, and only inside a piece are values sorted. A variable of few
values lies in one piece, one of very many in as many as it needs.
"""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.operators.relational import unpivot
from lendgrain.session import cut_lineage

VALUES_PER_PIECE = 100_000
BROADCAST_NUMBERS = 2_000_000


def lookup(df: DataFrame, keys, width=1) -> DataFrame:
    """A table of a few rows (of `width` numbers) for each variable, and for each group where there are any. It is
    counted, broadcast up to a limit, and joined by its keys beyond."""
    df = cut_lineage(df)
    return F.broadcast(df) if df.count() * width <= BROADCAST_NUMBERS else df


def n_pieces(vt: DataFrame) -> int:
    """So many that a piece has about VALUES_PER_PIECE distinct values."""
    return 1 + vt.count() // VALUES_PER_PIECE


def value_table(df: DataFrame, cols, target=None, weight=None, by=(), keep_null=False) -> DataFrame:
    """(by, variable, value) with n and, if asked for, events, w, we (weighted events). Everything else is
    taken from this table, so it is computed once and cut from its source, which is read this one time."""
    extra = list(by) + [c for c in (target, weight) if c]
    x = df.select(*extra, *[F.col(c).cast("double").alias(c) for c in cols if c not in extra])
    long = unpivot(x, extra, list(cols))
    if not keep_null:
        long = long.filter(F.col("value").isNotNull())
    aggs = [F.count(F.lit(1)).alias("n")]
    if target:
        aggs.append(F.sum(target).cast("long").alias("events"))
    if weight:
        aggs.append(F.sum(weight).alias("w"))
        if target:
            aggs.append(F.sum(F.col(weight) * F.col(target)).alias("we"))
    return cut_lineage(long.groupBy(*by, "variable", "value").agg(*aggs))


def _pieces(vt, keys, pieces):
    """Values with the piece they are in; pieces follow each other in order of (keys, value)."""
    if pieces == 1:
        return vt.withColumn("_piece", F.lit(0))
    # written, so that a piece keeps its rows whatever is run again
    return cut_lineage(vt.repartitionByRange(pieces, *keys, "value").withColumn("_piece", F.spark_partition_id()))


def _piece_starts(pv, keys, sums):
    """One row per variable and piece it has values in: what lies before it (at most variables + pieces rows)."""
    tot = pv.groupBy(*keys, "_piece").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    w = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy(*keys)
    return tot.select("*", *[F.coalesce(F.sum(f"_t_{c}").over(w), F.lit(0)).alias(f"_b_{c}") for c in sums],
                      *[F.sum(f"_t_{c}").over(all_).alias(f"_all_{c}") for c in sums])


def running_sums(vt: DataFrame, sums, keys=("variable",), pieces=None) -> DataFrame:
    """Adds before_<c> (sum over smaller values) and all_<c> to each value."""
    keys, pieces = list(keys), pieces or n_pieces(vt)
    pv = _pieces(vt, keys, pieces)
    starts = _piece_starts(pv, keys, sums)
    w = Window.partitionBy(*keys, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    j = pv.join(lookup(starts, keys, 2 * len(sums)), keys + ["_piece"])
    return j.select(*vt.columns, *[(F.col(f"_b_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"before_{c}") for c in sums],
                    *[F.col(f"_all_{c}").alias(f"all_{c}") for c in sums])


def quantiles(vt: DataFrame, probs, kind=7, keys=("variable",), pieces=None) -> DataFrame:
    """(keys, n, q): q is the array of quantiles. kind 7 interpolates at position (n-1)p+1, kind 8
    at (n+1/3)p+1/3."""
    keys, pieces = list(keys), pieces or n_pieces(vt)
    pv = _pieces(vt.select(*keys, "value", "n"), keys, pieces)
    starts = cut_lineage(_piece_starts(pv, keys, ["n"]))
    # the tables of wanted ranks below have at most two rows a probability for each row of this one
    side = F.broadcast if starts.count() * (3 + 4 * len(probs)) <= BROADCAST_NUMBERS else lambda df: df
    starts = side(starts)
    # zero-based position; type 8 positions a hair below a whole number count as whole
    pos = "(_all_n - 1) * p" if kind == 7 else "(_all_n + 1D/3) * p + 1D/3 - 1"
    fuzz = 0.0 if kind == 7 else 1e-9
    total = starts.groupBy(*keys).agg(F.max("_all_n").alias("_all_n"))
    ranks = (total.select(*keys, F.col("_all_n"), F.posexplode(F.array(*[F.lit(float(p)) for p in probs])).alias("i", "p"))
             .withColumn("h", F.expr(pos))
             .withColumn("j", F.floor(F.col("h") + fuzz))
             .withColumn("frac", F.when(F.abs(F.col("h") - F.col("j")) < fuzz, 0.0).otherwise(F.col("h") - F.col("j")))
             .withColumn("lo", F.greatest(F.least(F.col("j") + 1, F.col("_all_n")), F.lit(1)))
             .withColumn("hi", F.greatest(F.least(F.col("j") + 2, F.col("_all_n")), F.lit(1))))
    wanted = ranks.select(*keys, F.explode(F.array("lo", "hi")).alias("rank")).distinct()
    # only the pieces that hold a wanted rank are sorted
    need = (starts.join(side(wanted), keys)
            .filter((F.col("rank") > F.col("_b_n")) & (F.col("rank") <= F.col("_b_n") + F.col("_t_n")))
            .groupBy(*keys, "_piece", "_b_n").agg(F.collect_list("rank").alias("ranks")))
    w = Window.partitionBy(*keys, "_piece").orderBy("value").rowsBetween(Window.unboundedPreceding, 0)
    got = (pv.join(side(need), keys + ["_piece"])
           .withColumn("_upto", F.col("_b_n") + F.sum("n").over(w))
           .select(*keys, "value", F.explode(F.expr("filter(ranks, r -> r <= _upto and r > _upto - n)")).alias("rank")))
    got = side(cut_lineage(got))
    lo = got.withColumnsRenamed({"rank": "lo", "value": "v_lo"})
    hi = got.withColumnsRenamed({"rank": "hi", "value": "v_hi"})
    q = (ranks.join(lo, keys + ["lo"]).join(hi, keys + ["hi"])
         .withColumn("q", F.col("v_lo") + F.col("frac") * (F.col("v_hi") - F.col("v_lo"))))
    return q.groupBy(*keys).agg(F.max("_all_n").alias("n"), F.expr("transform(array_sort(collect_list(struct(i, q))), s -> s.q)").alias("q"))


def even_probs(n):
    return [i / n for i in range(n + 1)]


def quantile_edges(vt, n=10, kind=7, keys=("variable",), pieces=None):
    """(keys, edges): distinct quantile edges, n+1 at most."""
    return quantiles(vt, even_probs(n), kind, keys, pieces).select(*keys, F.array_distinct("q").alias("edges"))
