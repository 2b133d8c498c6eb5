"""Weight of evidence and information value."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.modelling.binning import bin_counts, cut
from lendgrain.modelling.quantile import quantile_edges, value_table

SIGNS = ("event", "non_event")


def _share(x, total, guard, eps):
    if guard == "max_half":
        return F.greatest(x.cast("double"), F.lit(0.5)) / total
    if guard == "add_half":
        return (x + 0.5) / total
    if guard == "eps":
        return x / total + F.lit(eps)
    return x / total


def woe_iv(bins: DataFrame, n="total", events="events", sign="event", guard="max_half", eps=1e-8, by=()) -> DataFrame:
    """bins(variable, bin, total, events) -> shares, woe, iv. sign="event" is ln(event share / non-event
    share), "non_event" the inverse. guard: max_half, add_half, eps or None (a bin without one outcome
    then has an infinite woe)."""
    w = Window.partitionBy("variable", *by)
    e = F.col(events).cast("double")
    ne = F.col(n).cast("double") - e
    x = bins.withColumns({"_e": e, "_ne": ne})
    x = x.withColumns({
        "non_events": F.col("_ne"),
        "event_share": _share(F.col("_e"), F.sum("_e").over(w), guard, eps),
        "non_event_share": _share(F.col("_ne"), F.sum("_ne").over(w), guard, eps)})
    ratio = F.try_divide("event_share", "non_event_share") if sign == "event" else F.try_divide("non_event_share", "event_share")
    woe = F.when(F.col("non_event_share") == 0 if sign == "event" else F.col("event_share") == 0, F.lit(float("inf"))) \
        .when(ratio == 0, F.lit(float("-inf"))).otherwise(F.ln(ratio))
    x = x.withColumn("woe", woe)
    diff = F.col("event_share") - F.col("non_event_share")
    return x.withColumn("iv", F.col("woe") * (diff if sign == "event" else -diff)).drop("_e", "_ne")


def variable_bins(df: DataFrame, target, numeric=(), categorical=(), bins=10, max_values=10, weight=None) -> DataFrame:
    """(variable, bin, total, events): numbers with more than max_values values are cut at quantiles, the
    rest grouped by value; null is a group of its own."""
    parts = []
    if numeric:
        vt = value_table(df, numeric, target, weight, keep_null=True)
        known = vt.filter(F.col("value").isNotNull())
        # quantiles are taken from the same counted values, so the data is shuffled once
        few = known.groupBy("variable").agg((F.count(F.lit(1)) <= max_values).alias("few"))
        c = cut(vt, quantile_edges(known, bins)).join(F.broadcast(few), "variable", "left")
        label = (F.when(F.col("value").isNull(), "missing").when(F.col("few"), F.col("value").cast("string"))
                 .otherwise(F.col("bin").cast("string")))
        parts.append(c.withColumn("bin", label))
    if categorical:
        extra = [target] + ([weight] if weight else [])
        long = df.select(*extra, *categorical).unpivot(extra, list(categorical), "variable", "value")
        aggs = [F.count(F.lit(1)).alias("n"), F.sum(target).cast("long").alias("events"), F.lit(None).cast("double").alias("value")]
        if weight:
            aggs += [F.sum(weight).alias("w"), F.sum(F.col(weight) * F.col(target)).alias("we")]
        parts.append(long.groupBy("variable", F.coalesce("value", F.lit("missing")).alias("bin")).agg(*aggs))
    keep = ["variable", "bin", "value", "n", "events"] + (["w", "we"] if weight else [])
    out = parts[0].select(*keep)
    for p in parts[1:]:
        out = out.unionByName(p.select(*keep))
    return bin_counts(out, weighted=bool(weight))


def iv_summary(table: DataFrame, floor=None) -> DataFrame:
    """IV per variable with its band; infinite ones are dropped."""
    s = table.groupBy("variable").agg(F.sum("iv").alias("iv")).filter(~F.col("iv").isin(float("inf"), float("-inf")))
    b = F.lit(V.IV_BANDS[-1][1])
    for limit, name in reversed(V.IV_BANDS[:-1]):
        b = F.when(F.col("iv") < limit, F.lit(name)).otherwise(b)
    s = s.withColumn("band", b)
    return s.filter(F.col("iv") > floor) if floor is not None else s


def neutralise(table: DataFrame, overrides: DataFrame) -> DataFrame:
    """Adds woe_upd and iv_upd: 0 for the (variable, bin) pairs listed in overrides."""
    o = overrides.select("variable", "bin").distinct().withColumn("_hit", F.lit(1))
    j = table.join(o, ["variable", "bin"], "left")
    hit = F.col("_hit").isNotNull()
    return j.withColumns({"woe_upd": F.when(hit, 0.0).otherwise(F.col("woe")),
                          "iv_upd": F.when(hit, 0.0).otherwise(F.col("iv"))}).drop("_hit")


def woe_transform(binned: DataFrame, table: DataFrame, cols, value="woe") -> DataFrame:
    """Adds <col>_woe next to <col>_bin. The table (a handful of bins for each variable) is read once and
    becomes one map for each variable, looked up in one projection without a join."""
    known = {c: {} for c in cols}
    for r in table.filter(F.col("variable").isin(list(cols))).select("variable", F.col("bin").cast("string").alias("bin"), F.col(value).cast("double").alias("woe")).collect():
        known[r["variable"]][r["bin"]] = r["woe"]
    out = {}
    for c, bins in known.items():
        pairs = [F.lit(x) for b, w in bins.items() if b is not None for x in (b, w)]
        found = F.try_element_at(F.create_map(*pairs), F.col(f"`{c}_bin`").cast("string")) if pairs else F.lit(None)
        out[f"{c}_woe"] = found.cast("double")
    return binned.withColumns(out)


def bivariate(df: DataFrame, cols, target, bins=10) -> DataFrame:
    """Per bin: range, counts, shares of all records, event rate. Shares are fractions."""
    vt = value_table(df, cols, target, keep_null=True)
    edges = quantile_edges(vt.filter(F.col("value").isNotNull()), bins)
    c = bin_counts(cut(vt, edges, open_ends=True))
    return _shares(c, ("variable",), 1)


def _shares(c, keys, scale):
    w = Window.partitionBy(*keys)
    records = F.sum("total").over(w)
    x = c.withColumns({"non_events": F.col("total") - F.col("events"), "_r": records})
    return x.withColumns({
        "events_perc": F.col("events") * scale / F.col("_r"), "non_events_perc": F.col("non_events") * scale / F.col("_r"),
        "pop_perc": F.col("total") * scale / F.col("_r"), "event_rate": F.col("events") / F.col("total")}).drop("_r")


def woe_bivariate(df: DataFrame, cols, target, sample, train="Train", bins=10) -> DataFrame:
    """bivariate with WOE for every sample on the edges of the training sample (shares x100)."""
    vt = value_table(df, cols, target, by=(sample,), keep_null=True)
    edges = quantile_edges(vt.filter((F.col(sample) == train) & F.col("value").isNotNull()).drop(sample), bins)
    c = bin_counts(cut(vt, edges, open_ends=True), (sample, "variable"))
    s = _shares(c, (sample, "variable"), 100)
    return woe_iv(s, guard="eps", by=(sample,)).drop("event_share", "non_event_share", "iv")


def woe_check(table: DataFrame, by=()) -> DataFrame:
    """Does the WOE move one way over the numbered bins?"""
    w = Window.partitionBy(*by, "variable").orderBy("bin")
    step = F.col("woe") - F.lag("woe").over(w)
    x = table.filter(F.col("bin") > 0).withColumn("_s", step)
    return x.groupBy(*by, "variable").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum(F.when(F.col("_s") > 0, 1).otherwise(0)).alias("n_up"),
        F.sum(F.when(F.col("_s") < 0, 1).otherwise(0)).alias("n_down")).withColumn(
        "monotone", (F.col("n_up") == 0) | (F.col("n_down") == 0))
