"""How well a score separates events from the rest."""

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.modelling.binning import cut
from lendgrain.modelling.quantile import even_probs, quantile_edges, quantiles, running_sums, value_table
from lendgrain.operators.relational import band_join

RUN = (Window.unboundedPreceding, 0)


def score_table(df, target="target", prob="prob", by=(), weight=None) -> DataFrame:
    """The counted scores (by, value, n, events) that all measures can be taken from: the source is read once. Every
    function below that takes a frame of scores takes such a table as `counted` instead."""
    return value_table(df, [prob], target, weight, by=by)


def score_bins(df, target="target", prob="prob", n=10, kind=7, edges=None, by=(), weight=None, counted=None) -> DataFrame:
    """(by, bin): counts of each score bin. `edges` are given cut points; else the sample's own quantiles."""
    vt = score_table(df, target, prob, by, weight) if counted is None else counted
    keys = [*by, "variable"]
    if edges is None:
        c = cut(vt, quantile_edges(vt, n, kind, keys), keys)
    else:
        c = vt.withColumn("edges", F.array(*[F.lit(float(e)) for e in edges]))
        c = c.withColumn("bin", F.expr("case when value between edges[0] and edges[size(edges) - 1] "
                                       "then greatest(1, size(filter(edges, e -> e < value))) end"))
    aggs = [F.min("value").alias("min_prob"), F.max("value").alias("max_prob"),
            (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("avg_prob"),
            F.sum("n").alias("total"), F.sum("events").alias("events")]
    if weight:
        aggs += [F.sum("w").alias("w"), F.sum("we").alias("we")]
    return c.filter("bin is not null").groupBy(*by, "bin").agg(*aggs).withColumn("nonevents", F.col("total") - F.col("events"))


def train_edges(df, prob="prob", n=10, kind=8, counted=None):
    """Cut points for use on other samples: the inner quantiles between 0 and 1. The outer two of all
    n + 1 are replaced before equal ones are dropped, so a tie at an end keeps its cut point."""
    q = quantiles(value_table(df, [prob]) if counted is None else counted, even_probs(n), kind).first()["q"]
    return sorted({0.0, 1.0, *(float(x) for x in q[1:-1])})


def _cum(bins, by, ascending):
    order = F.col("bin").asc() if ascending else F.col("bin").desc()
    run = Window.partitionBy(*by).orderBy(order).rowsBetween(*RUN)
    allw = Window.partitionBy(*by)
    return bins.withColumns({
        "cum_event": F.sum("events").over(run), "cum_nonevent": F.sum("nonevents").over(run),
        "_e": F.sum("events").over(allw), "_ne": F.sum("nonevents").over(allw), "_n": F.sum("total").over(allw),
        "_row": F.row_number().over(Window.partitionBy(*by).orderBy(F.col("bin").asc()))})


def ks_table(df, target="target", prob="prob", n=10, by=(), counted=None) -> DataFrame:
    """Deciles from the highest score down: rates, cumulative rates, bad rate and signed KS."""
    x = _cum(score_bins(df, target, prob, n, 7, by=by, counted=counted), by, False)
    ce, cn = F.col("cum_event") / F.col("_e"), F.col("cum_nonevent") / F.col("_ne")
    return x.select(
        *by, F.col("_row").alias("decile"), "min_prob", "max_prob", "avg_prob", "events", "nonevents",
        (F.col("events") / F.col("_e")).alias("event_rate"), (F.col("nonevents") / F.col("_ne")).alias("nonevent_rate"),
        ce.alias("cum_eventrate"), cn.alias("cum_noneventrate"), (F.col("events") * 100 / F.col("total")).alias("bad_rate"),
        (F.round(ce - cn, 5) * 100).alias("ks"))


def _decile_table(bins, by, ascending):
    x = _cum(bins, by, ascending)
    order = F.col("bin").asc() if ascending else F.col("bin").desc()
    w = Window.partitionBy(*by).orderBy(order)
    ce, cn = F.col("cum_event") / F.col("_e"), F.col("cum_nonevent") / F.col("_ne")
    x = x.withColumns({"pct_cum_event": ce, "pct_cum_nonevent": cn})
    return x.withColumns({"_le": F.coalesce(F.lag("pct_cum_event").over(w), F.lit(0.0)),
                          "_ln": F.coalesce(F.lag("pct_cum_nonevent").over(w), F.lit(0.0))})


def decile_table(df, target="target", prob="prob", n=10, edges=None, ascending=True, by=(), counted=None) -> DataFrame:
    """Decile report with population share, event rate, cumulative shares, KS in percent and each
    decile's part of the Gini area."""
    x = _decile_table(score_bins(df, target, prob, n, 8, edges, by, counted=counted), by, ascending)
    return x.select(
        *by, F.col("_row").alias("decile"), "nonevents", "events", "total", (F.col("total") / F.col("_n")).alias("pct_pop"),
        (F.col("events") / F.col("total")).alias("event_rate"), "cum_nonevent", "cum_event", "pct_cum_nonevent", "pct_cum_event",
        F.round(F.abs(F.col("pct_cum_nonevent") - F.col("pct_cum_event")) * 100, 2).alias("ks"),
        ((F.col("pct_cum_event") + F.col("_le")) * (F.col("pct_cum_nonevent") - F.col("_ln")) * 0.5).alias("gini"))


def gini_ks(df, target="target", prob="prob", n=10, edges=None, by=(), counted=None) -> DataFrame:
    """Gini (trapezoids over ascending deciles) and KS, to four digits."""
    x = _decile_table(score_bins(df, target, prob, n, 8, edges, by, counted=counted), by, True)
    area = F.sum((F.col("pct_cum_event") - F.col("_le")) * (F.col("pct_cum_nonevent") + F.col("_ln")) * 0.5)
    return x.groupBy(*by).agg(F.round((area - 0.5) * 2, 4).alias("gini"),
                              F.round(F.max(F.abs(F.col("pct_cum_nonevent") - F.col("pct_cum_event"))), 4).alias("ks"))


def auc(df, target="target", prob="prob", by=(), auto_direction=False, digits=4, counted=None) -> DataFrame:
    """Exact area under the ROC curve, ties counted half."""
    vt = score_table(df, target, prob, by) if counted is None else counted
    vt = vt.withColumn("ne", F.col("n") - F.col("events"))
    r = running_sums(vt, ["ne", "events"], [*by, "variable"])
    wins = F.sum((F.col("before_ne") + F.col("ne") / 2) * F.col("events"))
    a = wins / (F.max("all_ne").cast("double") * F.max("all_events"))
    if auto_direction:
        a = F.greatest(a, 1 - a)
    return r.groupBy(*by).agg(F.round(a, digits).alias("auc"))


def weighted_metrics(df, target="target", prob="prob", weight="weight", by=("sample",)) -> DataFrame:
    """Total weight, KS, Gini and ROC area in percent, with row weights, over all distinct scores."""
    vt = value_table(df, [prob], target, weight, by=by).withColumn("wn", F.col("w") - F.col("we"))
    r = running_sums(vt, ["we", "wn"], [*by, "variable"])
    ce = (F.col("before_we") + F.col("we")) / F.col("all_we")
    cn = (F.col("before_wn") + F.col("wn")) / F.col("all_wn")
    area = F.sum((F.col("before_wn") + F.col("wn") / 2) * F.col("we")) / (F.max("all_we") * F.max("all_wn"))
    return r.groupBy(*by).agg(F.sum("w").alias("total"), (F.max(F.abs(ce - cn)) * 100).alias("ks"),
                              ((area * 2 - 1) * 100).alias("gini"), (area * 100).alias("roc"))


def gains_table(df, target="target", prob="prob", weight="weight", n=10, breaks=None, by=()) -> DataFrame:
    """Weighted gains from the highest interval down; lift is the cumulative gain over the cumulative
    population share."""
    edges = sorted(breaks) if breaks else None
    b = score_bins(df, target, prob, n, 7, edges, by, weight)
    run = Window.partitionBy(*by).orderBy(F.col("bin").desc()).rowsBetween(*RUN)
    allw = Window.partitionBy(*by)
    x = b.withColumns({"wn": F.col("w") - F.col("we"), "interval": F.row_number().over(Window.partitionBy(*by).orderBy(F.col("bin").desc()))})
    cum_e = F.sum("we").over(run) / F.sum("we").over(allw)
    cum_n = F.sum("wn").over(run) / F.sum("wn").over(allw)
    cum_p = F.sum("w").over(run) / F.sum("w").over(allw)
    return x.select(*by, "interval", "min_prob", "max_prob", F.col("w").alias("total"), F.col("we").alias("events"), F.col("wn").alias("nonevents"),
                    (F.col("we") / F.col("w")).alias("event_rate"), cum_e.alias("gain"), cum_n.alias("cum_nonevent"), cum_p.alias("cum_pop"),
                    (F.abs(cum_e - cum_n) * 100).alias("ks"), (cum_e / cum_p).alias("lift"))


def rank_order(table, by=(), order="decile", rate="event_rate") -> DataFrame:
    """Number of places where the event rate falls although the decile rises."""
    w = Window.partitionBy(*by).orderBy(order)
    x = table.withColumn("_b", F.when(F.col(rate) < F.lag(rate).over(w), 1).otherwise(0))
    return x.groupBy(*by).agg(F.sum("_b").alias("breaks")).withColumn("ordered", F.col("breaks") == 0)


def model_summary(df, target="target", prob="prob", sample="sample", train="Train", edges=None, tolerance=0.07) -> DataFrame:
    """AUC, Gini, KS and the drop of KS against training, per sample, on the training cut points."""
    counted = score_table(df, target, prob, (sample,))
    if edges is None:
        edges = train_edges(df, prob, counted=counted.filter(F.col(sample) == train).drop(sample))
    g = gini_ks(df, edges=edges, by=(sample,), counted=counted).join(auc(df, by=(sample,), counted=counted), sample)
    base = F.broadcast(g.filter(F.col(sample) == train).select(F.col("ks").alias("_t")))
    x = g.join(base, F.lit(True))
    drop = F.try_divide(F.col("_t") - F.col("ks"), F.col("_t"))
    return x.select(sample, "auc", "gini", "ks", drop.alias("ks_drop"), (F.abs(drop) <= tolerance).alias("within_tolerance"))


def validation_perf(train_table, scored, target="target", prob="prob", n=10) -> DataFrame:
    """A new population on the score ranges of the training deciles; scores in no range are left out of
    the deciles but stay in the totals."""
    s = scored.filter(F.col(target).isin(0, 1)).groupBy(prob).agg(F.count(F.lit(1)).alias("n"), F.sum(target).alias("e"))
    return _on_ranges(train_table, s, prob, n)


def validation_report(df, target="target", prob="prob", sample="sample", train="Train", new="OOT", n=10) -> DataFrame:
    """validation_perf of one sample on the deciles of another, both taken from scores that are counted once. Rows
    without a known target are left out."""
    counted = score_table(df.filter(F.col(target).isin(0, 1) & F.col(sample).isin(train, new)), target, prob, (sample,))
    of = lambda s: counted.filter(F.col(sample) == s).drop(sample)
    table = ks_table(df, n=n, counted=of(train))
    return _on_ranges(table, of(new).select(F.col("value").alias(prob), "n", F.col("events").alias("e")), prob, n)


def _on_ranges(train_table, s, prob, n):
    """s: score, n, e (events)."""
    bands = train_table.select(F.col("decile"), F.col("min_prob").alias("lo"), F.col("max_prob").alias("hi"))
    # a score on a shared border belongs to every range that holds it
    j = band_join(s, bands, prob, "lo", "hi")
    g = j.groupBy("decile", "lo", "hi").agg(
        (F.sum(F.col(prob) * F.col("n")) / F.sum("n")).alias("avg_prob"), F.sum("n").alias("num_cust"), F.sum("e").alias("events"))
    tot = F.broadcast(s.agg(F.sum("e").alias("_e"), F.sum(F.col("n") - F.col("e")).alias("_ne")))
    g = g.withColumn("nonevents", F.col("num_cust") - F.col("events")).join(tot, F.lit(True))
    run = Window.orderBy("decile").rowsBetween(*RUN)
    whole = Window.partitionBy()
    ce, cn = F.sum("events").over(run) / F.col("_e"), F.sum("nonevents").over(run) / F.col("_ne")
    low = F.sum(F.when(F.col("decile") < n // 2 + 1, F.col("num_cust")).otherwise(0)).over(whole)
    return g.select("decile", "lo", "hi", "avg_prob", "num_cust", "events", "nonevents",
                    (F.col("events") / F.col("_e")).alias("event_rate"), (F.col("nonevents") / F.col("_ne")).alias("nonevent_rate"),
                    ce.alias("cum_eventrate"), cn.alias("cum_noneventrate"), (F.col("events") * 100 / F.col("num_cust")).alias("bad_rate"),
                    F.abs(F.round(ce - cn, 5) * 100).alias("ks"),
                    (F.round(F.col("num_cust") / F.sum("num_cust").over(whole), 5) * 100).alias("population_percent"),
                    (low / F.sum("num_cust").over(whole)).alias("low_half_share"))


def capture_conversion(df, flags, bad) -> DataFrame:
    """Per early flag: flagged, capture = flagged and bad / bad, conversion = flagged and bad / flagged.
    One pass over the data for all flags."""
    aggs = [F.count(F.lit(1)).alias("_n"), F.expr(f"sum(case when {bad} = 1 then 1 else 0 end) as _bad")]
    for i, f in enumerate(flags):
        aggs += [F.expr(f"sum(case when {f} = 1 then 1 else 0 end) as f{i}"), F.expr(f"sum(case when {f} = 1 and {bad} = 1 then 1 else 0 end) as b{i}")]
    one = df.agg(*aggs)
    items = ", ".join(f"named_struct('flag', '{f}', 'flagged', f{i}, 'hit', b{i})" for i, f in enumerate(flags))
    x = one.selectExpr("_n", "_bad", f"inline(array({items}))")
    return x.selectExpr("flag", "flagged", "_n as total", "try_divide(hit, _bad) as capture_rate", "try_divide(hit, flagged) as conversion_rate")


def decision_band(prob, approve, decline):
    """Below `approve` approve, at or above `decline` decline, in between refer."""
    p = F.col(prob) if isinstance(prob, str) else prob
    return F.when(p < approve, "approve").when(p >= decline, "decline").when(p.isNotNull(), "refer")


def segment_evaluate(df, segment, target="target", prob="prob", sample="sample", oot="OOT"):
    """A segment with training and test pooled as development: metrics and decile tables of development
    and out-of-time, both on the development cut points."""
    s = df.filter(segment).withColumn("part", F.when(F.col(sample) == oot, "oot").otherwise("dev"))
    counted = score_table(s, target, prob, ("part",))
    edges = train_edges(s, prob, counted=counted.filter("part = 'dev'").drop("part"))
    metrics = gini_ks(s, edges=edges, by=("part",), counted=counted).join(auc(s, by=("part",), counted=counted), "part")
    return metrics, decile_table(s, edges=edges, ascending=False, by=("part",), counted=counted)


def stack_samples(frames):
    """{name: frame} to one frame with a sample column."""
    return reduce(lambda a, b: a.unionByName(b), [f.withColumn("sample", F.lit(n)) for n, f in frames.items()])
