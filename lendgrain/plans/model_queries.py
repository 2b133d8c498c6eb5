"""Binning, WOE, stability, evaluation and selection on a scored sample made of `lineitem` and `orders`."""

import pyarrow as pa
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions.columns import impute, settle
from lendgrain.functions.lookups import small_frame
from lendgrain.modelling import binning as B
from lendgrain.modelling import boost as BT
from lendgrain.modelling import evaluate as E
from lendgrain.modelling import models as M
from lendgrain.modelling import quantile as Q
from lendgrain.modelling import select as S
from lendgrain.modelling import stability as ST
from lendgrain.modelling import woe as W
from lendgrain.operators.relational import unpivot
from lendgrain.plans.registry import query
from lendgrain.plans.row_queries import _DPD, _MOB, PERF, performance
from lendgrain.plans.sql_tables import SCORED, rnd, with_
from lendgrain.session import cut_lineage
from lendgrain.sources import driver_tables as D
from lendgrain.functions.trade_columns import dpd_targets

NUMERIC = ["quantity", "price", "discount", "tax", "total"]
PROBS = "[" + ", ".join(f"{i / 10}::double" for i in range(11)) + "]"


def scored(spark, sf):
    return D.scored(spark, sf)


def rounded(df, *cols, digits=6):
    return df.withColumns({c: settle(c, digits) for c in cols})


def long_sql(cols, extra, name="long"):
    return f"{name} as (" + " union all ".join(f"select {extra}, '{c}' as variable, cast({c} as double) as value from scored" for c in cols) + ")"


LONG = long_sql(NUMERIC, "target, sample, weight")
EDGES7 = f"edges as (select variable, list_sort(list_distinct(quantile_cont(value, {PROBS}))) as edges from long where value is not null group by variable)"
TRAIN_EDGES7 = EDGES7.replace("where value", "where sample = 'Train' and value")
CUT_OPEN = "case when value is null then -1 else least(len(edges) - 1, greatest(1, len(list_filter(edges, e -> e < value)))) end"
CUT_OPEN = CUT_OPEN.replace("e -> e", "lambda e: e")
CUT_CLOSED = "case when value is null then -1 when value between edges[1] and edges[len(edges)] then greatest(1, len(list_filter(edges, lambda e: e < value))) end"


# ---- quantiles and bins --------------------------------------------------------------------------------------
@query("quantile_edges_t7", with_(SCORED, LONG, f"q as (select variable, quantile_cont(value, {PROBS}) as q from long where value is not null group by variable)",
       body=f"select variable, cast(i as integer) as i, {rnd('q[i + 1]', 6)} as edge from q, range(11) t(i)"))
def quantile_edges_t7(spark, sf):
    q = Q.quantiles(Q.value_table(scored(spark, sf), NUMERIC), Q.even_probs(10), 7)
    return rounded(q.select("variable", F.posexplode("q").alias("i", "edge")), "edge")


TYPE8 = f"""r as (select variable, value, row_number() over (partition by variable order by value) as rn, count(*) over (partition by variable) as n from long where value is not null),
  p as (select distinct variable, n, i, (n + 1.0::double / 3) * (i / 10.0::double) + 1.0::double / 3 as h from r, range(11) t(i)),
  x as (select variable, i, case when abs(h - floor(h + 1e-9)) < 1e-9 then 0.0 else h - floor(h + 1e-9) end as frac,
     greatest(1, least(n, floor(h + 1e-9))) as lo, greatest(1, least(n, floor(h + 1e-9) + 1)) as hi from p),
  t8 as (select x.variable, i, a.value + frac * (b.value - a.value) as edge from x join r a on a.variable = x.variable and a.rn = lo join r b on b.variable = x.variable and b.rn = hi)"""


@query("quantile_edges_t8", with_(SCORED, LONG, TYPE8, body=f"select variable, cast(i as integer) as i, {rnd('edge', 6)} as edge from t8"))
def quantile_edges_t8(spark, sf):
    q = Q.quantiles(Q.value_table(scored(spark, sf), NUMERIC), Q.even_probs(10), 8)
    return rounded(q.select("variable", F.posexplode("q").alias("i", "edge")), "edge")


@query("cut_right_closed", with_(SCORED, LONG, EDGES7, body=f"select variable, cast({CUT_CLOSED} as integer) as bin, count(*) as n from long join edges using (variable) group by all"))
def cut_right_closed(spark, sf):
    vt = Q.value_table(scored(spark, sf), NUMERIC, keep_null=True)
    c = B.cut(vt, Q.quantile_edges(vt.filter("value is not null")))
    return c.groupBy("variable", "bin").agg(F.sum("n").alias("n"))


HIST = "case when value between lo and hi then 1 + " + " + ".join(f"case when value >= lo + {i} * ((hi - lo) / 10) then 1 else 0 end" for i in range(1, 10)) + " end"


@query("equal_width_hist", with_(SCORED, LONG, "s as (select variable, min(value) as lo, max(value) as hi from long where sample = 'Train' group by variable)",
       body=f"select variable, sample, cast({HIST} as integer) as bin, count(*) as n from long join s using (variable) where value is not null group by all"))
def equal_width_hist(spark, sf):
    vt = Q.value_table(scored(spark, sf), NUMERIC, by=("sample",))
    lim = vt.filter("sample = 'Train'").groupBy("variable").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    x = vt.join(F.broadcast(lim), "variable").withColumn("bin", F.expr(B.hist_bin("value", "lo", "hi", 10)))
    return x.groupBy("variable", "sample", "bin").agg(F.sum("n").alias("n"))


@query("fit_bins")
def fit_bins(spark, sf):
    return B.fit_bins(scored(spark, sf), "target", NUMERIC, weight="weight", tolerance=0.0)


@query("apply_bins")
def apply_bins(spark, sf):
    s = scored(spark, sf)
    bins = B.fit_bins(s.filter("sample = 'Train'"), "target", NUMERIC, tolerance=0.0)
    return B.apply_bins(s, bins, NUMERIC).groupBy("sample", *[f"{c}_bin" for c in NUMERIC]).agg(
        F.count("*").alias("n"), F.sum("target").alias("events"))


@query("fit_bins_facts", with_(SCORED, LONG, body="""select variable, count(*)::double as total, sum(target)::double as events, count(*) filter (value is null)::double as n_missing,
  true as large_enough, true as one_way from long group by 1"""))
def fit_bins_facts(spark, sf):
    """What must hold for the fitted bins, at their default settings."""
    b = B.fit_bins(scored(spark, sf), "target", NUMERIC)
    known, order = F.col("bin") > 0, F.array_sort(F.collect_list(F.when(F.col("bin") > 0, F.struct("bin", "woe"))))
    g = b.groupBy("variable").agg(F.sum("total").alias("total"), F.sum("events").alias("events"), F.sum(F.when(known, 0.0).otherwise(F.col("total"))).alias("n_missing"),
                                  F.min(F.when(known, F.col("total"))).alias("least"), F.max("reject").alias("reject"), order.alias("o"))
    steps = "transform(sequence(1, size(o) - 1), i -> o[i].woe - o[i - 1].woe)"
    return g.selectExpr("variable", "total", "events", "n_missing", "least >= 0.05 * total as large_enough",
                        f"size(o) < 2 or forall({steps}, x -> x >= 0) or forall({steps}, x -> x <= 0) as one_way")


@query("fit_bins_weighted_facts", with_(SCORED, LONG, body="""select variable, sum(weight) as total, sum(weight * target) as events, coalesce(sum(weight) filter (value is null), 0.0) as missing,
  true as large_enough, true as one_way, true as apart from long group by 1"""))
def fit_bins_weighted_facts(spark, sf):
    """The same with row weights and missing values: totals are sums of weights, neighbours a WOE of 0.02 apart."""
    b = B.fit_bins(scored(spark, sf), "target", NUMERIC, weight="weight")
    known, order = F.col("bin") > 0, F.array_sort(F.collect_list(F.when(F.col("bin") > 0, F.struct("bin", "woe"))))
    g = b.groupBy("variable").agg(F.sum("total").alias("total"), F.sum("events").alias("events"), F.sum(F.when(known, 0.0).otherwise(F.col("total"))).alias("missing"),
                                  F.min(F.when(known, F.col("total"))).alias("least"), order.alias("o"))
    steps = "transform(sequence(1, size(o) - 1), i -> o[i].woe - o[i - 1].woe)"
    return g.selectExpr("variable", "total", "events", "missing", "least >= 0.05 * total as large_enough", f"size(o) < 2 or forall({steps}, x -> x >= 0) or forall({steps}, x -> x <= 0) as one_way",
                        f"size(o) < 2 or forall({steps}, x -> abs(x) >= 0.02) as apart")


@query("apply_bins_facts", with_(SCORED, LONG, body="select variable, sample, count(*) as n, count(*) filter (value is null) as n_missing, true as all_known from long group by 1, 2"))
def apply_bins_facts(spark, sf):
    """Every row has a bin of the fitted table, and nulls the missing one; bins follow the values."""
    s = scored(spark, sf)
    bins = B.fit_bins(s.filter("sample = 'Train'"), "target", NUMERIC)
    x = B.apply_bins(s, bins, NUMERIC).select("sample", F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("value"), F.col(f"{c}_bin").alias("bin")) for c in NUMERIC])).alias("z")).select("sample", "z.*")
    fitted = bins.select("variable", "bin", "lo", "hi")
    inside = F.when(F.col("bin") < 0, F.col("value").isNull()).otherwise((F.col("value") > F.col("lo")) & (F.col("value") <= F.col("hi")))
    return x.join(fitted, ["variable", "bin"], "left").groupBy("variable", "sample").agg(
        F.count("*").alias("n"), F.count(F.when(F.col("bin") == B.MISSING, 1)).alias("n_missing"), F.bool_and(F.coalesce(inside, F.col("bin") < 0)).alias("all_known"))


# ---- WOE and IV -------------------------------------------------------------------------------------------------
CATS = ["line_status", "priority"]
VB = with_(SCORED, LONG, EDGES7, f"""few as (select variable, count(distinct value) <= 10 as few from long group by variable),
  labelled as (select variable, case when value is null then 'missing' when few then case when value = floor(value) then cast(value as varchar) else cast(value as varchar) end
     else cast({CUT_CLOSED} as varchar) end as bin, target, weight from long join edges using (variable) join few using (variable)
     union all select 'line_status', line_status, target, weight from scored union all select 'priority', priority, target, weight from scored),
  vb as (select variable, bin, count(*) as total, cast(sum(target) as bigint) as events, sum(weight) as w, sum(weight * target) as we from labelled group by all)""", body="")


def woe_sql(sign, guard, n="total", e="events", by="variable", source="vb"):
    ne = f"({n} - {e})"
    def share(x):
        t = f"sum({x}) over (partition by {by})"
        return {"max_half": f"greatest({x}::double, 0.5::double) / {t}", "add_half": f"({x} + 0.5) / {t}", "eps": f"({x} / {t} + 1e-8)", None: f"{x} / {t}"}[guard]
    pe, pn = share(e), share(ne)
    ratio = f"ln(({pe}) / ({pn}))" if sign == "event" else f"ln(({pn}) / ({pe}))"
    diff = f"(({pe}) - ({pn}))" if sign == "event" else f"(({pn}) - ({pe}))"
    return pe, pn, ratio, f"{ratio} * {diff}"


def vbins(spark, sf, weight=None):
    return W.variable_bins(scored(spark, sf), "target", NUMERIC, CATS, weight=weight)


_pe, _pn, _w, _iv = woe_sql("event", "max_half")


@query("woe_iv_table", VB + f"select variable, bin, total, events, cast(total - events as double) as non_events, {rnd(_pe, 8)} as event_share, {rnd(_pn, 8)} as non_event_share, {rnd(_w, 6)} as woe, {rnd(_iv, 8)} as iv from vb")
def woe_iv_table(spark, sf):
    t = W.woe_iv(vbins(spark, sf)).drop("min_value", "max_value")
    return rounded(rounded(t, "woe"), "iv", "event_share", "non_event_share", digits=8)


@query("woe_conventions", VB + "select variable, bin, " + ", ".join(
    f"{rnd(woe_sql(s, g)[2], 6)} as {s}_{g}" for s in ("event", "non_event") for g in ("max_half", "add_half", "eps"))
    + f", {rnd(woe_sql('event', None, 'w', 'we')[2], 6)} as weighted from vb")
def woe_conventions(spark, sf):
    b = vbins(spark, sf, "weight")
    out = b.select("variable", "bin", *[c for c in ("total", "events", "w", "we")])
    for s in W.SIGNS:
        for g in ("max_half", "add_half", "eps"):
            out = W.woe_iv(out, sign=s, guard=g).withColumnRenamed("woe", f"{s}_{g}").drop("non_events", "event_share", "non_event_share", "iv")
    out = W.woe_iv(out, "w", "we", guard=None).withColumnRenamed("woe", "weighted")
    names = [f"{s}_{g}" for s in W.SIGNS for g in ("max_half", "add_half", "eps")] + ["weighted"]
    return rounded(out.select("variable", "bin", *names), *names)


IVS = VB.rstrip() + f", tab as (select variable, {_iv} as iv from vb), s as (select variable, sum(iv) as iv from tab group by variable)\n"


@query("iv_summary", IVS + f"select variable, {rnd('iv', 8)} as iv, case when iv < 0.02 then 'not useful' when iv < 0.1 then 'weak' when iv < 0.3 then 'medium' when iv < 0.5 then 'strong' else 'suspicious' end as band from s")
def iv_summary(spark, sf):
    return rounded(W.iv_summary(W.woe_iv(vbins(spark, sf))), "iv", digits=8)


@query("iv_band", IVS + "select case when iv < 0.02 then 'not useful' when iv < 0.1 then 'weak' when iv < 0.3 then 'medium' when iv < 0.5 then 'strong' else 'suspicious' end as band, count(*) as n from s group by 1")
def iv_band(spark, sf):
    return W.iv_summary(W.woe_iv(vbins(spark, sf))).groupBy("band").agg(F.count("*").alias("n"))


@query("neutralise_bins", VB + f"select variable, bin, {rnd('case when (variable = ' + chr(39) + 'tax' + chr(39) + ' and bin = ' + chr(39) + 'missing' + chr(39) + ') or (variable = ' + chr(39) + 'priority' + chr(39) + ' and bin like ' + chr(39) + '1%' + chr(39) + ') then 0.0 else ' + _w + ' end', 6)} as woe_upd from vb")
def neutralise_bins(spark, sf):
    t = W.woe_iv(vbins(spark, sf))
    o = small_frame(spark, {"variable": (["tax", "priority"], pa.string()), "bin": (["missing", "1-URGENT"], pa.string())})
    return rounded(W.neutralise(t, o).select("variable", "bin", "woe_upd"), "woe_upd")


_CATW = "cw as (select priority as priority_bin, ln((sum(target) / (select sum(target) from scored)) / (sum(1 - target) / (select sum(1 - target) from scored))) as priority_woe from scored group by 1)"


@query("woe_transform", with_(SCORED, _CATW, body=f"select sample, priority_bin, {rnd('max(priority_woe)', 6)} as priority_woe, count(*) as n from scored join cw on priority = priority_bin group by 1, 2"))
def woe_transform(spark, sf):
    s = scored(spark, sf)
    table = W.woe_iv(W.variable_bins(s, "target", categorical=["priority"]), guard=None)
    x = W.woe_transform(s.withColumnRenamed("priority", "priority_bin"), table, ["priority"])
    return rounded(x.groupBy("sample", "priority_bin").agg(F.max("priority_woe").alias("priority_woe"), F.count("*").alias("n")), "priority_woe")


@query("woe_transform_numeric", with_(SCORED, LONG, EDGES7, f"""b as (select variable, target, value, {CUT_OPEN} as bin from long join edges using (variable)),
  t as (select variable, bin, sum(target) as e, sum(1 - target) as g from b group by 1, 2),
  w as (select *, ln((e / sum(e) over (partition by variable)) / (g / sum(g) over (partition by variable))) as woe from t)""",
  body=f"select variable, {rnd('sum(woe * (e + g)) / sum(e + g)', 6)} as mean_woe, cast(sum(e + g) as bigint) as n from w group by 1"))
def woe_transform_numeric(spark, sf):
    """All numeric variables, nulls included, put through one table of WOE."""
    s = scored(spark, sf)
    vt = Q.value_table(s, NUMERIC, "target", keep_null=True)
    edges = Q.quantile_edges(vt.filter("value is not null"))
    table = W.woe_iv(B.bin_counts(B.cut(vt, edges, open_ends=True)), guard=None)
    upper = {r["variable"]: r["edges"] for r in edges.collect()}
    binned = s.withColumns({f"{c}_bin": F.expr("case when " + f"`{c}` is null then -1 else greatest(1, " + " + ".join(f"int(double(`{c}`) > {e!r}D)" for e in upper[c][:-1]) + ") end") for c in NUMERIC})
    x = W.woe_transform(binned, table, NUMERIC)
    one = x.agg(*[F.avg(f"{c}_woe").alias(c) for c in NUMERIC], F.count("*").alias("n"))
    return rounded(one.unpivot(["n"], NUMERIC, "variable", "mean_woe").select("variable", "mean_woe", "n"), "mean_woe")


BIV = f"""bv as (select variable, cast({CUT_OPEN} as integer) as bin, min(value) as min_value, max(value) as max_value, count(*) as total, cast(sum(target) as bigint) as events
   from long join edges using (variable) group by 1, 2)"""


@query("bivariate", with_(SCORED, LONG, EDGES7, BIV, body="""select *, total - events as non_events, events / sum(total) over w as events_perc, (total - events) / sum(total) over w as non_events_perc,
   total / sum(total) over w as pop_perc, events / total as event_rate from bv window w as (partition by variable)"""))
def bivariate(spark, sf):
    return W.bivariate(scored(spark, sf), NUMERIC, "target")


SBIV = f"""bv as (select sample, variable, cast({CUT_OPEN} as integer) as bin, min(value) as min_value, max(value) as max_value, count(*) as total, cast(sum(target) as bigint) as events
   from long join edges using (variable) group by 1, 2, 3)"""
_sw = woe_sql("event", "eps", by="sample, variable", source="bv")[2]


@query("woe_bivariate", with_(SCORED, LONG, TRAIN_EDGES7, SBIV, body=f"""select *, cast(total - events as double) as non_events, events * 100 / sum(total) over w as events_perc, (total - events) * 100 / sum(total) over w as non_events_perc,
   total * 100 / sum(total) over w as pop_perc, events / total as event_rate, {rnd(_sw, 6)} as woe from bv window w as (partition by sample, variable)"""))
def woe_bivariate(spark, sf):
    return rounded(W.woe_bivariate(scored(spark, sf), NUMERIC, "target", "sample"), "woe")


@query("woe_check", with_(SCORED, LONG, TRAIN_EDGES7, SBIV, f"t as (select sample, variable, bin, {_sw} as woe from bv), l as (select *, woe - lag(woe) over (partition by sample, variable order by bin) as s from t where bin > 0)",
       body="select sample, variable, count(*) as n_bins, cast(sum(case when s > 0 then 1 else 0 end) as bigint) as n_up, cast(sum(case when s < 0 then 1 else 0 end) as bigint) as n_down, n_up = 0 or n_down = 0 as monotone from l group by sample, variable"))
def woe_check(spark, sf):
    return W.woe_check(W.woe_bivariate(scored(spark, sf), NUMERIC, "target", "sample"), by=("sample",))


# ---- stability ---------------------------------------------------------------------------------------------------------
def psi_sql(other):
    g = lambda s: f"(case when {s} = 0 then 1e-10::double else {s} end)"
    a, e = g("a / na"), g("e / ne")
    return f"""sz_{other} as (select variable, sum(case when sample = 'Train' then 1 else 0 end) as ne, sum(case when sample = '{other}' then 1 else 0 end) as na,
      min(case when sample = 'Train' then value end) as lo, max(case when sample = 'Train' then value end) as hi from long group by variable),
    h_{other} as (select variable, {HIST} as bin, sum(case when sample = 'Train' then 1 else 0 end) as e, sum(case when sample = '{other}' then 1 else 0 end) as a,
      max(ne) as ne, max(na) as na from long join sz_{other} using (variable) where sample in ('Train', '{other}') group by 1, 2),
    psi_{other} as (select variable, sum(({a} - {e}) * ln({a} / {e})) as psi from h_{other} where bin is not null group by variable)"""


@query("psi_continuous", with_(SCORED, LONG, psi_sql("Test"), psi_sql("OOT"), body=" union all ".join(f"select '{o}' as compared, variable, {rnd('psi', 8)} as psi from psi_{o}" for o in ("Test", "OOT"))))
def psi_continuous(spark, sf):
    x = ST.csi_report(scored(spark, sf), "sample", NUMERIC)
    return rounded(x.select("compared", "variable", "psi"), "psi", digits=8)


_A, _E = "(case when a = 0 then 1e-6::double else a / na end)", "(case when e = 0 then 1e-9::double else e / ne end)"


@query("psi_categorical", with_(SCORED, """c as (select 'line_status' as variable, line_status as value, sample from scored union all select 'priority', priority, sample from scored
    union all select 'month', cast(quantity as varchar) || sample[1:2], sample from scored),
  g as (select variable, value, count(*) filter (sample = 'Train') as e, count(*) filter (sample = 'OOT') as a from c where sample in ('Train', 'OOT') group by 1, 2),
  t as (select *, sum(e) over (partition by variable) as ne, sum(a) over (partition by variable) as na from g)""",
    body=f"select variable, {rnd(f'sum(({_A} - {_E}) * ln({_A} / {_E}))', 6)} as psi, {rnd('sum(case when a = 0 or e = 0 then 0.0 else (a / na - e / ne) * ln((a / na) / (e / ne)) end)', 6)} as psi_compat from t group by variable"))
def psi_categorical(spark, sf):
    s = scored(spark, sf).withColumn("month", F.concat(F.col("quantity").cast("string"), F.substring("sample", 1, 2)))
    cols = ["line_status", "priority", "month"]
    a = ST.psi_categorical(s, "sample", cols, "Train", "OOT")
    b = ST.psi_categorical(s, "sample", cols, "Train", "OOT", compat=True).withColumnRenamed("psi", "psi_compat")
    return rounded(a.join(b, "variable"), "psi", "psi_compat")


_PLONG = long_sql(["prob", "quantity", "price"], "target, sample, weight")
_BAND = "case when psi < 0.1 then 'stable' when psi < 0.2 then 'monitor' else 'retrain' end"


@query("csi_report", with_(SCORED, _PLONG, psi_sql("Test"), psi_sql("OOT"), body=" union all ".join(
    f"select variable, {rnd('psi', 8)} as psi, '{o}' as compared, case when variable = 'prob' then 'PSI' else 'CSI' end as \"index\", {_BAND} as band from psi_{o}" for o in ("Test", "OOT"))))
def csi_report(spark, sf):
    return rounded(ST.csi_report(scored(spark, sf), "sample", ["quantity", "price"], "prob"), "psi", digits=8)


_CATEGORIES = "cat as (select 'line_status' as variable, line_status as value, sample from scored union all select 'priority', priority, sample from scored)"


def psi_categories_sql(other):
    return f"""cg_{other} as (select variable, value, count(*) filter (sample = 'Train') as e, count(*) filter (sample = '{other}') as a from cat where sample in ('Train', '{other}') group by 1, 2),
    ct_{other} as (select *, sum(e) over (partition by variable) as ne, sum(a) over (partition by variable) as na from cg_{other}),
    cpsi_{other} as (select variable, sum(({_A} - {_E}) * ln({_A} / {_E})) as psi from ct_{other} group by variable)"""


@query("csi_report_all", with_(SCORED, _PLONG, psi_sql("Test"), psi_sql("OOT"), _CATEGORIES, psi_categories_sql("Test"), psi_categories_sql("OOT"), body=" union all ".join(
    f"select variable, {rnd('psi', 8)} as psi, '{o}' as compared, case when variable = 'prob' then 'PSI' else 'CSI' end as \"index\", {_BAND} as band from {t}_{o}" for o in ("Test", "OOT") for t in ("psi", "cpsi"))))
def csi_report_all(spark, sf):
    """Numbers, categories and the score in one report."""
    return rounded(ST.csi_report(scored(spark, sf), "sample", ["quantity", "price"], "prob", categorical=["line_status", "priority"]), "psi", digits=8)


def psi_quantile_sql(other):
    g = lambda s: f"(case when {s} = 0 then 1e-10::double else {s} end)"
    a, e = g("a / na"), g("e / ne")
    return f"""q_{other} as (select variable, {CUT_OPEN} as bin, count(*) filter (sample = 'Train') as e, count(*) filter (sample = '{other}') as a
      from long join edges using (variable) where sample in ('Train', '{other}') group by 1, 2),
    qt_{other} as (select *, sum(e) over (partition by variable) as ne, sum(a) over (partition by variable) as na from q_{other}),
    qpsi_{other} as (select variable, sum(({a} - {e}) * ln({a} / {e})) as psi from qt_{other} group by variable)"""


@query("psi_quantile", with_(SCORED, LONG, TRAIN_EDGES7, psi_quantile_sql("Test"), psi_quantile_sql("OOT"),
                             body=" union all ".join(f"select '{o}' as compared, variable, {rnd('psi', 8)} as psi from qpsi_{o}" for o in ("Test", "OOT"))))
def psi_quantile(spark, sf):
    """Stability on the deciles of the training sample; a missing value is a bin of its own."""
    x = ST.csi_report(scored(spark, sf), "sample", NUMERIC, method="quantile")
    return rounded(x.select("compared", "variable", "psi"), "psi", digits=8)


# ---- evaluation ----------------------------------------------------------------------------------------------------------
E7 = f"ed as (select list_sort(list_distinct(quantile_cont(prob, {PROBS}))) as edges from scored)"
DEC7 = """d as (select greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, min(prob) as min_prob, max(prob) as max_prob, avg(prob) as avg_prob,
   sum(target) as events, sum(1 - target) as nonevents from scored, ed group by 1),
 k as (select row_number() over (order by bin) as decile, *, sum(events) over (order by bin desc) / sum(events) over () as ce, sum(nonevents) over (order by bin desc) / sum(nonevents) over () as cn,
   sum(events) over () as te, sum(nonevents) over () as tn from d)"""


@query("ks_table_desc", with_(SCORED, E7, DEC7, body=f"""select cast(decile as integer) as decile, min_prob, max_prob, {rnd('avg_prob', 8)} as avg_prob, cast(events as bigint) as events, cast(nonevents as bigint) as nonevents,
  events / te as event_rate, nonevents / tn as nonevent_rate, ce as cum_eventrate, cn as cum_noneventrate, events * 100 / (events + nonevents) as bad_rate, {rnd(rnd('ce - cn', 5) + ' * 100', 6)} as ks from k"""))
def ks_table_desc(spark, sf):
    return rounded(rounded(E.ks_table(scored(spark, sf)), "avg_prob", digits=8), "ks")


E8 = TYPE8.replace("from long where value is not null", "from (select 'prob' as variable, prob as value from scored) z")
E8_EDGES = E8 + ", ed as (select list_sort(list_distinct(list(edge))) as edges from t8)"


def decile_sql(order):
    return f"""d as (select greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, cast(sum(target) as bigint) as events, cast(sum(1 - target) as bigint) as nonevents, count(*) as total
     from scored, ed where prob between edges[1] and edges[len(edges)] group by 1),
   c as (select *, row_number() over (order by bin) as decile, cast(sum(events) over (order by bin {order}) as bigint) as cum_event, cast(sum(nonevents) over (order by bin {order}) as bigint) as cum_nonevent from d),
   k as (select *, cum_event / sum(events) over () as pct_cum_event, cum_nonevent / sum(nonevents) over () as pct_cum_nonevent, total / sum(total) over () as pct_pop from c),
   l as (select *, coalesce(lag(pct_cum_event) over (order by bin {order}), 0) as le, coalesce(lag(pct_cum_nonevent) over (order by bin {order}), 0) as ln_ from k)"""


_DT = f"""select cast(decile as integer) as decile, nonevents, events, total, pct_pop, events / total as event_rate, cum_nonevent, cum_event, pct_cum_nonevent, pct_cum_event,
  {rnd('abs(pct_cum_nonevent - pct_cum_event) * 100', 2)} as ks, {rnd('(pct_cum_event + le) * (pct_cum_nonevent - ln_) * 0.5', 8)} as gini from l"""


@query("ks_table_r", with_(SCORED, E8_EDGES, decile_sql("asc"), body=_DT))
def ks_table_r(spark, sf):
    return rounded(E.decile_table(scored(spark, sf)), "gini", digits=8)


FIXED = [0.0, 0.15, 0.2, 0.25, 0.3, 0.35, 0.4, 0.45, 0.5, 0.6, 1.0]
_FIXED_SQL = "ed as (select [" + ", ".join(f"{x}::double" for x in FIXED) + "] as edges)"


@query("ks_table_r_fixed", with_(SCORED, _FIXED_SQL, decile_sql("desc"), body=_DT))
def ks_table_r_fixed(spark, sf):
    return rounded(E.decile_table(scored(spark, sf), edges=FIXED, ascending=False), "gini", digits=8)


_GINI = f"round(cast((sum((pct_cum_event - le) * (pct_cum_nonevent + ln_) * 0.5) - 0.5) * 2 as decimal(30, 10)), 4)::double as gini, {rnd('max(abs(pct_cum_nonevent - pct_cum_event))', 4)} as ks"


@query("gini_ks", with_(SCORED, E8_EDGES, decile_sql("asc"), body=f"select {_GINI} from l"))
def gini_ks(spark, sf):
    return E.gini_ks(scored(spark, sf))


AUC_SQL = """g as (select sample, prob, count(*) as n, sum(target) as e, sum(1 - target) as ne from scored group by 1, 2),
  b as (select *, coalesce(sum(ne) over (partition by sample order by prob rows between unbounded preceding and 1 preceding), 0) as before from g),
  auc as (select sample, sum((before + ne / 2) * e) / (sum(ne)::double * sum(e)) as auc from b group by sample)"""


@query("auc", with_(SCORED, AUC_SQL, body=f"select sample, {rnd('auc', 4)} as auc from auc"))
def auc(spark, sf):
    return E.auc(scored(spark, sf), by=("sample",))


@query("weighted_ks_gini_roc", with_(SCORED, """g as (select sample, prob, sum(weight) as w, sum(weight * target) as we from scored group by 1, 2),
  b as (select *, w - we as wn, sum(we) over o as cwe, sum(w - we) over o as cwn, sum(we) over (partition by sample) as te, sum(w - we) over (partition by sample) as tn from g window o as (partition by sample order by prob)),
  m as (select sample, sum(w) as total, max(abs(cwe / te - cwn / tn)) * 100 as ks, sum((cwn - wn / 2) * we) / (max(te) * max(tn)) as area from b group by sample)""",
  body=f"select sample, total, {rnd('ks', 6)} as ks, {rnd('(area * 2 - 1) * 100', 6)} as gini, {rnd('area * 100', 6)} as roc from m"))
def weighted_ks_gini_roc(spark, sf):
    return rounded(E.weighted_metrics(scored(spark, sf)), "ks", "gini", "roc")


GAIN_CUTS = [0.0, 0.2, 0.3, 0.4, 0.5, 0.6, 1.0]


@query("gains_table", with_(SCORED, "ed as (select [" + ", ".join(f"{x}::double" for x in GAIN_CUTS) + "] as edges)", """d as (select sample, greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, min(prob) as min_prob, max(prob) as max_prob,
  sum(weight) as total, sum(weight * target) as events, sum(weight) - sum(weight * target) as nonevents from scored, ed group by 1, 2),
  c as (select *, row_number() over o as interval, sum(events) over o / sum(events) over s as gain, sum(nonevents) over o / sum(nonevents) over s as cum_nonevent, sum(total) over o / sum(total) over s as cum_pop from d
   window o as (partition by sample order by bin desc), s as (partition by sample))""",
  body=f"select sample, cast(interval as integer) as interval, min_prob, max_prob, total, events, nonevents, events / total as event_rate, gain, cum_nonevent, cum_pop, {rnd('abs(gain - cum_nonevent) * 100', 6)} as ks, {rnd('gain / cum_pop', 6)} as lift from c"))
def gains_table(spark, sf):
    return rounded(E.gains_table(scored(spark, sf), breaks=GAIN_CUTS, by=("sample",)), "ks", "lift")


@query("lift", with_(SCORED, E7, """d as (select greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, sum(weight) as total, sum(weight * target) as events from scored, ed group by 1)""",
  body=f"select cast(row_number() over (order by bin desc) as integer) as interval, {rnd('(sum(events) over (order by bin desc) / sum(events) over ()) / (sum(total) over (order by bin desc) / sum(total) over ())', 6)} as lift from d"))
def lift(spark, sf):
    return rounded(E.gains_table(scored(spark, sf)).select("interval", "lift"), "lift")


@query("rank_order_check", with_(SCORED, E8_EDGES, decile_sql("asc"), "ro as (select *, lag(events / total) over (order by decile) as prev from l)",
       body="select cast(sum(case when events / total < prev then 1 else 0 end) as bigint) as breaks, breaks = 0 as ordered from ro"))
def rank_order_check(spark, sf):
    return E.rank_order(E.decile_table(scored(spark, sf)))


SUMMARY = f"""d as (select sample, greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, sum(target) as events, sum(1 - target) as nonevents from scored, ed group by 1, 2),
  k as (select *, sum(events) over o / sum(events) over s as pct_cum_event, sum(nonevents) over o / sum(nonevents) over s as pct_cum_nonevent from d window o as (partition by sample order by bin), s as (partition by sample)),
  l as (select *, coalesce(lag(pct_cum_event) over (partition by sample order by bin), 0) as le, coalesce(lag(pct_cum_nonevent) over (partition by sample order by bin), 0) as ln_ from k),
  gk as (select sample, {_GINI} from l group by sample)"""


@query("model_summary", with_(SCORED, _FIXED_SQL, SUMMARY, AUC_SQL, "t as (select ks as tks from gk where sample = 'Train')",
       body=f"select sample, {rnd('auc', 4)} as auc, gini, ks, (tks - ks) / tks as ks_drop, abs((tks - ks) / tks) <= 0.07 as within_tolerance from gk join auc using (sample), t"))
def model_summary(spark, sf):
    return E.model_summary(scored(spark, sf), edges=FIXED)


TRAIN_E7 = E7.replace("from scored", "from scored where sample = 'Train'")


@query("validation_perf", with_(SCORED, TRAIN_E7, DEC7.replace("from scored, ed", "from scored, ed where sample = 'Train'"),
  """v as (select decile, min_prob as lo, max_prob as hi, avg(s.prob) as avg_prob, count(*) as num_cust, sum(s.target) as events, count(*) - sum(s.target) as nonevents
     from k join scored s on s.prob between min_prob and max_prob where s.sample = 'OOT' group by 1, 2, 3),
  tt as (select sum(target) as te, sum(1 - target) as tn from scored where sample = 'OOT'),
  c as (select *, sum(events) over (order by decile) / te as ce, sum(nonevents) over (order by decile) / tn as cn from v, tt)""",
  body=f"""select cast(decile as integer) as decile, lo, hi, {rnd('avg_prob', 8)} as avg_prob, num_cust, cast(events as bigint) as events, cast(nonevents as bigint) as nonevents, events / te as event_rate, nonevents / tn as nonevent_rate,
  ce as cum_eventrate, cn as cum_noneventrate, events * 100 / num_cust as bad_rate, {rnd('abs(' + rnd('ce - cn', 5) + ' * 100)', 6)} as ks, {rnd(rnd('num_cust / sum(num_cust) over ()', 5) + ' * 100', 6)} as population_percent,
  sum(case when decile < 6 then num_cust else 0 end) over () / sum(num_cust) over () as low_half_share from c"""))
def validation_perf(spark, sf):
    v = E.validation_report(scored(spark, sf))
    return rounded(rounded(v, "avg_prob", digits=8), "ks", "population_percent")


_FLAGS = [f"target_{m}mob_{d}_flag" for m in _MOB for d in _DPD]
_BAD = "target_24mob_180_flag"


@query("capture_conversion", with_(PERF, "f as (select " + ", ".join(f"case when max_dpd{m}mob >= {d} then 1 else 0 end as target_{m}mob_{d}_flag" for m in _MOB for d in _DPD) + " from perf)",
       body=" union all ".join(f"select '{f}' as flag, cast(sum({f}) as bigint) as flagged, count(*) as total, sum({f} * {_BAD}) / sum({_BAD}) as capture_rate, case when sum({f}) > 0 then sum({f} * {_BAD}) / sum({f}) end as conversion_rate from f" for f in _FLAGS)))
def capture_conversion(spark, sf):
    p = performance(spark, sf)
    return E.capture_conversion(p.select(*[c.alias(n) for n, c in dpd_targets().items()]), _FLAGS, _BAD)


@query("decision_band", with_(SCORED, body="select sample, case when prob < 0.25 then 'approve' when prob >= 0.5 then 'decline' else 'refer' end as decision, count(*) as n, cast(sum(target) as bigint) as events from scored group by 1, 2"))
def decision_band(spark, sf):
    return scored(spark, sf).groupBy("sample", E.decision_band("prob", 0.25, 0.5).alias("decision")).agg(F.count("*").alias("n"), F.sum("target").alias("events"))


SEG = "z as (select case when sample = 'OOT' then 'oot' else 'dev' end as part, prob, target from scored where line_status = 'F')"
E8_SEG = E8.replace("from scored) z", "from z where part = 'dev') y") + ", ed as (select list_concat(list_concat([0.0::double], list_slice(e, 2, len(e) - 1)), [1.0::double]) as edges from (select list_sort(list_distinct(list(edge))) as e from t8))"


@query("segment_evaluate", with_(SCORED, SEG, E8_SEG, SUMMARY.replace("select sample, greatest", "select part as sample, greatest").replace("from scored, ed", "from z, ed"),
       AUC_SQL.replace("select sample, prob, count", "select part as sample, prob, count").replace("from scored", "from z"), body=f"select sample as part, gini, ks, {rnd('auc', 4)} as auc from gk join auc using (sample)"))
def segment_evaluate(spark, sf):
    return E.segment_evaluate(scored(spark, sf), F.col("line_status") == "F")[0]


@query("segment_deciles", with_(SCORED, SEG, E8_SEG, f"""d as (select part, greatest(1, len(list_filter(edges, lambda e: e < prob))) as bin, sum(target) as events, count(*) as total from z, ed group by 1, 2)""",
       body=f"""select part, cast(row_number() over (partition by part order by bin) as integer) as decile, cast(events as bigint) as events, cast(total as bigint) as total,
  {rnd('sum(events) over (partition by part order by bin desc) / sum(events) over (partition by part)', 8)} as pct_cum_event from d"""))
def segment_deciles(spark, sf):
    """The decile tables of a segment, development and out of time, on the development cut points."""
    t = E.segment_evaluate(scored(spark, sf), F.col("line_status") == "F")[1]
    return rounded(t.select("part", "decile", "events", "total", "pct_cum_event"), "pct_cum_event", digits=8)


# ---- profile and selection -----------------------------------------------------------------------------------------------
PCTS = [0.0, 0.005, 0.01, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.99, 0.999, 1.0]


def pname(p):
    return "p" + f"{p * 100:g}".replace(".", "_")


@query("describe_percentiles", with_(SCORED, LONG, f"u as (select variable, avg(value) as mean, stddev_samp(value) as std, min(value) as min, max(value) as max, 100.0::double * (count(*) - count(value)) / count(*) as missing, quantile_cont(value, [{', '.join(f'{p}::double' for p in PCTS)}]) as q from long group by variable)",
       body=f"select variable, {rnd('mean', 6)} as mean, {rnd('std', 6)} as std, min, max, {rnd('missing', 6)} as missing, " + ", ".join(f"{rnd(f'q[{i + 1}]', 6)} as {pname(p)}" for i, p in enumerate(PCTS)) + " from u"))
def describe_percentiles(spark, sf):
    s = scored(spark, sf)
    long = unpivot(s.select(*NUMERIC), [], NUMERIC)
    base = long.groupBy("variable").agg(F.avg("value").alias("mean"), F.stddev("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
                                        (F.lit(100.0) * F.sum(F.when(F.col("value").isNull(), 1).otherwise(0)) / F.count(F.lit(1))).alias("missing"))
    q = Q.quantiles(Q.value_table(s, NUMERIC), PCTS, 7)
    out = base.join(F.broadcast(q), "variable").selectExpr("variable", "mean", "std", "min", "max", "missing", *[f"q[{i}] as {pname(p)}" for i, p in enumerate(PCTS)])
    return rounded(out, "mean", "std", "missing", *[pname(p) for p in PCTS])


DICT_SQL = "dict as (select p_partkey as attribute, case when p_partkey % 5 = 0 then 'Total balance of ' when p_partkey % 7 = 0 then 'Value at month 3 ' else 'Number of ' end || p_name as description, cast(p_partkey % 9 as integer) as blacklist from part)"


def dictionary(spark, sf):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, "Total balance of ").when(k % 7 == 0, "Value at month 3 ").otherwise("Number of ")
    return D.table(spark, sf, "part").select(k.alias("attribute"), F.concat(text, "p_name").alias("description"), (k % 9).cast("int").alias("blacklist"))


@query("select_by_blacklist", "with " + DICT_SQL + " select attribute from dict where blacklist not in (1, 2, 3, 4, 6) and attribute <> 5")
def select_by_blacklist(spark, sf):
    d = dictionary(spark, sf)
    return S.screen(d.select("attribute"), d, extra=(5,))


@query("select_by_description", "with " + DICT_SQL + " select attribute from dict where not (" + " or ".join(f"contains(description, '{p}')" for p in V.DESCRIPTION_MONTH_PATTERNS + V.DESCRIPTION_BALANCE_PATTERNS) + ")")
def select_by_description(spark, sf):
    d = dictionary(spark, sf)
    return S.screen_text(d.select("attribute"), d, V.DESCRIPTION_MONTH_PATTERNS + V.DESCRIPTION_BALANCE_PATTERNS)


@query("select_iv_importance", IVS + "select variable from s where iv > 0.0001 and variable <> 'tax' union select variable from s where variable in ('price', 'priority')")
def select_iv_importance(spark, sf):
    iv = W.iv_summary(W.woe_iv(vbins(spark, sf)))
    names = iv.select("variable")
    well = names.filter("variable <> 'tax'")
    return S.pick(well, iv, names.filter("variable in ('price', 'priority')"), 0.0001)


@query("correlation_filter", with_(SCORED, """x as (select quantity, price, quantity * 2 + price / 10000 as mixed, discount, total from scored),
  c as (select abs(corr(quantity, price)) as qp, abs(corr(quantity, mixed)) as qm, abs(corr(quantity, discount)) as qd, abs(corr(price, mixed)) as pm, abs(corr(mixed, discount)) as md, abs(corr(price, discount)) as pd from x)""",
  body="select 'quantity' as variable from c union all select 'price' from c where qp < 0.4 union all select 'mixed' from c where qm < 0.4 and (qp >= 0.4 or pm < 0.4) union all select 'discount' from c where qd < 0.4 and (qp >= 0.4 or pd < 0.4)"))
def correlation_filter(spark, sf):
    x = scored(spark, sf).withColumn("mixed", F.col("quantity") * 2 + F.col("price") / 10000)
    keep = S.low_correlation(x, ["quantity", "price", "mixed", "discount"], 0.4)
    return small_frame(spark, {"variable": (keep, pa.string())})


@query("vif", with_(SCORED, "x as (select corr(quantity, price) as r from scored)", body=f"select 'quantity' as variable, {rnd('1 / (1 - r * r)', 6)} as vif from x union all select 'price', {rnd('1 / (1 - r * r)', 6)} from x"))
def vif(spark, sf):
    v = S.vif(scored(spark, sf), ["quantity", "price"])
    return rounded(small_frame(spark, {"variable": (list(v), pa.string()), "vif": (list(v.values()), pa.float64())}), "vif")


_TRAIN_E8 = E8.replace("from scored) z", "from scored where sample = 'Train') y") + ", ed as (select list_concat(list_concat([0.0::double], list_slice(e, 2, len(e) - 1)), [1.0::double]) as edges from (select list_sort(list_distinct(list(edge))) as e from t8))"


@query("model_summary_own_edges", with_(SCORED, _TRAIN_E8, SUMMARY, AUC_SQL, "t as (select ks as tks from gk where sample = 'Train')",
       body=f"select sample, {rnd('auc', 4)} as auc, gini, ks, (tks - ks) / tks as ks_drop, abs((tks - ks) / tks) <= 0.07 as within_tolerance from gk join auc using (sample), t"))
def model_summary_own_edges(spark, sf):
    """On cut points of the training sample's own; scores are counted once for these, the deciles and the area."""
    return E.model_summary(scored(spark, sf))


_SCREENED = {"quantity": 0, "price": 1, "discount": 5, "tax": 0, "total": 6, "line_status": 0, "fixed": 0, "priority": 4, "weight": 7, "unknown": 0}


@query("model_variables", with_(SCORED, "b as (select * from (values " + ", ".join(f"('{n}', {c})" for n, c in _SCREENED.items()) + ") as t(variable, code))",
       """v as (select unnest(['quantity', 'price', 'discount', 'tax', 'total', 'weight', 'fixed']) as variable, unnest([var_samp(quantity), var_samp(price), var_samp(discount), var_samp(tax), var_samp(total), var_samp(weight), 0]) as spread from scored),
  k as (select unnest(['quantity', 'price', 'discount', 'tax', 'total', 'weight', 'fixed', 'line_status', 'priority']) as variable)""",
       body="""select variable, case when code in (1, 2, 3, 4, 6) or variable = 'weight' then 'blacklisted' when spread is null then 'not numeric' when spread = 0 then 'constant' end as reason
  from k join b using (variable) left join v using (variable)"""))
def model_variables(spark, sf):
    """Blacklist, type and spread in one screen; a name of the blacklist that is no column has no row."""
    b = small_frame(spark, {"attribute": (list(_SCREENED), pa.string()), "blacklist": (list(_SCREENED.values()), pa.int32())})
    return S.model_variables(scored(spark, sf).withColumn("fixed", F.lit(3.0)), b, extra=("weight",))


def wide_model_frame(spark, sf):
    """Thirty-two variables: powers, bands and mixtures of four, some of them nearly the same."""
    x = model_frame(spark, sf)
    base = {c: F.col(c) for c in MODEL_VARS}
    out = dict(base)
    for c, v in base.items():
        out |= {f"{c}_sq": v * v, f"{c}_neg": -v, f"{c}_root": F.sqrt(F.greatest(v, F.lit(0.0))), f"{c}_high": (v > F.lit({"quantity": 25, "price": 30000, "discount": 0.05, "tax": 0.04}[c])).cast("double")}
    for i, a in enumerate(MODEL_VARS):
        for b in MODEL_VARS[i + 1:]:
            out |= {f"{a}_{b}": base[a] * base[b], f"{a}_and_{b}": base[a] + base[b]}
    names = list(out)[:32]
    # an outcome that some of them carry
    odds = F.col("quantity") / 20 + F.col("discount") * 10 - 1.5
    made = (F.conv(F.substring(F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in ("quantity", "price", "discount", "tax", "total")])), 1, 6), 16, 10).cast("double") / 16777216.0)
    # fits and moments read the rows many times: they are joined and written once, and the variables made of them at each reading
    x = cut_lineage(x.select("sample", *MODEL_VARS, (made < 1 / (1 + F.exp(-odds))).cast("int").alias("outcome")))
    return x.select(*[v.alias(n) for n, v in out.items() if n in names], "outcome", "sample"), names


@query("accepted_variables", "select true as some_accepted, true as signs_hold, true as p_values_hold, true as inflation_holds, true as all_accounted_for")
def accepted_variables(spark, sf):
    """Backward steps over thirty-two variables end in a model that meets its rule."""
    df, names = wide_model_frame(spark, sf)
    train = df.filter("sample = 'Train'")
    kept, gone = S.accepted(train, names, "outcome")
    numbers = M.glm_numbers(M.fit_glm(train, kept, "outcome"), kept)
    facts = {"some_accepted": 0 < len(kept) < len(names), "signs_hold": all(c >= 0 for c, _ in numbers.values()), "p_values_hold": all(p < 0.001 for _, p in numbers.values()),
             "inflation_holds": all(v < 2 for v in S.vif(train, kept).values()), "all_accounted_for": sorted([*kept, *[n for n, _ in gone]]) == sorted(names)}
    return small_frame(spark, {k: ([v], pa.bool_()) for k, v in facts.items()})


# ---- models (no SQL equivalent) ----------------------------------------------------------------------------------------------
MODEL_VARS = ["quantity", "price", "discount", "tax"]


def model_frame(spark, sf):
    return scored(spark, sf).withColumns({c: impute(c).cast("double") for c in MODEL_VARS})


def fitting_frame(spark, sf, weight=("weight",)):
    """What the models are fitted on and score. A fit reads its rows once for each step, so they are joined and written once."""
    return cut_lineage(model_frame(spark, sf).select("sample", "target", *weight, *MODEL_VARS))


@query("glm_logit")
def glm_logit(spark, sf):
    s = fitting_frame(spark, sf)
    return M.glm_table(M.fit_glm(s.filter("sample = 'Train'"), MODEL_VARS, "target", "weight"), MODEL_VARS)


@query("gbt_train")
def gbt_train(spark, sf):
    """The first cut at its full number of rounds, and the mean score of each sample."""
    s = fitting_frame(spark, sf)
    m = M.fit_gbt(s.filter("sample = 'Train'"), MODEL_VARS, "target", M.FIRST_CUT)
    return M.score(m, s).groupBy("sample").agg(F.count("*").alias("n"), F.avg("prob").alias("mean_prob"))


@query("gbt_importance_facts", "select true as gain_is_whole, true as frequency_is_whole, true as cover_is_whole, 4::bigint as n")
def gbt_importance_facts(spark, sf):
    """Each kind of importance is a share of a whole, over all variables."""
    s = fitting_frame(spark, sf)
    m = M.fit_gbt(s.filter("sample = 'Train'"), MODEL_VARS, "target", dict(maxDepth=2, maxIter=3, stepSize=0.1))
    whole = lambda c: (F.abs(F.sum(c) - 1) < 1e-9).alias(f"{c}_is_whole")
    return M.gbt_importance(m, MODEL_VARS, spark).agg(whole("gain"), whole("frequency"), whole("cover"), F.count("*").alias("n"))


@query("gbt_importance")
def gbt_importance(spark, sf):
    s = fitting_frame(spark, sf)
    m = M.fit_gbt(s.filter("sample = 'Train'"), MODEL_VARS, "target", dict(maxDepth=1, maxIter=10, stepSize=0.1))
    d = small_frame(spark, {"variable": (MODEL_VARS, pa.string()), "description": ([f"Line {v}" for v in MODEL_VARS], pa.string())})
    return M.gbt_importance(m, MODEL_VARS, spark, d)


@query("score")
def score(spark, sf):
    s = fitting_frame(spark, sf, weight=())
    m = M.fit_glm(s.filter("sample = 'Train'"), MODEL_VARS, "target")
    return E.gini_ks(M.score(m, s), by=("sample",))




@query("glm_score_equations", "select unnest(['quantity', 'price', 'discount', 'tax', '(intercept)']) as variable, true as solved")
def glm_score_equations(spark, sf):
    """A fitted logit solves sum(w x (y - p)) = 0 for every variable and for the intercept."""
    s = fitting_frame(spark, sf).filter("sample = 'Train'")
    fitted = M.score(M.fit_glm(s, MODEL_VARS, "target", "weight"), s)
    left = F.col("weight") * (F.col("target") - F.col("prob"))
    parts = {"(intercept)": F.lit(1.0), **{v: F.col(v) for v in MODEL_VARS}}
    one = fitted.agg(*[(F.abs(F.sum(left * x)) <= 1e-6 * F.sum(F.abs(left * x))).alias(n) for n, x in parts.items()])
    return one.unpivot([], [F.col(f"`{n}`") for n in parts], "variable", "solved")


@query("score_facts", with_(SCORED, body="select sample, count(*) as n, true as within from scored group by 1"))
def score_facts(spark, sf):
    """Every row has a probability, from the logit and from the trees alike."""
    s = fitting_frame(spark, sf)
    train = s.filter("sample = 'Train'")
    a = M.score(M.fit_glm(train, MODEL_VARS, "target"), s)
    b = M.score(M.fit_gbt(train, MODEL_VARS, "target", dict(maxDepth=1, maxIter=3, stepSize=0.1)), a, "prob_trees")
    return b.groupBy("sample").agg(F.count("*").alias("n"), F.bool_and(F.coalesce(F.col("prob").between(0, 1) & F.col("prob_trees").between(0, 1), F.lit(False))).alias("within"))


@query("woe_logit_facts", "select unnest(['price', 'quantity', 'tax', 'total']) as variable, true as slope_is_one, true as intercept_is_log_odds")
def woe_logit_facts(spark, sf):
    """A logit on one WOE column alone has slope 1, and the log odds of all rows as intercept."""
    cols = ["price", "quantity", "tax", "total"]
    train = scored(spark, sf).filter("sample = 'Train'")
    bins = B.fit_bins(train, "target", cols, tolerance=0.0)
    x = cut_lineage(W.woe_transform(B.apply_bins(train, bins, cols), bins, cols).select("target", *[f"{c}_woe" for c in cols]))
    want, one, level = M.expected_intercept(x, "target"), [], []
    for c in cols:
        intercept, slope = M.one_variable_logit(x, f"{c}_woe", "target")
        flat = x.agg(F.max(f"{c}_woe") - F.min(f"{c}_woe")).first()[0] < 1e-9  # one bin: there is no slope
        one.append(flat or abs(slope - 1) < 0.05)
        level.append(abs(intercept - want) < 0.02)
    return small_frame(spark, {"variable": (cols, pa.string()), "slope_is_one": (one, pa.bool_()), "intercept_is_log_odds": (level, pa.bool_())})


# ---- boosting at the full number of rounds -----------------------------------------------------------------------------------
def boost_facts(spark, sf, settings):
    """Facts of a booster of all rounds: how many trees; shares that are wholes; scores that answer for the events of
    the training rows and beat the mean as a guess, on them."""
    s = fitting_frame(spark, sf)
    train = s.filter("sample = 'Train'")
    model = BT.fit(train, MODEL_VARS, "target", settings, "weight")
    split = any((t.variable >= 0).any() for t in model.trees)
    whole = lambda c: (F.abs(F.sum(c) - (1 if split else 0)) < 1e-9).alias(f"{c}_is_whole")
    shares = BT.importance(model, spark).agg(whole("gain"), whole("cover"), whole("frequency"), F.count("*").alias("variables")).first().asDict()
    p, y, w = F.col("prob"), F.col("target"), F.col("weight")
    fitted = BT.predict(model, train).agg(F.sum(w * p).alias("wp"), F.sum(w * y).alias("wy"), F.sum(w).alias("w"),
                                         F.sum(-w * F.when(y == 1, F.log(p)).otherwise(F.log(1 - p))).alias("loss"))
    rate = F.col("wy") / F.col("w")
    guess = -F.col("w") * (rate * F.log(rate) + (1 - rate) * F.log(1 - rate))
    facts = fitted.select(F.lit(len(model.trees)).cast("long").alias("trees"), (F.abs(F.col("wp") / F.col("wy") - 1) < 0.02).alias("answers_for_events"), (F.col("loss") <= guess * 1.0001).alias("beats_the_mean"))
    return facts.withColumns({k: F.lit(v).cast("long") if k == "variables" else F.lit(v) for k, v in shares.items()})


BOOST_FACTS = "select {}::bigint as trees, true as answers_for_events, true as beats_the_mean, true as gain_is_whole, true as cover_is_whole, true as frequency_is_whole, 4::bigint as variables"


@query("boost_selection_facts", BOOST_FACTS.format(1500))
def boost_selection_facts(spark, sf):
    return boost_facts(spark, sf, BT.SELECTION)


@query("boost_first_cut_facts", BOOST_FACTS.format(1000))
def boost_first_cut_facts(spark, sf):
    return boost_facts(spark, sf, BT.FIRST_CUT)


@query("boost_importance")
def boost_importance(spark, sf):
    """Gain, cover and frequency of the 1,500 stumps that rank the variables, with their descriptions."""
    s = fitting_frame(spark, sf)
    d = small_frame(spark, {"variable": (MODEL_VARS, pa.string()), "description": ([f"Line {v}" for v in MODEL_VARS], pa.string())})
    return BT.importance(BT.fit(s.filter("sample = 'Train'"), MODEL_VARS, "target", BT.SELECTION, "weight"), spark, d)
