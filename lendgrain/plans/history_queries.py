"""Payment-history operators on monthly cells of `lineitem` (arrays are shown as text to be compared)."""

from pyspark.sql import functions as F

from lendgrain.functions import columns as C
from lendgrain.functions import history as H
from lendgrain.functions import trade_columns as TC
from lendgrain.operators.aggregates import exprs, monthly_totals, trend_counts
from lendgrain.plans.registry import query
from lendgrain.plans.sql_tables import BASE, BUCKET_A, CELLS, RAW_TRADES, TRADES, mdiff, with_
from lendgrain.sources import driver_tables as D


def show(arr):
    """An array of whole numbers or text as one string, null as n."""
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("string"), F.lit("n"))), ",")


def show_long(arr):
    return F.array_join(F.transform(arr, lambda x: F.coalesce(x.cast("long").cast("string"), F.lit("n"))), ",")


def show_sql(arr, as_type=None):
    x = f"cast(x as {as_type})" if as_type else "x"
    return f"array_to_string(list_transform({arr}, lambda x: coalesce(cast({x} as varchar), 'n')), ',')"


def base(spark, sf):
    return TC.trade_base(D.trades(spark, sf))


def add(name, sql, make, ctes=(TRADES,), frame=D.trades):
    """A query that only projects columns of one frame."""
    def run(spark, sf):
        return frame(spark, sf).select("account", *make())
    query(name, with_(*ctes, body=sql))(run)


HIST = (CELLS,)

# ---- unpack, pad, bucket --------------------------------------------------------------------------------
SLOTS3 = "list_transform(range(1, 37), lambda i: substr(dpd_text, cast(3 * i - 2 as integer), 3))"
add("hist_unpack_fixed", f"select account, {show_sql(SLOTS3)} as slots from hist",
    lambda: [show(H.unpack("dpd_text")).alias("slots")], HIST, D.account_history)
add("hist_unpack_list", f"select account, {show_sql('months')} as dates, {show_sql('bals', 'bigint')} as balances, {show_sql('dues', 'bigint')} as overdue from hist",
    lambda: [show(H.unpack_list("reported_list", "date")).alias("dates"), show_long(H.unpack_list("balance_list")).alias("balances"),
             show_long(H.unpack_list("overdue_list")).alias("overdue")], HIST, D.history_lists)
add("hist_pad_history", "select account, rpad(dpd_text, cast(greatest(length(dpd_text), 36) as integer), '0') as padded from hist",
    lambda: [H.pad_history("dpd_text", 12).alias("padded")], HIST, D.account_history)
_B = """case when {c} = 'XXX' then 9 when {c} = 'STD' then 0 when try_cast({c} as integer) between 360 and 999 then 7
  when try_cast({c} as integer) between 180 and 359 then 6 when try_cast({c} as integer) between 150 and 179 then 5
  when try_cast({c} as integer) between 90 and 149 then 4 when try_cast({c} as integer) between 60 and 89 then 3
  when try_cast({c} as integer) between 30 and 59 then 2 when try_cast({c} as integer) between 1 and 29 then 1
  when try_cast({c} as integer) = 0 then 0 else 8 end"""
_C = """case substr({c}, 3, 1) when '0' then 0 when 'S' then 0 when '1' then 2 when '2' then 3 when '3' then 4 when '4' then 4 when 'B' then 4 when 'D' then 4
  when 'L' then 4 when 'M' then 4 when '5' then 5 when '6' then 6 else -1 end"""
add("hist_bucket_dpd", "select account, " + ", ".join(
    show_sql(f"list_transform({SLOTS3}, lambda c: {rule.format(c='c')})") + f" as {n}" for n, rule in (("a", BUCKET_A), ("b", _B), ("c", _C))) + " from hist",
    lambda: [show(H.bucket_dpd(H.unpack("dpd_text"), "a")).alias("a"), show(H.bucket_dpd(H.unpack("dpd_text"), "b")).alias("b"),
             show(H.bucket_dpd(F.transform(H.unpack("dpd_text"), lambda x: F.substring(x, 3, 1)), "c")).alias("c")], HIST, D.account_history)
add("hist_code_days", """select account, case when c = 'SUB' then 91 when c = 'STD' and overdue > 5000 then 89 when c = 'XXX' then -1 when c = 'STD' then 0
   when c = '901' and overdue < 1000 then 0 when c = '901' and overdue <= 2000 then 29 when c = '901' and overdue <= 5000 then 30 when c = '901' then 90
   when c = '905' then 61 else cast(c as integer) end as days from (select account, overdue, substr(dpd_text, 7, 3) as c from hist)""",
    lambda: [H.code_to_days(F.substring("dpd_text", 7, 3), "overdue", F.lit(False)).alias("days")], HIST, D.account_history)

# ---- alignment ----------------------------------------------------------------------------------------------
add("hist_align_slots_prefix", f"select account, repeat('8,', cast(greatest(k - 1, 0) as integer)) || {show_sql('bals', 'bigint')} as line from (select *, {mdiff('as_of', 'hist_start')} as k from raw_trades)",
    lambda: [F.concat(F.expr("repeat('8,', greatest(k - 1, 0))"), show_long("bals")).alias("line")], (RAW_TRADES,),
    lambda s, sf: D.raw_trades(s, sf).withColumn("k", C.month_diff("as_of", "hist_start")))
add("hist_prefix_nulls", f"select account, {show_sql('list_concat(list_transform(range(1, greatest(k, 1)), lambda i: null::double), bals)', 'bigint')} as line from (select *, {mdiff('as_of', 'hist_start')} as k from raw_trades)",
    lambda: [show_long(H.align_prefix("bals", "k", F.lit(None).cast("double"))).alias("line")], (RAW_TRADES,),
    lambda s, sf: D.raw_trades(s, sf).withColumn("k", C.month_diff("as_of", "hist_start")))
add("hist_cut_future", f"select account, {show_sql('case when k <= 0 then list_slice(bals, cast(2 - k as bigint), 1000) else bals end', 'bigint')} as line from (select *, {mdiff('as_of', 'hist_start')} as k from raw_trades)",
    lambda: [show_long(H.cut_future("bals", "k")).alias("line")], (RAW_TRADES,),
    lambda s, sf: D.raw_trades(s, sf).withColumn("k", C.month_diff("as_of", "hist_start")))
add("hist_align_slots_dates", f"select account, {show_sql('bal', 'bigint')} as bal, {show_sql('due', 'bigint')} as due from trades",
    lambda: [show_long("bal").alias("bal"), show_long("due").alias("due")])
add("hist_mark_out_of_range", f"select account, {show_sql('dpd')} as dpd, {show_sql('phist')} as newest from trades",
    lambda: [show("dpd").alias("dpd"), show("phist").alias("newest")])
add("hist_mark_not_reported", "select account, " + show_sql(f"list_transform({SLOTS3}, lambda c: case {_B.format(c='c')} when 9 then -2 when 8 then -1 else {_B.format(c='c')} end)") + " as line from hist",
    lambda: [show(H.mark_not_reported(H.bucket_dpd(H.unpack("dpd_text"), "b"))).alias("line")], HIST, D.account_history)
add("hist_explode_slots", "select account, " + ", ".join(f"dpd[{i}] as dpd_{i}, bal[{i}] as bal_{i}" for i in range(1, 37)) + " from trades",
    lambda: exprs([f"get(dpd, {i - 1}) as dpd_{i}" for i in range(1, 37)] + [f"get(bal, {i - 1}) as bal_{i}" for i in range(1, 37)]))

# ---- questions -------------------------------------------------------------------------------------------------
_n = "list_slice(dpd, 1, {n})"


def _cnt(test, n):
    return f"len(list_filter({_n.format(n=n)}, lambda x: x {test}))"


def cases(template, ns, bs):
    return ", ".join(template(n, b) for n in ns for b in bs)


add("hist_any_ge", "select account, " + cases(lambda n, b: f"case when {_cnt(f'>= {b}', n)} > 0 then 1 else 0 end as any_{b}_{n}", (12, 24), range(0, 8)) + " from trades",
    lambda: [H.any_ge("dpd", n, b).alias(f"any_{b}_{n}") for n in (12, 24) for b in range(0, 8)])
add("hist_count_ge", "select account, " + cases(lambda n, b: f"cast({_cnt(f'>= {b}', n)} as integer) as n_{b}_{n}", (6, 24), range(0, 5))
    + f", cast({_cnt('= 0', 24)} as integer) as n_zero, cast(case when len(list_filter(list_slice(bal, 1, 3), lambda x: x is null)) = 0 then len(list_filter(list_slice(bal, 1, 3), lambda x: x >= 50000)) end as integer) as n_bal from trades",
    lambda: [H.count_ge("dpd", n, b).alias(f"n_{b}_{n}") for n in (6, 24) for b in range(0, 5)]
    + [H.count_eq("dpd", 24, 0).alias("n_zero"), H.count_ge("bal", 3, 50000).alias("n_bal")])
add("hist_max", "select account, " + ", ".join(f"list_max({_n.format(n=n)}) as max_{n}" for n in (3, 6, 12, 24, 36))
    + ", list_max(list_slice(bal, 1, 12)) as max_bal, case list_max(list_slice(dpd, 1, 24)) when 0 then 0 when 1 then 1 when 2 then 30 when 3 then 60 when 4 then 90 when 5 then 150 when 6 then 180 when 7 then 180 end as worst_days from trades",
    lambda: [H.hist_max("dpd", n).alias(f"max_{n}") for n in (3, 6, 12, 24, 36)] + [H.hist_max("bal", 12).alias("max_bal"), H.bucket_to_days(H.hist_max("dpd", 24)).alias("worst_days")])


def _first(test, arr="dpd"):
    return f"list_min(list_filter(range(1, 37), lambda i: {arr}[i] {test}))"


add("hist_first_pos", f"""select account, cast({_first('> 0')} as integer) as first_bad, cast(list_max(list_filter(range(1, 37), lambda i: dpd[i] > 0)) as integer) as last_bad,
  cast(list_position(dpd, list_max(list_slice(dpd, 1, 24))) as integer) as peak from trades""",
    lambda: [H.first_pos("dpd", lambda x: x > 0).alias("first_bad"), H.last_pos("dpd", lambda x: x > 0).alias("last_bad"), H.peak_pos("dpd").alias("peak")])
add("hist_first_val", "select account, " + ", ".join(
    f"list_filter(list_slice(dpd, 1, 12), lambda x: x {t})[1] as {n}" for n, t in (("first_bad", "> 0"), ("first_valid", ">= 0"), ("first_30", "> 1"), ("first_60", "> 2"), ("first_90", "> 3")))
    + ", list_reverse(list_filter(list_slice(dpd, 1, 12), lambda x: x > 0))[1] as last_bad from trades",
    lambda: [H.first_val("dpd", t, 12).alias(n) for n, t in (("first_bad", lambda x: x > 0), ("first_valid", lambda x: x >= 0), ("first_30", lambda x: x > 1), ("first_60", lambda x: x > 2), ("first_90", lambda x: x > 3))]
    + [H.last_val("dpd", lambda x: x > 0, 12).alias("last_bad")])


def sat_sql(n):
    return (f"case when written_off = 1 then 0 when {_cnt('in (-2, 0, 1)', n)} = {n} then 1 when {_cnt('>= 2', n)} > 0 then 0 end")


add("hist_satisfactory_flag", "select account, " + ", ".join(f"{sat_sql(n)} as sat_{n}" for n in (6, 12, 24)) + " from trades",
    lambda: [H.satisfactory("dpd", n, "written_off").alias(f"sat_{n}") for n in (6, 12, 24)])
add("hist_value_count", f"select account, cast({_cnt('= 0', 36)} as integer) as n_zero, cast({_cnt('= -2', 36)} as integer) as n_absent, case when {_cnt('in (0, -2)', 36)} = 36 then 1 else 0 end as all_current from trades",
    lambda: [H.count_value("dpd", 0).alias("n_zero"), H.count_value("dpd", -2).alias("n_absent"), H.all_current("dpd").alias("all_current")])


def sum_sql(arr, n):
    return f"(case when len(list_filter(list_slice({arr}, 1, {n}), lambda x: x is null)) = 0 then list_sum(list_slice({arr}, 1, {n})) end)"


add("hist_sum_window", "select account, " + ", ".join(f"{sum_sql(a, n)} as {a}_{n}, {sum_sql(a, n)} / {float(n)}::double as mean_{a}_{n}" for a in ("bal", "due") for n in (1, 2, 3, 6)) + " from trades",
    lambda: [x for a in ("bal", "due") for n in (1, 2, 3, 6) for x in (H.sum_first(a, n).alias(f"{a}_{n}"), H.mean_first(a, n).alias(f"mean_{a}_{n}"))])


def serious_sql(n, b):
    both = f"len(list_filter(range(1, {n + 1}), lambda i: dpd[i] >= {b} and due[i] >= 5000)) > 0"
    return f"case when (product = 'CC' and {both}) or (product <> 'CC' and {_cnt(f'>= {b}', n)} > 0) then 1 else 0 end"


add("hist_zip_filter", f"select account, {serious_sql(6, 2)} as dpd30_6m, {serious_sql(24, 3)} as dpd60_24m, {serious_sql(36, 4)} as dpd90_36m from trades",
    lambda: [H.serious_delinquency(F.col("product") == "CC", "dpd", "due", n, b).alias(a) for a, n, b in (("dpd30_6m", 6, 2), ("dpd60_24m", 24, 3), ("dpd90_36m", 36, 4))])
_month = "cast(date '2001-01-01' - to_months(cast(i as integer)) as date)"
add("hist_status_array", "select account, " + show_sql(f"list_transform(range(1, 37), lambda i: case when {_month} between cast(date_trunc('month', opened) as date) and cast(date_trunc('month', coalesce(closed, as_of)) as date) - 1 then 1 else 0 end)") + " as slots from trades",
    lambda: [show(H.status_slots("opened", F.coalesce("closed", "as_of"), "as_of")).alias("slots")])
add("hist_default_after", "select account, len(list_filter(list_slice(list_reverse(list_slice(dpd, 1, cast(greatest(m_open, 0) as bigint))), 2, 14), lambda x: x not in (0, -1, -2))) > 0 as defaulted from trades",
    lambda: [H.default_after("dpd", "m_open").alias("defaulted")])
add("hist_recent_delinquency", "select account, " + ", ".join(f"coalesce(list_filter(list_slice(dpd, 1, 12), lambda x: x >= {b})[1] = list_filter(list_slice(dpd, 1, 12), lambda x: x >= 0)[1], false) as recent_{b}" for b in (2, 3, 4))
    + ", case when live[1] = 1 and list_max(phist) > 0 then list_max(phist) end as live_max from base",
    lambda: [H.recent_delinquency("dpd", b).alias(f"recent_{b}") for b in (2, 3, 4)]
    + [F.when((F.col("live")[0] == 1) & (F.array_max("phist") > 0), F.array_max("phist")).alias("live_max")], (BASE,), base)
add("hist_months_since_delinquency", f"select account, cast(m_start + {_first('> 0')} as integer) as since_first, cast(m_start + list_position(dpd, list_max(list_slice(dpd, 1, 24))) as integer) as since_peak from trades",
    lambda: [H.months_since("m_start", H.first_pos("dpd", lambda x: x > 0)).alias("since_first"), H.months_since("m_start", H.peak_pos("dpd")).alias("since_peak")])
_CC = [f"sum(case when product = 'CC' then bal[{i}] end) as b{i}" for i in range(1, 13)]


_B12 = ", ".join(f"b{i}" for i in range(1, 13))


@query("hist_peak_month", with_(TRADES, "m as (select member, " + ", ".join(_CC) + " from trades group by member)",
       body="select member, case when greatest(" + _B12 + ") is not null then cast(list_position([" + _B12 + "], greatest(" + _B12 + ")) as bigint) end as peak_month from m"))
def hist_peak_month(spark, sf):
    t = D.trades(spark, sf).filter("product is not null")
    g = t.groupBy("member").agg(*exprs([f"sum(case when product = 'CC' then get(bal, {i - 1}) end) as b{i}" for i in range(1, 13)]))
    return g.select("member", H.argmax_slot([f"b{i}" for i in range(1, 13)]).alias("peak_month"))


add("hist_presence_flag", "select account, " + ", ".join(f"case when {_cnt('>= 0', n)} > 0 then 1 else 0 end as present_{n}" for n in (1, 3, 6, 12, 24)) + " from trades",
    lambda: [H.any_reported("dpd", n).alias(f"present_{n}") for n in (1, 3, 6, 12, 24)])
add("hist_concat_buckets", "select account, " + f"list_aggregate(list_transform({SLOTS3}, lambda c: cast({BUCKET_A.format(c='c')} as varchar)), 'string_agg', '')" + " as digits from hist",
    lambda: [H.join_slots(H.bucket_dpd(H.unpack("dpd_text"))).alias("digits")], HIST, D.account_history)

# ---- totals and movement ------------------------------------------------------------------------------------------
TOTALS = [f"sum(bal[{i}]) as s{i}" for i in range(1, 37)]
TOTALS_CTE = "tot as (select member, case when secured = 1 then 'secured' else 'unsecured' end as part, " + ", ".join(TOTALS) + " from trades group by 1, 2)"
_LIST = "[" + ", ".join(f"s{i}" for i in range(1, 37)) + "]"


def totals(spark, sf):
    return monthly_totals(D.trades(spark, sf), "member", "bal", F.when(F.col("secured") == 1, "secured").otherwise("unsecured"))


@query("monthly_totals", with_(TRADES, TOTALS_CTE, body=f"select member, part, {show_sql(_LIST, 'bigint')} as totals from tot"))
def q_monthly_totals(spark, sf):
    return totals(spark, sf).select("member", "part", show_long("totals").alias("totals"))


def moves(n, cmp):
    return "cast(" + " + ".join(f"(case when s{i} {cmp} s{i + 1} + 500 then 1 else 0 end)" for i in range(1, n)) + " as integer)"


@query("trend_counts", with_(TRADES, TOTALS_CTE, body="select member, part, " + ", ".join(f"{moves(n, '>')} as rise_{n}m, {moves(n, '<')} as fall_{n}m" for n in (12, 24, 36)) + " from tot"))
def q_trend_counts(spark, sf):
    return totals(spark, sf).select("member", "part", *trend_counts("totals"))


@query("period_ratio", with_(TRADES, TOTALS_CTE, body="select member, part, case when s12 > 0 then s6 / s12 else -1.0 end as ratio from tot"))
def q_period_ratio(spark, sf):
    return totals(spark, sf).select("member", "part", H.period_ratio("totals").alias("ratio"))
