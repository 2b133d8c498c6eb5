"""Joins, aggregates, order-dependent operators, sets."""

from pyspark.sql import functions as F

from lendgrain.functions import columns as C
from lendgrain.functions import trade_columns as TC
from lendgrain.operators import aggregates as A
from lendgrain.operators import relational as R
from lendgrain.operators import windows as W
from lendgrain.operators.enquiry import prepare_enquiries
from lendgrain.plans.registry import query
from lendgrain.plans.sql_tables import (BASE, ENQ, MEMBER_DATES, RAW_ENQ, RAW_TRADES, SCORED, TRADES, mdiff, months_between, rnd, with_)
from lendgrain.sources import driver_tables as D


def enq(spark, sf):
    return prepare_enquiries(D.raw_enquiries(spark, sf), spark)


def base(spark, sf):
    return TC.trade_base(D.trades(spark, sf))


# ---- joins ---------------------------------------------------------------------------------------------
@query("join_inner", "select o_orderkey as account, o_custkey as member, c_mktsegment as segment from orders join customer on o_custkey = c_custkey")
def join_inner(spark, sf):
    o = D.table(spark, sf, "orders").select(F.col("o_orderkey").alias("account"), F.col("o_custkey").alias("member"))
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), F.col("c_mktsegment").alias("segment"))
    return R.join(o, c, "member")


@query("join_left", "select c_custkey as member, n_name as nation, o_orderkey as account from customer left join nation on c_nationkey = n_nationkey and n_regionkey < 3 left join orders on o_custkey = c_custkey and o_totalprice > 490000")
def join_left(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), F.col("c_nationkey").alias("n_nationkey"))
    n = D.table(spark, sf, "nation").filter("n_regionkey < 3").select("n_nationkey", F.col("n_name").alias("nation"))
    o = D.table(spark, sf, "orders").filter("o_totalprice > 490000").select(F.col("o_custkey").alias("member"), F.col("o_orderkey").alias("account"))
    j = R.join(c, n, "n_nationkey", "left", small_right=True).drop("n_nationkey")
    return R.join(j, o, "member", "left")


@query("join_anti", "select p_partkey, p_name from part where p_partkey not in (select l_partkey from lineitem where l_quantity >= 45)")
def join_anti(spark, sf):
    p = D.table(spark, sf, "part").select("p_partkey", "p_name")
    li = D.table(spark, sf, "lineitem").filter("l_quantity >= 45").select(F.col("l_partkey").alias("p_partkey"))
    return R.anti_join(p, li, "p_partkey")


BANDS_SQL = "bands as (select * from (values (1, 1, 10), (2, 10, 20), (3, 20, 30), (4, 32, 60)) t(band, lo, hi))"


def quantity_bands(spark):
    import pyarrow as pa
    from lendgrain.functions.lookups import small_frame
    return small_frame(spark, {"band": ([1, 2, 3, 4], pa.int32()), "lo": ([1, 10, 20, 32], pa.int32()), "hi": ([10, 20, 30, 60], pa.int32())})


@query("join_range", "with " + BANDS_SQL + " select band, count(*) as n, sum(l_quantity) as quantity from lineitem join bands on l_quantity between lo and hi group by band")
def join_range(spark, sf):
    li = D.table(spark, sf, "lineitem").select("l_quantity")
    return R.band_join(li, quantity_bands(spark), "l_quantity", "lo", "hi").groupBy("band").agg(
        F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"))


@query("join_cross", "with " + BANDS_SQL + " select c_custkey as member, band, c_acctbal * band as scaled from customer cross join bands")
def join_cross(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), "c_acctbal")
    return R.cross_small(c, quantity_bands(spark)).select("member", "band", (F.col("c_acctbal") * F.col("band")).alias("scaled"))


@query("join_point_in_time", with_(RAW_TRADES, MEMBER_DATES, body="select member, own_as_of, count(*) as n, max(opened) as newest, max(sanction) as largest from raw_trades join member_dates using (member) where opened < own_as_of group by all"))
def join_point_in_time(spark, sf):
    t = D.raw_trades(spark, sf).select("member", "opened", "sanction")
    j = R.asof_join(t, D.member_dates(spark, sf), "member", "opened", "own_as_of")
    return j.groupBy("member", "own_as_of").agg(F.count("*").alias("n"), F.max("opened").alias("newest"), F.max("sanction").alias("largest"))


@query("positional_join", "select o_orderkey, o_totalprice, o_totalprice * 2 as doubled, o_orderstatus from orders")
def positional_join(spark, sf):
    o = D.table(spark, sf, "orders")
    left = o.select("o_orderkey", "o_totalprice", "o_orderstatus")
    right = o.select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("doubled"))
    return R.keyed_join(left, right, "o_orderkey")


# ---- aggregates ------------------------------------------------------------------------------------------
@query("group_agg", with_(TRADES, body="select member, count(*) as n, sum(balance) as balance, avg(sanction) as mean_sanction, max(overdue) as worst, min(opened) as oldest from trades group by member"))
def group_agg(spark, sf):
    return A.group_agg(D.trades(spark, sf), "member", [
        F.count("*").alias("n"), F.sum("balance").alias("balance"), F.avg("sanction").alias("mean_sanction"),
        F.max("overdue").alias("worst"), F.min("opened").alias("oldest")])


@query("group_by_member_month", with_(RAW_TRADES, body="select member, cast(date_trunc('month', opened) as date) as loan_month, count(*) as n, sum(sanction) as sanction from raw_trades group by 1, 2"))
def group_by_member_month(spark, sf):
    t = D.raw_trades(spark, sf).withColumn("loan_month", F.trunc("opened", "month"))
    return A.group_agg(t, ["member", "loan_month"], [F.count("*").alias("n"), F.sum("sanction").alias("sanction")])


@query("count_distinct", with_(RAW_TRADES, body="select member, count(distinct account_type) as n_types, count(distinct case when opened >= date '1999-01-01' then account_type end) as n_recent from raw_trades group by member"))
def count_distinct(spark, sf):
    t = D.raw_trades(spark, sf).select("member", "account_type", F.datediff("as_of", "opened").alias("age"))
    return A.distinct_within(t, "member", "account_type", "age", {"n_types": None, "n_recent": 731})


@query("cond_sum", with_(BASE, body="select member, sum(case when product = 'PL' then balance else 0 end)::double as pl_zero, sum(case when product = 'PL' then balance end) as pl_null from base group by member"))
def cond_sum(spark, sf):
    return base(spark, sf).groupBy("member").agg(
        A.cond_sum(F.col("product") == "PL", "balance").alias("pl_zero"), A.cond_sum(F.col("product") == "PL", "balance", "null").alias("pl_null"))


@query("cond_count", with_(BASE, body="select member, count(case when is_open = 1 then 1 end) as n_open, count(case when tenure <= 12 and product = 'CC' then 1 end) as n_new_cards from base group by member"))
def cond_count(spark, sf):
    return base(spark, sf).groupBy("member").agg(
        A.cond_count(F.col("is_open") == 1).alias("n_open"), A.cond_count((F.col("tenure") <= 12) & (F.col("product") == "CC")).alias("n_new_cards"))


@query("cond_max", with_(BASE, body="select member, max(case when secured = 1 then sanction end) as top_secured, max(case when product = 'GL' then sanction else 0 end) as top_gold, avg(case when is_open = 1 then tenure end) as open_tenure from base group by member"))
def cond_max(spark, sf):
    return base(spark, sf).groupBy("member").agg(
        A.cond_agg("max", "sanction", F.col("secured") == 1).alias("top_secured"),
        A.cond_agg("max", "sanction", F.col("product") == "GL", "zero").alias("top_gold"),
        A.cond_agg("avg", "tenure", F.col("is_open") == 1).alias("open_tenure"))


def moment_sql(x):
    d = f"cast({x} as double)"
    c3 = f"(avg({d} ** 3) - 3 * avg({d}) * avg({d} ** 2) + 2 * avg({d}) ** 3)"
    c4 = f"(avg({d} ** 4) - 4 * avg({d}) * avg({d} ** 3) + 6 * avg({d}) ** 2 * avg({d} ** 2) - 3 * avg({d}) ** 4)"
    ok = f"max({d}) > min({d})"
    return {"avg": f"avg({d})", "median": f"quantile_cont({d}, 0.5)", "max": f"max({d})", "min": f"min({d})", "stddev": f"stddev_samp({d})",
            "skewness": f"case when {ok} then {c3} / var_pop({d}) ** 1.5 end", "kurtosis": f"case when {ok} then {c4} / var_pop({d}) ** 2 - 3 end"}


@query("moments", with_(TRADES, body="select member, " + ", ".join(f"{rnd(e)} as {n}" for n, e in moment_sql("m_open").items()) + " from trades group by member"))
def moments(spark, sf):
    return A.group_moments(D.trades(spark, sf), "member", "m_open")


@query("coef_variation", with_(TRADES, body=f"select member, case when avg(m_open) = 0 then null else {rnd('stddev_samp(m_open) / avg(m_open)')} end as cv from trades group by member"))
def coef_variation(spark, sf):
    g = D.trades(spark, sf).groupBy("member").agg(F.stddev("m_open").alias("s"), F.avg("m_open").alias("a"))
    return g.select("member", A.coef_var("s", "a").alias("cv"))


@query("first_value_agg", with_(RAW_ENQ, body="select member, any_value(as_of) as as_of from raw_enq group by member"))
def first_value_agg(spark, sf):
    return D.raw_enquiries(spark, sf).groupBy("member").agg(A.constant_of("as_of").alias("as_of"))


@query("median_mean_min_max", with_(TRADES, body=f"""select member, product, min({mdiff('closed', 'opened')})::integer as span_min, max({mdiff('closed', 'opened')})::integer as span_max,
  avg({mdiff('closed', 'opened')}) as span_mean, quantile_cont(cast({mdiff('closed', 'opened')} as double), 0.5) as span_median from trades group by member, product"""))
def median_mean_min_max(spark, sf):
    t = D.trades(spark, sf).withColumn("span", C.month_diff("closed", "opened"))
    return A.group_stats(t, ["member", "product"], "span", "span_")


@query("row_greatest", with_(BASE, body="select account, greatest(live[1], live[2], live[3]) as live_q1, list_max(live) as ever_live, greatest(balance, overdue, high_credit) as top from base"))
def row_greatest(spark, sf):
    return base(spark, sf).select("account", A.row_max(*[F.col("live")[i] for i in range(3)]).alias("live_q1"),
                                  F.array_max("live").alias("ever_live"), A.row_max("balance", "overdue", "high_credit").alias("top"))


@query("group_count", with_(TRADES, body="select product, secured, count(*) as n from trades group by all"))
def group_count(spark, sf):
    return A.group_count(D.trades(spark, sf), ["product", "secured"])


@query("weighted_agg", with_(SCORED, body="select sample, priority, sum(weight) as total, sum(target * weight) as events, sum((1 - target) * weight) as non_events from scored group by all"))
def weighted_agg(spark, sf):
    return A.weighted_agg(D.scored(spark, sf), ["sample", "priority"], "target", "weight")


# ---- order-dependent -----------------------------------------------------------------------------------------
@query("dedup_keep_max", with_(RAW_ENQ, body="select member, enq_date, purpose, max(amount) as amount, as_of from (select distinct * from raw_enq) group by all"))
def dedup_keep_max(spark, sf):
    return W.dedup_keep(D.raw_enquiries(spark, sf), ["member", "enq_date", "purpose", "as_of"], "amount")


@query("dedup_keep_row", "select o_custkey, o_orderstatus, max(o_totalprice) as o_totalprice, arg_max(o_orderkey, o_totalprice) as o_orderkey, arg_max(o_orderpriority, o_totalprice) as o_orderpriority from orders group by 1, 2")
def dedup_keep_row(spark, sf):
    o = D.table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_totalprice", "o_orderkey", "o_orderpriority")
    return W.dedup_keep(o, ["o_custkey", "o_orderstatus"], "o_totalprice")


@query("first_last_product", with_(ENQ, body="select member, first(product order by enq_date, amount desc, product) as first_product, first(product order by enq_date desc, amount desc, product) as latest_product from enq group by member"))
def first_last_product(spark, sf):
    return W.first_last(enq(spark, sf), "member", "enq_date", "amount", "product", "first_product", "latest_product")


@query("prev_date_gap", with_(ENQ, "g as (select member, enq_date, cast(enq_date - lag(enq_date) over (partition by member order by enq_date) as integer) as gap from enq)",
                              body="select member, enq_date, gap, count(*) as n from g where gap is not null group by all"))
def prev_date_gap(spark, sf):
    return W.gap_table(enq(spark, sf), "member", "enq_date")


@query("partition_extreme", with_(BASE, """x as (select *, max(highest) over (partition by member, product) as top, max(m_open) over (partition by member, product) as oldest, min(m_open) over (partition by member, product) as newest from base)""",
    body="""select member, product, sum(case when highest = top then balance end) as at_top, sum(case when m_open = oldest then highest end) as at_oldest,
  sum(case when m_open = newest then balance end) as at_newest from x group by member, product"""))
def partition_extreme(spark, sf):
    return A.sum_at_extreme(base(spark, sf), ["member", "product"], [
        ("at_top", "highest", "max", "balance"), ("at_oldest", "m_open", "max", "highest"), ("at_newest", "m_open", "min", "balance")])


@query("latest_value", with_(ENQ, body="select member, product, first(amount order by enq_date desc, amount desc) as latest_amount from enq group by member, product"))
def latest_value(spark, sf):
    return W.latest_value(enq(spark, sf), ["member", "product"], ["enq_date", "amount"], "amount", "latest_amount")


@query("row_number_by_product", with_(BASE, "r as (select *, row_number() over (partition by member, product order by opened desc, limit_amount desc, balance desc) as rn from base)",
    body="select member, product, limit_amount, balance from r where rn = 1"))
def row_number_by_product(spark, sf):
    return W.newest_per(base(spark, sf), ["member", "product"], ["opened", "limit_amount"], ["balance", "limit_amount"])


@query("first_latest_loan_in_category", with_(BASE, body="""select member,
  first(highest order by opened, highest desc) filter (product = 'PL') as first_pl, first(highest order by opened desc, highest desc) filter (product = 'PL') as latest_pl,
  first(highest order by opened, highest desc) filter (secured = 1) as first_sec, first(highest order by opened desc, highest desc) filter (secured = 1) as latest_sec from base group by member"""))
def first_latest_loan_in_category(spark, sf):
    b = base(spark, sf)
    out = []
    for n, cond in (("pl", F.col("product") == "PL"), ("sec", F.col("secured") == 1)):
        out += [F.min(F.when(cond, F.struct("opened", (-F.col("highest")).alias("h")))).getField("h").__neg__().alias(f"first_{n}"),
                F.max(F.when(cond, F.struct("opened", F.col("highest").alias("h")))).getField("h").alias(f"latest_{n}")]
    return b.groupBy("member").agg(*out)



@query("lag_gap", with_(BASE, """g as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base),
  g1 as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base where highest <= 100000),
  g3 as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base where highest > 300000)""",
    body="""select member, avg(gap) as mean_gap, (select avg(gap) from g1 where g1.member = g.member) as mean_gap_small,
  (select avg(gap) from g3 where g3.member = g.member) as mean_gap_large from g group by member"""))
def lag_gap(spark, sf):
    b = base(spark, sf)
    return b.groupBy("member").agg(W.mean_gap("opened").alias("mean_gap"), W.mean_gap("opened", F.col("highest") <= 100000).alias("mean_gap_small"),
                                   W.mean_gap("opened", F.col("highest") > 300000).alias("mean_gap_large"))


@query("reopen_after_close", with_(BASE, "l as (select member, product, account, opened, closed, lag(closed) over (partition by member, product order by opened, account) as prev_closed from base)",
    body="select member, product, account, opened, closed, prev_closed, case when opened > prev_closed then 1 else 0 end as reopened, "
    + ", ".join(f"case when opened > prev_closed and {months_between('opened', 'prev_closed')} < {m} then 1 else 0 end as reopen_{m}m" for m in (1, 3, 6, 12)) + " from l"))
def reopen_after_close(spark, sf):
    b = base(spark, sf).select("member", "product", "account", "opened", "closed")
    return W.reopened(b, ["member", "product"], "opened", "closed", "account")


@query("latest_event_in_partition", with_(BASE, body=f"select member, max(case when written_off = 1 then reported end) as latest_event, cast({mdiff('max(as_of)', 'max(case when written_off = 1 then reported end)')} as integer) as months_since from base group by member"))
def latest_event_in_partition(spark, sf):
    e = W.latest_event(base(spark, sf), "member", "reported", F.col("written_off") == 1)
    return e.withColumn("months_since", C.month_diff(F.lit(D.TRADE_ASOF).cast("date"), "latest_event"))


@query("cumulative", with_(SCORED, "d as (select cast(floor(quantity / 10) as bigint) as bin, count(*) as n, cast(sum(target) as bigint) as events from scored group by 1)",
    body="select bin, n, events, cast(sum(n) over w as bigint) as cum_n, cast(sum(events) over w as bigint) as cum_events from d window w as (order by bin rows unbounded preceding)"))
def cumulative(spark, sf):
    d = D.scored(spark, sf).groupBy(F.floor(F.col("quantity") / 10).alias("bin")).agg(F.count("*").alias("n"), F.sum("target").alias("events"))
    return A.running_totals(d, "bin", ["n", "events"])


@query("row_index", with_(SCORED, "d as (select priority, count(*) as n from scored group by 1)", body="select priority, n, cast(row_number() over (order by priority desc) as integer) as decile from d"))
def row_index(spark, sf):
    d = D.scored(spark, sf).groupBy("priority").agg(F.count("*").alias("n"))
    return A.row_index(d, "priority", ascending=False)


# ---- sort, limit, sets ---------------------------------------------------------------------------------------
@query("sort", "select o_custkey as member, count(*) as n, sum(floor(o_totalprice)) as total from orders group by 1 order by n desc, member")
def sort(spark, sf):
    g = D.table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("member")).agg(F.count("*").alias("n"), F.sum(F.floor("o_totalprice").cast("double")).alias("total"))
    return R.sort(g, F.desc("n"), "member")


@query("preview", "select o_orderkey, o_totalprice from orders order by o_orderkey limit 20")
def preview(spark, sf):
    return R.head(R.sort(D.table(spark, sf, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey"), 20)


@query("distinct", "select distinct o_custkey, o_orderpriority from orders")
def distinct(spark, sf):
    return R.distinct(D.table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"])


@query("union_all", "select o_custkey as member, 'order' as kind from orders union all select user_id, 'event' from events")
def union_all(spark, sf):
    a = D.table(spark, sf, "orders").select(F.col("o_custkey").alias("member"), F.lit("order").alias("kind"))
    return R.stack([a, D.table(spark, sf, "events").select(F.lit("event").alias("kind"), F.col("user_id").alias("member"))])


def _sets(spark, sf):
    return (D.table(spark, sf, "orders").select(F.col("o_custkey").alias("member")),
            D.table(spark, sf, "events").select(F.col("user_id").alias("member")))


for _name, _op, _sql in (("union_set", R.union_set, "union"), ("intersect", R.intersect, "intersect"), ("except", R.minus, "except")):
    def _run(spark, sf, op=_op):
        return op(*_sets(spark, sf))
    query(_name, f"select o_custkey as member from orders {_sql} select user_id from events")(_run)


@query("unpivot", "select c_custkey as member, u.variable, u.value from customer, lateral (select unnest(['c_acctbal', 'c_nationkey']) as variable, unnest([c_acctbal, c_nationkey::double]) as value) u")
def unpivot(spark, sf):
    c = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("member"), "c_acctbal", "c_nationkey")
    return R.unpivot(c, ["member"], ["c_acctbal", "c_nationkey"])


@query("variance_filter", "select 'c_acctbal' as variable, round(var_samp(c_acctbal), 4) as variance from customer")
def variance_filter(spark, sf):
    from lendgrain.modelling.select import variances
    c = D.table(spark, sf, "customer").withColumn("constant", F.lit(3.0))
    return variances(c, ["c_acctbal", "constant"]).filter("variance > 0").select("variable", F.round("variance", 4).alias("variance"))


