"""Segment families; the SQL computes every cell of the wide frame directly."""

from lendgrain.functions import trade_columns as TC
from lendgrain.operators import categories as K
from lendgrain.plans.registry import query
from lendgrain.plans.row_queries import CLOSED_CAT, SEGMENT_SQL
from lendgrain.plans.sql_tables import BASE, mdiff, with_
from lendgrain.sources import driver_tables as D

SEGS = {n: f"({SEGMENT_SQL[n]})" for n in {*K.AMOUNT_SEGMENTS, *K.DELINQUENCY_SEGMENTS}}


def _n(test, n):
    return f"len(list_filter(list_slice(dpd, 1, {n}), lambda x: x {test}))"


_cols = [f"case when {CLOSED_CAT} then 1 else 0 end as is_closed", "coalesce(round(case when highest <> 0 then balance / highest end, 3), 0) as util", f"{mdiff('closed', 'opened')} as span"]
_cols += [f"{_n(f'>= {b}', w)} as n{w}_{d}" for w in K.DELINQUENCY_WINDOWS for d, b in K.LEVELS.items()]
_cols += [f"{_n('>= 0', w)} > 0 as p{w}" for w in K.DELINQUENCY_WINDOWS] + [f"list_max(list_slice(dpd, 1, {w})) as w{w}" for w in K.DELINQUENCY_WINDOWS]
_cols.append("1::bigint << (dense_rank() over (order by product) - 1) as own_bit")  # counting different products 300 times takes DuckDB minutes
SEG = BASE + ", seg as materialized (select *, " + ", ".join(_cols) + ", " + ", ".join(f's_{n}' for n in sorted(SEGS)) + " from (select *, " + ", ".join(
    f"{c} as s_{n}" for n, c in sorted(SEGS.items())) + " from base))"


def base(spark, sf):
    return TC.trade_base(D.trades(spark, sf))


def cells(segments, make):
    return [f"{e} as {s}_{n}" for s in segments for n, e in make(f"s_{s}").items()]


def table(items, ctes=()):
    return with_(SEG, *ctes, body="select member, " + ",\n ".join(items) + " from seg group by member")


def amounts(s):
    live = f"{s} and m_report <= 3 and is_closed = 0"
    x = f"case when {live} then highest end"
    small = f"(case when min({x}) = 0 then 0.1::double else min({x}) end)"
    last = f"last(highest order by opened, highest) filter ({live})"
    last = f"(case when {last} = 0 then 0.1::double else {last} end)"
    first = f"first(highest order by opened, highest desc) filter ({live})"
    return {"first_amount": first, "latest_amount": last, "avg_amount": f"avg({x})", "max_amount": f"max({x})", "min_amount": small,
            "ratio_first_latest": f"{first} / {last}", "ratio_max_min": f"max({x}) / {small}", "ratio_max_avg": f"case when avg({x}) <> 0 then max({x}) / avg({x}) end"}


def open_live(s):
    out = {}
    for w in K.WINDOWS:
        live = f"{s} and m_report <= {w} and is_closed = 0"
        b, h = f"sum(case when {live} then balance end)", f"sum(case when {live} then highest end)"
        out.update({f"n_opened_{w}m": f"cast(sum(case when {s} and m_open <= {w} then 1 end) as bigint)", f"n_live_{w}m": f"cast(sum(case when {live} then 1 end) as bigint)",
                    f"live_balance_{w}m": b, f"live_sanction_{w}m": h, f"mean_util_{w}m": f"round(avg(case when {live} then util end), 6)",
                    f"sum_util_{w}m": f"case when {h} <> 0 then round({b} / {h}, 3) end"})
    return out


def spans(s):
    out = {}
    for w in K.WINDOWS:
        x = f"case when {s} and m_report <= {w} then span end"
        out.update({f"span_min_{w}m": f"cast(min({x}) as integer)", f"span_max_{w}m": f"cast(max({x}) as integer)", f"span_mean_{w}m": f"avg({x})",
                    f"span_median_{w}m": f"quantile_cont(cast({x} as double), 0.5)"})
    return out


def delinquency(s):
    out = {}
    for w in K.DELINQUENCY_WINDOWS:
        for d in K.LEVELS:
            bad = f"{s} and n{w}_{d} >= 1 and p{w}"
            out.update({f"bad_balance_{w}m_{d}": f"sum(case when {bad} then balance end)", f"bad_sanction_{w}m_{d}": f"sum(case when {bad} then highest end)",
                        f"bad_accounts_{w}m_{d}": f"cast(sum(case when {bad} then 1 end) as bigint)",
                        f"bad_products_{w}m_{d}": f"cast(bit_count(bit_or(case when {bad} then own_bit end)) as integer)", f"times_{w}m_{d}": f"cast(max(case when {s} and p{w} then n{w}_{d} end) as integer)"})
        worst = f"max(case when {s} and p{w} then w{w} end)"
        out[f"worst_days_{w}m"] = f"case {worst} when 0 then 0 when 1 then 1 when 2 then 30 when 3 then 60 when 4 then 90 when 5 then 150 when 6 then 180 when 7 then 180 end"
    return out


def ratios(s):
    out = {}
    for w in K.DELINQUENCY_WINDOWS:
        hit = f"m_start <= {w} and p{w}"
        ts, ta = f"sum(case when {hit} then highest end)", f"sum(case when {hit} then 1 end)"
        for d in K.LEVELS:
            bad = f"{s} and n{w}_{d} >= 1 and p{w}"
            out.update({f"ratio_balance_{w}m_{d}": f"case when {ts} <> 0 then sum(case when {bad} then balance end) / {ts} end",
                        f"ratio_accounts_{w}m_{d}": f"case when {ta} <> 0 then sum(case when {bad} then 1 end) / {ta} end",
                        f"ratio_sanction_{w}m_{d}": f"case when {ts} <> 0 then sum(case when {bad} then highest end) / {ts} end"})
    return out


_totals = [f"{e} as {n}" for w in K.DELINQUENCY_WINDOWS for n, e in (
    (f"total_sanctions_{w}m", f"sum(case when m_start <= {w} and p{w} then highest end)"), (f"total_accounts_{w}m", f"cast(sum(case when m_start <= {w} and p{w} then 1 end) as bigint)"))]

query("cat_loan_amounts", table(cells(K.AMOUNT_SEGMENTS, amounts)))(lambda spark, sf: K.cat_loan_amounts(base(spark, sf)))


@query("cat_open_live", table(cells(K.AMOUNT_SEGMENTS, open_live)))
def cat_open_live(spark, sf):
    x = K.cat_open_live(base(spark, sf))
    return x.selectExpr(*[f"round({c}, 6) as {c}" if "_mean_util_" in c else c for c in x.columns])


query("cat_open_close_months", table(cells(K.AMOUNT_SEGMENTS, spans)))(lambda spark, sf: K.cat_open_close_months(base(spark, sf)))
query("cat_delinquency", table(cells(K.DELINQUENCY_SEGMENTS, delinquency) + _totals))(lambda spark, sf: K.cat_delinquency(base(spark, sf)))
query("cat_delinquency_ratios", table(cells(K.DELINQUENCY_SEGMENTS, ratios)))(lambda spark, sf: K.cat_delinquency_ratios(base(spark, sf)))
query("open_velocity", with_(BASE, """g as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base),
  g1 as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base where highest <= 10000),
  g3 as (select member, opened - lag(opened) over (partition by member order by opened) as gap from base where highest > 30000)""",
  body="""select member, avg(gap) as mean_gap, (select avg(gap) from g1 where g1.member = g.member) as mean_gap_upto_10k,
  (select avg(gap) from g3 where g3.member = g.member) as mean_gap_over_30k from g group by member"""))(lambda spark, sf: K.open_velocity(base(spark, sf)))


@query("category_features")
def category_features(spark, sf):
    """Every segment family on one row per member. The families have queries, and SQL, of their own."""
    return K.category_features(base(spark, sf))
