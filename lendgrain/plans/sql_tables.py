"""The same domain tables as sources/driver_tables.py, written as SQL for the comparison."""

from lendgrain.functions import fixed_values as V
from lendgrain.sources.driver_tables import (ENQUIRY_ASOF, EVENT_PURPOSE, ORDER_ACCOUNT_TYPE, TRADE_ASOF)


def q(text):
    return "'" + str(text).replace("'", "''") + "'"


def in_list(values):
    return "(" + ", ".join(q(v) for v in values) + ")"


def case_of(col, mapping, default="null"):
    return "case " + " ".join(f"when {col} = {q(k)} then {q(v)}" for k, v in mapping.items()) + f" else {default} end"


def product_case(col, products, default="'Other'"):
    return "case " + " ".join(f"when {col} in {in_list(m)} then {q(p)}" for p, m in products.items()) + f" else {default} end"


def rnd(x, digits=4, settled=10):
    """Half-up rounding of the decimal value, settled at a later digit first."""
    return f"(cast(round(cast({x} as decimal(30, {settled})), {digits}) as double) + 0.0)"


def mdiff(a, b):
    return f"((year({a}) - year({b})) * 12 + month({a}) - month({b}))"


def months_between(a, b):
    """Calendar months with a 31-day month, as Spark computes it (whole when days match or both are month ends)."""
    return (f"(case when day({a}) = day({b}) or (last_day({a}) = {a} and last_day({b}) = {b}) "
            f"then cast({mdiff(a, b)} as double) "
            f"else round({mdiff(a, b)} + (day({a}) - day({b})) / 31.0::double, 8) end)")


RAW_ENQ = f"""raw_enq as (
  select user_id as member, cast(ts as date) as enq_date, {case_of('event_type', EVENT_PURPOSE)} as purpose,
         cast(floor(value * 100) as double) as amount, date '{ENQUIRY_ASOF}' as as_of from events)"""

ENQ = RAW_ENQ + f""", enq as (
  select member, enq_date, purpose, max(amount) as amount, as_of, cast(as_of - enq_date as bigint) as age,
         {product_case('purpose', V.ENQUIRY_PRODUCT)} as product,
         case when purpose in {in_list(V.ENQUIRY_SECURED)} then 1 else 0 end as secured
  from raw_enq where enq_date < as_of group by member, enq_date, purpose, as_of)"""

MEMBER_DATES = """member_dates as (
  select c_custkey as member, date '2000-01-01' + cast(c_custkey % 365 as integer) as own_as_of from customer)"""

CELLS = """cells as (
  select l_orderkey as account, cast(date_trunc('month', l_shipdate) as date) as month,
    cast(sum(floor(l_extendedprice * (1 - l_discount))) as double) as bal,
    cast(sum(floor(l_extendedprice * l_tax)) as double) as due,
    cast(sum(floor(l_extendedprice * l_discount)) as double) as paid,
    cast(max(l_quantity) as integer) as qty, max(l_discount) as disc,
    cast(sum(case when l_linestatus = 'O' then floor(l_extendedprice * (1 - l_discount)) else 0 end) as double) as open_bal,
    cast(sum(case when l_returnflag = 'R' then floor(l_extendedprice * l_tax) else 0 end) as double) as late_due,
    max(cast(l_shipdate as date)) as last_day, min(cast(l_shipdate as date)) as first_day,
    max(case when l_linestatus = 'F' then cast(l_shipdate as date) end) as pay_day
  from lineitem group by 1, 2),
coded as (
  select *, (case when qty % 4 = 0 then lpad(cast(qty * 8 as varchar), 3, '0') else '000' end)
    || (case when disc > 0.08::double then 'XXX' when disc > 0.05::double then 'STD' else '000' end)
    || (case qty % 10 when 1 then '901' when 2 then '905' when 3 then '029' when 4 then 'SUB' else '000' end) as codes
  from cells),
hist as (
  select account, max(last_day) as hist_start, min(first_day) as hist_end, sum(open_bal) as balance,
    sum(late_due) as overdue, sum(paid) as last_payment, max(pay_day) as last_paid, max(qty) as max_qty,
    count(*) as n_months, string_agg(codes, '' order by month desc) as dpd_text,
    list(month order by month desc) as months, list(bal order by month desc) as bals,
    list(due order by month desc) as dues, list(paid order by month desc) as paids
  from coded group by account)"""

_first = {k: v[0] for k, v in ORDER_ACCOUNT_TYPE.items()}
_second = {k: v[1] for k, v in ORDER_ACCOUNT_TYPE.items()}

RAW_TRADES = CELLS + f""", raw_trades as (
  select o_custkey as member, o_orderkey as account,
    case when o_orderstatus = 'P' then {case_of('o_orderpriority', _second)} else {case_of('o_orderpriority', _first)} end as account_type,
    cast(o_orderdate as date) as opened, o_orderstatus as status, cast(floor(o_totalprice) as double) as sanction,
    case when o_orderkey % 7 <> 0 then cast(floor(o_totalprice * 1.1::double) as double) end as high_credit,
    case when o_orderpriority = '2-HIGH' and o_orderstatus <> 'P' and o_orderkey % 9 <> 0
         then cast(floor(o_totalprice * 0.5::double) as double) end as credit_limit,
    case when o_orderkey % 5 <> 0 then cast(o_orderkey % 48 as integer) end as tenor,
    (['PVT', 'HFC', 'NBF', 'PUB', 'FOR'])[cast(o_orderkey % 5 + 1 as integer)] as lender,
    lpad(cast(o_orderkey % 20 as varchar), 2, '0') as wo_status, cast(300 + (o_orderkey * 7) % 600 as integer) as score, date '{TRADE_ASOF}' as as_of,
    hist_start, hist_end, balance, overdue, last_payment, last_paid, hist_start as reported,
    case when o_orderstatus = 'F' then greatest(hist_start, cast(o_orderdate as date)) end as closed,
    case when max_qty = 50 then 1 else 0 end as written_off,
    case when max_qty >= 48 then floor(floor(o_totalprice) / 10) end as write_off_amt,
    dpd_text, months, bals, dues, paids
  from orders join hist on account = o_orderkey)"""

BUCKET_A = """case when try_cast({c} as integer) = 901 then 0 when try_cast({c} as integer) = 905 then 3
  when try_cast({c} as integer) = 902 then 4 when try_cast({c} as integer) in (903, 904) then 6
  when try_cast({c} as integer) between 360 and 900 then 7 when try_cast({c} as integer) between 180 and 359 then 6
  when try_cast({c} as integer) between 150 and 179 then 5 when try_cast({c} as integer) between 90 and 149 then 4
  when try_cast({c} as integer) between 60 and 89 then 3 when try_cast({c} as integer) between 30 and 59 then 2
  when try_cast({c} as integer) between 1 and 29 then 1 when try_cast({c} as integer) = 0 then 0 else 8 end"""

# text of one digit per slot: 36 buckets, lined up with the as-of month
TRADES = RAW_TRADES + f""", t_codes as (
  select *, list_transform(range(1, 37), lambda i: substr(dpd_text, cast(3 * i - 2 as integer), 3)) as codes,
    {mdiff('as_of', 'opened')} as m_open, {mdiff('as_of', 'closed')} as m_close, {mdiff('as_of', 'reported')} as m_report,
    {mdiff('as_of', 'last_paid')} as m_pay, {mdiff('as_of', 'hist_start')} as m_start, {mdiff('as_of', 'hist_end')} as m_end
  from raw_trades where opened <= as_of),
t_digits as (
  select *, list_aggregate(list_transform(codes, lambda c: cast({BUCKET_A.format(c='c')} as varchar)), 'string_agg', '') as digits from t_codes),
t_line as (
  select *, case when m_start >= 1 then repeat('8', cast(m_start - 1 as integer)) || digits
                 else substr(digits, cast(abs(m_start) + 2 as integer)) end as line from t_digits),
trades as (
  select * exclude (codes, digits, line),
    {product_case('account_type', V.ACCOUNT_PRODUCT)} as product,
    case when account_type in {in_list(V.ACCOUNT_SECURED)} then 1 else 0 end as secured,
    case when account_type in {in_list(V.ACCOUNT_REVOLVING)} then 1 else 0 end as revolving,
    case when account_type in {in_list(V.ACCOUNT_SECURED)} then 0 else 1 end as unsecured,
    case when account_type in {in_list(V.ACCOUNT_REVOLVING)} then 0 else 1 end as installment,
    list_transform(range(1, 37), lambda i: case
       when try_cast(substr(line, cast(i as integer), 1) as integer) between 0 and 7 then cast(substr(line, cast(i as integer), 1) as integer)
       when substr(line, cast(i as integer), 1) = '8' and (i < m_start or i > m_end) then -2 else -1 end) as dpd,
    list_transform(range(1, 7), lambda i: case
       when substr(digits, cast(i as integer), 1) = '8' and i > {mdiff('hist_start', 'hist_end')} + 1 then -2
       when substr(digits, cast(i as integer), 1) = '8' then -1
       else cast(substr(digits, cast(i as integer), 1) as integer) end) as phist,
    list_transform(range(1, 37), lambda i: bals[list_position(list_transform(months, lambda m: {mdiff('as_of', 'm')}), i)]) as bal,
    list_transform(range(1, 37), lambda i: dues[list_position(list_transform(months, lambda m: {mdiff('as_of', 'm')}), i)]) as due
  from t_line)"""

SCORED = """scored as (
  select case when l_returnflag = 'R' then 1 else 0 end as target,
    (l_discount * 5 + l_tax * 3 + l_quantity / 100) / 1.3::double as prob, l_quantity as weight,
    case when o_orderdate < timestamp '1999-01-01' then 'Train' when o_orderdate < timestamp '2001-01-01' then 'Test' else 'OOT' end as sample,
    l_quantity as quantity, cast(floor(l_extendedprice) as double) as price, l_discount as discount,
    case when l_tax > 0 then l_tax end as tax, cast(floor(o_totalprice) as double) as total,
    l_linestatus as line_status, o_orderpriority as priority
  from lineitem join orders on l_orderkey = o_orderkey)"""


def _open_m(i):
    return (f"(case when m_open < {i} or m_close > {i} or (balance = 0 and revolving = 0 and m_pay > {i}) then 0 else 1 end)")


START = "cast(date_trunc('month', as_of) as date)"
# trades plus the derived columns of functions/trade_columns.trade_base
BASE = TRADES + f""", b1 as (
  select *, case when closed < {START} or (balance = 0 and revolving = 0 and last_paid < {START}) then 0 else 1 end as is_open,
    m_open as tenure, list_transform(range(0, 13), lambda i: {_open_m('i')}) as live,
    case when account_type not in {in_list(V.ACCOUNT_CARD)} then sanction when credit_limit > 0 then credit_limit
         else greatest(high_credit, sanction) end as limit_amount,
    greatest(high_credit, sanction, 0.0) as highest,
    as_of - opened as vintage_days, as_of - reported as report_days,
    case when product = 'CC' then greatest(high_credit, credit_limit) else high_credit end as hc,
    case when as_of - reported <= 365 then 1 end as recent
  from trades),
b2 as (
  select *, case when case when limit_amount - balance >= 0 then limit_amount else balance end > 0
              then case when limit_amount - balance >= 0 then limit_amount else balance end else 0.0 end as principal,
    case when balance > 0 and sanction > 0 and is_open = 1 then
      case product when 'CC' then 0.05::double * balance when 'HL' then 0.01::double * sanction else 0.03::double * sanction end
      else 0.0 end as emi,
    case when m_end = 0 then 1 when m_end <= 36 then len(list_filter(dpd, lambda x: x = 0))
         else len(list_filter(dpd, lambda x: x = 0)) + m_end - 36 end as current_months
  from b1),
b3 as (
  select *, case when revolving = 0 and principal > 0 and principal <= 5000 then principal
     when revolving = 0 and principal > 5000 and principal > balance and current_months > 0 then (principal - balance) / current_months
     when product in ('CC', 'PL') and principal > 0 then 0.05::double * principal
     when product in ('HL', 'LAP') and principal > 0 then 0.007::double * principal
     when principal > 0 then 0.03::double * principal else 0.0 end as emi_new
  from b2),
b4 as (
  select *, case when live[1] = 1 then null when closed is not null then closed
     when last_paid > cast(date_trunc('month', opened) as date) then last_paid else hist_start end as close_date
  from b3),
base as (
  select *, cast(case when close_date is not null then {mdiff('close_date', 'opened')} + 1 when tenor > 0 then tenor
       when balance > 0 and emi_new > 0 then m_open + balance / emi_new
       when emi_new <> 0 then limit_amount / emi_new end as double) as loan_tenure,
    {months_between('as_of', "cast(date_trunc('month', close_date) as date)")} as m_acct_close,
    case when principal > 30000 then 1 else 0 end as long_term, case when principal <= 30000 then 1 else 0 end as short_term
  from b4)"""


def with_(*ctes, body):
    return "with " + ", ".join(ctes) + "\n" + body
