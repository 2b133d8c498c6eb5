"""Enquiry families on `events` (day windows, because the data spans one month)."""

from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.operators import enquiry as E
from lendgrain.plans.registry import query
from lendgrain.plans.sql_tables import ENQ, in_list, product_case, rnd, with_
from lendgrain.sources.driver_tables import ORDER_PURPOSE, TRADE_ASOF, raw_enquiries, raw_order_enquiries

S = E.DAY_SPEC
SCOPES = {"all": "true", "unsec": "secured = 0", **{p.lower(): f"product = '{p}'" for p in S.count_products}}


def enquiries(spark, sf):
    e = E.prepare_enquiries(raw_enquiries(spark, sf), spark)
    return e.withColumn("age", F.col("days"))


def one_row(items):
    return with_(ENQ, body="select member, " + ",\n  ".join(items) + " from enq group by member")


def n_if(cond):
    return f"cast(sum(case when {cond} then 1 else 0 end) as bigint)"


RECENCY = ["cast(max(age) as integer) as enq_oldest", "cast(min(age) as integer) as enq_latest"]
for _n, _c in [(p.lower(), f"product = '{p}'") for p in S.recency_products] + [("sec", "secured = 1"), ("unsec", "secured = 0")]:
    RECENCY += [f"cast(max(case when {_c} then age end) as integer) as {_n}_enq_oldest",
                f"cast(min(case when {_c} then age end) as integer) as {_n}_enq_latest"]
COUNTS = ["count(*) as enq_total"]
COUNTS += [f"{n_if(f'product = {chr(39)}{p}{chr(39)}')} as {p.lower()}_enq_total" for p in S.total_products]
for _w in S.windows:
    COUNTS.append(f"{n_if(f'age <= {_w}')} as enq_{_w}d")
    for _n, _c in [(p.lower(), f"product = '{p}'") for p in S.count_products] + [("unsec", "secured = 0"), ("sec", "secured = 1")]:
        COUNTS.append(f"{n_if(f'age <= {_w} and {_c}')} as {_n}_enq_{_w}d")
BANDS = [f"{n_if(f'{c} and amount > {lo} and amount <= {hi} and age <= {w}')} as {n}_enq_upto_{hi}_{w}d"
         for n, c in SCOPES.items() for lo, hi in S.bands for w in S.windows]
AMOUNTS = [f"max(case when {c} and age <= {w} then amount else 0 end) as {n}_max_amount_{w}d"
           for n, c in SCOPES.items() for w in S.amount_windows]
VELOCITY = [
    n_if(f"purpose not in {in_list(V.ENQUIRY_NOT_CREDIT)} and age <= {S.velocity_days}") + " as credit_enq_recent",
    "cast(min(case when product not in ('BL', 'LAP', 'CV') then age end) as integer) as days_since_retail_enq",
    n_if(f"purpose not in {in_list(V.ENQUIRY_VELOCITY_SECURED)} and age < {S.velocity_window}") + " as non_secured_enq_recent"]
DISTINCT = [f"count(distinct case when age <= {w} then purpose end) as distinct_purposes_{w}d" for w in S.distinct_windows]
RECENT_DISTINCT = [f"count(distinct case when age < {S.velocity_days} then purpose end) as distinct_purposes_recent"]


def shares_sql():
    def share(n, d, name):
        return f"cast(case when {n} is null then -1 when {d} is null then -2 when {d} = 0 then -3 else {n} / {d} end as double) as {name}"
    out = [share(f"{n}enq_{w}d", "enq_total", f"{n}enq_share_{w}d")
           for n in ["", "unsec_"] + [p.lower() + "_" for p in S.count_products] for w in S.windows]
    a, b = S.windows[-2:]
    out += [share(f"{n}enq_{a}d", f"{n}enq_{b}d", f"{n}enq_{a}_of_{b}d")
            for n in [""] + [p.lower() + "_" for p in S.count_products]]
    return out


LATEST_CTE = """newest as (
  select member, product, secured, amount,
    row_number() over (partition by member order by enq_date desc, amount desc) as rn,
    row_number() over (partition by member order by enq_date desc, amount desc, secured) as rs,
    row_number() over (partition by member, product order by enq_date desc, amount desc) as rp from enq)"""
LATEST = ["max(case when rn = 1 then amount end) as latest_amount",
          "max(case when rs = 1 then amount * (1 - secured) end) as unsec_latest_amount"] + [
    f"max(case when rp = 1 and product = '{p}' then amount when product <> '{p}' then 0 end) as {p.lower()}_latest_amount"
    for p in S.latest_products]

GAPS_CTE = """g as (
  select member, product, secured, age,
    enq_date - lag(enq_date) over (partition by member order by enq_date) as g_all,
    enq_date - lag(enq_date) over (partition by member, secured order by enq_date) as g_sec,
    enq_date - lag(enq_date) over (partition by member, product order by enq_date) as g_prod from enq)"""


def gap_items():
    out = []
    scopes = [("all", "g_all", "true", S.gap_windows), ("unsec", "g_sec", "secured = 0", S.part_gap_windows)]
    scopes += [(p.lower(), "g_prod", f"product = '{p}'", S.part_gap_windows) for p in S.gap_products]
    for n, col, cond, ws in scopes:
        for w in ws:
            x = f"(case when {cond} and age <= {w} then cast({col} as double) end)"
            m2 = f"var_pop({x})"
            c3 = f"(avg({x} ** 3) - 3 * avg({x}) * avg({x} ** 2) + 2 * avg({x}) ** 3)"
            c4 = f"(avg({x} ** 4) - 4 * avg({x}) * avg({x} ** 3) + 6 * avg({x}) ** 2 * avg({x} ** 2) - 3 * avg({x}) ** 4)"
            expr = {"avg": f"avg({x})", "median": f"quantile_cont({x}, 0.5)", "max": f"max({x})", "min": f"min({x})",
                    "stddev": f"stddev_samp({x})",
                    "skewness": f"(case when max({x}) > min({x}) then {c3} / {m2} ** 1.5 end)",
                    "kurtosis": f"(case when max({x}) > min({x}) then {c4} / {m2} ** 2 - 3 end)"}
            out += [f"{rnd(expr[m])} as {n}_{m}_gap_{w}d" for m in S.moments]
    return out


def cv_items():
    out = []
    for n, ws in [("all", S.gap_windows), ("unsec", S.part_gap_windows)] + [(p.lower(), S.part_gap_windows) for p in S.gap_products]:
        out += [f"case when {n}_avg_gap_{w}d = 0 then null else {rnd(f'{n}_stddev_gap_{w}d / {n}_avg_gap_{w}d')} end as {n}_cv_gap_{w}d"
                for w in ws]
    return out


GAPS_SQL = "select member, " + ",\n  ".join(gap_items()) + " from g group by member"

query("enq_recency", one_row(RECENCY))(lambda spark, sf: E.enq_recency(enquiries(spark, sf), S))
query("enq_counts", one_row(COUNTS))(lambda spark, sf: E.enq_counts(enquiries(spark, sf), S))
query("enq_distinct_products", one_row(DISTINCT))(lambda spark, sf: E.enq_distinct_products(enquiries(spark, sf), S))
query("enq_amount_bands", one_row(BANDS))(lambda spark, sf: E.enq_amount_bands(enquiries(spark, sf), S))
query("enq_max_latest_amount", with_(
    ENQ, LATEST_CTE, "a as (select member, " + ", ".join(AMOUNTS) + " from enq group by member)",
    "l as (select member, " + ", ".join(LATEST) + " from newest group by member)",
    body="select * from a join l using (member)"))(
    lambda spark, sf: E.enq_max_latest_amount(enquiries(spark, sf), S))
query("enq_gaps", with_(ENQ, GAPS_CTE, body=GAPS_SQL))(lambda spark, sf: E.enq_gaps(enquiries(spark, sf), S))
query("enq_gap_cv", with_(ENQ, GAPS_CTE, f"w as ({GAPS_SQL})", body="select member, " + ", ".join(cv_items()) + " from w"))(
    lambda spark, sf: E.enq_gap_cv(enquiries(spark, sf), S))
query("enq_share", with_(ENQ, "c as (select member, " + ", ".join(COUNTS) + " from enq group by member)",
                         body="select member, " + ", ".join(shares_sql()) + " from c"))(
    lambda spark, sf: E.enq_share(enquiries(spark, sf), S))
query("enq_velocity", one_row(VELOCITY + RECENT_DISTINCT))(lambda spark, sf: E.enq_velocity(enquiries(spark, sf), S))

query("enquiry_features", with_(
    ENQ, LATEST_CTE, GAPS_CTE,
    "c as (select member, " + ", ".join(RECENCY + COUNTS + AMOUNTS + VELOCITY + BANDS + DISTINCT + RECENT_DISTINCT)
    + ", first(product order by enq_date, amount desc, product) as first_product"
    + ", first(product order by enq_date desc, amount desc, product) as latest_product from enq group by member)",
    "l as (select member, " + ", ".join(LATEST) + " from newest group by member)",
    f"w as ({GAPS_SQL})",
    body="select * , " + ", ".join(shares_sql() + cv_items()) + " from c join l using (member) join w using (member)"))(
    lambda spark, sf: E.enquiry_features(enquiries(spark, sf), S))


# ---- month windows, over years of enquiries ------------------------------------------------------------------------------
MONTH_SPEC = E.EnquirySpec(gap_products=("PL", "CD", "CC"), moments=("avg", "max", "min"))
LONG_DAYS = E.EnquirySpec(windows=(30, 90, 180, 365), unit="d")
_PURPOSES = "case o_orderpriority " + " ".join(f"when '{k}' then '{v}'" for k, v in ORDER_PURPOSE.items()) + " end"
ORDER_ENQ = f"""raw_enq as (select o_custkey as member, cast(o_orderdate as date) as enq_date, {_PURPOSES} as purpose, floor(o_totalprice)::double as amount from orders),
  enq as (select member, enq_date, purpose, max(amount) as amount, {product_case('purpose', V.ENQUIRY_PRODUCT)} as product,
    case when purpose in {in_list(V.ENQUIRY_SECURED)} then 1 else 0 end as secured, date_diff('day', enq_date, date '{TRADE_ASOF}') as days,
    date_diff('month', enq_date, date '{TRADE_ASOF}') as months
  from raw_enq where enq_date < date '{TRADE_ASOF}' group by member, enq_date, purpose)"""


def window_counts(spec, age):
    scopes = {p.lower(): f"product = '{p}'" for p in spec.count_products} | {"unsec": "secured = 0", "sec": "secured = 1"}
    out = ["count(*) as enq_total"] + [f"count(*) filter (where product = '{p}') as {p.lower()}_enq_total" for p in spec.total_products]
    for w in spec.windows:
        out.append(f"count(*) filter (where {age} <= {w}) as enq_{w}{spec.unit}")
        out += [f"count(*) filter (where {age} <= {w} and {c}) as {n}_enq_{w}{spec.unit}" for n, c in scopes.items()]
    return out


def order_enquiries(spark, sf, age):
    return E.prepare_enquiries(raw_order_enquiries(spark, sf), spark).withColumn("age", F.col(age))


def _grouped(items):
    return with_(ORDER_ENQ, body="select member, " + ", ".join(items) + " from enq group by member")


query("enq_counts_months", _grouped(window_counts(MONTH_SPEC, "months")))(lambda spark, sf: E.enq_counts(order_enquiries(spark, sf, "months"), MONTH_SPEC))
query("enq_counts_long_days", _grouped(window_counts(LONG_DAYS, "days")))(lambda spark, sf: E.enq_counts(order_enquiries(spark, sf, "days"), LONG_DAYS))
query("enq_distinct_months", _grouped([f"count(distinct purpose) filter (where months <= {w}) as distinct_purposes_{w}m" for w in MONTH_SPEC.distinct_windows]))(
    lambda spark, sf: E.enq_distinct_products(order_enquiries(spark, sf, "months"), MONTH_SPEC))


def month_gaps():
    out = []
    scopes = [("all", "g_all", "true", MONTH_SPEC.gap_windows), ("unsec", "g_sec", "secured = 0", MONTH_SPEC.part_gap_windows)]
    scopes += [(p.lower(), "g_prod", f"product = '{p}'", MONTH_SPEC.part_gap_windows) for p in MONTH_SPEC.gap_products]
    for n, gap, cond, windows in scopes:
        for w in windows:
            out += [f"{rnd(f'{m}(cast({gap} as double)) filter (where {cond} and months <= {w})')} as {n}_{m}_gap_{w}m" for m in MONTH_SPEC.moments]
    return out


query("enq_gaps_months", with_(ORDER_ENQ, GAPS_CTE.replace("secured, age,", "secured, months,"), body="select member, " + ", ".join(month_gaps()) + " from g group by member"))(
    lambda spark, sf: E.enq_gaps(order_enquiries(spark, sf, "months"), MONTH_SPEC))
