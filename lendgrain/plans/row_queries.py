"""Sources, cleaning and row-level operators."""

import os
import uuid

from pyspark.sql import functions as F

from lendgrain.functions import columns as C
from lendgrain.functions import fixed_values as V
from lendgrain.functions import history as H
from lendgrain.functions import trade_columns as TC
from lendgrain.functions.lookups import map_category, map_flags, map_prep_product, vocabulary
from lendgrain.operators import relational as R
from lendgrain.plans.registry import query
from lendgrain.plans.sql_tables import (BASE, ENQ, RAW_ENQ, RAW_TRADES, SCORED, TRADES, in_list, mdiff, months_between,
                                        product_case, with_)
from lendgrain.session import checkpoint_dir
from lendgrain.sources import driver_tables as D
from lendgrain.sources import files as S

ORDER_BASE = "select o_orderkey as account, cast(o_orderdate as date) as opened"


def scratch(spark):
    """A new folder below the shared one."""
    return os.path.join(checkpoint_dir(spark), "scratch", uuid.uuid4().hex)


def orders(spark, sf):
    return D.table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("account"), F.col("o_custkey").alias("member"),
        F.to_date("o_orderdate").alias("opened"), F.col("o_totalprice").alias("price"),
        F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))


# ---- sources and sinks -------------------------------------------------------------------------------
ENQ_CSV = RAW_ENQ + ", e as (select member, enq_date, purpose, amount from raw_enq)"


@query("scan_csv_schema", with_(ENQ_CSV, body="select purpose, count(*) as n, sum(amount) as amount from e group by purpose"))
def scan_csv_schema(spark, sf):
    path = scratch(spark)
    S.write_csv(D.raw_enquiries(spark, sf).select("member", "enq_date", "purpose", "amount"), path)
    df = S.read_csv(spark, path, "member long, enq_date date, purpose string, amount double")
    return df.groupBy("purpose").agg(F.count("*").alias("n"), F.sum("amount").alias("amount"))


@query("scan_csv_infer", with_(ENQ_CSV, body="select member, count(*) as n, max(enq_date) as newest from e group by member"))
def scan_csv_infer(spark, sf):
    path = scratch(spark)
    S.write_csv(D.raw_enquiries(spark, sf).select("member", "enq_date", "purpose", "amount"), path)
    df = S.read_csv(spark, path)
    return df.groupBy(F.col("member").cast("long").alias("member")).agg(
        F.count("*").alias("n"), F.max("enq_date").alias("newest"))


@query("scan_parquet", "select l_orderkey, l_quantity, l_shipdate from lineitem where l_quantity >= 45")
def scan_parquet(spark, sf):
    return S.read_parquet(spark, f"{sf}/lineitem.parquet", ["l_orderkey", "l_quantity", "l_shipdate"]).filter("l_quantity >= 45")


@query("scan_table", "select c_mktsegment, count(*) as n from customer group by 1")
def scan_table(spark, sf):
    name = "t_" + uuid.uuid4().hex
    D.table(spark, sf, "customer").createOrReplaceTempView(name)
    return S.read_table(spark, name).groupBy("c_mktsegment").agg(F.count("*").alias("n"))


@query("sink_parquet", with_(RAW_ENQ, body="select * from raw_enq"))
def sink_parquet(spark, sf):
    path = scratch(spark)
    S.write_parquet(D.raw_enquiries(spark, sf), path, compression="snappy")
    return S.read_parquet(spark, path)


@query("sink_csv", ORDER_BASE + ", o_orderpriority as priority from orders")
def sink_csv(spark, sf):
    path = scratch(spark)
    S.write_csv(orders(spark, sf).select("account", "opened", "priority"), path)
    return S.read_csv(spark, path, "account long, opened date, priority string")


@query("stage_checkpoint", with_(ENQ, body="select member, purpose, count(*) as n from enq group by all"))
def stage_checkpoint(spark, sf):
    from lendgrain.operators.enquiry import prepare_enquiries
    staged = S.stage(prepare_enquiries(D.raw_enquiries(spark, sf), spark), scratch(spark))
    return staged.groupBy("member", "purpose").agg(F.count("*").alias("n"))


@query("normalise_names", 'select c_custkey as "inq_var_custkey", c_acctbal as "inq_var_acctbal", c_nationkey as cv_var_nation from customer')
def normalise_names(spark, sf):
    df = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias(" Cust-Key "), F.col("c_acctbal").alias("Acct/Bal:"), F.col("c_nationkey").alias("cv_var_nation"))
    return S.prefix_names(S.plain_names(S.strip_names(df)), "inq_var_")


@query("profile_counts", "select count(*) as n_rows, count(distinct o_custkey) as n_keys, cast(6 as bigint) as n_cols from orders")
def profile_counts(spark, sf):
    return S.profile(D.table(spark, sf, "orders"), "o_custkey")


# ---- dates ------------------------------------------------------------------------------------------
@query("parse_date_padded", ORDER_BASE + ", cast(o_orderdate as date) as text_date, cast(o_orderdate as date) as number_date, cast(null as date) as bad_date from orders")
def parse_date_padded(spark, sf):
    o = orders(spark, sf)
    return o.select("account", "opened",
                    C.parse_date(F.date_format("opened", "d-MMM-yy"), "dd-MMM-yy", 9, pivot_year=2050).alias("text_date"),
                    C.parse_date(F.date_format("opened", "ddMMyyyy").cast("int"), "ddMMyyyy", 8).alias("number_date"),
                    C.parse_date(F.concat(F.lit("99-Foo-"), (F.col("account") % 10).cast("string")), "dd-MMM-yy", 9).alias("bad_date"))


@query("parse_date_multi", ORDER_BASE + ", case when o_orderkey % 3 < 2 then cast(o_orderdate as date) end as parsed from orders")
def parse_date_multi(spark, sf):
    o = orders(spark, sf)
    k = F.col("account") % 3
    text = (F.when(k == 0, F.date_format("opened", "dd-MM-yyyy")).when(k == 1, F.date_format("opened", "d/M/yyyy"))
            .otherwise(F.date_format("opened", "yyyy.MM.dd")))
    rules = [(r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy")]
    return o.select("account", "opened", C.parse_date_any(text, rules).alias("parsed"))


@query("parse_date_fmt", ORDER_BASE + ", cast(o_orderdate as date) as slashed, cast(o_orderdate as date) as compact from orders")
def parse_date_fmt(spark, sf):
    o = orders(spark, sf)
    return o.select("account", "opened", C.parse_date(F.date_format("opened", "dd/MM/yyyy"), "dd/MM/yyyy").alias("slashed"),
                    C.parse_date(F.date_format("opened", "yyyyMMdd"), "yyyyMMdd").alias("compact"))


@query("date_sanity", with_(RAW_TRADES, body="""select account,
  case when opened > date '1996-01-01' and opened <= as_of then opened end as opened_ok,
  case when hist_start > date '1960-01-01' and hist_start < as_of then hist_start end as start_ok from raw_trades"""))
def date_sanity(spark, sf):
    return D.raw_trades(spark, sf).select(
        "account", C.date_sanity("opened", "as_of", "1996-01-01").alias("opened_ok"),
        C.date_sanity("hist_start", "as_of", include_upper=True).alias("start_ok"))


@query("fallback_date", with_(RAW_TRADES, body="""select account, coalesce(last_paid, reported) as reported_any,
  case when coalesce(last_paid, opened) < hist_end then hist_end else coalesce(last_paid, opened) end as close_any from raw_trades"""))
def fallback_date(spark, sf):
    return D.raw_trades(spark, sf).select(
        "account", C.coalesce_dates("last_paid", "reported").alias("reported_any"),
        C.coalesce_dates("last_paid", "opened", not_before="hist_end").alias("close_any"))


@query("month_offset", with_(RAW_TRADES, body=f"select account, cast({mdiff('as_of', 'opened')} as integer) as m_open, cast({mdiff('as_of', 'closed')} as integer) as m_close from raw_trades"))
def month_offset(spark, sf):
    return D.raw_trades(spark, sf).select("account", C.month_diff("as_of", "opened").alias("m_open"),
                                          C.month_diff("as_of", "closed").alias("m_close"))


@query("fractional_months", with_(RAW_TRADES, body=f"select account, {months_between('as_of', 'opened')} as vintage, {months_between('hist_start', 'hist_end')} as span from raw_trades"))
def fractional_months(spark, sf):
    return D.raw_trades(spark, sf).select("account", C.months_exact("as_of", "opened").alias("vintage"),
                                          C.months_exact("hist_start", "hist_end").alias("span"))


@query("day_gap", with_(RAW_TRADES, body="select account, cast(as_of - opened as integer) as vintage_days, cast(as_of - closed as integer) as closed_days, cast(as_of - reported as integer) as report_days from raw_trades"))
def day_gap(spark, sf):
    return D.raw_trades(spark, sf).select("account", C.days_between("as_of", "opened").alias("vintage_days"),
                                          C.days_between("as_of", "closed").alias("closed_days"),
                                          C.days_between("as_of", "reported").alias("report_days"))


@query("mob", with_(RAW_TRADES, body=f"select account, cast(case when closed > opened then {mdiff('closed', 'opened')} else {mdiff('reported', 'opened')} end as integer) as mob from raw_trades"))
def mob(spark, sf):
    return D.raw_trades(spark, sf).select("account", C.months_on_book("opened", "closed", "reported").alias("mob"))


# ---- filters ------------------------------------------------------------------------------------------
@query("asof_filter", with_(RAW_TRADES, body="select account, opened, hist_start from raw_trades where opened <= as_of and hist_start <= as_of and reported < as_of"))
def asof_filter(spark, sf):
    t = D.raw_trades(spark, sf)
    return R.asof_filter(t, "as_of", not_after=["opened", "hist_start"], before=["reported"]).select("account", "opened", "hist_start")


@query("row_quality_filter", with_(RAW_TRADES, body="select account, lender, length(dpd_text) as n from raw_trades where high_credit is not null and length(dpd_text) between 0 and 36 and lender not in ('FOR')"))
def row_quality_filter(spark, sf):
    t = R.quality_filter(D.raw_trades(spark, sf), ["high_credit"], ("dpd_text", 0, 36), ("lender", ["FOR"]))
    return t.select("account", "lender", F.length("dpd_text").cast("long").alias("n"))


# ---- amounts -----------------------------------------------------------------------------------------
@query("clean_amount", "select o_orderkey as account, o_totalprice as amount, cast(null as double) as bad from orders")
def clean_amount(spark, sf):
    o = orders(spark, sf)
    return o.select("account", C.clean_amount(F.format_number("price", 2)).alias("amount"),
                    C.clean_amount(F.concat(F.lit("n/a "), "status")).alias("bad"))


@query("clamp_amounts", """with x as (select o_orderkey as account, case when o_orderkey % 11 = 0 then -1.0 else floor(o_totalprice) - 100000 end as v from orders)
select account, case when v <= 0 then 0.0 else v end as non_negative, case when v >= 0 then v end as null_if_negative,
  case when v = -1 then null when v < 0 then 0.0 else v end as minus_one_null, case when v < 0 then 1 else 0 end as was_negative from x""")
def clamp_amounts(spark, sf):
    v = F.when(F.col("account") % 11 == 0, F.lit(-1.0)).otherwise(F.floor("price").cast("double") - 100000)
    o = orders(spark, sf).select("account", v.alias("v"))
    return o.select("account", *[C.clamp("v", r).alias(r) for r in C.CLAMP_RULES], C.flag(F.col("v") < 0).alias("was_negative"))


@query("trim_text", "select o_orderkey as account, o_orderpriority as priority from orders")
def trim_text(spark, sf):
    return orders(spark, sf).select("account", F.trim(F.concat(F.lit("  "), "priority", F.lit(" "))).alias("priority"))


@query("impute_sentinel", with_(SCORED, body="""select sample, sum(case when tax is null or tax < 0 then -99 else tax end * 100) is not null as known,
  count(*) as n, cast(sum(case when tax is null then 1 else 0 end) as bigint) as n_imputed, min(coalesce(tax, -99)) as lowest,
  cast(sum(case when price - 50000 < 0 then -99 else price - 50000 end) as double) as price_sum from scored group by sample"""))
def impute_sentinel(spark, sf):
    x = D.scored(spark, sf).select("sample", C.impute("tax").alias("tax"), C.impute("tax", negative=False).alias("tax0"),
                                   C.impute(F.col("price") - 50000).alias("p"))
    return x.groupBy("sample").agg(
        F.sum(F.col("tax") * 100).isNotNull().alias("known"), F.count("*").alias("n"),
        F.sum(C.flag(F.col("tax") == -99)).alias("n_imputed"), F.min("tax0").alias("lowest"), F.sum("p").alias("price_sum"))


@query("safe_ratio", with_(TRADES, body="""select account,
  case when credit_limit is null then -1 when high_credit is null then -2 when high_credit = 0 then -3 else credit_limit / high_credit end as plain,
  case when balance is null then 0 when overdue is null or overdue = 0 then balance else balance / overdue end as or_numerator,
  case when credit_limit = 0 then -2 when credit_limit is null then -1 else balance / credit_limit end as den_only,
  case when sanction = 0 then -3 when sanction is null then -2 when sanction < 20000 then -1 else (sanction - balance) / sanction end as with_floor,
  case when balance is null or balance = 0 then -1 else overdue / balance end as minus_one,
  case when balance = 0 then null else overdue / balance end as or_null from trades"""))
def safe_ratio(spark, sf):
    r = C.safe_ratio
    return D.trades(spark, sf).select(
        "account", r("credit_limit", "high_credit").alias("plain"), r("balance", "overdue", 0, "num", "num").alias("or_numerator"),
        r("balance", "credit_limit", None, -1, -2, den_first=True).alias("den_only"),
        r(F.col("sanction") - F.col("balance"), "sanction", None, -2, -3, (20000, -1), den_first=True).alias("with_floor"),
        r("overdue", "balance", None, -1, -1, den_first=True).alias("minus_one"), r("overdue", "balance", None, None, None).alias("or_null"))


@query("to_numeric_cols", "select c_custkey, c_nationkey::double as c_nationkey, c_acctbal, cast(null as double) as c_mktsegment from customer")
def to_numeric_cols(spark, sf):
    c = D.table(spark, sf, "customer")
    assert S.numeric_columns(c, ["c_custkey"]) == ["c_nationkey", "c_acctbal"]
    return S.to_numeric(c, ["c_nationkey", "c_acctbal", "c_mktsegment"]).drop("c_name")


@query("replace_values", with_(RAW_TRADES, body="select account, case when balance = 0 then 0.1 else balance end::double as balance, case when overdue = 0 then 0.1 else overdue end::double as overdue from raw_trades"))
def replace_values(spark, sf):
    return S.replace_values(D.raw_trades(spark, sf).select("account", "balance", "overdue"), 0, 0.1, ["balance", "overdue"])


# ---- vocabularies --------------------------------------------------------------------------------------
PREP_CASE = product_case("account_type", V.PREP_PRODUCT, "'OTHERS'")


@query("map_product", with_(RAW_TRADES, body=f"""select account, account_type, {product_case('account_type', V.ACCOUNT_PRODUCT)} as product,
  {PREP_CASE} as product_type, case when account_type in {in_list(V.PREP_SECURED)} then 'Secured' else 'Unsecured' end as secured_type,
  case cast(account % 20 as integer) when 2 then 'AL' when 11 then 'PL' when 13 then 'PL' when 7 then 'CC' when 1 then 'BL' when 3 then 'BL' when 12 then 'BL'
    when 6 then 'CD' when 18 then 'CD' when 8 then 'EL' when 5 then 'CE' when 14 then 'LAP' when 10 then 'LAS' when 16 then 'TW' when 4 then 'CV' else 'Other' end as code_product
  from raw_trades"""))
def map_product(spark, sf):
    t = D.raw_trades(spark, sf).select("account", "account_type", (F.col("account") % 20).alias("code"))
    t = map_category(t, "account_type", vocabulary(spark, "a_account")).drop("secured", "revolving").withColumnRenamed("product", "p")
    t = map_category(t, "code", vocabulary(spark, "c_enquiry")).withColumnRenamed("product", "code_product").drop("secured", "revolving")
    return map_prep_product(t, "account_type", spark).withColumnRenamed("p", "product").drop("code")


def _flag_sql(name, col, values):
    return f"case when {col} in {in_list(values)} then 1 else 0 end as {name}"


FLAG_SELECT = ("select account, " + _flag_sql("secured", "account_type", V.ACCOUNT_SECURED) + ", "
               + _flag_sql("revolving", "account_type", V.ACCOUNT_REVOLVING) + ", case when account_type in "
               + in_list(V.ACCOUNT_SECURED) + " then 0 else 1 end as unsecured, case when account_type in "
               + in_list(V.ACCOUNT_REVOLVING) + " then 0 else 1 end as installment")


def _flags(spark, sf):
    return map_flags(D.raw_trades(spark, sf).select("account", "account_type"), "account_type", vocabulary(spark, "a_account"))


@query("flag_secured", with_(RAW_TRADES, body=FLAG_SELECT + " from raw_trades"))
def flag_secured(spark, sf):
    return _flags(spark, sf).select("account", "secured", "revolving", "unsecured", "installment")


@query("flag_revolving", with_(RAW_TRADES, body="select revolving, count(*) as n from (" + FLAG_SELECT + " from raw_trades) group by revolving"))
def flag_revolving(spark, sf):
    return _flags(spark, sf).groupBy("revolving").agg(F.count("*").alias("n"))


@query("flag_cc_like", with_(RAW_TRADES, body=f"select account_type, {_flag_sql('cc_like', 'account_type', V.ACCOUNT_REVOLVING)}, {_flag_sql('card', 'account_type', V.ACCOUNT_CARD)}, count(*) as n from raw_trades group by all"))
def flag_cc_like(spark, sf):
    x = D.raw_trades(spark, sf).groupBy("account_type").agg(F.count("*").alias("n"))
    return x.select("account_type", C.flag(C.is_in("account_type", V.ACCOUNT_REVOLVING)).alias("cc_like"),
                    C.flag(TC.is_card()).alias("card"), "n")


_PL = "account_type = 'Personal Loan'"
SEGMENT_SQL = {
    "PLlt5": f"{_PL} and highest <= 5000", "PLgt5": f"{_PL} and highest > 5000", "PLlt10k": f"{_PL} and highest <= 10000",
    "PLlt1L": f"{_PL} and highest <= 100000", "PLgt1L": f"{_PL} and highest > 100000",
    "NAGRI": f"account_type in {in_list(V.SEGMENT_NAGRI)}", "SEC": f"account_type in {in_list(V.SEGMENT_SEC)}",
    "UNSEC": f"account_type in {in_list(V.SEGMENT_UNSEC)}", "Overall": "true", "GL": "account_type = 'Gold Loan'",
    "CC": "account_type = 'Credit Card'", "TW": "account_type = 'Two-wheeler Loan'",
    "AL": "account_type = 'Auto Loan (Personal)'", "HL": "account_type = 'Housing Loan'"}


@query("segment_flags", with_(BASE, body="select account, " + ", ".join(f'case when {c} then 1 end as "seg_{n}"' for n, c in SEGMENT_SQL.items()) + " from base"))
def segment_flags(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    return t.select("account", *[C.flag_or_null(c).alias(f"seg_{n}") for n, c in TC.segment_flags().items()])


# ---- open, limits, instalments -----------------------------------------------------------------------
CLOSED_CAT = f"(closed < as_of or written_off = 1 or (balance = 0 and account_type not in {in_list(V.ACCOUNT_ZERO_BALANCE_LIVE)}))"


def _quarter(d):
    return f"case when as_of - closed > {d} or (balance = 0 and revolving = 0 and as_of - hist_start > {d}) then 0 else 1 end"


@query("open_flag", with_(BASE, body=f"""select account, is_open as by_date, live[1] as m0, live[7] as m6, live[13] as m12,
  case when {CLOSED_CAT} then 0 else 1 end as by_category,
  case when m_close > 0 or (revolving = 0 and m_close is null and balance <= 0) then 0 else 1 end as by_code,
  {_quarter(90)} as q1, {_quarter(180)} as q2,
  case when date '2000-12-01' between cast(date_trunc('month', opened) as date) and cast(date_trunc('month', coalesce(closed, as_of)) as date) - 1 then 1 else 0 end as slot_1,
  case when substr(dpd_text, 1, 3) = 'STD' then 1 else 0 end as status_1 from base"""))
def open_flag(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    slots = H.status_slots("opened", F.coalesce("closed", "as_of"), "as_of")
    return t.select(
        "account", F.col("is_open").alias("by_date"), *[TC.is_open(month=i).alias(f"m{i}") for i in (0, 6, 12)],
        TC.is_open("category").alias("by_category"), TC.is_open("code").alias("by_code"),
        TC.is_open("q1").alias("q1"), TC.is_open("q2").alias("q2"), H.slot(slots, 1).alias("slot_1"),
        H.slot(TC.open_by_status(H.unpack("dpd_text"), "STD"), 1).alias("status_1"))


@query("sanction_derived", with_(BASE, body="""select account, limit_amount, highest, hc as card_high_credit,
  case when credit_limit = 0 and high_credit > 0 then high_credit else coalesce(credit_limit, high_credit) end as card_limit,
  coalesce(credit_limit, greatest(sanction, high_credit)) as card_line, coalesce(high_credit, sanction) as sanction_any from base"""))
def sanction_derived(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    return t.select("account", "limit_amount", "highest", F.col("hc").alias("card_high_credit"),
                    C.card_limit("credit_limit", "high_credit").alias("card_limit"), TC.card_line().alias("card_line"),
                    F.coalesce("high_credit", "sanction").alias("sanction_any"))


@query("emi_estimate", with_(BASE, body="select account, product, emi from base"))
def emi_estimate(spark, sf):
    return TC.trade_base(D.trades(spark, sf)).select("account", "product", "emi")


@query("emi_amortised", with_(BASE, body="select account, principal, cast(current_months as integer) as current_months, emi_new from base"))
def emi_amortised(spark, sf):
    return TC.trade_base(D.trades(spark, sf)).select("account", "principal", "current_months", "emi_new")


@query("account_close_date", with_(BASE, body="select account, close_date, m_acct_close from base"))
def account_close_date(spark, sf):
    return TC.trade_base(D.trades(spark, sf)).select("account", "close_date", "m_acct_close")


@query("loan_tenure", with_(BASE, body="select account, loan_tenure, long_term, short_term from base"))
def loan_tenure(spark, sf):
    return TC.trade_base(D.trades(spark, sf)).select("account", "loan_tenure", "long_term", "short_term")


BANDS = ((0, 50000), (50000, 100000), (100000, 500000))


@query("ticket_band_flags", with_(BASE, body="select account, " + ", ".join(
    f"case when sanction > {lo} and sanction <= {hi} and m_open <= {w} and product = 'PL' then 1 else 0 end as upto_{hi}_{w}"
    for lo, hi in BANDS for w in (3, 6, 12)) + " from base"))
def ticket_band_flags(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    fl = TC.band_flags("sanction", BANDS, "m_open", (3, 6, 12), F.col("product") == "PL")
    return t.select("account", *[c.alias(n) for n, c in fl.items()])


_LINE = "coalesce(credit_limit, greatest(sanction, high_credit))"


@query("util_flags", with_(BASE, body="select account, " + ", ".join(
    f"case when recent = 1 and product = 'PL' and balance / sanction > {c}::double then 1 end as pl_util_gt_{int(c * 100)}, "
    f"case when recent = 1 and product = 'CC' and balance / {_LINE} > {c}::double then 1 end as cc_util_gt_{int(c * 100)}"
    for c in (0.25, 0.5, 0.75)) + """, case when account_type = 'Credit Card' and credit_limit <> 0 and balance / credit_limit < 0.6::double
      and m_open <= 12 then 1 else 0 end as cc_util_lt_60_12m from base"""))
def util_flags(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    return t.select("account", *[c.alias(n) for n, c in TC.util_flags().items()])


_OVERDUE_SQL = {
    "open_overdue": "is_open = 1", "recent_overdue": "m_report < 4",
    "delinquent_overdue": "(product = 'CC' and dpd[1] >= 2) or (product <> 'CC' and dpd[1] >= 1)",
    "cc_overdue": "product = 'CC'", "non_cc_overdue": "product <> 'CC'", "pl_overdue": "product = 'PL'",
    "overdue_3m": "report_days <= 90", "overdue_6m": "report_days <= 180"}


@query("overdue_splits", with_(BASE, body="select account, " + ", ".join(
    f"case when {c} then overdue else 0.0 end as {n}" for n, c in _OVERDUE_SQL.items()) + " from base"))
def overdue_splits(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    return t.select("account", *[c.alias(n) for n, c in TC.overdue_splits().items()])


@query("lender_type_flags", with_(BASE, body="select account, " + ", ".join(
    f"case when is_open = {v} and product = '{p}' and lender = '{c}' then 1 else 0 end as {s}_{p.lower()}_{c.lower()}"
    for s, v in (("open", 1), ("closed", 0)) for p in ("CC", "PL") for c in V.LENDER_CLASSES)
    + ", case when product = 'HL' and lender <> 'HFC' then 1 else 0 end as external_hl from base"))
def lender_type_flags(spark, sf):
    t = TC.trade_base(D.trades(spark, sf))
    return t.select("account", *[c.alias(n) for n, c in TC.lender_flags().items()], TC.external_lender("lender", "hfc").alias("external_hl"))


@query("written_off_flag", with_(RAW_TRADES, body=f"""select account,
  case when wo_status in {in_list(V.C_WRITTEN_OFF_STATUS)} and coalesce(write_off_amt, overdue) > 10000 then 1 else 0 end as by_status,
  case when write_off_amt > 0 or overdue > 5000 then 1 else 0 end as by_amount,
  case when written_off = 1 or tenor = 1 then 1 else 0 end as by_code from raw_trades"""))
def written_off_flag(spark, sf):
    return D.raw_trades(spark, sf).select(
        "account", TC.written_off_status("wo_status", "write_off_amt", "overdue").alias("by_status"),
        TC.written_off_amounts("write_off_amt", F.col("overdue") - 5000).alias("by_amount"),
        TC.written_off_codes("written_off", "tenor").alias("by_code"))


_MOB = (6, 9, 12, 15, 18, 24)
_DPD = (30, 60, 90, 120, 150, 180)
PERF = """perf as (select l_orderkey as account, """ + ", ".join(
    f"max(case when l_linenumber <= {i + 1} then cast(l_quantity * 5 as integer) end) as max_dpd{m}mob" for i, m in enumerate(_MOB)) + " from lineitem group by 1)"


def performance(spark, sf):
    """Worst days past due by month on book, per account."""
    li = D.table(spark, sf, "lineitem")
    return li.groupBy(F.col("l_orderkey").alias("account")).agg(*[
        F.max(F.when(F.col("l_linenumber") <= i + 1, (F.col("l_quantity") * 5).cast("int"))).alias(f"max_dpd{m}mob")
        for i, m in enumerate(_MOB)])


@query("encode_target", with_(PERF, body="select account, " + ", ".join(
    f"case when max_dpd{m}mob >= {d} then 1 else 0 end as target_{m}mob_{d}_flag" for m in _MOB for d in _DPD)
    + ", case account % 3 when 0 then 1 when 1 then 0 end as label from perf"))
def encode_target(spark, sf):
    p = performance(spark, sf)
    k = F.col("account") % 3
    text = F.when(k == 0, "04_Bad").when(k == 1, "03_Good").otherwise("02_Indeterminate")
    return p.select("account", *[c.alias(n) for n, c in TC.dpd_targets().items()], TC.make_target(text).alias("label"))


# ---- scalar function families ---------------------------------------------------------------------------
@query("f_string", """select o_orderkey as account, lpad(cast(o_orderkey as varchar), 8, '0') as padded, rpad(o_orderstatus, 3, 'x') as rpadded,
  lower(o_orderpriority) as low, upper(o_orderpriority) as up, cast(length(o_orderpriority) as integer) as n, substr(o_orderpriority, 3, 4) as part,
  o_orderstatus || '/' || o_orderpriority as joined, string_split(o_orderpriority, '-')[1] as head,
  regexp_replace(o_orderpriority, '[^A-Z]', '', 'g') as letters, o_orderpriority like '%IGH%' as has_igh,
  starts_with(o_orderpriority, '1') as urgent, regexp_matches(o_orderpriority, '^[12]') as top, cast(strpos(o_orderpriority, 'LOW') > 0 as boolean) as low_flag from orders""")
def f_string(spark, sf):
    p, st = F.col("priority"), F.col("status")
    return orders(spark, sf).select(
        "account", F.lpad(F.col("account").cast("string"), 8, "0").alias("padded"), F.rpad(st, 3, "x").alias("rpadded"),
        F.lower(p).alias("low"), F.upper(p).alias("up"), F.length(p).alias("n"), F.substring(p, 3, 4).alias("part"),
        F.concat_ws("/", st, p).alias("joined"), F.get(F.split(p, "-"), 0).alias("head"),
        F.regexp_replace(p, "[^A-Z]", "").alias("letters"), p.like("%IGH%").alias("has_igh"),
        p.startswith("1").alias("urgent"), p.rlike("^[12]").alias("top"), p.contains("LOW").alias("low_flag"))


@query("f_date", """select o_orderkey as account, cast(date_trunc('month', o_orderdate) as date) as month,
  cast(cast(o_orderdate as date) + interval 3 month as date) as plus3, cast(o_orderdate as date) + 10 as plus10,
  cast(date '2001-01-01' - cast(o_orderdate as date) as integer) as days, last_day(cast(o_orderdate as date)) as month_end,
  cast(epoch(o_orderdate) as bigint) as unix_seconds, year(o_orderdate)::integer as y, month(o_orderdate)::integer as m from orders""")
def f_date(spark, sf):
    d = F.col("opened")
    return orders(spark, sf).select(
        "account", F.trunc(d, "month").alias("month"), F.add_months(d, 3).alias("plus3"), F.date_add(d, 10).alias("plus10"),
        F.datediff(F.lit("2001-01-01").cast("date"), d).alias("days"), F.last_day(d).alias("month_end"),
        F.unix_timestamp(d.cast("timestamp")).alias("unix_seconds"), F.year(d).alias("y"), F.month(d).alias("m"))


@query("f_math", """select o_orderkey as account, greatest(o_totalprice, 200000.0::double) as hi, abs(o_totalprice - 200000) as gap,
  cast(floor(o_totalprice) as bigint) as whole, round(ln(greatest(o_totalprice, 0.5::double)), 6) as log_price,
  case when o_totalprice > 300000 then 300000.0::double when o_totalprice < 5000 then 5000.0::double else o_totalprice end as clipped,
  cast(o_totalprice > 250000 as integer) as big from orders""")
def f_math(spark, sf):
    p = F.col("price")
    return orders(spark, sf).select(
        "account", F.greatest(p, F.lit(200000.0)).alias("hi"), F.abs(p - 200000).alias("gap"), F.floor(p).alias("whole"),
        F.round(F.ln(F.greatest(p, F.lit(0.5))), 6).alias("log_price"),
        F.when(p > 300000, 300000.0).when(p < 5000, 5000.0).otherwise(p).alias("clipped"), (p > 250000).cast("int").alias("big"))


@query("f_null", with_(RAW_TRADES, body="select account, coalesce(credit_limit, high_credit, 0.0) as any_limit, credit_limit is null as no_limit, coalesce(tenor, -99) as tenor, greatest(credit_limit, high_credit) as top from raw_trades"))
def f_null(spark, sf):
    return D.raw_trades(spark, sf).select(
        "account", F.coalesce("credit_limit", "high_credit", F.lit(0.0)).alias("any_limit"), F.isnull("credit_limit").alias("no_limit"),
        C.impute("tenor").alias("tenor"), F.greatest("credit_limit", "high_credit").alias("top"))


@query("f_array", with_(RAW_TRADES, body="""select account, cast(len(bals) as integer) as n, list_max(bals) as top, bals[1] as newest, list_sum(bals) as total,
  cast(len(list_filter(bals, lambda x: x > 50000)) as integer) as n_large, len(list_filter(dues, lambda x: x >= 2000)) > 0 as any_due,
  cast(list_position(bals, list_max(bals)) as bigint) as peak, list_contains(dues, 0.0) as has_zero, list_reverse(bals)[1] as oldest,
  list_slice(bals, 1, 2) as first_two from raw_trades"""))
def f_array(spark, sf):
    b, d = F.col("bals"), F.col("dues")
    return D.raw_trades(spark, sf).select(
        "account", F.size(b).alias("n"), F.array_max(b).alias("top"), F.get(b, 0).alias("newest"),
        F.aggregate(b, F.lit(0.0), lambda a, x: a + x).alias("total"), F.size(F.filter(b, lambda x: x > 50000)).alias("n_large"),
        F.exists(d, lambda x: x >= 2000).alias("any_due"), F.array_position(b, F.array_max(b)).alias("peak"),
        F.array_contains(d, F.lit(0.0)).alias("has_zero"), F.get(F.reverse(b), 0).alias("oldest"), F.slice(b, 1, 2).alias("first_two"))


@query("f_predicate", with_(RAW_TRADES, body="""select account, sanction between 1000 and 200000 as mid, lender in ('PVT', 'PUB') as big_lender,
  lender not in ('PVT', 'PUB') as other_lender, closed is not null as is_closed, not (lender like 'P%') as not_p,
  case when tenor > 24 then 'long' when tenor > 12 then 'mid' when tenor is null then 'unknown' else 'short' end as term from raw_trades"""))
def f_predicate(spark, sf):
    t, le = F.col("tenor"), F.col("lender")
    return D.raw_trades(spark, sf).select(
        "account", F.col("sanction").between(1000, 200000).alias("mid"), le.isin("PVT", "PUB").alias("big_lender"),
        (~le.isin("PVT", "PUB")).alias("other_lender"), F.col("closed").isNotNull().alias("is_closed"), (~le.like("P%")).alias("not_p"),
        F.when(t > 24, "long").when(t > 12, "mid").when(t.isNull(), "unknown").otherwise("short").alias("term"))


@query("f_cast", """select o_orderkey as account, cast(floor(o_totalprice) as integer) as as_int, cast(o_totalprice as float)::double as as_float,
  cast(cast(o_orderdate as date) as varchar) as as_text, cast(null as integer) as bad, cast(o_orderdate as date) as as_date from orders""")
def f_cast(spark, sf):
    return orders(spark, sf).select(
        "account", F.col("price").try_cast("int").alias("as_int"), F.col("price").cast("float").cast("double").alias("as_float"),
        F.col("opened").cast("string").alias("as_text"), F.col("priority").try_cast("int").alias("bad"),
        F.col("opened").cast("string").try_cast("date").alias("as_date"))
