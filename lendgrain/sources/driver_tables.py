"""The domain tables read out of the given test tables (events, orders, lineitem, customer).

Amounts are whole numbers so that sums do not depend on the order of addition.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import history as H
from lendgrain.functions.lookups import map_flags, vocabulary
from lendgrain.operators.relational import quality_filter
from lendgrain.sources.bureaus import early_buckets, with_offsets

ENQUIRY_ASOF = "2024-02-01"
TRADE_ASOF = "2001-01-01"

# how the test tables' values stand for bureau values
EVENT_PURPOSE = {"view": "Personal Loan", "click": "Credit Card", "purchase": "Consumer Loan",
                 "error": "Leasing", "signup": "Housing Loan"}
ORDER_ACCOUNT_TYPE = {
    "1-URGENT": ("Personal Loan", "Two-wheeler Loan"), "2-HIGH": ("Credit Card", "Gold Loan"),
    "3-MEDIUM": ("Housing Loan", "Auto Loan (Personal)"),
    "4-NOT SPECIFIED": ("Business Loan - General", "Property Loan"), "5-LOW": ("Consumer Loan", "Overdraft"),
}


def table(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _choose(col, mapping):
    out = F.lit(None).cast("string")
    for k, v in mapping.items():
        out = F.when(col == k, F.lit(v)).otherwise(out)
    return out


def raw_enquiries(spark, sf_dir):
    """member, enq_date, purpose, amount, as_of"""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("user_id").alias("member"), F.to_date("ts").alias("enq_date"),
        _choose(F.col("event_type"), EVENT_PURPOSE).alias("purpose"),
        F.floor(F.col("value") * 100).cast("double").alias("amount"),
        F.lit(ENQUIRY_ASOF).cast("date").alias("as_of"))


def member_dates(spark, sf_dir, base="2000-01-01"):
    """Each customer's own as-of date."""
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("member"),
                    F.date_add(F.lit(base).cast("date"), (F.col("c_custkey") % 365).cast("int")).alias("own_as_of"))


def monthly_cells(spark, sf_dir):
    """One row per account and report month (so what is collected per account is bounded by the
    calendar): bal, due, paid, qty, disc."""
    li = table(spark, sf_dir, "lineitem")
    ep = F.col("l_extendedprice")
    return li.groupBy(
        F.col("l_orderkey").alias("account"), F.trunc(F.to_date("l_shipdate"), "month").alias("month")
    ).agg(
        F.sum(F.floor(ep * (1 - F.col("l_discount")))).cast("double").alias("bal"),
        F.sum(F.floor(ep * F.col("l_tax"))).cast("double").alias("due"),
        F.sum(F.floor(ep * F.col("l_discount"))).cast("double").alias("paid"),
        F.max("l_quantity").cast("int").alias("qty"),
        F.max("l_discount").alias("disc"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.floor(ep * (1 - F.col("l_discount")))).otherwise(0)
              ).cast("double").alias("open_bal"),
        F.sum(F.when(F.col("l_returnflag") == "R", F.floor(ep * F.col("l_tax"))).otherwise(0)
              ).cast("double").alias("late_due"),
        F.max(F.to_date("l_shipdate")).alias("last_day"),
        F.min(F.to_date("l_shipdate")).alias("first_day"),
        F.max(F.when(F.col("l_linestatus") == "F", F.to_date("l_shipdate"))).alias("pay_day"),
    )


def cell_codes():
    """Three history codes of a cell."""
    q = F.col("qty")
    c1 = F.when(q % 4 == 0, F.lpad((q * 8).cast("string"), 3, "0")).otherwise("000")
    c2 = F.when(F.col("disc") > 0.08, "XXX").when(F.col("disc") > 0.05, "STD").otherwise("000")
    c3 = (F.when(q % 10 == 1, "901").when(q % 10 == 2, "905").when(q % 10 == 3, "029")
          .when(q % 10 == 4, "SUB").otherwise("000"))
    return F.concat(c1, c2, c3)


def account_history(spark, sf_dir):
    """One row per account: packed text and month lists, newest month first."""
    cells = monthly_cells(spark, sf_dir).withColumn("codes", cell_codes())
    rows = F.reverse(F.array_sort(F.collect_list(F.struct("month", "codes", "bal", "due", "paid"))))
    g = cells.groupBy("account").agg(
        rows.alias("r"), F.max("last_day").alias("hist_start"), F.min("first_day").alias("hist_end"),
        F.sum("open_bal").alias("balance"), F.sum("late_due").alias("overdue"),
        F.sum("paid").alias("last_payment"), F.max("pay_day").alias("last_paid"),
        F.max("qty").alias("max_qty"), F.count(F.lit(1)).alias("n_months"))
    return g.select(
        "account", "hist_start", "hist_end", "balance", "overdue", "last_payment", "last_paid", "max_qty", "n_months",
        F.array_join(F.col("r.codes"), "").alias("dpd_text"),
        F.col("r.month").alias("months"), F.col("r.bal").alias("bals"),
        F.col("r.due").alias("dues"), F.col("r.paid").alias("paids"))


def history_lists(spark, sf_dir):
    """Bureau B shape: comma lists with a trailing comma, packed codes."""
    h = account_history(spark, sf_dir)

    def joined(c, f):
        return F.concat(F.array_join(F.transform(F.col(c), f), ","), F.lit(","))

    return h.select(
        "account", joined("months", lambda x: F.date_format(x, "yyyyMMdd")).alias("reported_list"),
        joined("bals", lambda x: x.cast("long").cast("string")).alias("balance_list"),
        joined("dues", lambda x: x.cast("long").cast("string")).alias("overdue_list"),
        F.col("dpd_text").alias("dpd_text"), F.lit(TRADE_ASOF).cast("date").alias("as_of"))


def raw_trades(spark, sf_dir):
    """One row per account with its attributes and raw history."""
    o = table(spark, sf_dir, "orders")
    h = account_history(spark, sf_dir)
    kind = F.col("o_orderstatus")
    price = F.col("o_totalprice")
    k = F.col("o_orderkey")
    head = o.select(
        F.col("o_custkey").alias("member"), k.alias("account"),
        F.when(kind == "P", _choose(F.col("o_orderpriority"), {a: b[1] for a, b in ORDER_ACCOUNT_TYPE.items()}))
        .otherwise(_choose(F.col("o_orderpriority"), {a: b[0] for a, b in ORDER_ACCOUNT_TYPE.items()}))
        .alias("account_type"),
        F.to_date("o_orderdate").alias("opened"), kind.alias("status"),
        F.floor(price).cast("double").alias("sanction"),
        F.when(k % 7 != 0, F.floor(price * 1.1).cast("double")).alias("high_credit"),
        F.when((F.col("o_orderpriority") == "2-HIGH") & (kind != "P") & (k % 9 != 0),
               F.floor(price * 0.5).cast("double")).alias("credit_limit"),
        F.when(k % 5 != 0, (k % 48).cast("int")).alias("tenor"),
        F.element_at(F.array(*[F.lit(x) for x in ("PVT", "HFC", "NBF", "PUB", "FOR")]),
                     (k % 5 + 1).cast("int")).alias("lender"),
        F.lpad((k % 20).cast("string"), 2, "0").alias("wo_status"), (300 + (k * 7) % 600).cast("int").alias("score"),
        F.lit(TRADE_ASOF).cast("date").alias("as_of"))
    t = head.join(h, "account")
    return t.select(
        *head.columns, "hist_start", "hist_end", "balance", "overdue", "last_payment", "last_paid",
        F.col("hist_start").alias("reported"),
        F.when(F.col("status") == "F", F.greatest("hist_start", "opened")).alias("closed"),
        (F.col("max_qty") == 50).cast("int").alias("written_off"),
        F.when(F.col("max_qty") >= 48, F.floor(F.col("sanction") / 10)).cast("double").alias("write_off_amt"),
        "dpd_text", "months", "bals", "dues", "paids")


def trades(spark, sf_dir, max_history_text=None, raw=None):
    """The canonical account frame: as-of filters applied, codes mapped, 36-slot arrays aligned. raw: accounts as from
    raw_trades, with dates of their own in as_of.

    max_history_text: accounts with a longer history text are left out, which is a rule of the first
    bureau (36 months of 3 characters); None keeps them."""
    t = (raw_trades(spark, sf_dir) if raw is None else raw).filter(F.col("opened") <= F.col("as_of"))
    if max_history_text is not None:
        t = quality_filter(t, text_length=("dpd_text", 0, max_history_text))
    t = with_offsets(map_flags(t, "account_type", vocabulary(spark, "a_account")))
    buckets = H.bucket_dpd(H.unpack("dpd_text"))
    t = t.withColumn("dpd", H.mark_out_of_range(H.align(buckets, "m_start", F.lit(8)), "m_start", "m_end"))
    null = F.lit(None).cast("double")
    t = t.withColumn("phist", early_buckets(buckets))
    return t.withColumns({
        "bal": H.align_by_month("bals", "months", "as_of", null),
        "due": H.align_by_month("dues", "months", "as_of", null),
    })


def scored(spark, sf_dir):
    """One row per line item: sample, target, prob, weight and model variables."""
    li = table(spark, sf_dir, "lineitem")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice", "o_orderpriority")
    j = li.join(o, li["l_orderkey"] == o["o_orderkey"])
    d, t, q = F.col("l_discount"), F.col("l_tax"), F.col("l_quantity")
    return j.select(
        (F.col("l_returnflag") == "R").cast("int").alias("target"),
        ((d * 5 + t * 3 + q / 100) / 1.3).alias("prob"),
        q.alias("weight"),
        F.when(F.col("o_orderdate") < "1999-01-01", "Train").when(F.col("o_orderdate") < "2001-01-01", "Test")
        .otherwise("OOT").alias("sample"),
        q.alias("quantity"), F.floor("l_extendedprice").cast("double").alias("price"), d.alias("discount"),
        F.when(t > 0, t).alias("tax"), F.floor("o_totalprice").cast("double").alias("total"),
        F.col("l_linestatus").alias("line_status"), F.col("o_orderpriority").alias("priority"))


def file_a(spark, sf_dir):
    """The accounts in the shape of bureau A's file: dates as text and numbers, amounts as reported."""
    t = raw_trades(spark, sf_dir)
    short = lambda c: F.date_format(c, "d-MMM-yy")
    return t.select(
        F.col("member").cast("string").alias("MemberReference"), F.col("account").cast("string").alias("Loan_account_Number"),
        F.concat(F.lit(" "), "account_type").alias("Loan_Type"), F.lit("Individual").alias("Ownership_Type"), F.col("dpd_text").alias("Dpd_string"),
        short("opened").alias("DATE_OPENED"), short("closed").alias("DATE_CLOSED"), short("hist_start").alias("Pay_Hist_Start_Date"), short("hist_end").alias("Pay_Hist_END_Date"),
        F.date_format("reported", "ddMMyyyy").cast("int").alias("DateReported_trades"), F.date_format("last_paid", "ddMMyyyy").cast("int").alias("Last_payment_date"),
        F.col("sanction").alias("Sanction_Amount"), F.col("high_credit").alias("High_Credit_Amount"), F.col("balance").alias("Out_standing_Balance"), F.col("overdue").alias("Over_due_amount"),
        F.col("credit_limit").alias("CREDITLIMIT"), F.col("last_payment").alias("actual_paymt_amt"), "tenor", F.col("score").cast("string").alias("TU_Score"), F.col("lender").alias("Sector"),
        F.lit(None).cast("int").alias("suit_filed_status"), F.col("written_off").alias("Credit_Facility_Status"), F.col("write_off_amt").alias("writeoff_amt_tot"))


def file_b(spark, sf_dir):
    """The accounts in the shape of bureau B's file: comma lists by month, two ways of writing a date."""
    t = raw_trades(spark, sf_dir)
    listed = lambda c: F.concat(F.array_join(F.transform(c, lambda x: x.cast("long").cast("string")), ","), F.lit(","))
    day = lambda c: F.when(F.col("account") % 2 == 0, F.date_format(c, "dd-MM-yyyy")).otherwise(F.date_format(c, "d/M/yyyy"))
    return t.select(
        F.col("member").alias("losappid"), F.col("account").alias("acct_no"), F.col("account_type").alias("ACCTTYPE"), F.col("lender").alias("CREDITGRANTOR"),
        F.col("credit_limit").cast("string").alias("creditlimitsancamt"), day("closed").alias("CLOSEDT"), day("opened").alias("DISBURSEDDT"),
        F.concat(F.array_join(F.transform("months", lambda x: F.date_format(x, "yyyyMMdd")), ","), F.lit(",")).alias("REPORTEDDATEHIST"),
        listed("bals").alias("CURBALHIST"), listed("dues").alias("AMTOVERDUEHIST"), listed("bals").alias("HIGHCRDHIST"), listed("paids").alias("AMTPAIDHIST"), F.col("dpd_text").alias("DPDHIST"))


ORDER_PURPOSE = {"1-URGENT": "Personal Loan", "2-HIGH": "Credit Card", "3-MEDIUM": "Housing Loan", "4-NOT SPECIFIED": "Consumer Loan", "5-LOW": "Leasing"}


def raw_order_enquiries(spark, sf_dir):
    """Enquiries over several years: member, enq_date, purpose, amount, as_of."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_custkey").alias("member"), F.to_date("o_orderdate").alias("enq_date"), _choose(F.col("o_orderpriority"), ORDER_PURPOSE).alias("purpose"),
        F.floor("o_totalprice").cast("double").alias("amount"), F.lit(TRADE_ASOF).cast("date").alias("as_of"))
