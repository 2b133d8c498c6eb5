"""Raw bureau files to the canonical account frame that every family reads.

Each preparation takes the file's own columns as text and numbers, a frame of as-of dates (one per key, or per key and
month) or one date for all, and gives the same columns: keys, account, account_type, product, secured, unsecured,
revolving, installment, opened, closed, reported, last_paid, hist_start, hist_end, as_of and the months m_* between
them and as_of, sanction, high_credit, credit_limit, balance, overdue, last_payment, tenor, lender, score, wo_status,
write_off_amt, written_off, and the arrays dpd, phist, bal, due with one slot per month before as_of.

A date that cannot be read is null; an account without an opening date, or opened after as_of, is left out.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import history as H
from lendgrain.functions import trade_columns as TC
from lendgrain.functions.columns import clamp, clean_amount, coalesce_dates, date_sanity, month_diff, parse_date, parse_date_any
from lendgrain.functions.lookups import map_flags, vocabulary
from lendgrain.operators.relational import quality_filter

OFFSETS = {"m_open": "opened", "m_close": "closed", "m_report": "reported", "m_pay": "last_paid", "m_start": "hist_start", "m_end": "hist_end"}
FIELDS = ("account account_type product secured unsecured revolving installment opened closed reported last_paid hist_start hist_end as_of "
          "m_open m_close m_report m_pay m_start m_end sanction high_credit credit_limit balance overdue last_payment tenor lender score wo_status "
          "write_off_amt written_off dpd phist bal due").split()
B_DATES = ((r"^\d{2}-\d{2}-\d{4}$", "dd-MM-yyyy"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/yyyy"))
EARLY_SLOTS = 6


def with_asof(raw: DataFrame, asof, key) -> DataFrame:
    """asof: a date for all rows, or a frame of the key columns (or some of them) and as_of."""
    if isinstance(asof, DataFrame):
        on = [k for k in key if k in asof.columns]
        return raw.join(asof.select(*on, "as_of"), on)
    return raw.withColumn("as_of", F.lit(asof).cast("date"))


def with_offsets(t: DataFrame) -> DataFrame:
    return t.withColumns({m: month_diff("as_of", d) for m, d in OFFSETS.items()})


def early_buckets(buckets):
    """The first slots of the history as reported: -2 beyond its length in months, -1 for what cannot be read."""
    span = month_diff("hist_start", "hist_end")
    return F.transform(F.slice(buckets, 1, EARLY_SLOTS), lambda x, i: F.when((x == 8) & (i > span), F.lit(-2)).when(x == 8, F.lit(-1)).otherwise(x))


def amounts(columns: dict) -> dict:
    """{name: (column, rule)}: commas dropped, then the rule of columns.clamp, if any."""
    return {name: clamp(clean_amount(c), rule) if rule else clean_amount(c) for name, (c, rule) in columns.items()}


def canonical(t: DataFrame, key) -> DataFrame:
    """The columns in order; what a bureau does not report is null."""
    kinds = {"dpd": "array<int>", "phist": "array<int>", "bal": "array<double>", "due": "array<double>", "last_paid": "date", "hist_end": "date", "lender": "string", "wo_status": "string",
             "score": "int", "tenor": "int", "written_off": "int"}
    nothing = {c: F.lit(None).cast(kinds.get(c, "double")) for c in FIELDS if c not in t.columns}
    return t.withColumns(nothing).select(*key, *FIELDS)


def empty_slots(n=H.SLOTS):
    return F.array_repeat(F.lit(None).cast("double"), n)


def prepare_accounts_a(raw: DataFrame, spark, asof, key=("MemberReference",), max_history_text=108) -> DataFrame:
    """Bureau A: one row per account with ACCOUNT_SCHEMA's columns; the history is one text of 3-character codes,
    newest month first. Accounts of guarantors and with a longer text than max_history_text (None: any) are left out,
    as are those whose report, or failing it last payment, has no date."""
    t = with_asof(raw, asof, key)
    short = lambda c: parse_date(c, "dd-MMM-yy", pad=9, pivot_year=2050)
    number = lambda c: parse_date(F.lpad(F.col(c).cast("string"), 8, "0"), "ddMMyyyy")
    t = t.filter(F.coalesce(F.col("Ownership_Type") != "Guarantor", F.lit(False)))
    if max_history_text is not None:
        t = quality_filter(t, text_length=("Dpd_string", 0, max_history_text))
    t = t.withColumns({
        "account": F.col("Loan_account_Number"), "account_type": F.trim("Loan_Type"), "opened": short("DATE_OPENED"), "hist_start": short("Pay_Hist_Start_Date"),
        "hist_end": short("Pay_Hist_END_Date"), "last_paid": number("Last_payment_date")})
    t = t.withColumns({"reported": coalesce_dates(number("DateReported_trades"), "last_paid"), "closed": date_sanity(short("DATE_CLOSED"), "as_of")})
    t = t.filter((F.col("opened") <= F.col("as_of")) & (F.col("hist_start") <= F.col("as_of")) & F.col("reported").isNotNull())
    t = t.withColumns(amounts({
        "sanction": ("Sanction_Amount", None), "high_credit": ("High_Credit_Amount", None), "credit_limit": ("CREDITLIMIT", "null_if_negative"), "balance": ("Out_standing_Balance", "non_negative"),
        "overdue": ("Over_due_amount", "non_negative"), "last_payment": ("actual_paymt_amt", None), "write_off_amt": ("writeoff_amt_tot", None)}))
    t = t.withColumns({"tenor": F.col("tenor").cast("int"), "lender": F.col("Sector"), "score": F.col("TU_Score").try_cast("int"), "wo_status": F.col("Credit_Facility_Status").cast("string"),
                       "written_off": TC.written_off_codes("suit_filed_status", "Credit_Facility_Status")})
    t = with_offsets(map_flags(t, "account_type", vocabulary(spark, "a_account")))
    buckets = H.bucket_dpd(H.unpack("Dpd_string"))
    t = t.withColumns({"dpd": H.mark_out_of_range(H.align(buckets, "m_start", F.lit(8)), "m_start", "m_end"), "phist": early_buckets(buckets), "bal": empty_slots(), "due": empty_slots()})
    return canonical(t, key)


def prepare_accounts_b(raw: DataFrame, spark, asof, key=("losappid",), account="acct_no") -> DataFrame:
    """Bureau B: one row per account with comma lists by report month, newest first, each with a trailing comma, and
    packed 3-character codes of the same length. Months from that of as_of on are dropped, and with them accounts that have
    no other; the newest month left gives the account's present state."""
    t = with_asof(raw, asof, key)
    t = t.withColumns({"months": F.transform(H.unpack_list("REPORTEDDATEHIST", "date"), lambda d: F.trunc(d, "month")), "_n": F.size(H.unpack_list("REPORTEDDATEHIST", "date"))}).filter("_n > 0")
    lists = {"bals": "CURBALHIST", "dues": "AMTOVERDUEHIST", "highs": "HIGHCRDHIST", "paids": "AMTPAIDHIST"}
    codes = F.transform(F.sequence(F.lit(1), F.col("_n")), lambda i: F.substring(H.pad_history("DPDHIST", "_n"), (i - 1) * 3 + 1, F.lit(3)))
    t = t.withColumns({n: H.unpack_list(c) for n, c in lists.items()}).withColumn("codes", codes)
    # the first month before that of as_of, and all that follow it in the lists
    t = t.withColumn("_at", F.array_position(F.transform("months", lambda d: F.coalesce(d < F.trunc("as_of", "month"), F.lit(False))), True)).filter("_at > 0")
    t = t.withColumns({c: F.slice(c, F.col("_at").cast("int"), F.col("_n")) for c in ("months", "codes", *lists)})
    newest = lambda c: F.get(F.col(c), 0)
    before = lambda c: date_sanity(parse_date_any(c, B_DATES), "as_of", include_upper=True)
    t = t.withColumns({
        "account": F.col(account).cast("string") if account in raw.columns else F.lit(None).cast("string"), "account_type": F.trim("ACCTTYPE"), "opened": before("DISBURSEDDT"), "closed": before("CLOSEDT"),
        "reported": newest("months"), "hist_start": newest("months"), "hist_end": F.element_at("months", -1), "last_paid": F.lit(None).cast("date"), "high_credit": newest("highs"),
        "sanction": newest("highs"), "credit_limit": clamp(clean_amount("creditlimitsancamt"), "null_if_negative"), "balance": clamp(newest("bals"), "non_negative"), "overdue": newest("dues"),
        "last_payment": newest("paids"), "lender": F.col("CREDITGRANTOR")})
    t = with_offsets(map_flags(t.filter("opened is not null"), "account_type", vocabulary(spark, "b_account")))
    place = lambda values, missing: H.align_by_month(values, "months", "as_of", missing)
    buckets = H.bucket_dpd("codes", "b")
    null = F.lit(None).cast("double")
    t = t.withColumns({"dpd": H.mark_not_reported(place(buckets, F.lit(9))), "phist": H.mark_not_reported(F.slice(buckets, 1, EARLY_SLOTS)), "bal": place("bals", null), "due": place("dues", null)})
    return canonical(t, key)


def prepare_accounts_c(raw: DataFrame, spark, asof, key=("user_id",)) -> DataFrame:
    """Bureau C: one row per account with a column per month (01 the newest, before balance_dt): payment ratings 01-36,
    balances 01-24, amounts past due 01-36. Accounts whose balance date is not before as_of are left out. -1 stands
    for an unknown amount."""
    t = with_asof(raw, asof, key)
    day = lambda c: parse_date(c, "dd/MM/yyyy")
    names = {c.lower(): c for c in raw.columns}
    month = lambda stem, i: F.col(names[f"{stem}_{i:02d}"])
    slots = lambda stem, n, use: F.array(*[use(month(stem, i)) if i <= n else F.lit(None).cast("double") for i in range(1, H.SLOTS + 1)])
    t = t.withColumns({"account": F.col("acct_key").cast("string"), "account_type": F.col("acct_type_cd").cast("string"), "opened": day("open_dt"), "closed": day("closed_dt"),
                       "reported": day("balance_dt"), "hist_start": day("balance_dt"), "last_paid": day("last_payment_dt")})
    t = t.filter((F.col("opened") <= F.col("as_of")) & (F.col("reported") < F.col("as_of")))
    t = t.withColumn("hist_end", F.add_months("hist_start", 1 - H.SLOTS))
    t = t.withColumns(amounts({"sanction": ("orig_loan_am", "minus_one_null"), "credit_limit": ("credit_limit_am", "minus_one_null"), "balance": ("balance_am", None),
                               "overdue": ("past_due_am", "non_negative"), "write_off_amt": ("write_off_amt", None)}))
    t = t.withColumns({"high_credit": F.col("sanction"), "lender": F.col("M_SUB_ID"), "wo_status": F.col("written_off_and_settled_status").cast("string"),
                       "score": F.col(names["score_v3"]).try_cast("int") if "score_v3" in names else F.lit(None).cast("int")})
    t = t.withColumn("written_off", TC.written_off_status("wo_status", "write_off_amt"))
    t = with_offsets(map_flags(t, "account_type", vocabulary(spark, "c_account")))
    amount = lambda c: clamp(c.cast("double"), "non_negative")
    buckets = H.bucket_dpd(F.array(*[month("payment_rating_cd", i).cast("string") for i in range(1, H.SLOTS + 1)]), "c")
    null = F.lit(None).cast("double")
    t = t.withColumns({"dpd": F.transform(H.align(buckets, "m_start", F.lit(-2)), lambda x: F.coalesce(x, F.lit(-2))), "phist": F.slice(buckets, 1, EARLY_SLOTS),
                       "bal": H.align(slots("balance_am", 24, amount), "m_start", null), "due": H.align(slots("past_due_am", 36, amount), "m_start", null)})
    return canonical(t, key)
