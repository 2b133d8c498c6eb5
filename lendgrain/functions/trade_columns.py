"""Columns of one account. Input is the canonical account frame (see sources/driver_tables.trades):
member, account, account_type, product, secured, revolving, opened, closed, reported, last_paid,
hist_start, hist_end, as_of, m_* month offsets, sanction, high_credit, credit_limit, balance, overdue,
last_payment, tenor, written_off, dpd/bal/due slot arrays.
"""

from dataclasses import dataclass

from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions import history as H
from lendgrain.functions.columns import (as_col, band, derive_limit, flag, flag_or_null, is_in,
                                         month_diff)

PRODUCTS = ("PL", "GL", "CV", "TW", "BL", "HL", "Other", "OD", "AL", "CC", "LAP", "CE", "EL", "CD")
MAIN_PRODUCTS = ("PL", "GL", "TW", "BL", "HL", "CD", "AL")
MONTHS = tuple(range(13))


# ---- open or closed, by several rules --------------------------------------------------------------
def _paid_off(before):
    """A zero balance closes any account that is not a card, overdraft or facility."""
    return (F.col("balance") == 0) & (F.col("revolving") == 0) & before


def open_asof():
    start = F.trunc("as_of", "month")
    gone = (F.col("closed") < start) | _paid_off(F.col("last_paid") < start)
    return 1 - flag(gone)


def open_in_month(i):
    i = F.lit(i) if isinstance(i, int) else i
    gone = (F.col("m_open") < i) | (F.col("m_close") > i) | _paid_off(F.col("m_pay") > i)
    return 1 - flag(gone)


def closed_category():
    live_at_zero = is_in("account_type", V.ACCOUNT_ZERO_BALANCE_LIVE)
    return flag((F.col("closed") < F.col("as_of")) | (F.col("written_off") == 1)
                | ((F.col("balance") == 0) & ~live_at_zero))


def open_by_code(balance="balance"):
    """Bureau C: closed before the as-of month, or a non-revolving account with nothing owed."""
    return 1 - flag((F.col("m_close") > 0)
                    | ((F.col("revolving") == 0) & F.col("m_close").isNull() & (as_col(balance) <= 0)))


def open_by_status(codes, live="S04"):
    return F.transform(as_col(codes), lambda x: flag(x == live))


def live_within(days):
    """Quarter liveness: neither closed nor paid off for more than `days` days."""
    since = lambda c: F.datediff("as_of", F.col(c)) > days
    return 1 - flag(since("closed") | ((F.col("balance") == 0) & (F.col("revolving") == 0) & since("hist_start")))


OPEN_RULES = {"as_of": open_asof, "category": lambda: 1 - closed_category(), "code": open_by_code,
              "q1": lambda: live_within(90), "q2": lambda: live_within(180)}


def is_open(rule="as_of", month=None):
    return open_in_month(month) if month is not None else OPEN_RULES[rule]()


# ---- limits and instalments -------------------------------------------------------------------------
def is_card():
    return is_in("account_type", V.ACCOUNT_CARD)


def limit_amount():
    return derive_limit(is_card(), "credit_limit", "sanction", "high_credit")


def card_line():
    return F.coalesce("credit_limit", F.greatest("sanction", "high_credit"))


EMI_RATES = {"HL": 0.01, "CC": 0.05}
EMI_DEFAULT_RATE = 0.03


def emi_estimate(open_col="is_open", balance="balance", amount="sanction"):
    """Monthly instalment by product rate: cards on the balance, the rest on the sanction."""
    b, s = as_col(balance), as_col(amount)
    paying = (b > 0) & (s > 0) & (as_col(open_col) == 1)
    p = F.col("product")
    return F.when(paying & (p == "CC"), EMI_RATES["CC"] * b).when(paying & (p == "HL"), EMI_RATES["HL"] * s) \
        .when(paying, EMI_DEFAULT_RATE * s).otherwise(F.lit(0.0))


def principal():
    """What the account was for: the limit, or the balance where that is larger; never negative."""
    lim, b = F.col("limit_amount"), F.col("balance")
    amount = F.when(lim - b >= 0, lim).otherwise(b)
    return F.when(amount > 0, amount).otherwise(F.lit(0.0))


@dataclass(frozen=True)
class Schedule:
    """How an instalment follows from the principal: paid back at once up to `at_once`, else what has been paid a
    month so far, else a rate by product."""
    at_once: float = 5000
    rates: tuple = ((0.05, ("CC", "PL")), (0.007, ("HL", "LAP")))
    other_rate: float = 0.03

    def rate(self, product):
        by_product = F.create_map(*[F.lit(x) for rate, products in self.rates for p in products for x in (p, rate)])
        return F.coalesce(F.try_element_at(by_product, product), F.lit(self.other_rate))


def months_current():
    """Months without arrears: the slots that say so, and those before the first slot; a history that ends this month has one."""
    older = F.greatest(F.col("m_end") - H.SLOTS, F.lit(0))
    return F.when(F.col("m_end") != 0, H.count_value("dpd", 0) + older).otherwise(F.when(F.col("m_end") == 0, 1))


def emi_amortised(schedule=Schedule()):
    """Instalment of an account: the first answer that is there, else 0."""
    owed, term = F.col("principal"), F.col("revolving") == 0
    months, repaid = F.col("current_months"), F.col("principal") - F.col("balance")
    answers = [F.when(term & (owed <= schedule.at_once), owed),
               F.when(term & (owed > schedule.at_once) & (repaid > 0), F.try_divide(repaid, F.when(months > 0, months).cast("double"))),
               owed * schedule.rate(F.col("product"))]
    return F.coalesce(F.when(owed > 0, F.coalesce(*answers)), F.lit(0.0))


def account_close_date():
    return (F.when(F.col("live").getItem(0) == 1, None).when(F.col("closed").isNotNull(), F.col("closed"))
            .when(F.col("last_paid") > F.trunc("opened", "month"), F.col("last_paid"))
            .otherwise(F.col("hist_start")))


def loan_tenure():
    """Closed span, else stated, else elapsed plus what is left, else the whole amount over the instalment."""
    end, emi = F.col("close_date"), F.col("emi_new")
    return (F.when(end.isNotNull(), (month_diff(end, "opened") + 1).cast("double"))
            .when(F.col("tenor") > 0, F.col("tenor").cast("double"))
            .when((F.col("balance") > 0) & (emi > 0), F.col("m_open") + F.try_divide(F.col("balance"), emi))
            .otherwise(F.try_divide(F.col("limit_amount"), emi)))


# ---- flags ------------------------------------------------------------------------------------------
def segment_flags(amount="highest"):
    """Overlapping segments: ticket size of personal loans, security, product."""
    t, a = F.col("account_type"), as_col(amount)
    pl = t == "Personal Loan"
    seg = {"PLlt5": pl & (a <= 5000), "PLgt5": pl & (a > 5000), "PLlt10k": pl & (a <= 10000),
           "PLlt1L": pl & (a <= 100000), "PLgt1L": pl & (a > 100000),
           "NAGRI": t.isin(V.SEGMENT_NAGRI), "SEC": t.isin(V.SEGMENT_SEC), "UNSEC": t.isin(V.SEGMENT_UNSEC),
           "Overall": F.lit(True)}
    for p, types in V.SEGMENT_PRODUCT.items():
        if p != "PL":
            seg[p] = t.isin(types)
    return seg


def band_flags(amount, bands, age, windows, cond=None):
    more = F.lit(True) if cond is None else cond
    return {f"upto_{hi}_{w}": flag(band(amount, lo, hi) & (as_col(age) <= w) & more) for lo, hi in bands for w in windows}


def util_flags(cuts=(0.25, 0.5, 0.75)):
    """Utilisation above each cut (null when not), for recent personal loans and cards."""
    recent = F.col("recent") == 1
    pl = F.try_divide("balance", "sanction")
    cc = F.try_divide(F.col("balance"), card_line())
    out = {}
    for c in cuts:
        n = int(c * 100)
        out[f"pl_util_gt_{n}"] = flag_or_null(recent & (F.col("product") == "PL") & (pl > c))
        out[f"cc_util_gt_{n}"] = flag_or_null(recent & (F.col("product") == "CC") & (cc > c))
    young = F.try_divide("balance", "credit_limit") < 0.6
    out["cc_util_lt_60_12m"] = flag(is_in("account_type", ["Corporate Credit Card", "Credit Card", "Secured Credit Card"])
                                    & (F.col("credit_limit") != 0) & young & (F.col("m_open") <= 12))
    return out


def overdue_splits():
    o, p = F.col("overdue"), F.col("product")
    days = F.datediff("as_of", "reported")

    def part(cond):
        return F.when(cond, o).otherwise(F.lit(0.0))

    relaxed = F.when(p == "CC", H.slot("dpd", 1) >= 2).otherwise(H.slot("dpd", 1) >= 1)
    return {"open_overdue": part(F.col("is_open") == 1), "recent_overdue": part(F.col("m_report") < 4),
            "delinquent_overdue": part(relaxed), "cc_overdue": part(p == "CC"), "non_cc_overdue": part(p != "CC"),
            "pl_overdue": part(p == "PL"), "overdue_3m": part(days <= 90), "overdue_6m": part(days <= 180)}


def lender_flags(products=("CC", "PL"), classes=tuple(V.LENDER_CLASSES)):
    return {f"{state}_{p.lower()}_{c.lower()}": flag((F.col("is_open") == v) & (F.col("product") == p) & (F.col("lender") == c))
            for state, v in (("open", 1), ("closed", 0)) for p in products for c in classes}


def external_lender(lender, own):
    """Housing loans from anyone whose name does not contain `own`."""
    return flag((F.col("product") == "HL") & ~F.lower(as_col(lender)).like(f"%{own.lower()}%"))


def written_off_codes(suit="suit_filed", settled="settled_status"):
    return flag((as_col(suit) == 1) | (as_col(settled) == 1))


def written_off_amounts(settlement, total):
    return flag((as_col(settlement) > 0) | (as_col(total) > 0))


def written_off_status(status, *amounts, floor=10000):
    return flag(is_in(status, V.C_WRITTEN_OFF_STATUS) & (F.coalesce(*[as_col(a) for a in amounts]) > floor))


def make_target(label, bad="04_Bad", good="03_Good"):
    x = as_col(label)
    return F.when(x == bad, 1).when(x == good, 0)


def dpd_targets(months=(6, 9, 12, 15, 18, 24), days=(30, 60, 90, 120, 150, 180), template="max_dpd{m}mob"):
    return {f"target_{m}mob_{d}_flag": flag(F.col(template.format(m=m)) >= d) for m in months for d in days}


# ---- everything the families need ---------------------------------------------------------------------
def trade_base(t):
    """Adds the derived columns the families share. Flat selects, no shuffle."""
    t = t.withColumns({
        "is_open": open_asof(), "tenure": F.col("m_open"),
        "live": F.transform(F.sequence(F.lit(0), F.lit(12)), open_in_month),
        "limit_amount": limit_amount(), "highest": F.greatest("high_credit", "sanction", F.lit(0.0)),
        "vintage_days": F.datediff("as_of", "opened"), "report_days": F.datediff("as_of", "reported"),
        "hc": F.when(F.col("product") == "CC", F.greatest("high_credit", "credit_limit")).otherwise(F.col("high_credit")),
        "recent": flag_or_null(F.datediff("as_of", "reported") <= 365)})
    t = t.withColumns({"principal": principal(), "emi": emi_estimate(), "current_months": months_current()})
    t = t.withColumn("emi_new", emi_amortised())
    t = t.withColumn("close_date", account_close_date())
    return t.withColumns({
        "loan_tenure": loan_tenure(), "m_acct_close": F.months_between("as_of", F.trunc("close_date", "month")),
        "long_term": flag(F.col("principal") > 30000), "short_term": flag(F.col("principal") <= 30000)})


