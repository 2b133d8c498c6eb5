"""Account features: one wide row per member, or per member and month: every `key` is a name or several.

Input is trade_flags(trade_base(trades)). A family is a list of aggregate texts (so that any set of
families can share one pass); the families that span many (type x window) cells are aggregated long,
(member, type) first, and spread to columns last: each account row is then touched once per type it
belongs to and not once per output column.

"null" features are null for a member without a matching account, "zero" features are 0.
"""

from functools import reduce, wraps

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions import history as H
from lendgrain.functions import history_line as L
from lendgrain.functions import trade_columns as TC
from lendgrain.functions.columns import null_safe_diff, ratio_text, safe_ratio
from lendgrain.functions.trade_columns import MAIN_PRODUCTS, MONTHS, PRODUCTS
from lendgrain.operators.aggregates import exprs, key_names, monthly_totals, sum_at_extreme
from lendgrain.operators.relational import dealt
from lendgrain.operators.windows import first_last, reopened
from lendgrain.session import cut_lineage

DAY_WINDOWS = {"3m": 90, "6m": 180, "9m": 270, "12m": 365}
FOCUS = ("PL", "CC", "CD", "HL", "LAP", "BL")
TICKETS = {"50k": 50000, "1l": 100000, "5l": 500000}
LEVELS = {"x": 1, "30": 2, "60": 3, "90": 4, "150": 5, "180": 6, "360": 7}
CARD_LINE = "coalesce(credit_limit, greatest(sanction, high_credit))"


def trade_flags(base: DataFrame) -> DataFrame:
    """History flags as plain columns."""
    t = base.withColumn("line", L.to_line("dpd"))
    # the line is read dozens of times below, so it is settled in its own step
    texts = {"dpd_1": "get(dpd, 0)", "dpd_2": "get(dpd, 1)",
             "any_0": L.any_eq(24, 0), "any_valid": L.any_ge(24, 0), "any_valid_12": L.any_ge(12, 0),
             "n_0": L.count_eq(24, 0), "n_valid": L.count_ge(24, 0), "nx_12": L.count_ge(12, 1),
             "n60_6": L.count_ge(6, 3), "n90_6": L.count_ge(6, 4), "n90_12": L.count_ge(12, 4),
             "first_bad": L.first_pos(36, 1), "last_bad": L.last_pos(36, 1), "worst_24": L.worst(24),
             "rep6": "array_max(phist)", "bad_after": L.default_after("m_open")}
    texts.update({f"any_{n}": L.any_ge(24, b) for n, b in LEVELS.items()})
    texts.update({f"n_{n}": L.count_ge(24, LEVELS[n]) for n in ("x", "30", "60", "90")})
    texts.update({f"worst_{n}": L.worst(n) for n in (3, 6, 12, 36)})
    texts.update({f"sat_{n}": L.satisfactory(n) for n in (6, 12, 24)})
    texts.update({f"bad_now_{d}": L.recent_bad(12, b) for d, b in ((30, 2), (60, 3), (90, 4))})
    texts.update({f"live_{i}": f"get(live, {i})" for i in MONTHS})
    cols = {n: F.expr(x) for n, x in texts.items()}
    for n in (3, 6, 9, 12):
        cols[f"mean_bal_{n}"] = H.mean_first("bal", n)
        cols[f"mean_due_{n}"] = H.mean_first("due", n)
    card = F.col("product") == "CC"
    cols.update({"bad_30_6": H.serious_delinquency(card, "dpd", "due", 6, 2), "bad_60_24": H.serious_delinquency(card, "dpd", "due", 24, 3),
                 "bad_90_36": H.serious_delinquency(card, "dpd", "due", 36, 4), "all_current": H.all_current("dpd")})
    t = t.withColumns(cols)
    return t.withColumns({"peak": F.expr(L.peak_pos("worst_24")),
                          "curr_sat": F.expr("case when dpd_1 is null then null when dpd_1 in (-2, 0, 1) then 1 else 0 end")})


# ---- text helpers ----------------------------------------------------------------------------------------
def zero(name, cond, measure="1"):
    if measure == "1":
        return f"cast(sum(case when {cond} then 1 else 0 end) as bigint) as {name}"
    return f"sum(case when {cond} then {measure} else 0 end) as {name}"


def null(name, cond, measure="1", fn="sum"):
    x = f"{fn}(case when {cond} then {measure} end)"
    return (f"cast({x} as bigint)" if measure == "1" else x) + f" as {name}"


def count(name, cond):
    return f"count(case when {cond} then 1 end) as {name}"


def is_(p):
    return f"product = '{p}'"


R = "recent = 1 and "


# ---- families that are plain aggregates ----------------------------------------------------------------------
def trade_counts():
    parts = {"installment": "installment = 1", "revolving": "revolving = 1", "secured": "secured = 1", "unsecured": "unsecured = 1"}
    out = [zero("n_trades", "true"), zero("n_open", "is_open = 1")]
    for n, c in parts.items():
        out += [zero(f"n_{n}", c), zero(f"n_open_{n}", f"{c} and is_open = 1"),
                null(f"n_recent_{n}", R + c), null(f"n_recent_live_{n}", R + c + " and is_open = 1")]
    out += [null("n_recent", R + "true")]
    return out + [zero(f"n_open_{p.lower()}", f"is_open = 1 and {is_(p)}") for p in PRODUCTS]


def trade_balances():
    parts = {"install": "installment = 1", "revolving": "revolving = 1", "secured": "secured = 1", "unsecured": "unsecured = 1"}
    out = []
    for n, c in parts.items():
        for m, e in (("balance", "balance"), ("emi", "emi"), ("sanction", "sanction"), ("high_credit", "hc")):
            out += [zero(f"{n}_{m}", c, e), zero(f"open_{n}_{m}", f"{c} and is_open = 1", e)]
    out += [zero("revolving_line", "revolving = 1", CARD_LINE), zero("open_revolving_line", "revolving = 1 and is_open = 1", CARD_LINE),
            null("available_revolving", "revolving = 1", f"{CARD_LINE} - balance"),
            zero("open_balance", "is_open = 1", "balance"), zero("open_emi", "is_open = 1", "emi"), zero("open_payment", "is_open = 1", "last_payment"),
            zero("open_overdue", "is_open = 1", "overdue"), zero("recent_overdue", "m_report < 4", "overdue"),
            zero("install_overdue", "installment = 1 and m_report < 4", "overdue"), zero("open_recent_overdue", "is_open = 1 and m_report < 4", "overdue"),
            zero("cc_overdue", is_("CC"), "overdue"), zero("non_cc_overdue", "product <> 'CC'", "overdue"),
            zero("delinquent_overdue", "(product = 'CC' and dpd_1 >= 2) or (product <> 'CC' and dpd_1 >= 1)", "overdue"),
            zero("overdue_3m", "report_days <= 90", "overdue"), zero("overdue_6m", "report_days <= 180", "overdue"),
            null("derog_balance", "written_off = 1", "balance"), zero("plbl_balance", "product in ('PL', 'BL') and is_open = 1", "balance"),
            zero("sanction_seasoned", "tenure >= 12", "sanction"),
            null("open_dpdx_balance", "is_open = 1 and any_x = 1", "balance"), null("open_dpdx_emi", "is_open = 1 and any_x = 1", "emi"),
            null("pl_sanction", is_("PL"), "sanction"), null("cc_line", is_("CC") + " and is_open = 1", CARD_LINE),
            null("live_pl_sanction", R + is_("PL") + " and is_open = 1", "sanction"),
            null("recent_balance", R + "true", "balance"), null("recent_secured_balance", R + "secured = 1", "balance"),
            null("recent_unsecured_balance", R + "unsecured = 1", "balance"), null("recent_emi", R + "true", "emi"),
            zero("non_mortgage_sanction", R + "product <> 'HL'", CARD_LINE)]
    for m, e in (("balance", "balance"), ("sanction", "sanction"), ("credit_limit", "credit_limit"), ("high_credit", "hc")):
        out += [f"sum({e}) as total_{m}", f"max({e}) as max_{m}"]
    out.append("max(case when m_report < 4 then overdue else 0 end) as max_recent_overdue")
    for p in PRODUCTS:
        o, n = f"is_open = 1 and {is_(p)}", p.lower()
        out += [null(f"{n}_balance", o, "balance"), null(f"{n}_balance_avg", o, "balance", "avg"), null(f"{n}_emi", o, "emi"),
                null(f"{n}_payment", o, "last_payment"), null(f"{n}_sanction_6m", f"{o} and tenure <= 6", CARD_LINE if p == "CC" else "sanction"),
                zero(f"{n}_open_recent_overdue", f"{o} and m_report < 4", "overdue"), null(f"{n}_derog_balance", f"written_off = 1 and {is_(p)}", "balance")]
    return out


def trade_tenure():
    out = [f"{f}(tenure) as tenure_{f}" for f in ("max", "avg", "min")] + ["cast(sum(tenure) as bigint) as tenure_sum"]
    for n, c in {"open_install": "is_open = 1 and installment = 1", "open_revolving": "is_open = 1 and revolving = 1", "install": "installment = 1",
                 "revolving": "revolving = 1", "open": "is_open = 1", "open_sat": "is_open = 1 and sat_24 = 1", "secured": "secured = 1",
                 "cc": "account_type = 'Credit Card'", "plbl": "product in ('PL', 'BL')"}.items():
        out += [null(f"{n}_tenure_max", c, "tenure", "max"), null(f"{n}_tenure_avg", c, "tenure", "avg")]
    out += [null("months_since_newest_open", "is_open = 1", "tenure", "min"), "min(m_pay) as months_since_payment",
            "cast(sum(case when sanction <= 1000000 then tenure end) as bigint) as tenure_upto_10l"]
    return out + [f"cast(sum(case when {is_(p)} then tenure else 0 end) as bigint) as {p.lower()}_tenure_sum" for p in PRODUCTS]


def opened_last_n():
    out = []
    for w in (1, 3, 6, 12):
        out.append(count(f"n_opened_{w}m", f"tenure <= {w}"))
        out += [count(f"{p.lower()}_n_opened_{w}m", f"tenure <= {w} and {is_(p)}") for p in PRODUCTS]
    for w in (3, 6, 24):
        out.append(null(f"open_balance_{w}m", f"is_open = 1 and tenure <= {w}", "balance"))
        out += [null(f"{p.lower()}_open_balance_{w}m", f"is_open = 1 and tenure <= {w} and {is_(p)}", "balance") for p in PRODUCTS]
    out.append(zero("n_trades_24m", "tenure <= 24"))
    out += [zero(f"{p.lower()}_n_trades_24m", f"tenure <= 24 and {is_(p)}") for p in PRODUCTS]
    for n, d in DAY_WINDOWS.items():
        out.append(null(f"n_opened_days_{n}", f"vintage_days <= {d}"))
        for p in FOCUS:
            ticket = "credit_limit" if p == "CC" else "greatest(sanction, high_credit)"
            out += [null(f"{p.lower()}_n_opened_days_{n}", f"vintage_days <= {d} and {is_(p)}"),
                    null(f"live_{p.lower()}_balance_days_{n}", f"is_open = 1 and vintage_days <= {d} and {is_(p)}", "balance")]
            out += [null(f"{p.lower()}_n_opened_days_{n}_{t}", f"vintage_days <= {d} and {is_(p)} and {ticket} <= {a}")
                    for t, a in TICKETS.items() if not (p == "CC" and t == "5l")]
    out += [zero("pl_opened_12m_30k_10l", "product = 'PL' and m_open between 1 and 12 and sanction between 30000 and 1000000"),
            zero("hl_gt_15k_36m", "account_type = 'Housing Loan' and sanction > 15000 and tenure <= 36"),
            zero("pl_opened_12m", "product = 'PL' and tenure <= 12")]
    return out


def satisfactory():
    out = ["cast(sum(curr_sat) as bigint) as n_satisfactory_now", "cast(sum(sat_24) as bigint) as n_satisfactory", zero("n_unsatisfactory", "sat_24 = 0")]
    for n in (6, 12, 24):
        for name, v in (("sat", 1), ("unsat", 0)):
            out += [null(f"{name}_balance_{n}m", f"sat_{n} = {v}", "balance"), null(f"{name}_balance_{n}m_avg", f"sat_{n} = {v}", "balance", "avg")]
    for name, v in (("sat", 1), ("unsat", 0)):
        due = "case when m_report < 4 then overdue else 0 end"
        out += [null(f"{name}_overdue", f"sat_24 = {v}", due), null(f"{name}_overdue_avg", f"sat_24 = {v}", due, "avg")]
    return out + [null("open_sat_balance", "is_open = 1 and sat_24 = 1", "balance"), null("open_sat_balance_avg", "is_open = 1 and sat_24 = 1", "balance", "avg")]


def delinquency_counts():
    out = [f"cast(sum(any_{n}) as bigint) as n_dpd_{n}" for n in ("0", "x", "30", "60", "90", "valid")]
    out += [f"cast(sum(n_{n}) as bigint) as months_dpd_{n}" for n in ("0", "x", "30", "60", "90", "valid")]
    for n in ("0", "x", "30", "60", "90"):
        out += [f"sum(any_{n}) / nullif(sum(any_valid), 0) as frac_dpd_{n}", f"sum(n_{n}) / nullif(sum(n_valid), 0) as frac_months_dpd_{n}"]
    for d, b in ((30, 1), (60, 2), (90, 3)):
        out.append(null(f"n_open_curr_{d}", f"is_open = 1 and dpd_1 > {b}"))
        out += [null(f"{p.lower()}_n_open_curr_{d}", f"is_open = 1 and dpd_1 > {b} and {is_(p)}") for p in ("BL", "PL", "CC", "TW")]
    # "any" flags: the largest value over accounts, although such columns are often called counts
    out += [f"max(case when recent = 1 then any_{n} end) as any_dpd_{n}" for n in ["0"] + list(LEVELS)]
    out += ["max(dpd_1) as worst_now", "max(worst_3) as worst_3m", "max(worst_6) as worst_6m", "max(worst_12) as worst_12m",
            null("cc_worst_ever", is_("CC"), "worst_36", "max"), "max(case when n90_12 > 0 then 1 else 0 end) as ever_90_12m",
            "min(m_start + first_bad) as months_since_first_bad", "max(m_start + last_bad) as months_since_last_bad",
            "max(m_start + peak) as months_since_worst", "max(nx_12) as most_missed_12m",
            "max(case when secured = 1 and n60_6 >= 1 then 1 else 0 end) as sec_60_6m", "max(case when secured = 0 and n60_6 >= 1 then 1 else 0 end) as unsec_60_6m",
            "max(case when secured = 1 then n90_6 else 0 end) as sec_n90_6m", "max(case when secured = 0 then n90_6 else 0 end) as unsec_n90_6m",
            "cast(sum(all_current) as bigint) as n_all_current", "max(all_current) as any_all_current"]
    live = {"": "true", "pl_": is_("PL"), "cd_": is_("CD"), "sec_": "secured = 1", "unsec_": "secured = 0"}
    for n, c in live.items():
        out += [count(f"n_live_{n}bad_6m", f"live_0 = 1 and rep6 > 0 and {c}"), null(f"worst_live_{n}bad_6m", f"live_0 = 1 and rep6 > 0 and {c}", "rep6", "max")]
    return out + [zero("n_negative_balance", "balance < 0"), "min(m_start) as newest_report"]


def write_off():
    out = ["max(written_off) as any_written_off", "cast(sum(written_off) as bigint) as n_written_off"]
    out += [zero(f"{p.lower()}_n_written_off", f"written_off = 1 and {is_(p)}") for p in ("HL", "AL", "CC", "PL", "BL", "CD")]
    return out + [zero("sec_n_written_off", "written_off = 1 and secured = 1"), zero("unsec_n_written_off", "written_off = 1 and unsecured = 1")]


def hanging_trades():
    out = ["min(case when report_days > 365 then 1 else 0 end) as all_hanging"]
    return out + [f"min(case when {is_(p)} and report_days > 365 then 1 else 0 end) as all_hanging_{p.lower()}" for p in FOCUS]


def average_balance_overdue():
    out = []
    groups = {p.lower(): is_(p) for p in FOCUS}
    groups.update({"live": "is_open = 1", "install": "installment = 1", "live_install": "installment = 1 and is_open = 1", "revolving": "revolving = 1",
                   "live_revolving": "revolving = 1 and is_open = 1", "secured": "secured = 1", "live_secured": "secured = 1 and is_open = 1",
                   "unsecured": "secured = 0", "live_unsecured": "secured = 0 and is_open = 1"})
    for n, d in ((3, 90), (6, 180), (9, 270), (12, 365)):
        for g, c in {**groups, "all": f"report_days <= {d}"}.items():
            out.append(null(f"{g}_mean_balance_{n}m", c, f"mean_bal_{n}"))
            if g == "all" or g.upper() in FOCUS:
                out.append(null(f"{g}_mean_overdue_{n}m", c, f"mean_due_{n}"))
        out.append(zero(f"overdue_reported_{n}m", f"report_days <= {d}", "overdue"))
    return out


def delinquent_exposure():
    out = []
    for d in (30, 60, 90):
        bad = f"recent = 1 and bad_now_{d} = 1"
        out += [null(f"bad_{d}_balance", bad, "balance"), null(f"cc_live_bad_{d}_balance", f"{bad} and is_open = 1 and product = 'CC'", "balance"),
                null(f"pl_live_bad_{d}_balance", f"{bad} and is_open = 1 and product = 'PL'", "balance")]
        for n, w in DAY_WINDOWS.items():
            for g, c in (("", "true"), ("cc_", is_("CC")), ("pl_", is_("PL"))):
                out.append(f"cast(sum(case when recent = 1 then case when bad_now_{d} = 1 and vintage_days <= {w} and {c} then 1 else 0 end end) as bigint) as {g}n_bad_{d}_opened_{n}")
        out.append(f"case when coalesce(sum(case when recent = 1 then balance end), 0) = 0 then -1 else sum(case when {bad} then balance end) / sum(case when recent = 1 then balance end) end as share_bad_{d}")
        for g, c in (("cc", is_("CC")), ("pl", is_("PL"))):
            tot = f"sum(case when recent = 1 and is_open = 1 and {c} then balance end)"
            out.append(f"case when coalesce({tot}, 0) = 0 then -1 else sum(case when {bad} and is_open = 1 and {c} then balance end) / {tot} end as {g}_share_live_bad_{d}")
    return out


def lender_mix(classes=tuple(V.LENDER_CLASSES)):
    out = [zero(f"n_{s}_{p.lower()}_{c.lower()}", f"is_open = {v} and {is_(p)} and lender = '{c}'")
           for s, v in (("open", 1), ("closed", 0)) for p in ("CC", "PL") for c in classes]
    return out + [zero(f"n_{s}_pl_{g}", f"is_open = {v} and product = 'PL' and secured = {b}")
                  for s, v in (("open", 1), ("closed", 0)) for g, b in (("sec", 1), ("unsec", 0))]


def satisfaction_ratio():
    out = []
    for s, v in (("open", 1), ("closed", 0)):
        for g, b in (("sec", 1), ("unsec", 0)):
            good = f"sum(case when is_open = {v} and secured = {b} and written_off = 0 and dpd_1 in (0, -1) then 1 else 0 end)"
            pl = f"sum(case when is_open = {v} and secured = {b} and product = 'PL' then 1 else 0 end)"
            out += [f"cast({good} as bigint) as n_good_{s}_{g}", f"case when {pl} > 0 then {good} / {pl} end as ratio_good_{s}_pl_{g}"]
    return out


# product: how its top is taken, of what, over which accounts, and from which amount on a file counts as thick
THICK_FROM = {"CC": ("sum", CARD_LINE, "recent = 1 and is_open = 1", 75000), "PL": ("sum", "sanction", "recent = 1 and is_open = 1", 200000),
              "AL": ("max", "sanction", "true", 200000), "HL": ("max", "sanction", "true", 1000000)}
THICK_MONTHS, THIN_MONTHS = 12, 6


def thickness_indicator():
    reached, missed = [], []
    for product, (fn, measure, scope, limit) in THICK_FROM.items():
        top = f"{fn}(case when {scope} and {is_(product)} then {measure} end)"
        reached.append(f"{top} >= {limit}")
        missed.append(f"{top} < {limit}")
    age = "max(m_open)"
    rules = {"thick": f"{age} >= {THICK_MONTHS} and ({' or '.join(reached)})",
             "thin": f"{age} between {THIN_MONTHS} and {THICK_MONTHS - 1} or ({' and '.join(missed)})"}
    return ["case " + " ".join(f"when {test} then '{name}'" for name, test in rules.items()) + f" else 'less_than_{THIN_MONTHS}' end as thickness"]


# how full a loan or card is, for the shares of those above a limit
FILLED = {"pl": (R + is_("PL"), "try_divide(balance, sanction)"), "cc": (R + is_("CC"), f"try_divide(balance, {CARD_LINE})")}
FILLED_ABOVE = (25, 50, 75)
LATE = ("30", "60", "90")


def utilisation_parts():
    """The sums and counts that the ratios are made of."""
    out = trade_balances() + [null("open_sat_balance", "is_open = 1 and sat_24 = 1", "balance"), "count(1) as n_trades", zero("n_dpd_valid", "any_valid = 1")]
    out += [null(f"open_balance_{w}m", f"is_open = 1 and tenure <= {w}", "balance") for w in (3, 6, 24)]
    out += [zero(f"n_dpd_{d}", f"any_{d} = 1") for d in LATE]
    for n, (mine, full) in FILLED.items():
        out += [zero(f"n_{n}", mine), *[zero(f"n_{n}_above_{c}", f"{mine} and {full} > {c / 100}") for c in FILLED_ABOVE]]
    return out


# (name, numerator, denominator, answers of safe_ratio where they are not its defaults) over utilisation_parts
_DEN_FIRST = dict(den_first=True, num_null=None)
RATIOS = (
    ("emi_of_dpdx_balance", "open_dpdx_emi", "open_dpdx_balance", {}),
    ("emi_of_balance", "open_emi", "open_balance", {}),
    ("recent_emi_of_balance", "recent_emi", "recent_balance", {}),
    ("overdue_of_balance", "recent_overdue", "total_balance", {}),
    ("available_of_limit", "available_revolving", "total_credit_limit", {}),
    ("revolving_util", "revolving_balance", "revolving_line", {}),
    ("open_revolving_util", "open_revolving_balance", "open_revolving_line", {}),
    ("install_unpaid", "install_balance", "install_sanction", {}),
    ("open_install_unpaid", "open_install_balance", "open_install_sanction", {}),
    ("secured_of_unsecured", "secured_balance", "unsecured_balance", {}),
    ("recent_secured_of_unsecured", "recent_secured_balance", "recent_unsecured_balance", {}),
    ("share_secured", "recent_secured_balance", "recent_balance", dict(den_first=True, num_null=0, den_null=-1, den_zero=-1)),
    ("share_unsecured", "recent_unsecured_balance", "recent_balance", dict(den_first=True, num_null=0, den_null=-1, den_zero=-1)),
    ("cc_util", "cc_balance", "cc_line", dict(_DEN_FIRST, den_null=-1, den_zero=-2)),
    ("pl_runoff", "pl_sanction - pl_balance", "pl_sanction", dict(_DEN_FIRST, den_null=-1, den_zero=-2)),
    ("open_sat_of_24m", "open_sat_balance", "open_balance_24m", {}),
    ("open_part_3m", "open_balance_3m", "open_balance", {}),
    ("open_part_6m", "open_balance_6m", "open_balance", {}),
    *[(f"share_{n}_above_{c}", f"n_{n}_above_{c}", f"n_{n}", dict(den_first=True, den_zero=-1)) for n in FILLED for c in FILLED_ABOVE],
    *[(f"share_trades_{d}", f"n_dpd_{d}", "if(n_dpd_valid > 0, n_trades, 0)", dict(den_first=True, den_zero=-1)) for d in LATE],
    ("live_pl_paid", "live_pl_sanction - pl_balance", "live_pl_sanction", dict(_DEN_FIRST, den_null=-2, den_zero=-3, den_below=(1000, -1))),
)


def utilisation_ratios():
    """Columns over those of utilisation_parts."""
    out = [safe_ratio(F.expr(num), F.expr(den), **answers).alias(name) for name, num, den, answers in RATIOS]
    high_use = (F.col("cc_line") > 0) & (F.try_divide(F.col("cc_balance"), F.col("cc_line")) >= 0.85)
    return [*out, F.coalesce(F.col("open_revolving_balance") * 0.05, F.lit(-1)).alias("five_percent_of_revolving"),
            F.coalesce(high_use.cast("int"), F.lit(0)).alias("cc_util_gt_85"),
            F.coalesce((F.col("recent_overdue") >= 1000).cast("int"), F.lit(0)).alias("overdue_gt_1k")]


GROUPS = {"long": "long_term = 1", "short": "short_term = 1", "secured": "secured = 1", "unsecured": "unsecured = 1", "installment": "installment = 1", "revolving": "revolving = 1"}


def concurrent_loans():
    out = [f"cast(sum(live_{i}) as bigint) as live_m{i}" for i in MONTHS]
    out += [zero(f"{g}_live_m{i}", f"live_{i} = 1 and {c}") for i in (0, 1, 6) for g, c in GROUPS.items()]
    out += [zero(f"{g}_pl_live_m{i}", f"live_{i} = 1 and {c} and product = 'PL'") for i in (0, 1, 6) for g, c in GROUPS.items() if g not in ("installment", "revolving")]
    out += [f"sum(live_{i} * emi_new) as _emi_m{i}" for i in MONTHS]
    return out + [zero("live_m0_m2", "live_0 + live_1 + live_2 > 0"), zero("live_m6_m8", "live_6 + live_7 + live_8 > 0")]


LIVE_CLASSES = ("", *[f"{g}_{p}" for g in ("long", "short", "secured", "unsecured") for p in ("", "pl_")])


def concurrent_ratios():
    """Columns over those of concurrent_loans: now against half a year ago, against the peak, and instalments a loan."""
    out = []
    for g in LIVE_CLASSES:
        now, then = f"{g}live_m0", f"{g}live_m6"
        out += [null_safe_diff(now, then).alias(f"{g}live_diff"),
                safe_ratio(now, then, num_null=0, den_null="num", den_zero="num").alias(f"{g}live_ratio")]
    peak = F.greatest(*[f"live_m{i}" for i in MONTHS])
    out += [(peak - F.col(f"live_m{i}")).alias(f"live_below_peak_m{i}") for i in (0, 1)]
    out += [peak.alias("live_peak"), (F.col("live_m0_m2") - F.col("live_m6_m8")).alias("live_quarter_diff")]
    mean = {i: safe_ratio(f"_emi_m{i}", f"live_m{i}", den_first=True, num_null=None, den_null=None, den_zero=0) for i in (0, 1, 3, 6, 12)}
    return [*out, mean[0].alias("emi_per_live_m0"), *[(mean[0] - mean[i]).alias(f"emi_per_live_diff_m{i}") for i in mean if i]]


PLAIN = {f.__name__: f for f in (trade_counts, trade_balances, trade_tenure, opened_last_n, satisfactory, delinquency_counts, write_off,
                                 hanging_trades, average_balance_overdue, delinquent_exposure, lender_mix, satisfaction_ratio, thickness_indicator)}


def where_dealt(work):
    """A family on accounts dealt out by key (see relational.dealt). Its `rows` is the family on accounts as they are."""
    @wraps(work)
    def run(t, key="member"):
        return dealt(t, key_names(key), lambda rows: work(rows, key))
    run.rows = work
    return run


def family(t: DataFrame, name, key="member") -> DataFrame:
    """One plain family; key is a name or several (member, or member and month)."""
    return dealt(t, key_names(key), lambda rows: rows.groupBy(*key_names(key)).agg(*exprs(PLAIN[name]())))


@where_dealt
def utilisation(t, key="member"):
    g = t.groupBy(*key_names(key)).agg(*exprs(utilisation_parts()))
    return g.select(*key_names(key), *utilisation_ratios())


@where_dealt
def concurrency(t, key="member"):
    g = t.groupBy(*key_names(key)).agg(*exprs(concurrent_loans()))
    return g.select(*[c for c in g.columns if not c.startswith("_")], *concurrent_ratios())


# ---- families aggregated long ------------------------------------------------------------------------------------
EMI_TYPES = {"all": "true", "lt": "long_term = 1", "st": "short_term = 1", "secure": "secured = 1", "unsecure": "unsecured = 1",
             "revolve": "revolving = 1", "install": "installment = 1", **{p.lower(): is_(p) for p in ("CD", "AL", "BL", "PL", "HL", "CC")},
             "pl_short": "product = 'PL' and short_term = 1", "pl_long": "product = 'PL' and long_term = 1"}
EMI_VINTAGES = {"1": "m_open <= 1", "6": "m_open <= 6", "12": "m_open <= 12", "24": "m_open <= 24", "48": "m_open <= 48", "any": "true"}
LATE_VINTAGES = ("24", "48", "any")
PATH_TYPES = ("all", "lt", "st", "secure")


def by_type(t: DataFrame, types, aggs, key="member") -> DataFrame:
    """One row per account and type it belongs to, aggregated to (key, type)."""
    label = "array_compact(array(" + ", ".join(f"case when {c} then '{n}' end" for n, c in types.items()) + "))"
    long = t.withColumn("type", F.expr(f"explode({label})"))
    return long.groupBy(*key_names(key), "type").agg(*exprs(aggs))


def spread(long: DataFrame, types, keep=None, key="member", fill=None) -> DataFrame:
    """(key, type) rows to one row per key with <type>_<measure> columns. `keep` lists (type, measure);
    with `fill` (True, or a test on the name) a type the key does not have counts as 0."""
    keys = key_names(key)
    measures = {c: kind for c, kind in long.dtypes if c not in (*keys, "type")}
    # one array a type goes through the pivot, and not one column for each measure (numbers below 2**53 are exact)
    packed = long.select(*keys, "type", F.array(*[F.col(f"`{m}`").cast("double") for m in measures]).alias("_all"))
    wide = packed.groupBy(*keys).pivot("type", list(types)).agg(F.first("_all"))
    filled = (fill if callable(fill) else lambda n: True) if fill is not None else lambda n: False
    out = []
    for n in types:
        for i, (m, kind) in enumerate(measures.items()):
            if keep is None or keep(n, m):
                x = F.get(F.col(f"`{n}`"), i).cast(kind)
                out.append((F.coalesce(x, F.lit(0)) if filled(f"{n}_{m}") else x).alias(f"{n}_{m}"))
    return wide.select(*keys, *out)


def exposure_long(t, key="member"):
    e = {i: f"live_{i} * emi_new" for i in MONTHS}
    out = [f"{f}(case when {c} then {e[0]} else 0 end) as {f}_emi_m0_{v}" for f in ("sum", "max") for v, c in EMI_VINTAGES.items()]
    out += [f"sum({e[i]}) as sum_emi_m{i}_any" for i in MONTHS if i]
    for v in LATE_VINTAGES:
        c = EMI_VINTAGES[v]
        out += [f"sum(case when {c} then ({e[0]}) - ({e[i]}) else 0 end) as emi_diff_m0_m{i}_{v}" for i in (3, 6, 12)]
        out += [f"sum(case when {c} then {' + '.join(e[i] for i in range(n))} else 0 end) as emi_total_m0_m{n - 1}_{v}" for n in (3, 6, 12)]
    return by_type(t, EMI_TYPES, out, key)


def _exposure_keep(n, m):
    path = m.startswith("sum_emi_m") and not m.startswith("sum_emi_m0")
    return not path or n in PATH_TYPES


@where_dealt
def exposure_emi(t, key="member") -> DataFrame:
    """Instalments per month, type and vintage; changes and totals over 3, 6, 12 months."""
    return spread(exposure_long(t, key), EMI_TYPES, _exposure_keep, key, True)


@where_dealt
def exposure_ratios(t, key="member") -> DataFrame:
    """Each type's part of the whole, and how the recent quarter compares with the one half a year before.

    Ratios are taken on the (member, type) rows, next to the member's "all" row (a member has at most
    one row per type), and spread afterwards.
    """
    long = exposure_long(t, key)
    span = [(m, v) for v in LATE_VINTAGES for m in (3, 6, 12)]
    keys = key_names(key)
    whole = f"over (partition by {', '.join(keys)})"
    of_all = "max(case when type = 'all' then {} end) " + whole
    x = long.selectExpr("*", *[f"{of_all.format(f'emi_diff_m0_m{m}_{v}')} as _d{m}_{v}" for m, v in span],
                        *[f"{of_all.format(f'emi_total_m0_m{m - 1}_{v}')} as _t{m}_{v}" for m, v in span])
    path = ["sum_emi_m0_any"] + [f"sum_emi_m{i}_any" for i in MONTHS if i]
    new = " + ".join(f"{c} / 3" for c in path[0:3])
    old = " + ".join(f"{c} / 3" for c in path[6:9])
    texts = []
    for m, v in span:
        a, b = f"emi_diff_m0_m{m}_{v}", f"_d{m}_{v}"
        texts.append(f"case when {a} is null then 0 when {b} is null or {b} = 0 then {a} else {a} / {b} end as ratio_{a}")
        texts.append(ratio_text(f"emi_total_m0_m{m - 1}_{v}", f"_t{m}_{v}") + f" as share_emi_total_m0_m{m - 1}_{v}")
        texts.append(f"_t{m}_{v} as whole_m{m - 1}_{v}")
    texts += [f"{new} as emi_mean_m0_m2", f"{old} as emi_mean_m6_m8", f"({new}) - ({old}) as emi_mean_diff",
              f"case when {old} = 0 then 0 else ({new}) / ({old}) end as emi_mean_ratio"]
    texts += [f"greatest({', '.join(path)}) - {path[i]} as emi_below_peak_m{i}" for i in (0, 1)]
    r = x.selectExpr(*keys, "type", *texts)

    def keep(n, m):
        if m.startswith("emi_mean"):
            return n in PATH_TYPES
        return (n == "all") == m.startswith(("whole", "emi_below"))

    wide = spread(r, EMI_TYPES, keep, key)
    out = []
    for c in wide.columns:
        if "_share_emi_total_" in c:
            part = c.split("_share_emi_total_m0_")[1]
            out.append(f"coalesce({c}, case when all_whole_{part} = 0 then -3 else 0 end) as {c}")
        elif c not in keys and not c.startswith("all_whole"):
            out.append(f"coalesce({c}, 0) as {c}")
    return wide.selectExpr(*keys, *out)


TENURE_TYPES = {"all": "true", "long": "long_term = 1", "short": "short_term = 1", "secured": "secured = 1", "unsecured": "unsecured = 1",
                "installment": "installment = 1", "revolving": "revolving = 1", **{p.lower(): is_(p) for p in ("AL", "BL", "PL", "HL", "CC", "CD")}}
DURATIONS = (1, 6, 12, 24, 48)


def tenure_texts(prefix=""):
    out = []
    for state, s in (("", "true"), ("live_", "live_0 = 1")):
        for d in (None,) + DURATIONS:
            c = s + (f" and loan_tenure <= {d}" if d else "")
            name = f"{state}tenure" + (f"_upto_{d}" if d else "")
            out += [count(f"{name}_n", f"{c} and loan_tenure is not null"), null(f"{name}_max", c, "loan_tenure", "max"), null(f"{name}_avg", c, "loan_tenure", "avg")]
            if d and not state:
                out += [count(f"{name}_opened_{v}_n", f"{c} and m_open <= {v}") for v in DURATIONS if v > d]
    return out


@where_dealt
def tenure_profile(t, key="member") -> DataFrame:
    """Tenure by type, state and duration, with opening vintages."""
    return spread(by_type(t, TENURE_TYPES, tenure_texts(), key), TENURE_TYPES, None, key, lambda n: n.endswith("_n"))


def ticket_texts():
    out = []
    for w in DURATIONS:
        for how, c in (("tenure", f"loan_tenure <= {w}"), ("vintage", f"m_open <= {w}")):
            out += [f"max(case when {c} then limit_amount else 0 end) as max_sanction_{how}_{w}", f"min(case when {c} then limit_amount else 0 end) as min_sanction_{how}_{w}",
                    f"max(case when {c} then balance else 0 end) as max_balance_{how}_{w}", f"sum(case when {c} then balance else 0 end) as sum_balance_{how}_{w}"]
    return out


@where_dealt
def ticket_profile(t, key="member") -> DataFrame:
    """Sanction and balance by tenure and vintage for the main products. A minimum over a member's
    accounts is 0 as soon as one of them is of another product."""
    types, keys = {p.lower(): is_(p) for p in MAIN_PRODUCTS}, key_names(key)
    long = by_type(t, {**types, "every": "true"}, ticket_texts() + ["count(1) as n"], key)
    wide = spread(long, [*types, "every"], None, key)
    out = []
    for p in types:
        for c in long.columns:
            if c in (*keys, "type", "n"):
                continue
            x = f"coalesce({p}_{c}, 0)"
            out.append(f"case when {p}_n = every_n then {x} else 0 end as {p}_{c}" if c.startswith("min_") else f"{x} as {p}_{c}")
    return wide.selectExpr(*keys, *out)


@where_dealt
def latest_profile(t, key="member") -> DataFrame:
    """Newest account of each main product: balance, sanction, status, age (0 when there is none)."""
    types, keys = {p.lower(): is_(p) for p in MAIN_PRODUCTS}, key_names(key)
    newest = "max(case when {} then struct(opened, limit_amount, balance, live_0 as status, m_open as vintage) end)"
    long = by_type(t, types, [newest.format("true") + " as s"], key)
    long = long.selectExpr(*keys, "type", "s.balance as balance", "s.limit_amount as sanction", "s.status as status", "s.vintage as vintage")
    out = spread(long, types, None, key, True)
    return t.select(*keys).distinct().join(out, keys, "left").na.fill(0, [c for c in out.columns if c not in keys])


FLOW_TYPES = {"all": "true", **GROUPS, "pl_short": "product = 'PL' and short_term = 1", "pl_long": "product = 'PL' and long_term = 1",
              **{p.lower(): is_(p) for p in MAIN_PRODUCTS}}


def flow_texts():
    out = []
    for w in DURATIONS:
        out += [null(f"opened_{w}m", f"m_open <= {w}"), null(f"live_opened_{w}m", f"m_open <= {w} and live_0 = 1"), null(f"closed_{w}m", f"m_acct_close <= {w}")]
    return out


@where_dealt
def account_flow(t, key="member") -> DataFrame:
    """Accounts opened, opened and still live, and closed, by window and type (null when none)."""
    return spread(by_type(t, FLOW_TYPES, flow_texts(), key), FLOW_TYPES, None, key)


# ---- families with their own shape -------------------------------------------------------------------------------
def top_trade_snapshots(t, key="member"):
    """Amounts of the account with the largest line, the largest balance, the oldest and the newest one per
    product (ties are added up); recent accounts only."""
    specs = []
    for p, line in (("PL", "greatest(sanction, high_credit)"), ("HL", "greatest(sanction, high_credit)"), ("CC", "credit_limit")):
        c, n = f"recent = 1 and {is_(p)}", p.lower()
        amount, bal, age = (F.expr(f"case when {c} then {x} end") for x in (line, "balance", "vintage_days"))
        for name, m, how in (("top_line", amount, "max"), ("top_balance", bal, "max"), ("oldest", age, "max"), ("newest", age, "min")):
            specs += [(f"{name}_{n}_line", m, how, amount), (f"{name}_{n}_balance", m, how, bal)]
    keys = key_names(key)
    return t.select(*keys).distinct().join(sum_at_extreme(t, keys, specs), keys, "left")


def balance_trend(t, key="member"):
    """Rises, falls and the 6-to-12-month ratio of monthly totals: secured, unsecured, business, other."""
    parts = None
    for name, cond in (("sec", "secured = 1"), ("bl", "recent = 1 and product = 'BL'")):
        other = {"sec": "unsec", "bl": "non_bl"}[name]
        m = monthly_totals(t, key, "bal", F.expr(f"case when {cond} then '{name}' else '{other}' end"))
        parts = m if parts is None else parts.unionByName(m)
    cols = []
    for n in (12, 24, 36):
        cols += [H.rises("totals", n).alias(f"rise_{n}m"), H.falls("totals", n).alias(f"fall_{n}m")]
    long = parts.select(*key_names(key), F.col("part").alias("type"), *cols, H.period_ratio("totals").alias("ratio_6_12"))
    return spread(long, ["sec", "unsec", "bl", "non_bl"], None, key)


def card_behaviour(t, key="member"):
    cc = "recent = 1 and product = 'CC'"
    aggs = [f"max(case when {cc} then get(bal, 0) end) as top_card_balance", f"sum(case when {cc} then get(bal, 0) end) as card_balance",
            f"sum(case when {cc} then hc end) as card_line", f"max(case when {cc} then 1 end) as has_card"]
    aggs += [f"sum(case when {cc} then get(bal, {i - 1}) end) as _b{i}" for i in range(1, 13)]
    keys = key_names(key)
    g = t.groupBy(*keys).agg(*exprs(aggs))
    months = [f"_b{i}" for i in range(1, 13)]
    g = g.withColumns({"card_peak_balance": F.greatest(*months), "card_peak_month": H.argmax_slot(months),
                       "card_util": F.expr("case when card_line is null then -2 when card_line <= 0 then -1 else card_balance / card_line end")})
    newest = t.filter(cc).groupBy(*keys).agg(F.expr("max(struct(-vintage_days as a, dpd_2 as d)).d as newest_card_dpd"))
    return g.drop(*months).join(newest, keys, "left")


def reopen_counts(t, key="member", windows=(1, 3, 6, 12)):
    keys = key_names(key)
    x = t.select(*keys, "product", "account", "opened", "closed", "recent")
    r = reopened(x, [*keys, "product"], "opened", "closed", "account", windows)
    aggs = []
    for w in windows:
        aggs.append(f"cast(sum(case when recent = 1 then reopen_{w}m end) as bigint) as reopened_{w}m")
        aggs += [zero(f"{p.lower()}_reopened_{w}m", f"reopen_{w}m = 1 and {is_(p)}") for p in FOCUS]
    return r.groupBy(*keys).agg(*exprs(aggs))


def policy_exclusions(t, key="member", score="score", status="wo_status", amounts=("write_off_amt", "overdue")):
    """Reasons to leave a member out. A written-off date is the last report of a written-off account; the
    account-level "opened after it and went bad" rule is answered from three extremes, without joining
    the member's date back to its accounts."""
    wo = TC.written_off_status(status, *amounts)
    x = t.withColumn("_wo", wo).withColumn("_late_bad", F.expr("case when months_between(as_of, opened) >= 12 and bad_after then 1 else 0 end"))
    g = x.groupBy(*key_names(key)).agg(*exprs([
        f"max({score}) as _score", "max(bad_30_6) as bad_30_6m", "max(bad_60_24) as bad_60_24m", "max(bad_90_36) as bad_90_36m",
        "max(case when _wo = 1 then reported end) as _wo_date", "max(as_of) as _as_of", "max(vintage_days) as vintage_days",
        "max(case when _late_bad = 0 then 1 else 0 end) as _any_good", "min(case when _late_bad = 1 then opened end) as _first_bad_open"]))
    gap = "((year(_as_of) - year(_wo_date)) * 12 + month(_as_of) - month(_wo_date))"
    return g.selectExpr(
        *key_names(key), "case when _score < 600 then 1 else 0 end as low_score", "bad_30_6m", "bad_60_24m", "bad_90_36m",
        f"case when {gap} <= 12 then 1 else 0 end as written_off_12m", f"case when {gap} > 12 then 1 else 0 end as written_off_before",
        "case when _any_good = 1 or _wo_date is null or _first_bad_open <= _wo_date then 1 else 0 end as good_after_write_off",
        "case when vintage_days < 180 then 1 else 0 end as short_vintage")


def product_presence(t, key="member"):
    keys = key_names(key)
    kinds = t.groupBy(*keys, "account_type").agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_types"))
    has = t.groupBy(*keys).agg(*exprs([f"max(case when recent = 1 and {is_(p)} then 1 end) as has_{p.lower()}" for p in ("PL", "HL", "CC")]
                                    + ["max(case when product = 'HL' and lower(lender) not like '%hfc%' then 1 else 0 end) as external_hl"]))
    ends = first_last(t, keys, "opened", "limit_amount", "product", "first_product", "latest_product")
    return kinds.join(has, keys).join(ends, keys)


OWN = {f.__name__: f for f in (exposure_emi, exposure_ratios, tenure_profile, ticket_profile, latest_profile, account_flow, top_trade_snapshots,
                               balance_trend, card_behaviour, reopen_counts, policy_exclusions, product_presence)}
OWN["utilisation_ratios"], OWN["concurrent_loans"] = utilisation, concurrency


# columns of different meaning that two families give the same name: the name they have in trade_features
OTHER_NAMES = {
    "latest_profile": {c: f"{c}_latest" for c in ("pl_balance", "gl_balance", "tw_balance", "bl_balance", "hl_balance", "al_balance", "cd_balance", "pl_sanction")},
    "tenure_profile": {f"{g}_tenure_{m}": f"{g}_loan_tenure_{m}" for g in ("revolving", "secured", "cc") for m in ("max", "avg")},
    "account_flow": {"pl_opened_12m": "pl_flow_opened_12m"},
}


def side_by_side(parts, keys, how="left") -> DataFrame:
    """Frames with the same keys as one. Each goes through the joins as one array of numbers next to its other columns, so
    that no join lists thousands of columns (numbers below 2**53 are exact)."""
    numbers = ("int", "bigint", "double")
    joined, out = None, []
    for i, p in enumerate(parts):
        kinds = {c: kind for c, kind in p.dtypes if c not in keys}
        packed = [c for c, kind in kinds.items() if kind in numbers]
        p = p.select(*keys, *[c for c in kinds if c not in packed], F.array(*[F.col(c).cast("double") for c in packed]).alias(f"_part{i}"))
        joined = p if joined is None else joined.join(p, keys, how)
        place = {c: n for n, c in enumerate(packed)}
        out += [F.get(f"_part{i}", F.lit(place[c])).cast(kind).alias(c) if c in place else F.col(c) for c, kind in kinds.items()]
    return joined.select(*keys, *out)


def trade_features(t: DataFrame, families=None, key="member") -> DataFrame:
    """Any set of families on one row per member; the plain ones share one aggregate. The account frame is
    computed once. Two columns of one name are an error."""
    names, keys = list(families or [*PLAIN, *OWN]), key_names(key)
    t = cut_lineage(t)
    plain = [x for n in names if n in PLAIN for x in PLAIN[n]()]
    moved = [n for n in names if n in OWN and hasattr(OWN[n], "rows")]
    taken = {}

    def part(n, p):
        p = p.withColumnsRenamed(OTHER_NAMES.get(n, {}))
        for c in p.columns:
            if c not in keys and taken.setdefault(c, n) != n:
                raise ValueError(f"{n} and {taken[c]} both have a column {c}")
        return p

    def work(rows):
        parts = [part("plain families", rows.groupBy(*keys).agg(*exprs(plain)))] if plain else []
        return parts + [part(n, OWN[n].rows(rows, key)) for n in moved]

    parts = {n: part(n, OWN[n](t, key)) for n in names if n in OWN and n not in moved}
    near = dealt(t, keys, lambda rows: side_by_side(work(rows), keys)) if plain or moved else None
    first, *rest = ([near] if near is not None else []) + list(parts.values())
    return reduce(lambda a, b: a.join(b, keys, "left"), rest, first)
