"""SQL of the account families, written for themselves: nothing here is taken from the operators' texts.

Each function gives the select items over `flags`, one row per account. A filter clause says which accounts count;
`n0`, `s0` give 0 where none does, `n`, `s` null.
"""

from lendgrain.functions import fixed_values as V

CODES = {"pl": "PL", "cc": "CC", "cd": "CD", "hl": "HL", "lap": "LAP", "bl": "BL"}
LINE = "ifnull(credit_limit, greatest(sanction, high_credit))"
DAYS = {3: 90, 6: 180, 9: 270, 12: 365}


def n0(name, where="true"):
    return f"count(*) filter (where {where}) as {name}"


def n(name, where="true"):
    return f"nullif(count(*) filter (where {where}), 0) as {name}"


def s0(name, what, where):
    return f"sum(if({where}, {what}, 0)) as {name}"


def s(name, what, where="true", how="sum"):
    return f"{how}({what}) filter (where {where}) as {name}"


def whole(name, expression):
    return f"cast({expression} as bigint) as {name}"


def trade_counts(products):
    out = [n0("n_trades"), n0("n_open", "is_open = 1"), n("n_recent", "recent = 1")]
    for part in ("installment", "revolving", "secured", "unsecured"):
        out += [n0(f"n_{part}", f"{part} = 1"), n0(f"n_open_{part}", f"{part} = 1 and is_open = 1"),
                n(f"n_recent_{part}", f"recent = 1 and {part} = 1"), n(f"n_recent_live_{part}", f"recent = 1 and {part} = 1 and is_open = 1")]
    return out + [n0(f"n_open_{p.lower()}", f"is_open = 1 and product = '{p}'") for p in products]


def trade_balances(products):
    late = "m_report <= 3"
    out = []
    for name, part in (("install", "installment"), ("revolving", "revolving"), ("secured", "secured"), ("unsecured", "unsecured")):
        for measure, column in (("balance", "balance"), ("emi", "emi"), ("sanction", "sanction"), ("high_credit", "hc")):
            out += [s0(f"{name}_{measure}", column, f"{part} = 1"), s0(f"open_{name}_{measure}", column, f"{part} = 1 and is_open = 1")]
    out += [s0("revolving_line", LINE, "revolving = 1"), s0("open_revolving_line", LINE, "is_open = 1 and revolving = 1"), s("available_revolving", f"{LINE} - balance", "revolving = 1"),
            s0("open_balance", "balance", "is_open = 1"), s0("open_emi", "emi", "is_open = 1"), s0("open_payment", "last_payment", "is_open = 1"), s0("open_overdue", "overdue", "is_open = 1"),
            s0("recent_overdue", "overdue", late), s0("install_overdue", "overdue", f"{late} and installment = 1"), s0("open_recent_overdue", "overdue", f"{late} and is_open = 1"),
            s0("cc_overdue", "overdue", "product = 'CC'"), s0("non_cc_overdue", "overdue", "product != 'CC'"),
            s0("delinquent_overdue", "overdue", "dpd_1 >= if(product = 'CC', 2, 1)"), s0("overdue_3m", "overdue", "report_days <= 90"), s0("overdue_6m", "overdue", "report_days <= 180"),
            s("derog_balance", "balance", "written_off = 1"), s0("plbl_balance", "balance", "is_open = 1 and (product = 'PL' or product = 'BL')"), s0("sanction_seasoned", "sanction", "tenure > 11"),
            s("open_dpdx_balance", "balance", "any_x = 1 and is_open = 1"), s("open_dpdx_emi", "emi", "any_x = 1 and is_open = 1"), s("pl_sanction", "sanction", "product = 'PL'"),
            s("cc_line", LINE, "is_open = 1 and product = 'CC'"), s("live_pl_sanction", "sanction", "recent = 1 and is_open = 1 and product = 'PL'"),
            s("recent_balance", "balance", "recent = 1"), s("recent_secured_balance", "balance", "secured = 1 and recent = 1"), s("recent_unsecured_balance", "balance", "unsecured = 1 and recent = 1"),
            s("recent_emi", "emi", "recent = 1"), s0("non_mortgage_sanction", LINE, "product != 'HL' and recent = 1"), f"max(if({late}, overdue, 0)) as max_recent_overdue"]
    for name, column in (("balance", "balance"), ("sanction", "sanction"), ("credit_limit", "credit_limit"), ("high_credit", "hc")):
        out += [s(f"total_{name}", column), s(f"max_{name}", column, how="max")]
    for p in products:
        mine = f"product = '{p}' and is_open = 1"
        q = p.lower()
        out += [s(f"{q}_balance", "balance", mine), s(f"{q}_balance_avg", "balance", mine, "avg"), s(f"{q}_emi", "emi", mine), s(f"{q}_payment", "last_payment", mine),
                s(f"{q}_sanction_6m", LINE if p == "CC" else "sanction", f"{mine} and tenure < 7"), s0(f"{q}_open_recent_overdue", "overdue", f"{mine} and {late}"),
                s(f"{q}_derog_balance", "balance", f"product = '{p}' and written_off = 1")]
    return out


def trade_tenure(products):
    out = [s(f"tenure_{f}", "tenure", how=f) for f in ("max", "avg", "min")] + [whole("tenure_sum", "sum(tenure)")]
    groups = {"open": "is_open = 1", "install": "installment = 1", "revolving": "revolving = 1", "open_install": "installment = 1 and is_open = 1", "open_revolving": "revolving = 1 and is_open = 1",
              "open_sat": "sat_24 = 1 and is_open = 1", "secured": "secured = 1", "cc": "product = 'CC'", "plbl": "product = 'PL' or product = 'BL'"}
    for name, where in groups.items():
        out += [s(f"{name}_tenure_max", "tenure", where, "max"), s(f"{name}_tenure_avg", "tenure", where, "avg")]
    out += [s("months_since_newest_open", "tenure", "is_open = 1", "min"), s("months_since_payment", "m_pay", how="min"),
            whole("tenure_upto_10l", "sum(tenure) filter (where sanction <= 1e6)")]
    return out + [whole(f"{p.lower()}_tenure_sum", f"sum(if(product = '{p}', tenure, 0))") for p in products]


def opened_last_n(products):
    out = []
    scopes = {"": "true", **{p.lower() + "_": f"product = '{p}'" for p in products}}
    for prefix, mine in scopes.items():
        out += [n0(f"{prefix}n_opened_{w}m", f"{mine} and tenure <= {w}") for w in (1, 3, 6, 12)]
        out += [s(f"{prefix}open_balance_{w}m", "balance", f"{mine} and is_open = 1 and tenure <= {w}") for w in (3, 6, 24)]
        out.append(n0(f"{prefix}n_trades_24m", f"{mine} and tenure <= 24"))
    for w, days in DAYS.items():
        young = f"vintage_days <= {days}"
        out.append(n(f"n_opened_days_{w}m", young))
        for q, p in CODES.items():
            mine = f"{young} and product = '{p}'"
            out += [n(f"{q}_n_opened_days_{w}m", mine), s(f"live_{q}_balance_days_{w}m", "balance", f"{mine} and is_open = 1")]
            size = "credit_limit" if p == "CC" else "greatest(high_credit, sanction)"
            for label, top in (("50k", 50_000), ("1l", 100_000), ("5l", 500_000)):
                if (p, label) != ("CC", "5l"):
                    out.append(n(f"{q}_n_opened_days_{w}m_{label}", f"{mine} and {size} <= {top}"))
    return out + [n0("pl_opened_12m_30k_10l", "product = 'PL' and m_open >= 1 and m_open <= 12 and sanction >= 30000 and sanction <= 1000000"),
                  n0("hl_gt_15k_36m", "product = 'HL' and sanction > 15000 and tenure <= 36"), n0("pl_opened_12m", "product = 'PL' and tenure <= 12")]


def satisfactory(products):
    out = [whole("n_satisfactory_now", "sum(curr_sat)"), whole("n_satisfactory", "sum(sat_24)"), n0("n_unsatisfactory", "sat_24 = 0")]
    due = "if(m_report <= 3, overdue, 0)"
    for name, value in (("sat", 1), ("unsat", 0)):
        for w in (6, 12, 24):
            out += [s(f"{name}_balance_{w}m", "balance", f"sat_{w} = {value}"), s(f"{name}_balance_{w}m_avg", "balance", f"sat_{w} = {value}", "avg")]
        out += [s(f"{name}_overdue", due, f"sat_24 = {value}"), s(f"{name}_overdue_avg", due, f"sat_24 = {value}", "avg")]
    return out + [s("open_sat_balance", "balance", "sat_24 = 1 and is_open = 1"), s("open_sat_balance_avg", "balance", "sat_24 = 1 and is_open = 1", "avg")]


def delinquency_counts(products):
    kinds = ("0", "x", "30", "60", "90")
    out = [whole(f"n_dpd_{k}", f"sum(any_{k})") for k in (*kinds, "valid")] + [whole(f"months_dpd_{k}", f"sum(n_{k})") for k in (*kinds, "valid")]
    for k in kinds:
        out += [f"case when sum(any_valid) <> 0 then sum(any_{k}) / sum(any_valid) end as frac_dpd_{k}", f"case when sum(n_valid) <> 0 then sum(n_{k}) / sum(n_valid) end as frac_months_dpd_{k}"]
    for days, bucket in ((30, 2), (60, 3), (90, 4)):
        now = f"dpd_1 >= {bucket} and is_open = 1"
        out += [n(f"n_open_curr_{days}", now), *[n(f"{p.lower()}_n_open_curr_{days}", f"{now} and product = '{p}'") for p in ("BL", "PL", "CC", "TW")]]
    out += [s(f"any_dpd_{k}", f"any_{k}", "recent = 1", "max") for k in (*kinds, "150", "180", "360")]
    out += [s("worst_now", "dpd_1", how="max"), *[s(f"worst_{w}m", f"worst_{w}", how="max") for w in (3, 6, 12)], s("cc_worst_ever", "worst_36", "product = 'CC'", "max"),
            "cast(bool_or(n90_12 >= 1) as integer) as ever_90_12m", s("months_since_first_bad", "first_bad + m_start", how="min"), s("months_since_last_bad", "last_bad + m_start", how="max"),
            s("months_since_worst", "peak + m_start", how="max"), s("most_missed_12m", "nx_12", how="max")]
    for name, value in (("sec", 1), ("unsec", 0)):
        out += [f"max(if(secured = {value} and n60_6 > 0, 1, 0)) as {name}_60_6m", f"max(if(secured = {value}, n90_6, 0)) as {name}_n90_6m"]
    out += [whole("n_all_current", "sum(all_current)"), s("any_all_current", "all_current", how="max")]
    for name, part in (("", "true"), ("pl_", "product = 'PL'"), ("cd_", "product = 'CD'"), ("sec_", "secured = 1"), ("unsec_", "secured = 0")):
        bad = f"{part} and rep6 >= 1 and live_0 = 1"
        out += [n0(f"n_live_{name}bad_6m", bad), s(f"worst_live_{name}bad_6m", "rep6", bad, "max")]
    return out + [n0("n_negative_balance", "balance < 0"), s("newest_report", "m_start", how="min")]


def write_off(products):
    gone = "written_off = 1"
    out = [s("any_written_off", "written_off", how="max"), whole("n_written_off", "sum(written_off)")]
    out += [n0(f"{p.lower()}_n_written_off", f"{gone} and product = '{p}'") for p in ("HL", "AL", "CC", "PL", "BL", "CD")]
    return out + [n0("sec_n_written_off", f"{gone} and secured = 1"), n0("unsec_n_written_off", f"{gone} and unsecured = 1")]


def hanging_trades(products):
    old = "if(coalesce(report_days > 365, false), 1, 0)"
    return [f"min({old}) as all_hanging", *[f"min(if(product = '{p}', {old}, 0)) as all_hanging_{q}" for q, p in CODES.items()]]


def average_balance_overdue(products):
    groups = {q: f"product = '{p}'" for q, p in CODES.items()}
    for name, part in (("install", "installment = 1"), ("revolving", "revolving = 1"), ("secured", "secured = 1"), ("unsecured", "secured = 0")):
        groups |= {name: part, f"live_{name}": f"{part} and is_open = 1"}
    groups["live"] = "is_open = 1"
    out = []
    for w, days in DAYS.items():
        known = f"report_days <= {days}"
        out += [s(f"{g}_mean_balance_{w}m", f"mean_bal_{w}", where) for g, where in {**groups, "all": known}.items()]
        out += [s(f"{g}_mean_overdue_{w}m", f"mean_due_{w}", groups.get(g, known)) for g in (*CODES, "all")]
        out.append(s0(f"overdue_reported_{w}m", "overdue", known))
    return out


def delinquent_exposure(products):
    out = []
    for d in (30, 60, 90):
        bad = f"bad_now_{d} = 1 and recent = 1"
        out += [s(f"bad_{d}_balance", "balance", bad), *[s(f"{q}_live_bad_{d}_balance", "balance", f"{bad} and is_open = 1 and product = '{CODES[q]}'") for q in ("cc", "pl")]]
        for w, days in DAYS.items():
            for q, mine in (("", "true"), ("cc_", "product = 'CC'"), ("pl_", "product = 'PL'")):
                out.append(f"case when count(*) filter (where recent = 1) > 0 then count(*) filter (where {bad} and vintage_days <= {days} and {mine}) end as {q}n_bad_{d}_opened_{w}m")
        for name, scope in (("", "recent = 1"), ("cc_", "recent = 1 and is_open = 1 and product = 'CC'"), ("pl_", "recent = 1 and is_open = 1 and product = 'PL'")):
            total = f"sum(balance) filter (where {scope})"
            out.append(f"case when ifnull({total}, 0) = 0 then -1 else sum(balance) filter (where {scope} and bad_now_{d} = 1) / {total} end as {name}share{'_live' if name else ''}_bad_{d}")
    return out


def lender_mix(products):
    out = []
    for state, value in (("open", 1), ("closed", 0)):
        out += [n0(f"n_{state}_{q}_{c.lower()}", f"lender = '{c}' and product = '{p}' and is_open = {value}") for q, p in (("cc", "CC"), ("pl", "PL")) for c in V.LENDER_CLASSES]
        out += [n0(f"n_{state}_pl_{g}", f"secured = {b} and product = 'PL' and is_open = {value}") for g, b in (("sec", 1), ("unsec", 0))]
    return out


def satisfaction_ratio(products):
    out = []
    for state, value in (("open", 1), ("closed", 0)):
        for g, b in (("sec", 1), ("unsec", 0)):
            scope = f"is_open = {value} and secured = {b}"
            good, loans = f"count(*) filter (where {scope} and written_off = 0 and (dpd_1 = 0 or dpd_1 = -1))", f"count(*) filter (where {scope} and product = 'PL')"
            out += [f"{good} as n_good_{state}_{g}", f"case when {loans} <> 0 then {good} / {loans} end as ratio_good_{state}_pl_{g}"]
    return out


def thickness_indicator(products):
    tops = [(f"sum({LINE}) filter (where product = 'CC' and recent = 1 and is_open = 1)", 75_000), ("sum(sanction) filter (where product = 'PL' and recent = 1 and is_open = 1)", 200_000),
            ("max(sanction) filter (where product = 'AL')", 200_000), ("max(sanction) filter (where product = 'HL')", 1_000_000)]
    over, under = " or ".join(f"{t} >= {x}" for t, x in tops), " and ".join(f"{t} < {x}" for t, x in tops)
    return [f"case when max(m_open) > 11 and ({over}) then 'thick' when (max(m_open) >= 6 and max(m_open) < 12) or ({under}) then 'thin' else 'less_than_6' end as thickness"]


def concurrent_loans(products):
    months = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12)
    classes = {"long": "long_term = 1", "short": "short_term = 1", "secured": "secured = 1", "unsecured": "unsecured = 1", "installment": "installment = 1", "revolving": "revolving = 1"}
    out = [n0_live(f"live_m{i}", i) for i in months] + [f"sum(live_{i} * emi_new) as _emi_m{i}" for i in months]
    for i in (0, 1, 6):
        out += [n0(f"{c}_live_m{i}", f"{where} and live_{i} = 1") for c, where in classes.items()]
        out += [n0(f"{c}_pl_live_m{i}", f"{where} and live_{i} = 1 and product = 'PL'") for c, where in list(classes.items())[:4]]
    return out + [n0("live_m0_m2", "greatest(live_0, live_1, live_2) > 0"), n0("live_m6_m8", "greatest(live_6, live_7, live_8) > 0")]


def n0_live(name, i):
    return whole(name, f"sum(live_{i})")



def ratio_parts():
    """What the ratios need besides the balances."""
    out = [s("open_sat_balance", "balance", "sat_24 = 1 and is_open = 1"), n0("n_trades"), n0("n_dpd_valid", "any_valid = 1")]
    out += [s(f"open_balance_{w}m", "balance", f"is_open = 1 and tenure <= {w}") for w in (3, 6, 24)] + [n0(f"n_dpd_{d}", f"any_{d} = 1") for d in (30, 60, 90)]
    for q, limit in (("pl", "sanction"), ("cc", LINE)):
        mine = f"product = '{q.upper()}' and recent = 1"
        out += [n0(f"n_{q}", mine), *[n0(f"n_{q}_above_{c}", f"{mine} and balance / nullif({limit}, 0) > {c / 100}") for c in (25, 50, 75)]]
    return out


# ---- which accounts a type of the long families takes in, and from which age ----------------------------------------
CLASSES = {"lt": "long_term = 1", "st": "short_term = 1", "secure": "secured = 1", "unsecure": "unsecured = 1", "revolve": "revolving = 1", "install": "installment = 1"}
FULL_CLASSES = {"long": CLASSES["lt"], "short": CLASSES["st"], "secured": CLASSES["secure"], "unsecured": CLASSES["unsecure"], "installment": CLASSES["install"], "revolving": CLASSES["revolve"]}
PL_TERMS = {"pl_short": "short_term = 1 and product = 'PL'", "pl_long": "long_term = 1 and product = 'PL'"}
LEVELS = {"x": 1, "30": 2, "60": 3, "90": 4, "150": 5, "180": 6, "360": 7}  # smallest bucket of each level
SPANS = (1, 6, 12, 24, 48)
AGES = {**{str(m): f"m_open < {m + 1}" for m in SPANS}, "any": "1 = 1"}
LATER_AGES = ("24", "48", "any")
WITH_PATH = ("all", "lt", "st", "secure")


def of_products(*names):
    return {p.lower(): f"product in ('{p}')" for p in names}


EMI_KINDS = {"all": "1 = 1", **CLASSES, **of_products("CD", "AL", "BL", "PL", "HL", "CC"), **PL_TERMS}
TENURE_KINDS = {"all": "1 = 1", **FULL_CLASSES, **of_products("AL", "BL", "PL", "HL", "CC", "CD")}


def flow_kinds(products):
    return {"all": "1 = 1", **FULL_CLASSES, **PL_TERMS, **of_products(*products)}
