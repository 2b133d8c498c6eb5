"""Account families on `orders` and `lineitem`.

The SQL recomputes every history flag from the slot lists (the Spark side reads them off a line of
text), and the wide families cell by cell (the Spark side aggregates them long and spreads them).
"""

from lendgrain.functions import fixed_values as V
from lendgrain.functions import trade_columns as TC
from lendgrain.functions.trade_columns import MAIN_PRODUCTS, MONTHS, PRODUCTS
from lendgrain.operators import trades as T
from lendgrain.plans import trade_oracles as O
from lendgrain.plans.registry import query
from lendgrain.plans.sql_tables import BASE, in_list, mdiff, months_between, rnd, with_
from lendgrain.sources import driver_tables as D
from lendgrain.sources.driver_tables import TRADE_ASOF


def _n(test, n, arr="dpd"):
    return f"len(list_filter(list_slice({arr}, 1, {n}), lambda x: x {test}))"


def _any(test, n):
    return f"case when {_n(test, n)} > 0 then 1 else 0 end"


def _serious(n, b):
    both = f"len(list_filter(range(1, {n + 1}), lambda i: dpd[i] >= {b} and due[i] >= 5000)) > 0"
    return f"case when (product = 'CC' and {both}) or (product <> 'CC' and {_n(f'>= {b}', n)} > 0) then 1 else 0 end"


def _sat(n):
    return f"case when written_off = 1 then 0 when {_n('in (-2, 0, 1)', n)} = {n} then 1 when {_n('>= 2', n)} > 0 then 0 end"


def _mean(arr, n):
    return f"case when {_n('is null', n, arr)} = 0 then list_sum(list_slice({arr}, 1, {n})) / {float(n)}::double end"


_items = {
    "dpd_1": "dpd[1]", "dpd_2": "dpd[2]", "any_0": _any("= 0", 24), "any_valid": _any(">= 0", 24), "any_valid_12": _any(">= 0", 12),
    "n_0": _n("= 0", 24), "n_valid": _n(">= 0", 24), "nx_12": f"cast({_n('>= 1', 12)} as integer)", "n60_6": f"cast({_n('>= 3', 6)} as integer)",
    "n90_6": f"cast({_n('>= 4', 6)} as integer)", "n90_12": _n(">= 4", 12),
    "first_bad": "cast(list_min(list_filter(range(1, 37), lambda i: dpd[i] > 0)) as integer)", "last_bad": "cast(list_max(list_filter(range(1, 37), lambda i: dpd[i] > 0)) as integer)",
    "worst_24": "list_max(list_slice(dpd, 1, 24))", "rep6": "list_max(phist)",
    "bad_after": "len(list_filter(list_slice(list_reverse(list_slice(dpd, 1, cast(greatest(m_open, 0) as bigint))), 2, 14), lambda x: x not in (0, -1, -2))) > 0",
    "bad_30_6": _serious(6, 2), "bad_60_24": _serious(24, 3), "bad_90_36": _serious(36, 4),
    "all_current": f"case when {_n('in (0, -2)', 36)} = 36 then 1 else 0 end",
    "peak": "cast(list_position(dpd, list_max(list_slice(dpd, 1, 24))) as integer)", "curr_sat": "case when dpd[1] in (-2, 0, 1) then 1 else 0 end"}
_items.update({f"any_{n}": _any(f">= {b}", 24) for n, b in O.LEVELS.items()})
_items.update({f"n_{n}": _n(f">= {O.LEVELS[n]}", 24) for n in ("x", "30", "60", "90")})
_items.update({f"worst_{n}": f"list_max(list_slice(dpd, 1, {n}))" for n in (3, 6, 12, 36)})
_items.update({f"sat_{n}": _sat(n) for n in (6, 12, 24)})
_items.update({f"bad_now_{d}": f"case when list_filter(list_slice(dpd, 1, 12), lambda x: x >= 0)[1] >= {b} then 1 else 0 end" for d, b in ((30, 2), (60, 3), (90, 4))})
_items.update({f"live_{i}": f"live[{i + 1}]" for i in MONTHS})
_items.update({f"mean_{a}_{n}": _mean(a, n) for a in ("bal", "due") for n in (3, 6, 9, 12)})
FLAGS = BASE + ", flags as materialized (select *, " + ", ".join(f"{e} as {n}" for n, e in _items.items()) + " from base)"


def flags(spark, sf):
    return T.trade_flags(TC.trade_base(D.trades(spark, sf)))


def wide(items, source="flags", key="member"):
    return f"select {key}, " + ",\n  ".join(items) + f" from {source} group by {key}"


def _plain(name):
    query(name, with_(FLAGS, body=wide(getattr(O, name)(PRODUCTS))))(lambda spark, sf: T.family(flags(spark, sf), name))


for _name in T.PLAIN:
    if _name != "trade_balances":
        _plain(_name)


def _own(name, sql):
    query(name, sql)(lambda spark, sf: T.OWN[name](flags(spark, sf)))


# ---- exposure -----------------------------------------------------------------------------------------------------------
def exposure_items():
    out = []
    for n, c in O.EMI_KINDS.items():
        e = {i: f"(case when {c} then live_{i} * emi_new else 0 end)" for i in MONTHS}
        for f in ("sum", "max"):
            out += [f"{f}(case when {v} then {e[0]} else 0 end) as {n}_{f}_emi_m0_{k}" for k, v in O.AGES.items()]
        if n in O.WITH_PATH:
            out += [f"sum({e[i]}) as {n}_sum_emi_m{i}_any" for i in MONTHS if i]
        for k in O.LATER_AGES:
            v = O.AGES[k]
            out += [f"sum(case when {v} then {e[0]} - {e[i]} else 0 end) as {n}_emi_diff_m0_m{i}_{k}" for i in (3, 6, 12)]
            out += [f"sum(case when {v} then {' + '.join(e[i] for i in range(m))} else 0 end) as {n}_emi_total_m0_m{m - 1}_{k}" for m in (3, 6, 12)]
    return out


def _names(items):
    return [i.rsplit(" as ", 1)[1] for i in items]


EXPOSURE = "ex as materialized (" + wide(exposure_items()) + ")"


def settled_sql(names, source, pick=None):
    """Instalments are fractions whose sums depend on the order of addition in the last digits."""
    return "select member, " + ", ".join(f"{rnd(n, 2, 6)} as {n}" if pick is None or pick(n) else n for n in names) + f" from {source}"


def settled_query(name, sql_body, names, pick=None, run_family=None):
    from pyspark.sql import functions as F

    def run(spark, sf):
        df = (run_family or T.OWN[name])(flags(spark, sf))
        return df.select("member", *[F.expr(f"round(round(double({n}), 6), 2) + 0D as {n}") if pick is None or pick(n) else F.expr(n) for n in names])
    query(name, sql_body)(run)


def has_emi(n):
    return "emi" in n


settled_query("exposure_emi", with_(FLAGS, EXPOSURE, body=settled_sql(_names(exposure_items()), "ex")), _names(exposure_items()))


def exposure_ratio_items():
    out = []
    for n in [x for x in O.EMI_KINDS if x != "all"]:
        for v in O.LATER_AGES:
            for m in (3, 6, 12):
                a, b = f"{n}_emi_diff_m0_m{m}_{v}", f"all_emi_diff_m0_m{m}_{v}"
                out.append(f"case when {a} is null then 0 when {b} is null or {b} = 0 then {a} else {a} / {b} end as {n}_ratio_emi_diff_m0_m{m}_{v}")
                a, b = f"{n}_emi_total_m0_m{m - 1}_{v}", f"all_emi_total_m0_m{m - 1}_{v}"
                out.append(f"case when {a} is null then -1 when {b} is null then -2 when {b} = 0 then -3 else {a} / {b} end as {n}_share_emi_total_m0_m{m - 1}_{v}")
    path = {i: f"all_sum_emi_m{i}_any" for i in MONTHS}
    out += [f"greatest({', '.join(path.values())}) - {path[i]} as all_emi_below_peak_m{i}" for i in (0, 1)]
    for n in O.WITH_PATH:
        a, b = ("(" + " + ".join(f"{n}_sum_emi_m{i}_any / 3" for i in r) + ")" for r in (range(0, 3), range(6, 9)))
        out += [f"{a} as {n}_emi_mean_m0_m2", f"{b} as {n}_emi_mean_m6_m8", f"{a} - {b} as {n}_emi_mean_diff", f"case when {b} = 0 then 0 else {a} / {b} end as {n}_emi_mean_ratio"]
    return out


_er = exposure_ratio_items()
settled_query("exposure_ratios", with_(FLAGS, EXPOSURE, "rt as materialized (select member, " + ", ".join(_er) + " from ex)", body=settled_sql(_names(_er), "rt")), _names(_er))


def _answered(name, num, den, *rules):
    """num / den, unless one of the (test, answer) rules holds."""
    return "case " + " ".join(f"when {t} then {a}" for t, a in rules) + f" else ({num})::double / {den} end as {name}"


def ratio_items():
    """The ratios of SURVEY T13, each with its answers for missing and zero parts, over the balances."""
    plain = {"emi_of_dpdx_balance": "open_dpdx_emi open_dpdx_balance", "emi_of_balance": "open_emi open_balance", "recent_emi_of_balance": "recent_emi recent_balance",
             "overdue_of_balance": "recent_overdue total_balance", "available_of_limit": "available_revolving total_credit_limit", "revolving_util": "revolving_balance revolving_line",
             "open_revolving_util": "open_revolving_balance open_revolving_line", "install_unpaid": "install_balance install_sanction",
             "open_install_unpaid": "open_install_balance open_install_sanction", "secured_of_unsecured": "secured_balance unsecured_balance",
             "recent_secured_of_unsecured": "recent_secured_balance recent_unsecured_balance"}
    out = []
    for name, parts in plain.items():
        n, d = parts.split()
        out.append(_answered(name, n, d, (f"{n} is null", -1), (f"{d} is null", -2), (f"{d} = 0", -3)))
    for g in ("secured", "unsecured"):
        out.append(_answered(f"share_{g}", f"recent_{g}_balance", "recent_balance", ("coalesce(recent_balance, 0) = 0", -1), (f"recent_{g}_balance is null", 0)))
    out.append(_answered("cc_util", "cc_balance", "cc_line", ("cc_line is null", -1), ("cc_line = 0", -2)))
    out.append(_answered("pl_runoff", "pl_sanction - pl_balance", "pl_sanction", ("pl_sanction is null", -1), ("pl_sanction = 0", -2)))
    out.append(_answered("live_pl_paid", "live_pl_sanction - pl_balance", "live_pl_sanction", ("live_pl_sanction is null", -2), ("live_pl_sanction = 0", -3), ("live_pl_sanction < 1000", -1)))
    out += [_answered(name, n, d, (f"{n} is null", -1), (f"{d} is null", -2), (f"{d} = 0", -3)) for name, n, d in (
        ("open_sat_of_24m", "open_sat_balance", "open_balance_24m"), ("open_part_3m", "open_balance_3m", "open_balance"), ("open_part_6m", "open_balance_6m", "open_balance"))]
    for q in ("pl", "cc"):
        out += [f"coalesce(n_{q}_above_{c} / nullif(n_{q}, 0), -1) as share_{q}_above_{c}" for c in (25, 50, 75)]
    out += [f"case when n_dpd_valid > 0 then n_dpd_{d} / n_trades else -1 end as share_trades_{d}" for d in (30, 60, 90)]
    return out + ["coalesce(0.05::double * open_revolving_balance, -1) as five_percent_of_revolving", "coalesce(cast(cc_line > 0 and cc_balance >= 0.85 * cc_line as integer), 0) as cc_util_gt_85",
                  "coalesce(cast(recent_overdue >= 1000 as integer), 0) as overdue_gt_1k"]


def concurrent_items():
    """Live loans now against six months ago and the peak; instalments per live loan."""
    out = []
    for g in ["", *[a + b for a in ("long_", "short_", "secured_", "unsecured_") for b in ("", "pl_")]]:
        a, b = f"{g}live_m0", f"{g}live_m6"
        out += [f"coalesce({a}, 0) - coalesce({b}, 0) as {g}live_diff", f"coalesce({a}::double / nullif({b}, 0), {a}, 0) as {g}live_ratio"]
    peak = "list_max([" + ", ".join(f"live_m{i}" for i in MONTHS) + "])"
    out += [f"{peak} - live_m{i} as live_below_peak_m{i}" for i in (0, 1)] + [f"{peak} as live_peak", "live_m0_m2 - live_m6_m8 as live_quarter_diff"]
    mean = {i: f"(case when live_m{i} <> 0 then _emi_m{i} / live_m{i} when live_m{i} = 0 then 0 end)" for i in (0, 1, 3, 6, 12)}
    return out + [f"{mean[0]} as emi_per_live_m0"] + [f"{mean[0]} - {mean[i]} as emi_per_live_diff_m{i}" for i in (1, 3, 6, 12)]


_tb, _ur, _cl, _cr = O.trade_balances(PRODUCTS), ratio_items(), O.concurrent_loans(PRODUCTS), concurrent_items()
settled_query("trade_balances", with_(FLAGS, "u as (" + wide(_tb) + ")", body=settled_sql(_names(_tb), "u", has_emi)), _names(_tb), has_emi,
              lambda t: T.family(t, "trade_balances"))
settled_query("utilisation_ratios", with_(FLAGS, "u as (" + wide(_tb + O.ratio_parts()) + ")", "v as (select member, " + ", ".join(_ur) + " from u)",
                                          body=settled_sql(_names(_ur), "v", has_emi)), _names(_ur), has_emi)
_cn = [n for n in _names(_cl + _cr) if not n.startswith("_")]
settled_query("concurrent_loans", with_(FLAGS, "u as (" + wide(_cl) + ")", "v as (select *, " + ", ".join(_cr) + " from u)",
                                        body=settled_sql(_cn, "v", has_emi)), _cn, has_emi)


# ---- tenure, tickets, flow ------------------------------------------------------------------------------------------------
def tenure_items():
    out = []
    for n, c in O.TENURE_KINDS.items():
        for state, s in (("", "true"), ("live_", "live_0 = 1")):
            for d in (None, *O.SPANS):
                x = f"case when {c} and {s}" + (f" and loan_tenure <= {d}" if d else "") + " then loan_tenure end"
                name = f"{n}_{state}tenure" + (f"_upto_{d}" if d else "")
                out += [f"count({x}) as {name}_n", f"max({x}) as {name}_max", f"avg({x}) as {name}_avg"]
                if d and not state:
                    out += [f"count(case when m_open <= {v} then {x} end) as {name}_opened_{v}_n" for v in O.SPANS if v > d]
    return out


settled_query("tenure_profile", with_(FLAGS, "tp as materialized (" + wide(tenure_items()) + ")", body=settled_sql(_names(tenure_items()), "tp")), _names(tenure_items()))


def ticket_items():
    out = []
    for p in MAIN_PRODUCTS:
        for w in O.SPANS:
            for how, c in (("tenure", f"loan_tenure <= {w}"), ("vintage", f"m_open <= {w}")):
                hit = f"{c} and product = '{p}'"
                for f, m, name in (("max", "limit_amount", "max_sanction"), ("min", "limit_amount", "min_sanction"), ("max", "balance", "max_balance"), ("sum", "balance", "sum_balance")):
                    out.append(f"{f}(case when {hit} then {m} else 0 end) as {p.lower()}_{name}_{how}_{w}")
    return out


_own("ticket_profile", with_(FLAGS, body=wide(ticket_items())))
_latest = ["balance", "limit_amount", "live_0", "m_open"]
_LN = {"balance": "balance", "limit_amount": "sanction", "live_0": "status", "m_open": "vintage"}
_own("latest_profile", with_(FLAGS, "ln as (select *, row_number() over (partition by member, product order by opened desc, limit_amount desc, balance desc, live_0 desc) as rn from flags)",
                             body=wide([f"coalesce(max(case when rn = 1 and product = '{p}' then {m} end), 0) as {p.lower()}_{_LN[m]}" for p in MAIN_PRODUCTS for m in _latest], "ln")))


def flow_items():
    out = []
    for n, c in O.flow_kinds(MAIN_PRODUCTS).items():
        for w in O.SPANS:
            out += [f"cast(sum(case when {c} and m_open <= {w} then 1 end) as bigint) as {n}_opened_{w}m",
                    f"cast(sum(case when {c} and m_open <= {w} and live_0 = 1 then 1 end) as bigint) as {n}_live_opened_{w}m",
                    f"cast(sum(case when {c} and m_acct_close <= {w} then 1 end) as bigint) as {n}_closed_{w}m"]
    return out


_own("account_flow", with_(FLAGS, body=wide(flow_items())))

# ---- extremes, trends, cards, reopening, policy ---------------------------------------------------------------------------------
_cols, _items2 = [], []
for _p, _line in (("pl", "greatest(sanction, high_credit)"), ("hl", "greatest(sanction, high_credit)"), ("cc", "credit_limit")):
    _c = f"recent = 1 and product = '{_p.upper()}'"
    _cols += [f"case when {_c} then {_line} end as {_p}_line", f"case when {_c} then balance end as {_p}_bal", f"case when {_c} then vintage_days end as {_p}_age"]
_maxes = []
for _p in ("pl", "hl", "cc"):
    _maxes += [f"max({_p}_line) over m as {_p}_top_line", f"max({_p}_bal) over m as {_p}_top_balance", f"max({_p}_age) over m as {_p}_oldest", f"min({_p}_age) over m as {_p}_newest"]
    for _n2, _m2 in (("top_line", "line"), ("top_balance", "bal"), ("oldest", "age"), ("newest", "age")):
        _items2 += [f"sum(case when {_p}_{_m2} = {_p}_{_n2} then {_p}_line end) as {_n2}_{_p}_line", f"sum(case when {_p}_{_m2} = {_p}_{_n2} then {_p}_bal end) as {_n2}_{_p}_balance"]
_own("top_trade_snapshots", with_(FLAGS, "v as (select member, " + ", ".join(_cols) + " from flags)", "w as (select *, " + ", ".join(_maxes) + " from v window m as (partition by member))", body=wide(_items2, "w")))

_parts = {"sec": "secured = 1", "unsec": "secured = 0", "bl": "coalesce(recent = 1 and product = 'BL', false)", "non_bl": "not coalesce(recent = 1 and product = 'BL', false)"}
_tot = [f"sum(case when {c} then bal[{i}] end) as {n}_{i}" for n, c in _parts.items() for i in range(1, 37)]
_trend = []
for _n3, _c3 in _parts.items():
    for _h in (12, 24, 36):
        for _w, _op in (("rise", ">"), ("fall", "<")):
            _sum = " + ".join(f"(case when {_n3}_{i} {_op} {_n3}_{i + 1} + 500 then 1 else 0 end)" for i in range(1, _h))
            _trend.append(f"case when {_n3}_has > 0 then cast({_sum} as integer) end as {_n3}_{_w}_{_h}m")
    _trend.append(f"case when {_n3}_has > 0 then case when {_n3}_12 > 0 then {_n3}_6 / {_n3}_12 else -1.0 end end as {_n3}_ratio_6_12")
_has = [f"count(case when {c} then 1 end) as {n}_has" for n, c in _parts.items()]
_own("balance_trend", with_(FLAGS, "tt as (" + wide(_tot + _has) + ")", body="select member, " + ", ".join(_trend) + " from tt"))

_CC = "recent = 1 and product = 'CC'"
_b12 = ", ".join(f"b{i}" for i in range(1, 13))
_own("card_behaviour", with_(FLAGS, "cb as (" + wide(
    [f"max(case when {_CC} then bal[1] end) as top_card_balance", f"sum(case when {_CC} then bal[1] end) as card_balance", f"sum(case when {_CC} then hc end) as card_line",
     f"max(case when {_CC} then 1 end) as has_card", f"max(struct_pack(a := -vintage_days, d := dpd_2)) filter ({_CC}) as nw"]
    + [f"sum(case when {_CC} then bal[{i}] end) as b{i}" for i in range(1, 13)]) + ")",
    body=f"""select member, top_card_balance, card_balance, card_line, has_card, greatest({_b12}) as card_peak_balance,
  case when greatest({_b12}) is not null then cast(list_position([{_b12}], greatest({_b12})) as bigint) end as card_peak_month,
  case when card_line is null then -2 when card_line <= 0 then -1 else card_balance / card_line end as card_util, nw.d as newest_card_dpd from cb"""))

_ro = []
for _w4 in (1, 3, 6, 12):
    _hit = f"opened > prev_closed and {months_between('opened', 'prev_closed')} < {_w4}"
    _ro.append(f"cast(sum(case when recent = 1 then case when {_hit} then 1 else 0 end end) as bigint) as reopened_{_w4}m")
    _ro += [f"cast(sum(case when {_hit} and product = '{p}' then 1 else 0 end) as bigint) as {p.lower()}_reopened_{_w4}m" for p in ('PL', 'CC', 'CD', 'HL', 'LAP', 'BL')]
_own("reopen_counts", with_(FLAGS, "ro as (select member, product, recent, opened, lag(closed) over (partition by member, product order by opened, account) as prev_closed from flags)", body=wide(_ro, "ro")))

_own("policy_exclusions", with_(FLAGS, f"""w1 as (select *, case when wo_status in {in_list(V.C_WRITTEN_OFF_STATUS)} and coalesce(write_off_amt, overdue) > 10000 then 1 else 0 end as wo from flags),
  w2 as (select *, max(case when wo = 1 then reported end) over (partition by member) as latest from w1),
  w3 as (select *, {mdiff('as_of', 'latest')} as mn_wo, case when opened > latest and {months_between('as_of', 'opened')} >= 12 then 1 else 0 end as after_wo from w2)""",
  body="""select member, case when max(score) < 600 then 1 else 0 end as low_score, max(bad_30_6) as bad_30_6m, max(bad_60_24) as bad_60_24m, max(bad_90_36) as bad_90_36m,
  max(case when wo = 1 and mn_wo <= 12 then 1 else 0 end) as written_off_12m, max(case when wo = 1 and mn_wo > 12 then 1 else 0 end) as written_off_before,
  max(case when after_wo = 1 and bad_after then 0 else 1 end) as good_after_write_off, case when max(vintage_days) < 180 then 1 else 0 end as short_vintage from w3 group by member"""))

_own("product_presence", with_(FLAGS, body="""select member, count(distinct account_type) as n_types, max(case when recent = 1 and product = 'PL' then 1 end) as has_pl,
  max(case when recent = 1 and product = 'HL' then 1 end) as has_hl, max(case when recent = 1 and product = 'CC' then 1 end) as has_cc,
  max(case when product = 'HL' and lender <> 'HFC' then 1 else 0 end) as external_hl,
  first(product order by opened, limit_amount desc, product) as first_product, first(product order by opened desc, limit_amount desc, product) as latest_product from flags group by member"""))



# ---- several dates of each member ----------------------------------------------------------------------------------------
# every member has dates of its own, and every account is seen from two of them
_own_dates = f"cast(date '{TRADE_ASOF}' - cast(o_custkey % 300 as integer) - to_months(cast(back as integer)) as date)"
DATED = FLAGS.replace(f"date '{TRADE_ASOF}' as as_of,", f"{_own_dates} as as_of,").replace(
    "from orders join hist on account = o_orderkey)", "from orders join hist on account = o_orderkey cross join (values (0), (7)) as dates(back))")
DATED += ", dated as materialized (select *, cast(date_trunc('month', as_of) as date) as month from flags)"


def dated_flags(spark, sf):
    """The account frame at two dates of each member; month is the month of the date."""
    from pyspark.sql import functions as F
    raw = D.raw_trades(spark, sf).withColumn("_back", F.explode(F.array(F.lit(0), F.lit(7))))
    raw = raw.withColumn("as_of", F.add_months(F.date_sub(F.lit(TRADE_ASOF).cast("date"), (F.col("member") % 300).cast("int")), -F.col("_back"))).drop("_back")
    return T.trade_flags(TC.trade_base(D.trades(spark, sf, raw=raw))).withColumn("month", F.trunc("as_of", "month"))


BY_MONTH = "member, month"
query("trade_counts_by_month", with_(DATED, body=wide(O.trade_counts(PRODUCTS), "dated", BY_MONTH)))(lambda spark, sf: T.family(dated_flags(spark, sf), "trade_counts", ["member", "month"]))
query("account_flow_by_month", with_(DATED, body=wide(flow_items(), "dated", BY_MONTH)))(lambda spark, sf: T.account_flow(dated_flags(spark, sf), ["member", "month"]))
query("ticket_profile_by_month", with_(DATED, body=wide(ticket_items(), "dated", BY_MONTH)))(lambda spark, sf: T.ticket_profile(dated_flags(spark, sf), ["member", "month"]))
query("top_trade_snapshots_by_month", with_(DATED, "v as (select member, month, " + ", ".join(_cols) + " from dated)", "w as (select *, " + ", ".join(_maxes) + " from v window m as (partition by member, month))",
                                            body=wide(_items2, "w", BY_MONTH)))(lambda spark, sf: T.top_trade_snapshots(dated_flags(spark, sf), ["member", "month"]))
query("reopen_counts_by_month", with_(DATED, "ro as (select member, month, product, recent, opened, lag(closed) over (partition by member, month, product order by opened, account) as prev_closed from dated)",
                                      body=wide(_ro, "ro", BY_MONTH)))(lambda spark, sf: T.reopen_counts(dated_flags(spark, sf), ["member", "month"]))


# ---- all families ---------------------------------------------------------------------------------------------------------
@query("trade_features")
def trade_features(spark, sf):
    """Every account family on one row per member. The families have queries, and SQL, of their own."""
    return T.trade_features(flags(spark, sf))
