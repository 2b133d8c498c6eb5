"""Segment features: the same measures for every segment of a member's accounts, some thousand columns.

A segment is a set of accounts (ticket size of personal loans, security, product, all); an account is
in several. Each account is expanded to the segments it is in, aggregated to (member, segment), and
spread to <segment>_<measure> columns at the end.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions import history_line as L
from lendgrain.functions import trade_columns as TC
from lendgrain.operators.aggregates import exprs, key_names, with_medians
from lendgrain.operators.relational import dealt
from lendgrain.operators.trades import side_by_side, spread
from lendgrain.session import cut_lineage

AMOUNT_SEGMENTS = ("Overall", "PLlt5", "PLgt5", "PLlt1L", "PLgt1L", "GL", "CC", "TW", "AL", "HL", "SEC", "UNSEC", "NAGRI")
DELINQUENCY_SEGMENTS = ("Overall", "PLlt10k", "PLlt1L", "PLgt1L", "GL", "CC", "TW", "AL", "HL", "SEC", "UNSEC", "NAGRI")
WINDOWS = (3, 6, 12, 24)
DELINQUENCY_WINDOWS = (1, 3, 6, 12, 24)
LEVELS = {"0": 1, "30": 2, "60": 3, "90": 4, "180": 6}


def segment_frame(base: DataFrame, wanted) -> DataFrame:
    """base (see trade_columns.trade_base) with its segments as an array, and the row-level flags."""
    seg = TC.segment_flags()
    t = base.withColumns({"line": L.to_line("dpd"), "is_closed": TC.closed_category(),
                          "segments": F.array_compact(F.array(*[F.when(seg[n], F.lit(n)) for n in wanted]))})
    return t.withColumns({"util": F.expr("coalesce(round(try_divide(balance, highest), 3), 0)"),
                          "span": F.expr("(year(closed) - year(opened)) * 12 + month(closed) - month(opened)")})


AMOUNT_COLUMNS = ("m_report", "m_open", "is_closed", "opened", "highest", "balance", "util", "span")


def amount_rows(base, key="member") -> DataFrame:
    """Account rows with what the families by ticket read, and no more."""
    return segment_frame(base, AMOUNT_SEGMENTS).select(*key_names(key), "segments", *AMOUNT_COLUMNS)


def _by_segment(t, aggs, key):
    return t.withColumn("type", F.explode("segments")).groupBy(*key_names(key), "type").agg(*exprs(aggs))


LIVE_3M = "m_report <= 3 and is_closed = 0"


def amount_texts():
    """Tickets of live accounts reported in the last three months."""
    x = f"case when {LIVE_3M} then highest end"
    # the first and latest are taken over the rows that have a date; equal dates go by larger amount
    first = f"min(case when {LIVE_3M} then struct(opened, -highest as h) end)"
    last = f"max(case when {LIVE_3M} then struct(opened, highest as h) end)"
    return [f"-({first}).h as first_amount", f"({last}).h as latest_amount", f"avg({x}) as avg_amount", f"max({x}) as max_amount", f"min({x}) as min_amount"]


def cat_loan_amounts(base, key="member") -> DataFrame:
    """First, latest, mean, largest and smallest ticket and their ratios (a zero denominator is 0.1)."""
    return dealt(amount_rows(base, key), key, lambda rows: spread(_amounts(_by_segment(rows, amount_texts(), key)), AMOUNT_SEGMENTS, None, key))


def _amounts(long):
    long = long.replace(0.0, 0.1, subset=["min_amount", "latest_amount"])
    return long.selectExpr("*", "first_amount / latest_amount as ratio_first_latest", "max_amount / min_amount as ratio_max_min",
                           "try_divide(max_amount, avg_amount) as ratio_max_avg")


def open_live_texts():
    out = []
    for w in WINDOWS:
        live = f"m_report <= {w} and is_closed = 0"
        out += [f"cast(sum(case when m_open <= {w} then 1 end) as bigint) as n_opened_{w}m", f"cast(sum(case when {live} then 1 end) as bigint) as n_live_{w}m",
                f"sum(case when {live} then coalesce(balance, 0) end) as live_balance_{w}m", f"sum(case when {live} then coalesce(highest, 0) end) as live_sanction_{w}m",
                f"avg(case when {live} then util end) as mean_util_{w}m"]
    return out


def cat_open_live(base, key="member") -> DataFrame:
    return dealt(amount_rows(base, key), key, lambda rows: spread(_open_live(_by_segment(rows, open_live_texts(), key)), AMOUNT_SEGMENTS, None, key))


def _open_live(long):
    return long.selectExpr("*", *[f"round(try_divide(live_balance_{w}m, live_sanction_{w}m), 3) as sum_util_{w}m" for w in WINDOWS])


def cat_open_close_months(base, key="member") -> DataFrame:
    """Months from opening to closing, of accounts reported within the window."""
    return dealt(amount_rows(base, key), key, lambda rows: _open_close_months(rows, key))


def _open_close_months(rows, key):
    keys = key_names(key)
    t = rows.select(*keys, "m_report", "span", F.explode("segments").alias("type"))
    within = {w: F.expr(f"case when m_report <= {w} then span end") for w in WINDOWS}
    aggs = [f(x).alias(f"span_{n}_{w}m") for w, x in within.items() for n, f in (("min", F.min), ("max", F.max), ("mean", F.avg))]
    return spread(with_medians(t, [*keys, "type"], aggs, {f"span_median_{w}m": x for w, x in within.items()}), AMOUNT_SEGMENTS, None, key)


def delinquency_rows(base, key="member") -> DataFrame:
    """Account rows with what delinquency_long adds up, and no more. Each product is a bit, so that different ones are
    counted by an or of bits."""
    t = segment_frame(base, DELINQUENCY_SEGMENTS)
    cols = {f"_n{w}_{d}": F.expr(L.count_ge(w, b)) for w in DELINQUENCY_WINDOWS for d, b in LEVELS.items()}
    cols.update({f"_p{w}": F.expr(L.any_ge(w, 0)) for w in DELINQUENCY_WINDOWS})
    cols.update({f"_w{w}": F.expr(L.worst(w)) for w in DELINQUENCY_WINDOWS})
    cols["_bit"] = F.expr("shiftleft(1L, case product " + " ".join(f"when '{p}' then {i}" for i, p in enumerate(TC.PRODUCTS)) + " end)")
    return t.withColumns(cols).select(*key_names(key), "segments", "balance", "highest", "m_start", *cols)


def delinquency_long(rows, key="member") -> DataFrame:
    """(member, segment) rows out of delinquency_rows: delinquent balance, sanction, accounts, products, most months, worst
    bucket, and all sanctions and accounts reported (total_*, for the whole member in the segment Overall)."""
    aggs = []
    for w in DELINQUENCY_WINDOWS:
        for d in LEVELS:
            bad = f"_n{w}_{d} >= 1 and _p{w} = 1"
            aggs += [f"sum(case when {bad} then balance end) as bad_balance_{w}m_{d}", f"sum(case when {bad} then highest end) as bad_sanction_{w}m_{d}",
                     f"cast(sum(case when {bad} then 1 end) as bigint) as bad_accounts_{w}m_{d}",
                     f"bit_count(bit_or(case when {bad} then _bit end)) as bad_products_{w}m_{d}", f"max(case when _p{w} = 1 then _n{w}_{d} end) as times_{w}m_{d}"]
        aggs.append(f"max(case when _p{w} = 1 then _w{w} end) as worst_{w}m")
        all_of = f"type = 'Overall' and m_start <= {w} and _p{w} = 1"
        aggs += [f"sum(case when {all_of} then highest end) as total_sanctions_{w}m", f"cast(sum(case when {all_of} then 1 end) as bigint) as total_accounts_{w}m"]
    return _by_segment(rows, aggs, key)


TOTALS = [f"total_{n}_{w}m" for w in DELINQUENCY_WINDOWS for n in ("sanctions", "accounts")]


def _days(long, compat):
    days = V.DPD_BUCKET_DAYS_COMPAT if compat else V.DPD_BUCKET_DAYS
    table = "array(" + ", ".join(str(d) for d in days) + ")"
    return long.selectExpr("*", *[f"get({table}, case when worst_{w}m >= 0 then worst_{w}m end) as worst_days_{w}m" for w in DELINQUENCY_WINDOWS])


def _spread_with_totals(long, key):
    """<segment>_<measure> columns, then the totals, which every member has in its segment Overall."""
    wide = spread(long, DELINQUENCY_SEGMENTS, lambda n, m: n == "Overall" or m not in TOTALS, key)
    wide = wide.withColumnsRenamed({f"Overall_{c}": c for c in TOTALS})
    return wide.select(*[c for c in wide.columns if c not in TOTALS], *TOTALS)


def _delinquency(long, key, compat=False):
    return _spread_with_totals(_days(long, compat).drop(*[f"worst_{w}m" for w in DELINQUENCY_WINDOWS]), key)


def cat_delinquency(base, key="member", compat=False) -> DataFrame:
    """All delinquency measures per segment; `times` counts months, `bad_accounts` accounts, `bad_products` different
    products. The worst bucket is given back in days."""
    return dealt(delinquency_rows(base, key), key, lambda rows: _delinquency(delinquency_long(rows, key), key, compat))


def ratio_texts():
    """Columns over those of _spread_with_totals."""
    out = []
    for s in DELINQUENCY_SEGMENTS:
        for w in DELINQUENCY_WINDOWS:
            for d in LEVELS:
                out += [f"try_divide({s}_bad_balance_{w}m_{d}, total_sanctions_{w}m) as {s}_ratio_balance_{w}m_{d}",
                        f"try_divide(double({s}_bad_accounts_{w}m_{d}), double(total_accounts_{w}m)) as {s}_ratio_accounts_{w}m_{d}",
                        f"try_divide({s}_bad_sanction_{w}m_{d}, total_sanctions_{w}m) as {s}_ratio_sanction_{w}m_{d}"]
    return out


def cat_delinquency_ratios(base, key="member") -> DataFrame:
    """Delinquent balance, accounts and sanctions over all reported sanctions and accounts."""
    parts = [f"bad_{n}_{w}m_{d}" for w in DELINQUENCY_WINDOWS for d in LEVELS for n in ("balance", "sanction", "accounts")]

    def work(rows):
        long = delinquency_long(rows, key).select(*key_names(key), "type", *parts, *TOTALS)
        return _spread_with_totals(long, key).selectExpr(*key_names(key), *ratio_texts())

    return dealt(delinquency_rows(base, key), key, work)


def open_velocity(base, key="member") -> DataFrame:
    """Mean days between openings: all accounts, small and large tickets."""
    from lendgrain.operators.windows import mean_gap
    return base.groupBy(*key_names(key)).agg(mean_gap("opened").alias("mean_gap"), mean_gap("opened", F.col("highest") <= 10000).alias("mean_gap_upto_10k"),
                                 mean_gap("opened", F.col("highest") > 30000).alias("mean_gap_over_30k"))


READ = ("product", "account_type", "dpd", "opened", "closed", "as_of", "highest", "balance", "written_off", "m_start", "m_report", "m_open")


def category_features(base, key="member") -> DataFrame:
    """All segment families on one row per member. What they read of the account frame is written once; each of the two
    kinds of segments has one aggregate, and all of them stand on accounts dealt out by member."""
    keys = key_names(key)
    base = cut_lineage(base.select(*keys, *READ))

    def tickets(rows):
        both = _open_live(_amounts(_by_segment(rows, amount_texts() + open_live_texts(), key)))
        velocity = open_velocity(rows, key)
        return side_by_side([spread(both, AMOUNT_SEGMENTS, None, key), _open_close_months(rows, key), velocity], keys, "inner")

    def delinquency(rows):
        return _delinquency(delinquency_long(rows, key), key).selectExpr("*", *ratio_texts())

    parts = [dealt(amount_rows(base, key), key, tickets), dealt(delinquency_rows(base, key), key, delinquency)]
    return side_by_side(parts, keys, "inner")
