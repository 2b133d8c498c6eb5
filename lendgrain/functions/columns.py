"""Row-level building blocks. Everything returns a Column and stays inside generated code."""

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c):
    return F.col(c) if isinstance(c, str) else c


# ---- dates -------------------------------------------------------------------------------------
def parse_date(c, fmt, pad=None, pivot_year=None):
    """Text to date, null when unreadable. `pad` left-pads with zeros (unpadded days);
    two-digit years above `pivot_year` belong to the previous century."""
    text = as_col(c).cast("string")
    if pad:
        text = F.when(F.length(text) > 0, F.lpad(text, pad, "0"))
    d = F.try_to_date(text, fmt)
    if pivot_year:
        d = F.when(F.year(d) > pivot_year, F.add_months(d, -1200)).otherwise(d)
    return d


def parse_date_any(c, rules):
    """First rule (regex, format) whose regex matches decides; no match is null."""
    text = as_col(c)
    out = F.lit(None).cast("date")
    for pattern, fmt in reversed(rules):
        out = F.when(text.rlike(pattern), parse_date(text, fmt)).otherwise(out)
    return out


def month_diff(later, earlier):
    """Whole months between the months of two dates."""
    a, b = as_col(later), as_col(earlier)
    return (F.year(a) - F.year(b)) * 12 + F.month(a) - F.month(b)


def months_exact(later, earlier):
    return F.months_between(as_col(later), as_col(earlier))


def days_between(later, earlier):
    return F.datediff(as_col(later), as_col(earlier))


def date_sanity(c, upper=None, floor="1960-01-01", include_upper=False):
    """Null for dates on or before `floor`, or after `upper` (on or after with include_upper)."""
    d = as_col(c)
    ok = d > F.lit(floor).cast("date") if floor else F.lit(True)
    if upper is not None:
        u = as_col(upper)
        ok = ok & ((d < u) if include_upper else (d <= u))
    return F.when(ok, d)


def coalesce_dates(*cols, not_before=None):
    """First known date; with `not_before`, a known result is lifted to that date."""
    d = F.coalesce(*[as_col(c) for c in cols])
    if not_before is not None:
        lo = as_col(not_before)
        d = F.when(d < lo, lo).otherwise(d)
    return d


def months_on_book(opened, closed, reported):
    o, c, r = as_col(opened), as_col(closed), as_col(reported)
    return F.when(c > o, month_diff(c, o)).otherwise(month_diff(r, o))


# ---- amounts -----------------------------------------------------------------------------------
def clean_amount(c, dtype="double"):
    return F.regexp_replace(as_col(c), ",", "").try_cast(dtype)


CLAMP_RULES = ("non_negative", "null_if_negative", "minus_one_null")


def clamp(c, rule):
    v = as_col(c)
    if rule == "non_negative":
        return F.when(v <= 0, F.lit(0)).otherwise(v)
    if rule == "null_if_negative":
        return F.when(v >= 0, v)
    if rule == "minus_one_null":
        return F.when(v == -1, F.lit(None)).when(v < 0, F.lit(0)).otherwise(v)
    raise ValueError(rule)


def impute(c, value=-99, negative=True):
    v = as_col(c)
    bad = v.isNull() | (v < 0) if negative else v.isNull()
    return F.when(bad, F.lit(value)).otherwise(v)


def derive_limit(card, limit, sanction, high_credit):
    """Cards use their limit, else the larger of high credit and sanction; other trades the sanction."""
    lim, s, h = as_col(limit), as_col(sanction), as_col(high_credit)
    return F.when(~card, s).when(lim > 0, lim).otherwise(F.greatest(h, s))


def highest_amount(high_credit, sanction):
    return F.greatest(as_col(high_credit), as_col(sanction), F.lit(0))


def card_limit(limit, high_credit):
    """Reported limit, but a zero limit falls back to a positive high credit."""
    lim, h = as_col(limit), as_col(high_credit)
    return F.when((lim == 0) & (h > 0), h).otherwise(F.coalesce(lim, h))


# ---- flags -------------------------------------------------------------------------------------
def flag(cond):
    """1 / 0, where an unknown condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def flag_or_null(cond):
    return F.when(cond, F.lit(1))


def band(c, lo, hi):
    v = as_col(c)
    return (v > lo) & (v <= hi)


# ---- ratios ------------------------------------------------------------------------------------
def safe_ratio(num, den, num_null=-1, den_null=-2, den_zero=-3, den_below=None, den_first=False):
    """num/den with a stated answer for each defect.

    An answer is a number, None (null) or "num" (the numerator itself). The numerator is checked
    first unless `den_first`. `den_below=(limit, answer)` adds a floor for small denominators.
    """
    n, d = as_col(num).cast("double"), as_col(den).cast("double")

    def answer(a):
        if a is None:
            return F.lit(None).cast("double")
        return n if a == "num" else F.lit(float(a))

    checks = [(d.isNull(), answer(den_null)), (d == 0, answer(den_zero))]
    if den_below:
        checks.append((d < den_below[0], answer(den_below[1])))
    checks.insert(len(checks) if den_first else 0, (n.isNull(), answer(num_null)))
    out = F.when(*checks[0])
    for c in checks[1:]:
        out = out.when(*c)
    return out.otherwise(F.try_divide(n, d))


def ratio_text(num, den, num_null="-1", den_null="-2", den_zero="-3"):
    """safe_ratio as expression text, for generated families (an answer is any expression)."""
    return (f"cast(case when {num} is null then {num_null} when {den} is null then {den_null} when {den} = 0 then {den_zero} "
            f"else try_divide(double({num}), double({den})) end as double)")


def null_safe_diff(a, b):
    """a-b where a missing side counts as nothing, and both missing as 0."""
    x, y = as_col(a), as_col(b)
    return F.coalesce(x, F.lit(0)) - F.coalesce(y, F.lit(0))


def settle(c, digits=4):
    """Rounds half up, after settling the tenth digit, so that an exact tie does not depend on the
    order in which partial sums were added."""
    return F.round(F.round(as_col(c).cast("double"), 10), digits) + F.lit(0.0)


def any_of(conds):
    return reduce(lambda a, b: a | b, conds)


def is_in(c, values) -> Column:
    return F.coalesce(as_col(c).isin(list(values)), F.lit(False))
