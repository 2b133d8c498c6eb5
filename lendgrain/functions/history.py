"""Payment history as arrays: slot i (1-based) is the month i months before the as-of month.

An expression used inside a lambda is computed again for every element, so whatever a lambda needs
besides its element is bound first with `let`.
"""

from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions.columns import as_col, flag, month_diff

SLOTS = 36


def _slots(n):
    return F.sequence(F.lit(1), F.lit(n))


def let(value, body):
    """body(value) with value computed once per row, also when body uses it inside another lambda."""
    return F.get(F.transform(F.array(value), body), 0)


# ---- unpacking ---------------------------------------------------------------------------------
def unpack(c, width=3, n=SLOTS):
    """Fixed-width text to n strings ('' past the end)."""
    return let(as_col(c), lambda text: F.when(text.isNotNull(), F.transform(
        _slots(n), lambda i: F.substring(text, (i - 1) * width + 1, F.lit(width)))))


def unpack_list(c, dtype="double", fmt=None):
    """Comma list to a typed array; the piece after the last comma is dropped."""
    parts = F.split(as_col(c), ",")
    parts = F.slice(parts, 1, F.size(parts) - 1)
    if dtype == "date":
        return F.transform(parts, lambda x: F.try_to_date(x, fmt or "yyyyMMdd"))
    return F.transform(parts, lambda x: x.try_cast(dtype))


def pad_history(c, n, width=3):
    """Right-pads with '0' up to n slots; longer text is left alone."""
    text, size = as_col(c), as_col(n) * width if not isinstance(n, int) else F.lit(n * width)
    return F.when(F.length(text) < size, F.rpad(text, size, F.lit("0"))).otherwise(text)


def pack(arr, width=3):
    return F.array_join(F.transform(as_col(arr), lambda x: F.lpad(x, width, "0")), "")


# ---- buckets -----------------------------------------------------------------------------------
def dpd_bucket(days, top=900):
    """Days past due to bucket 0..7; null when out of range."""
    floors = V.DPD_BUCKET_FLOOR
    out = F.when((days < 0) | (days > top), None)
    for k in range(len(floors) - 1, -1, -1):
        out = out.when(days >= floors[k], F.lit(k))
    return out


def code_number(code):
    """A history code as a number, null for text. (The pattern test is cheap; a failing cast is not.)"""
    return F.when(code.rlike(r"^\s*[0-9]{1,9}\s*$"), code.cast("int"))


def bucket_number_a(n):
    """Bureau A: special codes 901-905 have their own bucket, unreadable is 8."""
    out = F.when(n.isNull(), F.lit(8))
    for special, bucket in V.DPD_SPECIAL.items():
        out = out.when(n == special, F.lit(bucket))
    return F.coalesce(out.otherwise(dpd_bucket(n)), F.lit(8))


def bucket_number_b(n):
    return F.when(n == -9, F.lit(9)).otherwise(F.coalesce(dpd_bucket(n, top=999), F.lit(8)))


def bucket_code_c(code):
    """Bureau C payment rating; unknown ratings are -1."""
    out = F.lit(-1)
    for bucket in sorted(set(V.C_RATING_BUCKET.values()), reverse=True):
        codes = [r for r, b in V.C_RATING_BUCKET.items() if b == bucket]
        out = F.when(code.isin(codes), F.lit(bucket)).otherwise(out)
    return out


def bucket_dpd(arr, bureau="a"):
    """Codes to buckets. Bureau B: 'XXX' is 9 (not reported), 'STD' is 0, other text is 8."""
    a = as_col(arr)
    if bureau == "c":
        return F.transform(a, bucket_code_c)
    if bureau == "b":
        numbers = F.transform(a, lambda x: F.when(x == "XXX", -9).when(x == "STD", 0).otherwise(code_number(x)))
        return F.transform(numbers, bucket_number_b)
    return F.transform(F.transform(a, code_number), bucket_number_a)


def code_to_days(code, overdue, is_card):
    """Alternative grading of a bureau A code into days, by the amount overdue."""
    over = as_col(overdue)
    n = code_number(code)
    return (F.when(code.isin("SUB", "LSS", "DBT"), 91)
            .when((code == "SMA") | ((code == "STD") & (~is_card) & (over > 5000))
                  | ((code == "STD") & is_card & (over > 10000)), 89)
            .when(code.isin("XXX", "X/X"), -1).when(code == "DDD", -1)
            .when(code == "STD", 0)
            .when((n == 901) & (over < 1000), 0).when((n == 901) & (over <= 2000), 29)
            .when((n == 901) & (over <= 5000), 30).when((n == 901) & (over > 5000), 90)
            .when(n.isin(902, 903, 904), 91).when(n == 905, 61).otherwise(n))


def bucket_to_days(b, compat=False):
    """Worst bucket back to days; bucket 5 is 150 (120 with compat)."""
    days = V.DPD_BUCKET_DAYS_COMPAT if compat else V.DPD_BUCKET_DAYS
    return F.get(F.array(*[F.lit(d) for d in days]), F.when(as_col(b) >= 0, as_col(b)))


def join_slots(arr):
    return F.array_join(as_col(arr), "")


# ---- alignment ---------------------------------------------------------------------------------
def align_prefix(arr, k, fill):
    """History starting k months back: k-1 fillers in front."""
    return F.concat(F.array_repeat(fill, F.greatest(as_col(k) - 1, F.lit(0))), as_col(arr))


def cut_future(arr, k):
    """History starting at (k=0) or after (k<0) the as-of month: the first |k|+1 slots go."""
    a, off = as_col(arr), as_col(k)
    drop = F.when(off <= 0, F.abs(off) + 1).otherwise(0)
    return F.slice(a, drop + 1, F.greatest(F.size(a) - drop, F.lit(0)))


def align(arr, k, fill, n=SLOTS):
    """align_prefix and cut_future in one step, n slots; null past the end of the history."""
    off = as_col(k)
    drop = F.greatest(1 - off, F.lit(0))
    moved = F.concat(F.array_repeat(fill, F.greatest(off - 1, F.lit(0))), as_col(arr),
                     F.array_repeat(F.nullif(fill, fill), drop + n))
    return F.slice(moved, drop + 1, F.lit(n))


def align_by_month(vals, dates, asof, missing=None, n=SLOTS):
    """Puts each value in the slot of its report month; unreported slots get `missing`.
    Of several reports for one month the first in the list counts; months >= as-of are dropped."""
    ref = as_col(asof)
    offsets = F.transform(as_col(dates), lambda x: month_diff(ref, x))

    def place(s):
        def pick(i):
            pos = F.array_position(s["o"], i).cast("int")
            got = F.get(s["v"], pos - 1)
            return got if missing is None else F.when(pos > 0, got).otherwise(missing)
        return F.transform(_slots(n), pick)

    return let(F.struct(offsets.alias("o"), as_col(vals).alias("v")), place)


def mark_out_of_range(buckets, start, end, n=SLOTS):
    """Buckets 0..7 stay; bucket 8 is -2 outside the reported months [start, end], else -1."""
    lo, hi = as_col(start), as_col(end)
    return F.transform(F.slice(as_col(buckets), 1, n), lambda x, i: F.when(x.between(0, 7), x)
                       .when((x == 8) & ((i + 1 < lo) | (i + 1 > hi)), F.lit(-2)).otherwise(F.lit(-1)))


def mark_not_reported(buckets):
    """Bureau B: 9 becomes -2, 8 becomes -1."""
    return F.transform(as_col(buckets), lambda x: F.when(x == 9, -2).when(x == 8, -1).otherwise(x))


def slot(arr, i):
    return F.get(as_col(arr), i - 1)


def slots_to_cols(arr, name, n=SLOTS):
    return [slot(arr, i).alias(f"{name}_{i}") for i in range(1, n + 1)]


# ---- questions about a history -----------------------------------------------------------------
def first_n(arr, n):
    return F.slice(as_col(arr), 1, n)


def any_ge(arr, n, b):
    return flag(F.exists(first_n(arr, n), lambda x: x >= b))


def any_eq(arr, n, b):
    return flag(F.exists(first_n(arr, n), lambda x: x == b))


def _count(arr, n, test):
    a = first_n(arr, n)
    whole = (F.size(a) == n) & F.forall(a, lambda x: x.isNotNull())
    return F.when(whole, F.size(F.filter(a, test)))


def count_ge(arr, n, b):
    """Number of the first n slots at or above b; null when any of them is unknown."""
    return _count(arr, n, lambda x: x >= b)


def count_eq(arr, n, b):
    return _count(arr, n, lambda x: x == b)


def hist_max(arr, n):
    return F.array_max(first_n(arr, n))


def first_pos(arr, test, n=SLOTS):
    """Index of the first slot that passes; null when none does."""
    pos = F.array_position(F.transform(first_n(arr, n), lambda x: F.coalesce(test(x), F.lit(False))), True)
    return F.when(pos > 0, pos.cast("int"))


def last_pos(arr, test, n=SLOTS):
    a = F.transform(first_n(arr, n), lambda x: F.coalesce(test(x), F.lit(False)))
    pos = F.array_position(F.reverse(a), True)
    return F.when(pos > 0, (F.size(a) - pos + 1).cast("int"))


def first_val(arr, test, n=SLOTS):
    return F.get(F.filter(first_n(arr, n), test), 0)


def last_val(arr, test, n=SLOTS):
    return F.try_element_at(F.filter(first_n(arr, n), test), F.lit(-1))


def peak_pos(arr, n=SLOTS, among=24):
    """First of n slots that equals the worst of the first `among`."""
    pos = F.array_position(first_n(arr, n), hist_max(arr, among))
    return F.when(pos > 0, pos.cast("int"))


def satisfactory(arr, n, written_off):
    """Written off is 0; all slots in (-2,0,1) is 1; any slot of 2 or more is 0; else unknown."""
    a = first_n(arr, n)
    return (F.when(as_col(written_off) == 1, 0)
            .when((F.size(a) == n) & F.forall(a, lambda x: F.coalesce(x.isin(-2, 0, 1), F.lit(False))), 1)
            .when(F.exists(a, lambda x: x >= 2), 0))


def count_value(arr, v):
    a = as_col(arr)
    return F.size(a) - F.size(F.array_remove(a, v))


def all_current(arr, n=SLOTS):
    """Every slot is 0 or not reported."""
    return flag(count_value(arr, 0) + count_value(arr, -2) == n)


def sum_first(arr, n):
    """Sum of the first n slots; null when any is unknown."""
    a = first_n(arr, n)
    total = F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double"))
    return F.when(F.size(a) == n, total)


def mean_first(arr, n):
    return sum_first(arr, n) / F.lit(float(n))


def zip_exists(dpd, due, n, b, floor):
    """Some slot has bucket >= b and at least `floor` overdue at once."""
    both = F.arrays_zip(first_n(dpd, n).alias("d"), first_n(due, n).alias("o"))
    return F.exists(both, lambda x: (x["d"] >= b) & (x["o"] >= floor))


def serious_delinquency(is_card, dpd, due, n, b, floor=5000):
    """Cards need bucket and overdue amount together, other trades the bucket only."""
    hit = F.when(is_card, F.size(F.filter(
        F.arrays_zip(first_n(dpd, n).alias("d"), first_n(due, n).alias("o")),
        lambda x: (x["d"] >= b) & (x["o"] >= floor))) > 0).otherwise(F.exists(first_n(dpd, n), lambda x: x >= b))
    return flag(hit)


def status_slots(opened, closed, asof, n=SLOTS):
    """1 where month i before as-of lies from the open month to before the close month."""
    o, c, ref = as_col(opened), as_col(closed), as_col(asof)
    return F.transform(_slots(n), lambda i: flag(
        F.add_months(F.trunc(ref, "month"), -i).between(F.trunc(o, "month"), F.date_sub(F.trunc(c, "month"), 1))))


def default_after(arr, months_open, first=2, count=13):
    """Any slot other than 0, -1, -2 in months `first`..`first+count-1` of a trade's own life."""
    life = F.slice(F.reverse(F.slice(as_col(arr), 1, as_col(months_open))), first, count)
    return F.exists(life, lambda x: ~x.isin(0, -1, -2))


def recent_delinquency(arr, b, n=12):
    """The newest reported slot is also the newest slot at b or above."""
    bad, valid = first_val(arr, lambda x: x >= b, n), first_val(arr, lambda x: x >= 0, n)
    return F.coalesce(bad == valid, F.lit(False))


def months_since(start, pos):
    return as_col(start) + as_col(pos)


def argmax_slot(cols):
    """Slot with the largest total (first one on ties); null when nothing is known."""
    cs = [as_col(c) for c in cols]
    top = F.greatest(*cs)
    return F.array_position(F.array(*cs), top)


def any_reported(arr, n):
    return flag(F.exists(first_n(arr, n), lambda x: x >= 0))


# ---- month-on-month movement -------------------------------------------------------------------
def _steps(arr, n, test):
    a = as_col(arr)
    newer, older = F.slice(a, 1, n - 1), F.slice(a, 2, n - 1)
    return F.size(F.filter(F.zip_with(newer, older, test), lambda hit: hit))


def rises(arr, n, tol=500):
    """How many of the newest n-1 steps went up by more than tol."""
    return _steps(arr, n, lambda new, old: new > old + tol)


def falls(arr, n, tol=500):
    """How many of the newest n-1 steps ended below the older month plus tol
    (so a small rise also counts, as in the definition this follows)."""
    return _steps(arr, n, lambda new, old: new < old + tol)


def period_ratio(arr, newer=6, older=12):
    a, b = slot(arr, newer), slot(arr, older)
    return F.when(b > 0, F.try_divide(a, b)).otherwise(F.lit(-1.0))


