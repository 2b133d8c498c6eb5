"""Enquiry features: one wide row per member.

Input: member, enq_date, purpose, amount, product, secured, age (days or whole months before the
as-of date, the unit of `windows`).
"""

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.functions.columns import days_between, month_diff, ratio_text, settle
from lendgrain.operators.aggregates import coef_var, count_if, distinct_within, exprs
from lendgrain.operators.windows import dedup_keep, gap_table


@dataclass
class EnquirySpec:
    """Windows are in the unit of `age`; names carry `unit`."""
    key: tuple = ("member",)
    windows: tuple = (1, 3, 6, 12)
    distinct_windows: tuple = (1, 3, 6, 12, 36)
    amount_windows: tuple = (1, 3, 12)
    gap_windows: tuple = (1, 3, 6, 12, 36)
    part_gap_windows: tuple = (3, 6)
    unit: str = "m"
    count_products: tuple = ("PL", "Other", "CC", "CD")
    recency_products: tuple = ("PL", "HL", "Other", "AL", "CC", "CD")
    total_products: tuple = ("PL", "CD", "OD", "CC")
    latest_products: tuple = ("PL", "CD")
    gap_products: tuple = ("PL", "CD")
    bands: tuple = ((0, 1), (1, 1000), (1000, 10000), (10000, 50000), (50000, 1000000))
    velocity_days: int = 30
    velocity_window: int = 3
    days: str = "days"
    not_retail: tuple = ("BL", "LAP", "CV")
    moments: tuple = ("avg", "median", "max", "min", "stddev", "skewness", "kurtosis")
    extra: dict = field(default_factory=dict)


DAY_SPEC = EnquirySpec(windows=(7, 14, 21, 30), distinct_windows=(7, 14, 21, 30), amount_windows=(7, 14, 30),
                       gap_windows=(7, 14, 21, 30), part_gap_windows=(14, 30), unit="d", velocity_days=14,
                       velocity_window=21)


def prepare_enquiries(raw: DataFrame, spark, vocabulary_name="a_enquiry", key=("member",)) -> DataFrame:
    """Dedup (largest amount per key, day, purpose), as-of filter, product and secured flag, ages."""
    from lendgrain.functions.lookups import map_category, vocabulary
    x = raw.filter(F.col("enq_date").isNotNull() & F.col("purpose").isNotNull()
                   & (F.col("enq_date") < F.col("as_of")))
    x = dedup_keep(x, [*key, "enq_date", "purpose", "as_of"], "amount")
    x = map_category(x, "purpose", vocabulary(spark, vocabulary_name)).drop("revolving")
    return x.withColumns({"days": days_between("as_of", "enq_date"), "months": month_diff("as_of", "enq_date")})


# ---- aggregates by family (generated as SQL text: a family has up to hundreds of columns) ---------------
def _quoted(values):
    return ", ".join("'" + v.replace("'", "\\'") + "'" for v in values)


def _products(names):
    return {p.lower(): f"product = '{p}'" for p in names}


SECURITY = {"unsec": "secured = 0", "sec": "secured = 1"}


def recency_aggs(s):
    out = ["max(age) as enq_oldest", "min(age) as enq_latest"]
    for n, cond in {**_products(s.recency_products), **SECURITY}.items():
        out += [f"{f}(case when {cond} then age end) as {n}_enq_{side}" for f, side in (("max", "oldest"), ("min", "latest"))]
    return exprs(out)


def count_aggs(s):
    out = ["count(1) as enq_total"]
    out += [f"{count_if(cond)} as {n}_enq_total" for n, cond in _products(s.total_products).items()]
    for w in s.windows:
        out.append(f"{count_if(f'age <= {w}')} as enq_{w}{s.unit}")
        out += [f"{count_if(f'age <= {w} and {cond}')} as {n}_enq_{w}{s.unit}"
                for n, cond in {**_products(s.count_products), **SECURITY}.items()]
    return exprs(out)


def _scopes(s):
    return {"all": "true", "unsec": "secured = 0", **_products(s.count_products)}


def band_aggs(s):
    return exprs(f"{count_if(f'{cond} and amount > {lo} and amount <= {hi} and age <= {w}')} as {n}_enq_upto_{hi}_{w}{s.unit}"
                 for n, cond in _scopes(s).items() for lo, hi in s.bands for w in s.windows)


def amount_aggs(s):
    return exprs(f"max(amount * int({cond} and age <= {w})) as {n}_max_amount_{w}{s.unit}"
                 for n, cond in _scopes(s).items() for w in s.amount_windows)


def latest_amount_aggs(s):
    """Newest amounts; a member with no such enquiry has 0."""
    out = ["max(struct(enq_date, amount)).amount as latest_amount",
           "max(struct(enq_date, amount, 1 - secured as u, amount * (1 - secured) as v)).v as unsec_latest_amount"]
    out += [f"greatest(max(case when {cond} then struct(enq_date, amount) end).amount, "
            f"max(case when not ({cond}) then amount * 0 end)) as {n}_latest_amount"
            for n, cond in _products(s.latest_products).items()]
    return exprs(out)


def velocity_aggs(s):
    return exprs([
        f"{count_if(f'purpose not in ({_quoted(V.ENQUIRY_NOT_CREDIT)}) and {s.days} <= {s.velocity_days}')} as credit_enq_recent",
        f"min(case when product not in ({_quoted(s.not_retail)}) then {s.days} end) as days_since_retail_enq",
        f"{count_if(f'purpose not in ({_quoted(V.ENQUIRY_VELOCITY_SECURED)}) and age < {s.velocity_window}')} as non_secured_enq_recent"])


# ---- families --------------------------------------------------------------------------------------
def _by_key(enq, s, aggs):
    return enq.groupBy(*s.key).agg(*aggs)


def enq_recency(enq, spec=EnquirySpec()):
    return _by_key(enq, spec, recency_aggs(spec))


def enq_counts(enq, spec=EnquirySpec()):
    return _by_key(enq, spec, count_aggs(spec))


def enq_distinct_products(enq, spec=EnquirySpec()):
    names = {f"distinct_purposes_{w}{spec.unit}": w for w in spec.distinct_windows}
    return distinct_within(enq, spec.key, "purpose", "age", names)


def enq_amount_bands(enq, spec=EnquirySpec()):
    return _by_key(enq, spec, band_aggs(spec))


def enq_max_latest_amount(enq, spec=EnquirySpec()):
    """The plain maxima stay in a hash aggregate; the newest amounts need an ordered one."""
    return _by_key(enq, spec, amount_aggs(spec)).join(_by_key(enq, spec, latest_amount_aggs(spec)), list(spec.key))


def _weighted_moments(x, n):
    """Moments of values x with multiplicities n (sums of whole numbers, so exact)."""
    c = F.sum(n).cast("double")
    s1, s2, s3, s4 = [F.sum(F.when(n > 0, F.pow(x.cast("double"), F.lit(k)) * n)) for k in (1, 2, 3, 4)]
    mean = s1 / c
    m2 = s2 - c * mean * mean
    m3 = s3 - 3 * mean * s2 + 2 * c * F.pow(mean, F.lit(3))
    m4 = s4 - 4 * mean * s3 + 6 * mean * mean * s2 - 3 * c * F.pow(mean, F.lit(4))
    spread = (F.max(x) > F.min(x))
    return {"avg": mean, "max": F.max(x), "min": F.min(x),
            "median": F.percentile(x, F.lit(0.5), F.coalesce(n, F.lit(0))),
            "stddev": F.when(c > 1, F.when(spread, F.sqrt(m2 / (c - 1))).otherwise(F.lit(0.0))),
            "skewness": F.when(spread, F.sqrt(c) * m3 / F.pow(m2, F.lit(1.5))),
            "kurtosis": F.when(spread, c * m4 / (m2 * m2) - 3)}


def enq_gaps(enq, spec=EnquirySpec(), digits=4):
    """Moments of the days between consecutive enquiries: all, per product, unsecured."""
    parts = [F.lit("all"), F.when(F.col("secured") == 0, F.lit("unsec"))]
    parts += [F.when(F.col("product") == p, F.lit(p.lower())) for p in spec.gap_products]
    long = enq.select(*spec.key, "enq_date", "age", F.explode(F.array(*parts)).alias("part")).filter("part is not null")
    gaps = gap_table(long, [*spec.key, "part"], "enq_date", extra=("age",))
    aggs = []
    for w in sorted(set(spec.gap_windows) | set(spec.part_gap_windows)):
        hit = F.col("age") <= w
        got = _weighted_moments(F.when(hit, F.col("gap")), F.when(hit, F.col("n")))
        aggs += [settle(got[m], digits).alias(f"{m}_gap_{w}{spec.unit}")
                 for m in spec.moments]
    by_part = gaps.groupBy(*spec.key, "part").agg(*aggs)
    names = ["all", "unsec"] + [p.lower() for p in spec.gap_products]
    measures = [c for c in by_part.columns if c not in (*spec.key, "part")]
    wide = by_part.groupBy(*spec.key).pivot("part", names).agg(*[F.first(c).alias(c) for c in measures])
    keep = []
    for n in names:
        ws = spec.gap_windows if n == "all" else spec.part_gap_windows
        keep += [f"{n}_{m}_gap_{w}{spec.unit}" for w in ws for m in spec.moments]
    # members whose enquiries leave no gap still get a row
    return enq.select(*spec.key).distinct().join(wide.select(*spec.key, *keep), list(spec.key), "left")


def add_gap_cv(gaps, spec=EnquirySpec()):
    out = {}
    for n in ["all", "unsec"] + [p.lower() for p in spec.gap_products]:
        for w in (spec.gap_windows if n == "all" else spec.part_gap_windows):
            out[f"{n}_cv_gap_{w}{spec.unit}"] = coef_var(f"{n}_stddev_gap_{w}{spec.unit}", f"{n}_avg_gap_{w}{spec.unit}")
    return gaps.withColumns(out)


def enq_gap_cv(enq, spec=EnquirySpec()):
    g = add_gap_cv(enq_gaps(enq, spec), spec)
    return g.select(*spec.key, *[c for c in g.columns if "_cv_gap_" in c])


def add_shares(counts, spec=EnquirySpec()):
    u, (half, full) = spec.unit, spec.windows[-2:]
    parts = [p.lower() + "_" for p in spec.count_products]
    out = [f"{ratio_text(f'{n}enq_{w}{u}', 'enq_total')} as {n}enq_share_{w}{u}" for n in ["", "unsec_"] + parts for w in spec.windows]
    out += [f"{ratio_text(f'{n}enq_{half}{u}', f'{n}enq_{full}{u}')} as {n}enq_{half}_of_{full}{u}" for n in [""] + parts]
    return counts.selectExpr("*", *out)


def enq_share(enq, spec=EnquirySpec()):
    c = add_shares(enq_counts(enq, spec), spec)
    return c.select(*spec.key, *[x for x in c.columns if "_share_" in x or "_of_" in x])


def enq_velocity(enq, spec=EnquirySpec()):
    base = _by_key(enq, spec, velocity_aggs(spec))
    d = distinct_within(enq, spec.key, "purpose", spec.days, {"distinct_purposes_recent": spec.velocity_days - 1})
    return base.join(d, list(spec.key), "left").na.fill(0, ["distinct_purposes_recent"])


def enquiry_features(enq: DataFrame, spec=EnquirySpec()) -> DataFrame:
    """All families on one row per member."""
    from lendgrain.operators.windows import first_last
    key = list(spec.key)
    flat = _by_key(enq, spec, recency_aggs(spec) + count_aggs(spec) + amount_aggs(spec) + velocity_aggs(spec))
    out = add_shares(flat, spec)
    for part in (enq_amount_bands(enq, spec), _by_key(enq, spec, latest_amount_aggs(spec)),
                 enq_distinct_products(enq, spec),
                 distinct_within(enq, key, "purpose", spec.days, {"distinct_purposes_recent": spec.velocity_days - 1}),
                 first_last(enq, key, "enq_date", "amount", "product", "first_product", "latest_product"),
                 add_gap_cv(enq_gaps(enq, spec), spec)):
        out = out.join(part, key, "left")
    return out
