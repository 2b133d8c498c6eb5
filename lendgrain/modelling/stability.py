"""Population and characteristic stability."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.modelling.binning import cut, hist_bin
from lendgrain.modelling.quantile import quantile_edges, value_table
from lendgrain.session import cut_lineage


def _guarded(share, eps):
    return F.when(share == 0, F.lit(eps)).otherwise(share)


def psi_term(actual, expected):
    return (actual - expected) * F.ln(actual / expected)


def sample_counts(df, sample, cols, samples) -> DataFrame:
    """Distinct values with the rows of each sample (n0, n1, ...): one pass over all samples, whatever is compared."""
    x = df.filter(F.col(sample).isin(list(samples))).withColumn("_s", F.col(sample))
    vt = value_table(x, cols, by=("_s",), keep_null=True)
    return cut_lineage(vt.groupBy("variable", "value").agg(*[F.sum(F.when(F.col("_s") == s, F.col("n")).otherwise(0)).alias(f"n{i}") for i, s in enumerate(samples)]))


def psi_continuous(df: DataFrame, sample, cols, expected="Train", actual="Test", bins=10, method="width", eps=1e-10) -> DataFrame:
    """(variable, psi). method="width": equal-width bins over the expected range, values outside are not
    binned but stay in the denominator; "quantile": bins at the expected deciles."""
    return _psi(sample_counts(df, sample, cols, (expected, actual)), 1, bins, method, eps)


def _psi(counts, other, bins=10, method="width", eps=1e-10) -> DataFrame:
    """PSI of sample number `other` against number 0."""
    vt = counts.select("variable", "value", F.col("n0").alias("e"), F.col(f"n{other}").alias("a")).filter("e > 0 or a > 0").withColumn("n", F.col("e") + F.col("a"))
    size = vt.groupBy("variable").agg(
        F.sum("e").alias("ne"), F.sum("a").alias("na"),
        F.min(F.when(F.col("e") > 0, F.col("value"))).alias("lo"), F.max(F.when(F.col("e") > 0, F.col("value"))).alias("hi"))
    if method == "width":
        x = vt.join(F.broadcast(size), "variable").withColumn("bin", F.expr(hist_bin("value", "lo", "hi", bins)))
        n_bins = F.lit(bins)
    else:
        known = vt.filter((F.col("e") > 0) & F.col("value").isNotNull()).select("variable", "value", F.col("e").alias("n"))
        edges = quantile_edges(known, bins)
        x = cut(vt, edges, open_ends=True).join(F.broadcast(size), "variable")
        n_bins = F.max(F.size("edges") - 1)
    g = x.filter("bin is not null").groupBy("variable", "bin").agg(
        F.sum("e").alias("e"), F.sum("a").alias("a"), F.max("ne").alias("ne"), F.max("na").alias("na"), n_bins.alias("n_bins"))
    # bins that nobody fell into add nothing: both guards are the same eps
    term = psi_term(_guarded(F.col("a") / F.col("na"), eps), _guarded(F.col("e") / F.col("ne"), eps))
    return g.groupBy("variable").agg(F.sum(term).alias("psi"))


def category_counts(df, sample, cols, samples) -> DataFrame:
    """Values of all categorical variables with the rows of each sample (n0, n1, ...): one long aggregate, one read."""
    rows = df.filter(F.col(sample).isin(list(samples))).select(F.col(sample).alias("_s"), *[F.col(c).cast("string").alias(c) for c in cols])
    long = rows.unpivot(["_s"], list(cols), "variable", "value").filter("value is not null")
    return cut_lineage(long.groupBy("variable", "value").agg(*[F.sum((F.col("_s") == s).cast("long")).alias(f"n{i}") for i, s in enumerate(samples)]))


def _psi_of_categories(counts, other, eps_actual=1e-6, eps_expected=1e-9, compat=False) -> DataFrame:
    """PSI of sample number `other` against number 0."""
    g = counts.select("variable", "value", F.col("n0").alias("e"), F.col(f"n{other}").alias("a")).filter("e > 0 or a > 0")
    size = g.groupBy("variable").agg(F.sum("e").alias("ne"), F.sum("a").alias("na"))
    x = g.join(F.broadcast(size), "variable").select("variable", (F.col("a") / F.col("na")).alias("sa"), (F.col("e") / F.col("ne")).alias("se"))
    if compat:
        term = F.when((F.col("sa") == 0) | (F.col("se") == 0), 0.0).otherwise(psi_term(F.col("sa"), F.col("se")))
    else:
        term = psi_term(_guarded(F.col("sa"), eps_actual), _guarded(F.col("se"), eps_expected))
    return x.groupBy("variable").agg(F.sum(term).alias("psi"))


def psi_categorical(df: DataFrame, sample, cols, expected="Train", actual="Test", eps_actual=1e-6, eps_expected=1e-9, compat=False) -> DataFrame:
    """Same on the shares of each value. A value missing on one side is guarded there; with compat the
    whole row takes the guard, so that it adds nothing."""
    return _psi_of_categories(category_counts(df, sample, cols, (expected, actual)), 1, eps_actual, eps_expected, compat)


def stability_band(psi="psi"):
    b = F.lit(V.PSI_BANDS[-1][1])
    for limit, name in reversed(V.PSI_BANDS[:-1]):
        b = F.when(F.col(psi) < limit, F.lit(name)).otherwise(b)
    return b


def csi_report(df: DataFrame, sample, cols, score=None, expected="Train", others=("Test", "OOT"), categorical=(), **kw) -> DataFrame:
    """One row per variable and comparison; the score itself is reported as PSI, features as CSI. Numbers and categories
    are counted once each for all samples, whatever is compared."""
    samples, numeric = (expected, *others), [*cols, *([score] if score else [])]
    counts = sample_counts(df, sample, numeric, samples) if numeric else None
    values = category_counts(df, sample, list(categorical), samples) if categorical else None
    frames = []
    for i, other in enumerate(others):
        parts = ([_psi(counts, i + 1, **kw)] if numeric else []) + ([_psi_of_categories(values, i + 1)] if categorical else [])
        frames += [p.withColumn("compared", F.lit(other)) for p in parts]
    out = reduce(lambda a, b: a.unionByName(b), frames)
    return out.withColumns({"index": F.when(F.col("variable") == (score or ""), "PSI").otherwise("CSI"), "band": stability_band()})
