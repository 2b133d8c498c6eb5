"""Which variables go into a model."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.functions import fixed_values as V
from lendgrain.operators.relational import unpivot
from lendgrain.session import cut_lineage

GROUPS = 16


def variances(df, cols):
    """Sample variance per variable, in one pass."""
    return unpivot(df.select(*[F.col(c).cast("double").alias(c) for c in cols]), [], cols).groupBy("variable").agg(
        F.var_samp("value").alias("variance"))


def drop_constant(df, cols):
    """Names of the columns that vary (one row per variable is brought to the driver)."""
    keep = {r["variable"] for r in variances(df, cols).filter("variance <> 0").collect()}
    return [c for c in cols if c in keep]


def screen(variables, blacklist, codes=tuple(V.BLACKLIST_CODES), extra=()):
    """variables(attribute) less the blacklisted ones and the names in `extra`."""
    bad = blacklist.filter(F.col("blacklist").isin(list(codes))).select("attribute").distinct()
    out = variables.join(bad, "attribute", "left_anti")
    return out.filter(~F.col("attribute").isin(list(extra))) if extra else out


def screen_text(variables, dictionary, patterns, text="description"):
    """Drops variables whose dictionary text contains any of the phrases. Unknown text is kept."""
    hit = "|".join(p.replace(".", r"\.") for p in patterns)
    bad = dictionary.filter(F.col(text).rlike(hit)).select("attribute").distinct()
    return variables.join(bad, "attribute", "left_anti")


def pick(well_binned, iv, importance, floor=0.1):
    """(well binned and IV above floor) or (well binned and used by the booster), as one name column."""
    strong = iv.filter(F.col("iv") > floor).select("variable")
    return well_binned.intersect(strong).union(well_binned.intersect(importance)).distinct()


class Moments:
    """Number of rows, means and sums of centred products of some variables: all that correlations need."""

    def __init__(self, names, n, mean, products):
        self.names, self.n, self.mean, self.products = list(names), n, mean, products

    def place(self, names):
        at = {c: i for i, c in enumerate(self.names)}
        return [at[c] for c in names]

    def variance(self, names=None):
        i = self.place(names or self.names)
        return np.diag(self.products)[i] / max(self.n - 1, 1)

    def correlation(self, names=None):
        i = self.place(names or self.names)
        p = self.products[np.ix_(i, i)]
        d = np.sqrt(np.diag(p))
        return p / np.outer(d, d)

    def vif(self, names):
        """Variance inflation factor of each of the variables among these; inf if one is a sum of others."""
        m = self.correlation(names)
        if len(names) > 1 and np.linalg.cond(m) > 1e12:
            inner = [1 - m[i, j] @ np.linalg.pinv(m[np.ix_(j, j)]) @ m[j, i] for i in range(len(names)) for j in [[k for k in range(len(names)) if k != i]]]
            return {c: float("inf") if x < 1e-9 else float(1 / x) for c, x in zip(names, inner)}
        return dict(zip(names, np.diag(np.linalg.inv(m)).tolist()))


def joined_moments(a, b):
    """(n, mean, products) of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    n, step = a[0] + b[0], b[1] - a[1]
    return n, a[1] + step * (b[0] / n), a[2] + b[2] + np.outer(step, step) * (a[0] * b[0] / n)


def moments(df, cols) -> Moments:
    """Moments of the rows that have all the variables, in one pass: each task adds up its rows, some tasks the tasks,
    and the driver what is left (variables x variables numbers)."""
    cols, kind = list(cols), "n double, mean array<double>, products array<double>"
    rows = df.select(*[F.col(f"`{c}`").cast("double") for c in cols]).toDF(*[f"x{i}" for i in range(len(cols))]).na.drop()

    def put(found):
        return pa.RecordBatch.from_arrays([pa.array([found[0]]), pa.array([found[1].tolist()]), pa.array([found[2].ravel().tolist()])], ["n", "mean", "products"])

    def add(batches):
        total = None
        for b in batches:
            if b.num_rows:
                x = np.stack([c.to_numpy(zero_copy_only=False) for c in b.columns], axis=1)
                mean = x.mean(axis=0)
                total = joined_moments(total, (float(len(x)), mean, (x - mean).T @ (x - mean)))
        if total:
            yield put(total)

    def add_up(batches):
        total = None
        for b in batches:
            for r in b.to_pylist():
                total = joined_moments(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(cols), -1)))
        if total:
            yield put(total)

    total = None
    for r in rows.mapInArrow(add, kind).repartition(GROUPS).mapInArrow(add_up, kind).collect():  # GROUPS rows at most
        total = joined_moments(total, (r["n"], np.array(r["mean"]), np.array(r["products"]).reshape(len(cols), -1)))
    if total is None:
        total = 0.0, np.zeros(len(cols)), np.zeros((len(cols), len(cols)))
    return Moments(cols, *total)


def correlations(df, cols):
    """Pearson matrix of the columns: (variables x variables) numbers on the driver."""
    return moments(df, cols).correlation()


def low_correlation(df, ordered, threshold, found=None):
    """Walks the variables best first and drops the later ones of each pair at or above threshold. found: their moments,
    if they are known."""
    m = (found or moments(df, ordered)).correlation(ordered)
    kept = []
    for i in range(len(ordered)):
        if all(abs(m[i][j]) < threshold for j in kept):
            kept.append(i)
    return [ordered[i] for i in kept]


def vif(df, cols):
    """Variance inflation factor per column, from the inverse correlation matrix."""
    return moments(df, cols).vif(list(cols))


def accepted(df, cols, target, weight=None, max_vif=2.0, max_p=0.001):
    """Backward steps to a model whose variables all have a coefficient of at least 0, a p-value below max_p and a
    variance inflation below max_vif. Inflation is settled first, from one matrix of moments, the largest going first
    (the later of equal ones); then models are fitted, the variable furthest from the rule going first: those with the
    lowest coefficient below 0, then the highest p-value. Gives (variables, [(variable, reason) in the order of going])."""
    from lendgrain.modelling.models import fit_glm, glm_numbers
    found, left, gone = moments(df, cols), list(cols), []
    flat = dict(zip(found.names, found.variance()))
    for c in [c for c in left if not flat[c] > 0]:
        left.remove(c)
        gone.append((c, "constant"))
    while len(left) > 1:
        inflation = found.vif(left)
        worst = max(reversed(left), key=inflation.__getitem__)
        if inflation[worst] < max_vif:
            break
        left.remove(worst)
        gone.append((worst, "inflation"))
    rows = cut_lineage(df.select(target, *([weight] if weight else []), *left))  # read by every fit
    while left:
        numbers = glm_numbers(fit_glm(rows, left, target, weight), left)
        low = min(left, key=lambda c: numbers[c][0])
        unsure = max(left, key=lambda c: numbers[c][1])
        if numbers[low][0] < 0:
            left.remove(low)
            gone.append((low, "coefficient"))
        elif numbers[unsure][1] >= max_p:
            left.remove(unsure)
            gone.append((unsure, "p-value"))
        else:
            break
    return left, gone


STATS = "variable string, n long, missing long, least double, most double, total double"


def column_profile(df, cols) -> DataFrame:
    """(variable, numeric, n, missing, least, most, mean, constant) of any number of columns in one pass. A column that
    is no number has its counts only; constant is true where no two values differ, or there is none."""
    kinds = dict(df.select(*[F.col(f"`{c}`") for c in cols]).dtypes)
    numeric = [c for c in cols if kinds[c].startswith("decimal") or kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")]
    own, where = {c: f"c{i}" for i, c in enumerate(cols)}, set(numeric)
    rows = df.select(*[(F.col(f"`{c}`").cast("double") if c in where else F.col(f"`{c}`").isNotNull().cast("boolean")).alias(own[c]) for c in cols])

    def add(batches):
        for b in batches:
            out = []
            for c in cols:
                x = b.column(own[c])
                if c in where:
                    x = x.to_numpy(zero_copy_only=False)
                    x = x[~np.isnan(x)]
                    out.append((c, len(x), b.num_rows - len(x), *([float(x.min()), float(x.max()), float(x.sum())] if len(x) else [None] * 3)))
                else:
                    n = x.true_count
                    out.append((c, n, b.num_rows - n, None, None, None))
            types = [pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), types)], ["variable", "n", "missing", "least", "most", "total"])

    parts = rows.mapInArrow(add, STATS).groupBy("variable").agg(F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.min("least").alias("least"), F.max("most").alias("most"), F.sum("total").alias("total"))
    constant = F.coalesce(F.col("least") == F.col("most"), F.lit(True))
    is_number = F.col("variable").isin(numeric) if numeric else F.lit(False)
    return parts.select("variable", is_number.alias("numeric"), "n", "missing", "least", "most", F.try_divide("total", "n").alias("mean"),
                        F.when(is_number, constant).alias("constant"))


def model_variables(df, blacklist, codes=tuple(V.BLACKLIST_CODES), extra=()) -> DataFrame:
    """(variable, reason): the columns that the blacklist's table knows, with the reason not to model on one, null for
    those that stay: `blacklisted`, `not numeric` or `constant`. One pass over the data, whatever the number of columns."""
    names = F.lower(F.col("attribute").cast("string"))
    rules = blacklist.groupBy(names.alias("_name")).agg(F.max(F.col("blacklist").isin(list(codes)) | F.col("attribute").cast("string").isin([str(x) for x in extra])).alias("_bad"))
    known = {r["_name"] for r in rules.select("_name").collect()}  # a row per column of the source
    profile = column_profile(df, [c for c in df.columns if c.lower() in known])
    found = profile.join(F.broadcast(rules), F.lower("variable") == F.col("_name"))
    reason = F.when(F.col("_bad"), "blacklisted").when(~F.col("numeric"), "not numeric").when(F.col("constant"), "constant")
    return found.select("variable", reason.alias("reason"))
