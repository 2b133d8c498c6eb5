"""Cutting values into bins, and finding supervised bins."""

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.modelling.quantile import lookup, quantile_edges, value_table

MISSING = -1


def cut(vt: DataFrame, edges: DataFrame, keys=("variable",), open_ends=False) -> DataFrame:
    """Adds `bin` (1-based) by right-closed intervals, the first including its lower edge; a null value
    is MISSING. Outside the edges is null, unless `open_ends` lets the outer bins run to infinity."""
    j = vt.join(lookup(edges, keys, 20), list(keys), "left")
    inner = "greatest(1, size(filter(edges, e -> e < value)))"
    last = "size(edges) - 1"
    if open_ends:
        b = f"least({last}, {inner})"
    else:
        b = f"case when value between edges[0] and edges[{last}] then {inner} end"
    return j.withColumn("bin", F.expr(f"case when value is null then {MISSING} else cast({b} as int) end"))


def hist_bin(value, lo, hi, n):
    """Equal-width bin text: [lo, hi) steps with the last one closed; outside is null."""
    parts = " + ".join(f"case when {value} >= {lo} + {i} * (({hi} - {lo}) / {n}) then 1 else 0 end" for i in range(1, n))
    return f"case when {value} between {lo} and {hi} then 1 + {parts} end"


def bin_counts(cut_values: DataFrame, keys=("variable",), weighted=False) -> DataFrame:
    aggs = [F.min("value").alias("min_value"), F.max("value").alias("max_value"),
            F.sum("n").alias("total"), F.sum("events").alias("events")]
    if weighted:
        aggs += [F.sum("w").alias("w"), F.sum("we").alias("we")]
    return cut_values.groupBy(*keys, "bin").agg(*aggs)


# ---- supervised bins -----------------------------------------------------------------------------------
def _woe(total, events, all_n, all_e):
    good = total - events
    return math.log(((events + 0.5) / (all_e + 0.5)) / ((good + 0.5) / (all_n - all_e + 0.5)))


def merge_bins(rows, min_share=0.05, tolerance=0.02, missing=(0.0, 0.0)):
    """rows: ordered [(hi, total, events)] of one variable; missing: (total, events) of the rows without
    a value, which count in the totals but are merged with nothing. Neighbours are merged until every bin has
    at least min_share of all, both outcomes, a WOE apart from its neighbour's by `tolerance`, and the
    WOE moves one way. At most a few dozen rows, so this is plain Python on the driver."""
    bins = [list(r) for r in rows]
    all_n, all_e = sum(b[1] for b in bins) + missing[0], sum(b[2] for b in bins) + missing[1]

    def join(i):
        bins[i] = [bins[i + 1][0], bins[i][1] + bins[i + 1][1], bins[i][2] + bins[i + 1][2]]
        del bins[i + 1]

    def woe(b):
        return _woe(b[1], b[2], all_n, all_e)

    def weak(b):
        return b[1] < min_share * all_n or b[2] <= 0 or b[2] >= b[1]

    while len(bins) > 1:
        bad = next((i for i, b in enumerate(bins) if weak(b)), None)
        if bad is not None:
            left = bad - 1 if bad > 0 else None
            right = bad + 1 if bad + 1 < len(bins) else None
            near = min((x for x in (left, right) if x is not None), key=lambda x: abs(woe(bins[x]) - woe(bins[bad])))
            join(min(bad, near))
            continue
        w = [woe(b) for b in bins]
        gaps = [abs(w[i + 1] - w[i]) for i in range(len(w) - 1)]
        close = min(range(len(gaps)), key=gaps.__getitem__)
        up = w[-1] >= w[0]
        wrong = [i for i in range(len(gaps)) if (w[i + 1] < w[i]) == up and gaps[i] > 0]
        if gaps[close] < tolerance:
            join(close)
        elif wrong:
            join(min(wrong, key=gaps.__getitem__))
        else:
            break
    return [tuple(b) for b in bins]


def fit_bins(df: DataFrame, target, cols, weight=None, fine=20, min_share=0.05, tolerance=0.02) -> DataFrame:
    """Supervised bins as a table (variable, bin, lo, hi, total, events, woe, reject). Fine quantile bins
    are counted by Spark; only (variables x fine) rows come to the driver to be merged. Rows without a
    value are bin MISSING (no lo and hi), with a WOE of its own; the totals are over all rows."""
    vt = value_table(df, cols, target, weight, keep_null=True)
    edges = quantile_edges(vt.filter(F.col("value").isNotNull()), fine)
    fine_bins = bin_counts(cut(vt, edges, open_ends=True), weighted=bool(weight))
    n_col, e_col = ("w", "we") if weight else ("total", "events")
    by_var, missing = {}, {}
    for r in fine_bins.orderBy("variable", "bin").collect():
        if r["bin"] == MISSING:
            missing[r["variable"]] = float(r[n_col]), float(r[e_col])
        else:
            by_var.setdefault(r["variable"], []).append((r["max_value"], float(r[n_col]), float(r[e_col])))
    out = []
    for v in [*by_var, *[m for m in missing if m not in by_var]]:
        none = missing.get(v, (0.0, 0.0))
        merged = merge_bins(by_var[v], min_share, tolerance, none) if v in by_var else []
        all_n, all_e = sum(b[1] for b in merged) + none[0], sum(b[2] for b in merged) + none[1]
        if v in missing:
            out.append((v, MISSING, None, None, *none, _woe(*none, all_n, all_e), int(len(merged) < 2)))
        lo = float("-inf")
        for i, (hi, n, e) in enumerate(merged):
            top = float("inf") if i == len(merged) - 1 else hi
            out.append((v, i + 1, lo, top, n, e, _woe(n, e, all_n, all_e), int(len(merged) < 2)))
            lo = top
    import pyarrow as pa
    names = ["variable", "bin", "lo", "hi", "total", "events", "woe", "reject"]
    types = [pa.string(), pa.int32()] + [pa.float64()] * 5 + [pa.int32()]
    cols_ = list(zip(*out)) if out else [[] for _ in names]
    return df.sparkSession.createDataFrame(pa.table({n: pa.array(list(c), t) for n, c, t in zip(names, cols_, types)}))


def bins_to_edges(bins: DataFrame) -> DataFrame:
    return bins.filter(F.col("bin") != MISSING).groupBy("variable").agg(F.expr("concat(array(min(lo)), array_sort(collect_list(hi)))").alias("edges"))


def apply_bins(df: DataFrame, bins: DataFrame, cols) -> DataFrame:
    """Adds <col>_bin from fitted bins (the table is variables x bins rows, read on the driver and
    turned into plain comparisons)."""
    upper = {}
    for r in bins.filter(F.col("bin") != MISSING).orderBy("variable", "bin").collect():
        upper.setdefault(r["variable"], []).append((r["bin"], r["hi"]))
    out = {}
    for c in cols:
        value, bin_no = F.col(f"`{c}`"), F.when(F.col(f"`{c}`").isNull(), MISSING)
        for b, hi in upper.get(c, [(MISSING, None)])[:-1]:
            bin_no = bin_no.when(value <= hi, b)
        out[f"{c}_bin"] = bin_no.otherwise(upper.get(c, [(MISSING, None)])[-1][0])
    return df.withColumns(out)
