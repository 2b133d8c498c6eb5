"""Quality scores: ridge regression on random Fourier features of a text's statistics, calibrated by isotonic regression.

The statistics (text_stats.py) of every document are computed once and written. Standardised, they are mapped to
cosines of random directions, whose products approximate a Gaussian kernel. The cosines are rounded to whole numbers,
so that the sums for the normal equations are exact and do not depend on how the rows are dealt: each task adds up
its rows, Spark adds up the tasks, and the driver solves one small system for each fold and each weight of the ridge.
The folds come from the statistics themselves, so that copies fall into one fold. The weight with the least error on
the rows left out is taken; scores of left-out rows, counted in bins, give the isotonic calibration (pool adjacent
violators), between whose steps scores are interpolated.

All labelled rows that may be learned from are used; nothing is sampled.

Defined cases: a null text is an empty one; empty texts have statistics of 0 and a score like any other; texts are
taken whole; a row without an id is not held out and has no label; labels of one id are averaged, null labels left
out; repeated rows count as often as they occur; if nothing can be learned all scores are 0.5; if all labels are equal
that label is the score; an empty table gives an empty result; other columns are not looked at.
"""

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType

from lendgrain.llm.shared import new_folder, staged
from lendgrain.llm.text_stats import NAMES, described

SEED = 12_007
FEATURES = 256
BANDWIDTH = 5.0
UNIT = 1 << 10
FOLDS = 5
RIDGES = (1e-4, 1e-3, 1e-2, 1e-1)
BINS = 1 << 12
ROWS = 4096
CUT = 0.7
CLIP = 8.0


def held_out(id_col: str):
    """One document in four, by its id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string")) % 4 == 2, F.lit(False))


def statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, stats."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                values = np.array([described(t.as_py() or b"") for t in some.column(1)], np.float64)
                yield pa.RecordBatch.from_arrays([some.column(0), lists(values)], ["doc_id", "stats"])

    return rows.mapInArrow(run, StructType([rows.schema["doc_id"]]).add("stats", ArrayType(DoubleType())))


def lists(rows: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(rows.ravel()))


def matrix(column) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Cosines:
    """Statistics to random Fourier features, as whole numbers of 1 / UNIT; the last one is constant."""

    def __init__(self, mean, spread, features=FEATURES, bandwidth=BANDWIDTH):
        draw = np.random.Generator(np.random.Philox(SEED))
        self.mean, self.spread = mean, spread
        self.directions = draw.standard_normal((len(mean), features)) / bandwidth
        self.shifts = draw.uniform(0, 2 * np.pi, features)

    def __call__(self, stats: np.ndarray) -> np.ndarray:
        x = np.clip((stats - self.mean) / self.spread, -CLIP, CLIP)
        z = np.rint(np.cos(x @ self.directions + self.shifts) * UNIT)
        return np.hstack([z, np.full((len(z), 1), float(UNIT))])


def folds(stats: np.ndarray, n: int) -> np.ndarray:
    return np.array([zlib.crc32(np.round(s, 9).tobytes()) % n for s in stats])


def normal_sums(rows: DataFrame, cosines: Cosines) -> np.ndarray:
    """For each fold the sums of n z z', y z and, last, of n and y over the rows (stats, n labels, y of them 1)."""
    size = len(cosines.shifts) + 1

    def add(batches):
        total = None
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                stats, n, y = matrix(some.column(0)), some.column(1).to_numpy(), some.column(2).to_numpy()
                total = np.zeros((FOLDS, size, size + 3), np.int64) if total is None else total
                of = folds(stats, FOLDS)
                for k in np.unique(of):
                    z, m, t = cosines(stats[of == k]), n[of == k].astype(np.float64), y[of == k].astype(np.float64)
                    # whole numbers below 2**53, so exact
                    total[k] += np.hstack([(z * m[:, None]).T @ z, (z.T @ t)[:, None], np.tile([m.sum(), t.sum()], (size, 1))]).astype(np.int64)
        if total is not None:
            for k in range(FOLDS):
                yield sums([k] * size, range(size), total[k])

    def sums(fold, row, values):
        return pa.RecordBatch.from_arrays([pa.array(fold, pa.int32()), pa.array(row, pa.int32()), lists(values)], ["fold", "row", "values"])

    def add_up(batches):
        total = {}
        for b in batches:
            for key, v in zip(zip(b.column(0).to_pylist(), b.column(1).to_pylist()), matrix(b.column(2)) if b.num_rows else []):
                total[key] = total[key] + v if key in total else v
        if total:
            yield sums([k for k, _ in total], [r for _, r in total], np.stack(list(total.values())))

    kind = "fold int, row int, values array<long>"
    out = np.zeros((FOLDS, size, size + 3), np.int64)
    for r in rows.mapInArrow(add, kind).repartition("fold", "row").mapInArrow(add_up, kind).collect():  # a row per fold and feature
        out[r["fold"], r["row"]] = r["values"]
    return out


def solved(sums: np.ndarray, ridge: float) -> np.ndarray:
    """Weights of the features; sums as from normal_sums, over some folds."""
    size, n = len(sums), max(int(sums[0, -2]), 1)
    gram = sums[:, :size] / (UNIT * UNIT)
    penalty = np.full(size, ridge * n)
    penalty[-1] = 1e-9
    return np.linalg.solve(gram + np.diag(penalty), sums[:, size] / UNIT)


def chosen(sums: np.ndarray):
    """The weight of the ridge with the least squared error on the folds left out, and the weights without each fold."""
    best = None
    for ridge in RIDGES:
        weights, error = [], 0.0
        for k in range(FOLDS):
            w = solved(sums.sum(axis=0) - sums[k], ridge)
            gram, cross = sums[k, :, :len(w)] / (UNIT * UNIT), sums[k, :, len(w)] / UNIT
            error += sums[k, 0, -1] - 2 * w @ cross + w @ gram @ w
            weights.append(w)
        if best is None or error < best[0]:
            best = error, ridge, np.stack(weights)
    return best[1:]


def isotonic(at: np.ndarray, n: np.ndarray, y: np.ndarray):
    """Pool adjacent violators: places in order with n labels, y of them 1 -> (places, values), the ends of each pool."""
    pools = []
    for x, m, t in zip(at.tolist(), n.tolist(), y.tolist()):
        pools.append([x, x, m, t])
        while len(pools) > 1 and pools[-2][3] * pools[-1][2] >= pools[-1][3] * pools[-2][2]:
            _, high, m, t = pools.pop()
            pools[-1][1:] = [high, pools[-1][2] + m, pools[-1][3] + t]
    return np.array([x for p in pools for x in p[:2]], np.float64), np.array([p[3] / p[2] for p in pools for _ in "ab"], np.float64)


class Model:
    def __init__(self, cosines=None, weights=None, places=None, values=None):
        self.cosines, self.weights, self.places, self.values = cosines, weights, places, values

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.cosines(stats) @ self.weights / UNIT

    def score(self, stats: np.ndarray) -> np.ndarray:
        if self.cosines is None:
            return np.full(len(stats), 0.5)
        return np.clip(np.interp(np.rint(self.raw(stats) * BINS), self.places, self.values), 0, 1)


def fit(rows: DataFrame, features=FEATURES, bandwidth=BANDWIDTH) -> Model:
    """rows: stats, n (labels of the document), y (how many are 1)."""
    first = rows.agg(*[f(F.col("stats")[i]) for f in (F.avg, F.stddev_pop) for i in range(len(NAMES))]).first()
    if first[0] is None:
        return Model()
    # rounded, so that the order in which Spark adds up does not show
    mean, spread = (np.array([float(f"{x:.6g}") for x in first[i:i + len(NAMES)]]) for i in (0, len(NAMES)))
    cosines = Cosines(mean, np.where(spread > 1e-9, spread, 1.0), features, bandwidth)
    sums = normal_sums(rows, cosines)
    ridge, left_out = chosen(sums)

    def bins(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                stats = matrix(some.column(0))
                raw = np.einsum("ij,ij->i", cosines(stats), left_out[folds(stats, FOLDS)]) / UNIT
                yield pa.RecordBatch.from_arrays([pa.array(np.rint(np.clip(raw, -1, 2) * BINS).astype(np.int64)), some.column(1), some.column(2)], ["at", "n", "y"])

    counted = rows.mapInArrow(bins, "at long, n long, y long").groupBy("at").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    counted = sorted(map(tuple, counted.collect()))  # 3 * BINS rows at most
    return Model(cosines, solved(sums.sum(axis=0), ridge), *isotonic(*np.array(counted, np.int64).T))


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    known = labels.where(F.col(f"`{label_col}`").isNotNull()).groupBy(F.col(f"`{id_col}`").alias("doc_id")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(f"`{label_col}`").cast("long")).alias("y"))
    return stats.where(~held_out("doc_id")).join(known, "doc_id").select("stats", "n", "y")


def quality(docs: DataFrame, labels: DataFrame, folder: str | None = None, id_col="doc_id", text_col="text", label_col="quality", cut=CUT,
            features=FEATURES, bandwidth=BANDWIDTH) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted. Stages go to the folder."""
    folder = folder or new_folder(docs.sparkSession, "quality")
    stats = staged(statistics(docs, id_col, text_col), f"{folder}/stats")
    rows = staged(training_rows(stats, labels, id_col, label_col), f"{folder}/labelled")
    model = fit(rows, features, bandwidth)

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                some = b.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(model.score(matrix(some.column(1))), pa.float64())], ["doc_id", "score"])

    scored = stats.mapInArrow(run, StructType([stats.schema["doc_id"]]).add("score", "double"))
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
