"""Boosted trees on counted rows: second-order boosting of small trees, as long as it takes.

The variables are cut at fitted edges and rows of equal cuts are counted once, with their weight and weighted
events; 1,000 and more rounds then walk this table and not the source. Where it is small (its rows are counted) all
rounds run over it in one task. Beyond that it is kept in blocks of arrays, each level of splits is a small job over
them (leaves have their sums from the split above), and the margins are written anew every few rounds. Gradients are
whole numbers, so that both ways, and any number of partitions, give the same trees.

A tree takes the split with the largest gain, T(G)**2 / (H + l2) of both sides less that of the whole, with
T(G) = sign(G) * max(|G| - l1, 0); splits that gain less than gamma are cut back from the leaves up. Rows without a
value go to the side that gains more.
"""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.modelling.quantile import quantile_edges, value_table
from lendgrain.session import checkpoint_dir, cut_lineage

UNIT = 1 << 20
ONE_TASK = 200_000
SETTLE = 25
LEAST_GAIN = 1e-6


@dataclass(frozen=True)
class Settings:
    """Fields are named for what they do: l1 and l2 punish large leaves, gamma is the least gain of a split that is
    kept, least_hessian the least of a side's sum of p * (1 - p), rows and columns the shares drawn for each round."""
    depth: int
    eta: float
    rounds: int
    rows: float = 1.0
    columns: float = 1.0
    l1: float = 0.0
    l2: float = 1.0
    gamma: float = 0.0
    least_hessian: float = 1.0
    bins: int = 64
    seed: int = 99


# the two settings used: many stumps to rank variables, slower deeper trees for the first cut
SELECTION = Settings(depth=1, eta=0.1, rounds=1500)
FIRST_CUT = Settings(depth=2, eta=0.01, rounds=1000, rows=0.75, columns=0.75, l1=8, l2=2, gamma=40, least_hessian=50)


@dataclass
class Tree:
    """Nodes in heap order (children of i are 2 i + 1 and 2 i + 2); variable -1 is a leaf."""
    variable: np.ndarray
    cut: np.ndarray  # bins up to this one go left
    missing_left: np.ndarray
    value: np.ndarray
    gain: np.ndarray
    hessian: np.ndarray

    @staticmethod
    def empty(depth: int) -> "Tree":
        n = (2 << depth) - 1
        return Tree(np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, bool), np.zeros(n), np.zeros(n), np.zeros(n))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        """The leaf of each row; bins: rows x variables, 0 for a missing value."""
        at = np.zeros(len(bins), np.int64)
        while True:
            v = self.variable[at]
            inner = v >= 0
            if not inner.any():
                return at
            b = bins[np.arange(len(bins)), np.maximum(v, 0)]
            left = np.where(b == 0, self.missing_left[at], b <= self.cut[at])
            at = np.where(inner, 2 * at + 2 - left, at)


@dataclass
class Booster:
    columns: list
    edges: dict  # the upper ends of a variable's bins but the last
    settings: Settings
    trees: list = field(default_factory=list)

    def binned(self, values: dict) -> np.ndarray:
        """values: numpy arrays by column, nan for missing."""
        return np.stack([np.where(np.isnan(x), 0, 1 + np.searchsorted(self.edges[c], x, "left")) for c, x in ((c, values[c]) for c in self.columns)], axis=1).astype(np.int16)

    def margin(self, bins: np.ndarray, trees=None) -> np.ndarray:
        out = np.zeros(len(bins))
        for t in self.trees if trees is None else trees:
            out += t.value[t.nodes(bins)]
        return out


def fitted_edges(df: DataFrame, cols, bins: int) -> dict:
    """Inner quantile edges of each variable (variables x bins numbers)."""
    found = {r["variable"]: np.array(r["edges"][1:-1], np.float64) for r in quantile_edges(value_table(df, cols), bins).collect()}
    return {c: found.get(c, np.zeros(0)) for c in cols}


def as_values(batch, cols) -> dict:
    return {c: batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols}


def counted(df: DataFrame, booster: Booster, target, weight=None) -> DataFrame:
    """One row per combination of bins: bins (16 bits each), copies, w, we."""
    cols = booster.columns

    def run(batches):
        for b in batches:
            rows = booster.binned(as_values(b, cols))
            yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in rows], pa.binary()), b.column("_y"), b.column("_w")], ["bins", "y", "w"])

    w = F.lit(1.0) if weight is None else F.col(f"`{weight}`").cast("double")
    x = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols], F.col(f"`{target}`").cast("double").alias("_y"), w.alias("_w"))
    rows = x.mapInArrow(run, "bins binary, y double, w double")
    return cut_lineage(rows.groupBy("bins").agg(F.count(F.lit(1)).alias("copies"), F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("we")))


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Some rows of the counted table, with their margins."""

    def __init__(self, batch, width: int):
        self.bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), np.int16).reshape(-1, width)
        self.copies, self.w, self.we = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("copies", "w", "we"))
        self.margin = np.zeros(len(self.bins))
        key = np.zeros(len(self.bins), np.uint64)
        for column in self.bins.T:
            key = mixed(key * np.uint64(31) + column.astype(np.uint64) + np.uint64(1))
        self.key = key

    def drawn(self, settings: Settings, turn: int) -> np.ndarray:
        """The part of each row's copies that the round takes: their share, rounded up or down by chance."""
        if settings.rows >= 1:
            return np.ones(len(self.key))
        chance = (mixed(self.key + np.uint64(settings.seed * 1_000_003 + turn)) >> np.uint64(11)) / float(1 << 53)
        return np.floor(self.copies * settings.rows + chance) / self.copies

    def histograms(self, tree: Tree, level: int, settings: Settings, turn: int, variables) -> np.ndarray:
        """Sums of gradients and hessians, whole numbers: (nodes of the level, variables, bins + 1, 2)."""
        first, n = (1 << level) - 1, 1 << level
        node = tree.nodes(self.bins) - first
        some = (node >= 0) & (node < n)
        p = 1 / (1 + np.exp(-self.margin))
        part = self.drawn(settings, turn)
        gh = np.rint(np.stack([(self.w * p - self.we) * part, self.w * p * (1 - p) * part], axis=1) * UNIT)[some]
        out = np.zeros((n, len(variables), settings.bins + 1, 2), np.int64)
        for k, v in enumerate(variables):
            place = node[some] * (settings.bins + 1) + self.bins[some, v]
            for j in range(2):  # sums of whole numbers below 2**53 are exact
                out[:, k, :, j] = np.bincount(place, gh[:, j], n * (settings.bins + 1)).reshape(n, -1).astype(np.int64)
        return out


def strength(g, h, s: Settings):
    return np.maximum(np.abs(g) - s.l1, 0) ** 2 / (h + s.l2)


def best_splits(hist: np.ndarray, s: Settings) -> list:
    """(gain, variable's place, cut, missing go left, G, H, G and H of the left side) of each node; gain 0 where no split
    is any good."""
    sums = hist / UNIT
    out = []
    for node in sums:
        g, h = node[0].sum(axis=0)
        best = (0.0, -1, 0, False, g, h, 0.0, 0.0)
        inner = np.cumsum(node[:, 1:], axis=1)[:, :-1]  # left of each cut, without the missing
        for missing_left in (False, True):
            left = inner + (node[:, :1] if missing_left else 0)
            gl, hl = left[..., 0], left[..., 1]
            gr, hr = g - gl, h - hl
            gain = strength(gl, hl, s) + strength(gr, hr, s) - strength(g, h, s)
            gain = np.where((hl >= s.least_hessian) & (hr >= s.least_hessian), gain, 0.0)
            if gain.size and gain.max() > best[0] + LEAST_GAIN:
                v, k = np.unravel_index(gain.argmax(), gain.shape)
                best = (float(gain[v, k]), int(v), int(k) + 1, missing_left, g, h, gl[v, k], hl[v, k])
        out.append(best)
    return out


def grow(tree: Tree, level: int, splits: list, variables, s: Settings) -> None:
    """Settles the nodes of a level and the two below each that is split, whose sums the split has."""
    def settle(i, g, h):
        tree.value[i] = -s.eta * np.sign(g) * max(abs(g) - s.l1, 0) / (h + s.l2)
        tree.hessian[i] = h

    for k, (gain, v, cut, missing_left, g, h, gl, hl) in enumerate(splits):
        i = (1 << level) - 1 + k
        settle(i, g, h)
        if gain > 0 and level < s.depth:
            tree.variable[i], tree.cut[i], tree.missing_left[i], tree.gain[i] = variables[v], cut, missing_left, gain
            settle(2 * i + 1, gl, hl)
            settle(2 * i + 2, g - gl, h - hl)


def cut_back(tree: Tree, s: Settings) -> None:
    """Takes out splits into two leaves that gain less than gamma, from the leaves up."""
    for i in range(len(tree.variable) // 2 - 1, -1, -1):
        leaves = tree.variable[[2 * i + 1, 2 * i + 2]] < 0
        if tree.variable[i] >= 0 and leaves.all() and tree.gain[i] < s.gamma:
            tree.variable[i], tree.gain[i] = -1, 0.0


def drawn_columns(s: Settings, turn: int, n: int) -> np.ndarray:
    if s.columns >= 1:
        return np.arange(n)
    draw = np.random.Generator(np.random.Philox(key=[s.seed, turn]))
    return np.sort(draw.choice(n, max(1, int(n * s.columns)), replace=False))


def boosted(settings: Settings, n_columns: int, sums, settle=None) -> list:
    """The trees. sums(tree, level, turn, variables): the histograms of all rows; settle(trees, i): told after each round."""
    trees = []
    for turn in range(settings.rounds):
        tree, variables = Tree.empty(settings.depth), drawn_columns(settings, turn, n_columns)
        for level in range(max(settings.depth, 1)):
            if level and not (tree.variable[(1 << (level - 1)) - 1:(1 << level) - 1] >= 0).any():
                break
            grow(tree, level, best_splits(sums(tree, level, turn, variables), settings), variables, settings)
        cut_back(tree, settings)
        trees.append(tree)
        if settle:
            settle(trees, turn)
    return trees


FIELDS = {"variable": "int", "cut": "int", "missing_left": "boolean", "value": "double", "gain": "double", "hessian": "double"}


KIND = "turn int, node int, variable long, cut long, missing_left boolean, value double, gain double, hessian double"


def as_batches(trees):
    for turn, t in enumerate(trees):
        n = len(t.variable)
        yield pa.RecordBatch.from_arrays([pa.array([turn] * n, pa.int32()), pa.array(range(n), pa.int32()), *[pa.array(getattr(t, f)) for f in FIELDS]], ["turn", "node", *FIELDS])


def as_trees(df: DataFrame, settings: Settings) -> list:
    rows = sorted(df.collect())  # rounds x nodes rows
    nodes = (2 << settings.depth) - 1
    return [Tree(*(np.array([r[i + 2] for r in rows[k:k + nodes]]) for i in range(len(FIELDS)))) for k in range(0, len(rows), nodes)]


def in_one_task(table: DataFrame, booster: Booster) -> list:
    """All rounds over the whole table, which has been counted and is small."""
    settings, width = booster.settings, len(booster.columns)

    def run(batches):
        block = Block(pa.Table.from_batches(list(batches)).combine_chunks(), width)

        def settle(trees, _):
            block.margin += trees[-1].value[trees[-1].nodes(block.bins)]

        yield from as_batches(boosted(settings, width, lambda tree, level, turn, variables: block.histograms(tree, level, settings, turn, variables), settle))

    return as_trees(table.coalesce(1).mapInArrow(run, KIND), settings)


def blocks_of(table: DataFrame, width: int):
    """The counted table as an RDD of Blocks, a batch of rows in each."""
    names = ("copies", "w", "we")

    def pack(batches):
        for b in batches:
            if b.num_rows:
                block = Block(b, width)
                yield pa.RecordBatch.from_arrays([pa.array([getattr(block, n).tobytes()], pa.binary()) for n in ("bins", "key", *names)], ["bins", "key", *names])

    def unpack(r):
        block = Block.__new__(Block)
        block.bins, block.key = np.frombuffer(r["bins"], np.int16).reshape(-1, width), np.frombuffer(r["key"], np.uint64)
        block.copies, block.w, block.we = (np.frombuffer(r[n], np.float64) for n in names)
        block.margin = np.zeros(len(block.bins))
        return block

    return table.mapInArrow(pack, ", ".join(f"{n} binary" for n in ("bins", "key", *names))).rdd.map(unpack)


def over_the_cluster(table: DataFrame, booster: Booster) -> list:
    """A job for each level of splits. The blocks' margins are those of the trees up to the last time they were written."""
    settings, width = booster.settings, len(booster.columns)
    checkpoint_dir(table.sparkSession)

    def written(blocks):
        blocks = blocks.persist(StorageLevel.MEMORY_AND_DISK)
        blocks.checkpoint()
        blocks.count()
        return blocks

    state = {"blocks": written(blocks_of(table, width)), "trees": []}

    def sums(tree, level, turn, variables):
        recent = state["trees"]

        def part(blocks):
            total = None
            for block in blocks:
                block.margin = block.margin + booster.margin(block.bins, recent)
                h = block.histograms(tree, level, settings, turn, variables)
                total = h if total is None else total + h
            return [] if total is None else [total]

        return state["blocks"].mapPartitions(part).treeReduce(np.add, 2)

    def settle(trees, turn):
        state["trees"] = [*state["trees"], trees[-1]]
        if len(state["trees"]) == SETTLE and turn + 1 < settings.rounds:
            recent, before = state["trees"], state["blocks"]

            def moved(block):
                block.margin = block.margin + booster.margin(block.bins, recent)
                return block

            state["blocks"], state["trees"] = written(before.map(moved)), []
            before.unpersist()

    trees = boosted(settings, width, sums, settle)
    state["blocks"].unpersist()
    return trees


def fit(df: DataFrame, cols, target, settings: Settings = SELECTION, weight=None, one_task=ONE_TASK) -> Booster:
    """one_task: up to so many rows of the counted table all rounds run in one task. A frame without rows has no trees."""
    booster = Booster(list(cols), fitted_edges(df, cols, settings.bins), settings)
    table = counted(df, booster, target, weight)
    n = table.count()
    if n:
        booster.trees = (in_one_task if n <= one_task else over_the_cluster)(table, booster)
    return booster


def predict(booster: Booster, df: DataFrame, name="prob") -> DataFrame:
    """Adds the probability of an event."""
    from pyspark.sql.types import DoubleType, StructType
    cols, kept, lead = booster.columns, df.columns, "_in"
    while any(c.lower().startswith(lead) for c in kept):
        lead = "_" + lead
    own = {c: f"{lead}_{i}" for i, c in enumerate(cols)}

    def run(batches):
        for b in batches:
            bins = booster.binned({c: b.column(own[c]).to_numpy(zero_copy_only=False).astype(np.float64) for c in cols})
            prob = 1 / (1 + np.exp(-booster.margin(bins)))
            yield pa.RecordBatch.from_arrays([*b.columns[:len(kept)], pa.array(prob)], [*kept, name])

    x = df.select(*[F.col(f"`{c}`") for c in kept], *[F.col(f"`{c}`").cast("double").alias(own[c]) for c in cols])
    return x.mapInArrow(run, StructType(list(df.schema.fields)).add(name, DoubleType()))


def importance(booster: Booster, spark, dictionary=None) -> DataFrame:
    """(variable, gain, cover, frequency): shares of all gain, of the hessians that pass the splits, and of the splits."""
    from lendgrain.functions.lookups import small_frame
    n = len(booster.columns)
    gain, cover, splits = np.zeros(n), np.zeros(n), np.zeros(n)
    for t in booster.trees:
        some = t.variable >= 0
        for total, what in ((gain, t.gain[some]), (cover, t.hessian[some]), (splits, np.ones(some.sum()))):
            np.add.at(total, t.variable[some], what)
    share = lambda x: (x / max(x.sum(), 1e-300)).tolist()
    out = small_frame(spark, {"variable": (booster.columns, pa.string()), "gain": (share(gain), pa.float64()), "cover": (share(cover), pa.float64()), "frequency": (share(splits), pa.float64())})
    return out.join(dictionary, "variable", "left") if dictionary is not None else out
