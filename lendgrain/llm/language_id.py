"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1, drawn from the letter's code point alone. A run of three letters is
bound into one vector: the first letter's rotated twice, times the second's rotated once, times the third's. A
document's vector is the bundle (sum) of its runs, a language's prototype the bundle of its training documents, each
weighted by one over its number of runs. A document goes to the language whose prototype has the largest cosine
with its vector; that cosine, not below 0, is the score.

Runs are taken over lower-cased letters, with one blank standing for whatever else; a run's middle is a letter. The
weights are whole numbers, so that the sums do not depend on the order of the rows. Training gathers the weight of
each run in each language; Spark adds these up, every run is bound once, and Spark adds up one vector for each task
and language. The prototypes (languages x size numbers) are sent to all tasks. A task keeps the bound vectors of a
bounded number of runs.

Defined cases: a text that is null or has no letter is `und` with score 0, as is every text if nothing could be
learned; ties go to the language first in order; rows with a null language or without letters teach nothing; a row
without an id belongs to the held-out third like no other and teaches nothing; texts are taken whole, in pieces;
repeated rows count as often as they occur; an empty table gives an empty result; extra columns are passed through.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import kept, own_name

SIZE = 2048
SEED = 20_111
PIECE = 1 << 18
SCALE = 1 << 16
UNDETERMINED = "und"
DENSE = 1 << 20
ROWS = 512
BLOCK = 3 << 18
RUNS = 1024
KEPT_RUNS = 1 << 13
HELD_WEIGHTS = 1 << 21


def letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return kept("letters", lambda: np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))


def letter_vector(point: int, size: int) -> np.ndarray:
    """The random vector of a code point; 0 is the blank."""
    held = kept("letter_vectors", dict)
    if (point, size) not in held:
        bits = np.random.Generator(np.random.Philox(key=[SEED, point])).integers(0, 2, size, dtype=np.int8)
        held[point, size] = (bits * 2 - 1).astype(np.float32)
    return held[point, size]


def run_vectors(points: np.ndarray, size: int) -> np.ndarray:
    """Bound vectors of runs; points: three code points a row."""
    out = np.empty((len(points), size), np.float32)
    for at in range(0, len(points), RUNS):
        part, bound = points[at:at + RUNS], None
        for k in range(3):
            some, back = np.unique(part[:, k], return_inverse=True)
            turned = np.stack([np.roll(letter_vector(int(p), size), 2 - k) for p in some])[back]
            bound = turned if bound is None else bound * turned
        out[at:at + RUNS] = bound
    return out


def run_keys(points: np.ndarray) -> np.ndarray:
    """Three code points of 21 bits each as one number."""
    return (points[:, 0] << 42) | (points[:, 1] << 21) | points[:, 2]


def key_points(keys: np.ndarray) -> np.ndarray:
    return np.stack([keys >> 42, (keys >> 21) & 0x1FFFFF, keys & 0x1FFFFF], axis=1)


class BoundRuns:
    """run_vectors() that remembers up to `most` runs, a byte a number."""

    def __init__(self, size: int, most: int = KEPT_RUNS):
        self.size, self.keys, self.places = size, np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.table = np.empty((most, size), np.int8)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        keys, out = run_keys(points), np.empty((len(points), self.size), np.float32)
        at = np.searchsorted(self.keys, keys)
        known = at < len(self.keys)
        known[known] = self.keys[at[known]] == keys[known]
        out[known] = self.table[self.places[at[known]]]
        rest = np.flatnonzero(~known)
        if len(rest):
            out[rest] = run_vectors(points[rest], self.size)
            new = rest[:len(self.table) - len(self.keys)]
            self.table[len(self.keys):len(self.keys) + len(new)] = out[new]
            keys, places = np.r_[self.keys, keys[new]], np.r_[self.places, len(self.keys) + np.arange(len(new))]
            order = np.argsort(keys)
            self.keys, self.places = keys[order], places[order]
        return out


def pieces(texts):
    """(row, code points with blanks for all but letters, padded) of each text or part of it; parts overlap by two."""
    known = letters()
    for i, t in enumerate(texts):
        t = (t or "").lower()
        for at in range(0, len(t), PIECE):
            low = max(0, at - 2)
            p = np.frombuffer(t[low:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
            p = np.where(known[p], p, 0)
            # the padding stands for the text's two ends; a run that an earlier part has is not taken again
            yield i, np.r_[[0] if at == 0 else [], p, [0] if at + PIECE >= len(t) else []].astype(np.int64)


def run_counts(texts):
    """Blocks of (rows, code points of some runs met (m x 3), counts (rows x m)); one text may come in several blocks."""
    block, held = [], 0
    for x in pieces(texts):
        block.append(x)
        held += len(x[1])
        if held > BLOCK or len(block) >= ROWS:
            yield from counted(block)
            block, held = [], 0
    if block:
        yield from counted(block)


def counted(block):
    points, back = np.unique(np.concatenate([p for _, p in block]), return_inverse=True)
    row = np.repeat(np.arange(len(block)), [len(p) for _, p in block])
    base, blank = len(points), points == 0
    whole = (row[2:] == row[:-2]) & ~blank[back[1:-1]]
    run, row = ((back[:-2] * base + back[1:-1]) * base + back[2:])[whole], row[:-2][whole]
    if base ** 3 <= DENSE:
        met = np.flatnonzero(np.bincount(run, minlength=base ** 3))
        index = np.zeros(base ** 3, np.int64)
        index[met] = np.arange(len(met))
        run = index[run]
    else:
        met, run = np.unique(run, return_inverse=True)
    rows = np.array([i for i, _ in block])
    order = np.argsort(run // RUNS, kind="stable") if len(met) > RUNS else slice(None)
    run, row = run[order], row[order]
    cuts = np.searchsorted(run // RUNS, np.arange(-(-len(met) // RUNS) + 1))
    for k in range(len(cuts) - 1):  # RUNS at a time, so that their vectors stay small
        some, part = met[k * RUNS:(k + 1) * RUNS], slice(cuts[k], cuts[k + 1])
        counts = np.bincount(row[part] * len(some) + run[part] - k * RUNS, minlength=len(block) * len(some)).reshape(len(block), len(some))
        yield rows, np.stack([points[some // base ** 2], points[some // base % base], points[some % base]], axis=1), counts


def held_out(id_col: str):
    """One document in three, by its id; null where there is no id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string")) % 3 == 1


def prototypes(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", size=SIZE) -> dict[str, np.ndarray]:
    """One vector for each language met in the training rows."""
    def learn(batches):
        held, n = {}, 0
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            langs, texts = b.column(1).to_pylist(), b.column(0).to_pylist()
            n_runs = np.zeros(len(langs), np.int64)  # a run for each letter, its middle
            for i, p in pieces(texts):
                n_runs[i] += np.count_nonzero(p[1:-1])
            names = sorted(set(langs))
            of = np.array([[lang == n for lang in langs] for n in names], np.float64)
            for rows, points, counts in run_counts(texts):
                weights = of[:, rows] @ np.rint(counts * (SCALE / np.maximum(n_runs[rows], 1))[:, None])
                keys = run_keys(points)
                for name, w in zip(names, weights):
                    held.setdefault(name, []).append((keys[w > 0], w[w > 0].astype(np.int64)))
                    n += len(held[name][-1][0])
            if n > HELD_WEIGHTS:
                yield from added_up(held)
                held, n = {}, 0
        yield from added_up(held)

    def added_up(held):
        for name, parts in held.items():
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            total = np.zeros(len(keys), np.int64)
            np.add.at(total, back, np.concatenate([w for _, w in parts]))
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys), pa.array(total)], ["lang", "run", "weight"])

    def bind(batches):
        total = {}
        for b in batches:
            langs, keys, weights = b.column(0).to_pylist(), b.column(1).to_numpy(), b.column(2).to_numpy()
            names = sorted(set(langs))
            place = {n: k for k, n in enumerate(names)}
            of = np.array([place[x] for x in langs], np.int64)
            for at in range(0, len(keys), RUNS):
                part = slice(at, at + RUNS)
                spread = np.zeros((len(names), len(keys[part])))
                spread[of[part], np.arange(len(keys[part]))] = weights[part]
                for n, v in zip(names, spread @ run_vectors(key_points(keys[part]), size).astype(np.float64)):
                    total[n] = total[n] + v if n in total else v
        if total:
            names = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(names), pa.array([total[n].astype(np.int64) for n in names], pa.list_(pa.int64()))], ["lang", "vector"])

    rows = docs.where(~held_out(id_col)).where(F.col(f"`{lang_col}`").isNotNull()).select(F.col(f"`{text_col}`").cast("string"), F.col(f"`{lang_col}`").cast("string"))
    weights = rows.mapInArrow(learn, "lang string, run long, weight long").groupBy("lang", "run").agg(F.sum("weight").alias("weight"))
    sums = weights.mapInArrow(bind, "lang string, vector array<long>").select("lang", F.posexplode("vector").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    sums = sums.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("v"))  # size numbers for each language
    found = {r.lang: np.array([e.x for e in r.v], np.float64) for r in sums.collect()}
    return {k: v for k, v in sorted(found.items()) if v.any()}


def classify(texts, names: list[str], profiles: np.ndarray, size: int, bound=None):
    """(language, score) of each text. profiles: a unit vector a row."""
    vectors, some = np.zeros((len(texts), size), np.float32), np.zeros(len(texts), bool)
    bound = bound or BoundRuns(size)
    for rows, points, counts in run_counts(texts):
        part = counts.astype(np.float32) @ bound(points)
        if (np.diff(rows) > 0).all():
            vectors[rows] += part
            some[rows] |= counts.any(axis=1)
        else:  # some text comes in several pieces
            np.add.at(vectors, rows, part)
            np.logical_or.at(some, rows, counts.any(axis=1))
    length = np.sqrt(np.einsum("ij,ij->i", vectors, vectors, dtype=np.float64))
    cosine = (vectors.astype(np.float64) @ profiles.T) / np.maximum(length, 1e-9)[:, None] if names else np.zeros((len(texts), 1))
    best = cosine.argmax(axis=1)
    known = some & bool(names)
    return [names[k] if ok else UNDETERMINED for k, ok in zip(best, known)], np.where(known, np.clip(cosine[np.arange(len(texts)), best], 0, 1), 0.0)


def identified(docs: DataFrame, found: dict[str, np.ndarray], text_col="text", lang="lang_pred", score="score") -> DataFrame:
    """The rows with two more columns."""
    names = list(found)
    profiles = np.stack([v / np.linalg.norm(v) for v in found.values()]) if names else np.zeros((1, SIZE))
    place, size = docs.columns.index(text_col), profiles.shape[1]

    def run(batches):
        bound = BoundRuns(size)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                langs, scores = classify(part.column(place).to_pylist(), names, profiles, size, bound)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, lang, score])

    from pyspark.sql.types import DoubleType, StringType, StructType
    return docs.mapInArrow(run, StructType(list(docs.schema.fields)).add(lang, StringType()).add(score, DoubleType()))


def language_id(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", size=SIZE) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    found = prototypes(docs, id_col, text_col, lang_col, size)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return identified(rows, found).select("doc_id", F.coalesce(held_out("doc_id"), F.lit(False)).alias("held_out"), "lang_pred", "score")


def with_language(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", size=SIZE, wanted=None) -> DataFrame:
    """The documents, all columns as they were, whose language could be told (and is one of those wanted, if given)."""
    found = prototypes(docs, id_col, text_col, lang_col, size)
    pred, score = own_name(docs, "lang_pred"), own_name(docs, "score")
    rows = identified(docs, found, text_col, pred, score).where(F.col(pred) != UNDETERMINED)
    return (rows if wanted is None else rows.where(F.col(pred).isin(list(wanted)))).select(*[F.col(f"`{c}`") for c in docs.columns])
