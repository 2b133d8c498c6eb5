"""Near duplicates by SimHash, linked through a Gray-order hierarchical index.

Fingerprints of equal value become one row first. Links (at most 3 differing bits) are searched among those in
groups: 64 bits are cut in 4 bands of which 3 differences leave one unchanged, so both ends of a link share a
group. A group above group_limit is dealt anew by the same rule on the bits that its band does not fix, and so
on, which ends as the remaining bits run out; no task ever gets an unbounded group and no link is lost.

Inside a task the fingerprints of a group are sorted by Gray rank. Every 8 neighbours get a node that holds the
bits they share (mask and pattern), every 8 nodes one above. All fingerprints descend together from the top,
adding the differences in the bits a node shares beyond its parent; a node beyond 3 is dropped with all below
it. Links found are merged at once, so that a group gives at most one edge per member, and the edges of all
groups go to components().

Defined cases: a null, empty or blank text has fingerprint zero and is linked like any other; texts of any length
are taken whole, in blocks of words; rows without an id have a fingerprint and name no component (null where no
row of the component has an id); repeated rows count once in the search; other columns are not looked at.
"""

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.components import components
from lendgrain.llm.shared import cut, new_folder, staged

SEED = 42
DISTANCE = 3
SHINGLE = 3
GROUP_LIMIT = 20_000
FAN = 8
BLOCK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """64 bits; bit set if it is set in over half the XXH64 hashes of the shingles."""
    words = (text or "").encode().lower().split()  # bytes: only A-Z change, only the six ASCII blanks divide
    if not words:
        return 0
    hash64 = partial(xxhash.xxh64_intdigest, seed=SEED)
    total, ones = max(1, len(words) - size + 1), np.zeros(64, np.int64)
    for at in range(0, total, BLOCK):
        part = words[at:min(total, at + BLOCK) + size - 1]
        runs = zip(*[part[i:] for i in range(size)]) if len(part) >= size else [part]
        hashes = np.fromiter(map(hash64, map(b" ".join, runs)), np.uint64)
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE) -> DataFrame:
    """doc_id and fingerprint as a signed long."""
    def run(batches):
        for b in batches:
            prints = np.array([fingerprint(x.as_py(), size) for x in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(x: np.ndarray) -> np.ndarray:
    for s in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(s))
    return x


def index_levels(values: np.ndarray, group: np.ndarray) -> list[tuple]:
    """From the leaves up: (pattern, mask, first child, number of children, last leaf) of each node; a node never
    spans two groups, and the top level has one node for each group."""
    n = len(values)
    levels = [(values, np.full(n, ~np.uint64(0)), np.arange(n), np.ones(n, np.int64), np.arange(n))]
    of = group
    while True:
        pattern, mask, _, _, last = levels[-1]
        starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
        if len(starts) == len(of) and len(levels) > 1:
            return levels
        place = np.arange(len(of)) - np.repeat(starts, np.diff(np.r_[starts, len(of)]))
        first = np.flatnonzero(place % FAN == 0)
        count = np.diff(np.r_[first, len(of)])
        node = np.repeat(np.arange(len(first)), count)
        shared = mask & ~(pattern ^ pattern[first][node])
        levels.append((pattern[first], np.bitwise_and.reduceat(shared, first), first, count, last[first + count - 1]))
        of = of[first]


def links(values: np.ndarray, group: np.ndarray, most: int = DISTANCE, block: int = 4096):
    """Pairs of positions (low, high) in one group whose values differ in at most `most` bits, block by block."""
    levels = index_levels(values, group)
    top = np.cumsum(np.r_[0, group[1:] != group[:-1]])
    for at in range(0, len(values), block):
        asked = np.arange(at, min(len(values), at + block))
        node = top[asked]
        keep = levels[-1][4][node] > asked
        asked, node = asked[keep], node[keep]
        diff = np.zeros(len(asked), np.int64)
        fixed = levels[-1][1][node]  # a group's shared bits are the asking value's own
        for k in range(len(levels) - 1, 0, -1):
            _, _, first, count, _ = levels[k]
            pattern, mask, _, _, last = levels[k - 1]
            many = count[node]
            below = np.repeat(first[node] - np.r_[0, np.cumsum(many)[:-1]], many) + np.arange(many.sum())
            asked, diff, fixed = np.repeat(asked, many), np.repeat(diff, many), np.repeat(fixed, many)
            diff = diff + np.bitwise_count((values[asked] ^ pattern[below]) & mask[below] & ~fixed)
            keep = (diff <= most) & (last[below] > asked)
            asked, node, diff = asked[keep], below[keep], diff[keep]
            fixed = mask[node]
        yield asked, node


def merge(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the sets of a[i] and b[i]; a root is the smallest position of its set."""
    while len(a):
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up
        a, b = parent[a], parent[b]
        apart = a != b
        a, b = np.minimum(a, b)[apart], np.maximum(a, b)[apart]
        np.minimum.at(parent, b, a)


def group_edges(key: np.ndarray, fp: np.ndarray, rep: np.ndarray, most: int = DISTANCE):
    """One edge from each linked member to the root of its set within the group. Sorted by key and Gray rank."""
    parent = np.arange(len(fp))
    for a, b in links(fp, key, most):
        merge(parent, a, b)
    merge(parent, np.arange(len(fp)), parent.copy())
    moved = np.flatnonzero(parent != np.arange(len(fp)))
    return rep[moved], rep[parent[moved]]


def bands(bits: list[int]) -> list[list[int]]:
    """Four parts of nearly equal size."""
    cut_at = [len(bits) * i // 4 for i in range(5)]
    return [bits[cut_at[i]:cut_at[i + 1]] for i in range(4)]


def signed(bits) -> int:
    x = sum(1 << b for b in bits)
    return x - (1 << 64) if x >> 63 else x


def grouped(prints: DataFrame, limit: int) -> DataFrame:
    """(key, fp, rep): each fingerprint once in each of its groups, none of which has more than limit rows."""
    paths, out = [list(range(64))], None
    now = prints.select("fp", "rep", F.lit(0).alias("path"), F.lit(0).cast("long").alias("key"))
    while True:
        parts = [b for p in paths for b in bands(p)]
        masks = F.array(*[F.lit(signed(b)) for b in parts])
        now = now.select("fp", "rep", "key", F.explode(F.array(*[F.col("path") * 4 + i for i in range(4)])).alias("path"))
        now = now.select("fp", "rep", "path", F.xxhash64("key", "path", F.col("fp").bitwiseAND(F.element_at(masks, F.col("path") + 1))).alias("key"))
        paths = [[x for x in p if x not in b] for p in paths for b in bands(p)]
        large = cut(now.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > limit).select("key"))
        some = large.limit(1).count() > 0 and len(paths[0]) > 8  # 8 bits left: at most 256 values in a group
        done = now.join(large, "key", "left_anti") if some else now
        out = done.select("key", "fp", "rep") if out is None else out.unionAll(done.select("key", "fp", "rep"))
        if not some:
            return out
        now = now.join(large, "key", "left_semi")


def edges(prints: DataFrame, limit=GROUP_LIMIT, most=DISTANCE) -> DataFrame:
    """prints: distinct fp with rep. Edges (a, b) that connect what is linked."""
    def run(batches):
        held = []
        for b in batches:
            held.append([c.to_numpy() for c in b.columns])
            if sum(len(x[0]) for x in held) < BLOCK:
                continue
            whole = [np.concatenate(x) for x in zip(*held)]
            end = np.flatnonzero(whole[0] != whole[0][-1])  # the last group may go on
            if len(end):
                yield from found([x[:end[-1] + 1] for x in whole])
                held = [[x[end[-1] + 1:] for x in whole]]
            else:
                held = [whole]
        if held:
            yield from found([np.concatenate(x) for x in zip(*held)])

    def found(columns):
        key, fp, rep = columns
        fp = fp.view(np.uint64)
        order = np.lexsort((gray_rank(fp), key))
        a, b = group_edges(key[order], fp[order], rep[order], most)
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return grouped(prints, limit).repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE, limit=GROUP_LIMIT) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    rows = cut(fingerprints(docs, id_col, text_col, size))
    prints = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    linked = components(edges(prints.where("rep is not null"), limit))
    named = prints.join(linked, F.col("rep") == F.col("a"), "left").select("fp", F.coalesce("b", "rep").alias("component_id"))
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one_each(docs: DataFrame, id_col="doc_id", text_col="text", size=SHINGLE, limit=GROUP_LIMIT) -> DataFrame:
    """The documents without those that another document of their component stands for (the one with the smallest id)."""
    away = near_duplicates(docs, id_col, text_col, size, limit).where("doc_id <> component_id").select(F.col("doc_id").alias(id_col)).distinct()
    away = staged(away, new_folder(docs.sparkSession, "near-copies"))  # the planner sees its size, and broadcasts it only if small
    return docs.join(away, id_col, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
