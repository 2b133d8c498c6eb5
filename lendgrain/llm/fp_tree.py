"""A tree of documents that share the beginnings of their term vectors, searched by branch and bound.

A document is the list of its query terms, the commonest first (terms are numbered in that order), with their
frequencies. Documents in the order of these lists form a trie; a node is a run of neighbours with a common beginning.
Nodes without a branch are left out, and neighbouring children of few documents share one leaf. A node knows the
largest frequency of every term below it and the least length weight m; as a score grows with a frequency and falls
with m, the score of these is a bound for everything below.
"""

import numpy as np

LEAF = 16
UNIT = 1_000_000_000


def part(weight, tf, m):
    """What a term adds to a score: whole numbers, rounded down."""
    return weight * ((UNIT * tf) // (1000 * tf + 12 * m))


def joined_slices(arrays, starts, ends):
    """The slices start:end of each array, one after the other."""
    at = [slice(s, e) for s, e in zip(starts, ends)]
    return [np.concatenate([a[x] for x in at]) if at else a[:0] for a in arrays]


class Tree:
    def __init__(self, terms: np.ndarray, tf: np.ndarray, sizes: np.ndarray, m: np.ndarray, place: np.ndarray, kinds: int, leaf: int = LEAF):
        """terms, tf: the vectors laid end to end; sizes: the terms of each document; place: its rank among ties; kinds: how many terms there are."""
        doc = np.repeat(np.arange(len(sizes)), sizes)
        by = np.lexsort((terms, doc))
        terms, tf = terms[by], tf[by]
        ends = np.cumsum(sizes)
        data, cuts = terms.astype(">u4").tobytes(), [0, *(4 * ends).tolist()]
        keys = [data[cuts[i]:cuts[i + 1]] for i in range(len(sizes))]
        order = np.array(sorted(range(len(keys)), key=keys.__getitem__), np.int64)
        self.docs, self.m, self.place, self.sizes = order, m[order], place[order], sizes[order]
        self.grow([keys[i] for i in order], leaf)

        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        row = back[doc]  # the lists are in the order of the documents still
        by = np.lexsort((row, terms))
        self.row, self.tf = row[by], tf[by]
        self.first = np.searchsorted(terms[by], np.arange(kinds + 1))  # first row of each term
        self.maxima(terms, tf, row, kinds)

    def grow(self, keys, leaf):
        common = np.zeros(len(keys), np.int64)
        for i in range(1, len(keys)):
            a, b = np.frombuffer(keys[i - 1], ">u4"), np.frombuffer(keys[i], ">u4")
            n = min(len(a), len(b))
            differ = a[:n] != b[:n]
            common[i] = differ.argmax() if differ.any() else n
        low, high, parent, level, children = [0], [len(keys)], [-1], [0], [[]]
        todo = [0]
        while todo:
            node = todo.pop()
            lo, hi = low[node], high[node]
            if hi - lo <= leaf:
                continue
            depth = common[lo + 1:hi].min()
            ended = lo + np.count_nonzero(self.sizes[lo:hi] == depth)  # they stand first
            if ended == hi:
                continue
            inner = ended + 1 + np.flatnonzero(common[ended + 1:hi] == depth)
            edges, runs = [*([lo] if ended > lo else []), ended, *inner.tolist(), hi], []
            for a, b in zip(edges, edges[1:]):
                if runs and a != ended and b - runs[-1][0] <= leaf:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
            if len(runs) == 1:
                continue
            for a, b in runs:
                children[node].append(len(low))
                todo.append(len(low))
                low.append(a), high.append(b), parent.append(node), level.append(level[node] + 1), children.append([])
        self.low, self.high, self.parent, self.level = (np.array(x, np.int64) for x in (low, high, parent, level))
        self.children = [np.array(x, np.int64) for x in children]
        self.least = np.array([self.m[a:b].min() for a, b in zip(low, high)], np.int64)

    def maxima(self, terms, tf, row, kinds):
        """The largest frequency of each term in each node, term by term; from the leaves up."""
        n = len(self.low)
        leaves = np.flatnonzero([not len(c) for c in self.children])
        leaves = leaves[np.argsort(self.low[leaves])]
        node = leaves[np.searchsorted(self.low[leaves], row, "right") - 1]
        key, top = most(terms * n + node, tf)
        found, above = [], (key[:0], top[:0])
        at = self.level[key % n]
        for level in range(int(self.level.max()), -1, -1):
            here = at == level
            key_here, top_here = most(np.r_[key[here], above[0]], np.r_[top[here], above[1]])
            found.append((key_here, top_here))
            above = key_here // n * n + self.parent[key_here % n], top_here
        key, top = (np.concatenate(x) for x in zip(*found))
        by = np.argsort(key)
        self.node, self.top = key[by] % n, top[by]
        self.node_first = np.searchsorted(key[by] // n, np.arange(kinds + 1))

    def bounds(self, terms, weights):
        starts, ends = self.node_first[terms], self.node_first[terms + 1]
        node, top = joined_slices((self.node, self.top), starts, ends)
        out = np.zeros(len(self.low), np.int64)
        np.add.at(out, node, part(np.repeat(weights, ends - starts), top, self.least[node]))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, k: int, least: int):
        """(document, score) of the k best with a score of at least `least`, best first; ties by place. Yields them leaf by leaf; send back the score to beat."""
        bounds, lists, todo = self.bounds(terms, weights), None, [0]
        while todo:
            node = todo.pop()
            if bounds[node] < least:
                continue
            children = self.children[node]
            if len(children):
                todo.extend(children[np.argsort(bounds[children], kind="stable")].tolist())
                continue
            if lists is None:
                starts, ends = self.first[terms], self.first[terms + 1]
                row, tf = joined_slices((self.row, self.tf), starts, ends)
                by = np.argsort(row, kind="stable")
                lists = row[by], tf[by], np.repeat(weights, ends - starts)[by]
            lo, hi = self.low[node], self.high[node]
            s, e = np.searchsorted(lists[0], (lo, hi))
            row = lists[0][s:e]
            score = np.zeros(hi - lo, np.int64)
            np.add.at(score, row - lo, part(lists[2][s:e], lists[1][s:e], self.m[row]))
            good = np.flatnonzero(score >= least)
            if len(good):
                good = good[np.lexsort((self.place[lo:hi][good], -score[good]))[:k]]
                least = yield self.docs[lo:hi][good], score[good]


def most(key, value):
    """The largest value of each key, keys in order."""
    by = np.argsort(key, kind="stable")
    key, value = key[by], value[by]
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.maximum.reduceat(value, at) if len(at) else value
