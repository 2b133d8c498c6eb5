"""FM-index over word ids, to a depth: both directions of a sequence, and its runs of words by extending intervals.

A sequence holds ids from 1 up, with 0 between the runs that no phrase crosses. Suffixes are ordered by their first
`depth` ids only, which is all that backward search for patterns of up to that length needs. The same index of the
reversed sequence is kept in step, so that a pattern can grow on either side.
"""

from functools import cached_property

import numpy as np


class Half:
    """The index of one direction: the suffixes' order, the Burrows-Wheeler transform and ranks in it."""

    def __init__(self, ids: np.ndarray, depth: int):
        n = len(ids)
        self.kinds = int(ids.max(initial=0)) + 1
        order, rank, known = np.argsort(ids), ids.astype(np.int64), 1
        while known < depth:  # ranks by `known` ids give ranks by up to twice as many
            step = min(known, depth - known)
            later = np.zeros(n, np.int64)
            later[:n - step] = rank[step:]
            key = rank * (int(rank.max(initial=0)) + 1) + later
            order = np.argsort(key)
            turned = key[order]
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(np.r_[0, turned[1:] != turned[:-1]])
            known += step
        self.before = ids[order - 1].astype(np.int64)  # the id left of each suffix; the sequence is a ring with 0 at its seam
        self.starts = np.searchsorted(ids[order], np.arange(self.kinds + 1))  # first row of each id
        self.where = np.sort(self.before * n + np.arange(n))  # rows of each id in the transform, one id after the other
        self.n = n

    def rank(self, ids: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """How often the id stands in the transform above the row."""
        return np.searchsorted(self.where, ids * self.n + rows) - self.starts[ids]


class Grams:
    """Some runs of words: their ids (a row each), the first row of each in both halves, and how often they occur."""

    def __init__(self, words: np.ndarray, low: np.ndarray, back: np.ndarray, count: np.ndarray):
        self.words, self.low, self.back, self.count = words, low, back, count


class WordIndex:
    def __init__(self, ids: np.ndarray, depth: int):
        """ids: begins and ends with 0. The half for the reversed sequence is built when a run first grows on its right."""
        self.forward, self.reverse = Half(ids, depth), lambda: Half(ids[::-1], depth)

    @cached_property
    def backward(self) -> Half:
        return self.reverse()

    def single(self) -> Grams:
        starts = self.forward.starts  # single words lie alike in both halves
        words = np.arange(1, self.forward.kinds)
        return Grams(words[:, None], starts[1:-1], starts[1:-1], np.diff(starts)[1:])

    def left(self, grams: Grams) -> Grams:
        """Every run with one more word on its left that occurs."""
        of, word, low, back, count = extended(self.forward, grams.low, grams.back, grams.count)
        return Grams(np.hstack([word[:, None], grams.words[of]]), low, back, count)

    def right(self, grams: Grams) -> Grams:
        """Every run with one more word on its right that occurs."""
        of, word, back, low, count = extended(self.backward, grams.back, grams.low, grams.count)
        return Grams(np.hstack([grams.words[of], word[:, None]]), low, back, count)

    def grams(self, longest: int):
        """The runs of two, three ... words, grown on the left and the right by turns."""
        found = self.single()
        for size in range(2, longest + 1):
            found = self.left(found) if size % 2 == 0 else self.right(found)
            yield found


def extended(half: Half, low: np.ndarray, other: np.ndarray, count: np.ndarray):
    """(run grown, id put before it, its first row here, its first row in the other half, its count)."""
    ends = np.cumsum(count)
    of = np.repeat(np.arange(len(low)), count)
    rows = np.arange(len(of)) + (low - (ends - count))[of]
    key, many = np.unique(of * half.kinds + half.before[rows], return_counts=True)
    of, word = key // half.kinds, key % half.kinds
    smaller = np.cumsum(many) - many  # occurrences with a smaller id before them, of this run and all earlier ones
    there = other[of] + smaller - (ends - count)[of]
    some = word > 0
    of, word, many, there = of[some], word[some], many[some], there[some]
    return of, word, half.starts[word] + half.rank(word, low[of]), there, many
