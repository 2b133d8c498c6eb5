"""Words of UTF-8 texts as numpy arrays, and polynomial (Rabin-Karp) hashes of words and of runs of words.

Hashes are sums of value times a power of an odd base, modulo 2**64; the prefix sums give every word or run with
one subtraction and one product by the inverse power. They are mixed afterwards, so that all bits can be used.
Long inputs go in segments, so that the arrays of powers stay small.
"""

import numpy as np

from lendgrain.llm.shared import kept

SEGMENT = 1 << 20
# odd 64-bit constants: two bases for bytes, two for words
BYTE_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
WORD_BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
BLANK_BYTES = b" \t\n\v\f\r"


def powers(base: int, n: int):
    """base**i and base**-i modulo 2**64 for i < n; grown as needed and kept by the worker."""
    held = kept("powers", dict)
    if base not in held or len(held[base][0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        held[base] = tuple(np.cumprod(np.r_[np.uint64(1), np.full(size - 1, np.uint64(b))], dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
    return held[base][0][:n], held[base][1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(data: bytes, word: np.ndarray):
    """Starts and ends of the words; word tells for each byte value whether it belongs to one."""
    inside = word[np.frombuffer(data, np.uint8)]
    edge = np.flatnonzero(np.diff(np.r_[False, inside, False].view(np.int8)))
    return edge[::2], edge[1::2]


def range_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of values[start:end] for each pair of ends; a segment's worth of values."""
    up, down = powers(base, len(values) + 1)
    sums = np.r_[np.uint64(0), np.cumsum(values * up[:-1], dtype=np.uint64)]
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: bytes, starts: np.ndarray, ends: np.ndarray, base: int = BYTE_BASES[0]) -> np.ndarray:
    raw, out, at = np.frombuffer(data, np.uint8), [], 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + SEGMENT, "right")))  # one longer word is a segment
        low = starts[at]
        out.append(range_hashes(raw[low:ends[to - 1]].astype(np.uint64) + np.uint64(1), starts[at:to] - low, ends[at:to] - low, base))
        at = to
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def run_hashes(words: np.ndarray, n: int, base: int = WORD_BASES[0]) -> np.ndarray:
    """Hash of words[i:i + n] for every i that has n words."""
    out = []
    for at in range(0, len(words) - n + 1, SEGMENT):
        part = words[at:at + SEGMENT + n - 1]
        i = np.arange(len(part) - n + 1)
        out.append(range_hashes(part, i, i + n, base))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def joined(texts, size: int = SEGMENT):
    """Runs of (first row, texts as bytes) of about a segment each."""
    block, held, first = [], 0, 0
    for i, t in enumerate(texts):
        block.append((t or "").encode())
        held += len(block[-1])
        if held > size:
            yield first, block
            block, held, first = [], 0, i + 1
    if block:
        yield first, block


class Block:
    """The words of some texts laid end to end: spans, hashes and the text each word is of."""

    def __init__(self, texts: list[bytes], word: np.ndarray):
        self.texts, self.data = texts, b" ".join(texts)
        self.starts, self.ends = spans(self.data, word)
        self.at = np.cumsum([0] + [len(t) + 1 for t in texts])[:-1]
        self.first = np.searchsorted(self.starts, np.r_[self.at, len(self.data) + 1])  # first word of each text
        self.count = np.diff(self.first)
        self.of = np.repeat(np.arange(len(texts)), self.count)

    def hashes(self, base: int = BYTE_BASES[0]) -> np.ndarray:
        return word_hashes(self.data, self.starts, self.ends, base)

    def whole(self, n: int) -> np.ndarray:
        """For each i: are words i to i + n - 1 of one text."""
        return self.of[n - 1:] == self.of[:len(self.of) - n + 1] if len(self.of) >= n else np.zeros(0, bool)


def blank_words() -> np.ndarray:
    word = np.ones(256, bool)
    word[list(BLANK_BYTES)] = False
    return word
