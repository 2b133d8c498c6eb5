"""Canonical, length-limited Huffman codes in numpy: lengths from counts, packing, decoding of many runs in step."""

import numpy as np

LONGEST = 18
RUN = 1024


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Code length of each symbol (0: does not occur) with the least total, none over longest: package-merge."""
    symbols = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    n = len(symbols)
    if n > 1 << longest:
        raise ValueError(f"{n} symbols need codes of more than {longest} bits")
    if n < 2:
        lengths[symbols] = 1
        return lengths
    symbols = symbols[np.argsort(counts[symbols], kind="stable")]
    weights = counts[symbols].astype(np.float64)
    row, single = weights, []
    for _ in range(longest - 1):
        pairs = row[: len(row) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.r_[weights, pairs]
        order = np.argsort(both, kind="stable")
        single.append(order < n)
        row = both[order]
    take, depth = 2 * n - 2, np.zeros(n, np.int64)
    for is_symbol in reversed(single):
        k = int(is_symbol[:take].sum())
        depth[:k] += 1
        take = 2 * (take - k)
    depth[:take] += 1
    lengths[symbols] = depth
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then symbol; the decoder needs the lengths alone."""
    codes = np.zeros(len(lengths), np.uint32)
    code = last = 0
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    for length in range(1, int(lengths.max(initial=0)) + 1):
        same = order[lengths[order] == length]
        code <<= length - last
        codes[same] = code + np.arange(len(same))
        code, last = code + len(same), length
    return codes


def table(lengths: np.ndarray):
    """The longest length, and for every value of the next `longest` bits 32 * symbol + length."""
    longest = int(lengths.max(initial=1))
    codes = canonical(lengths).astype(np.int64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    share = 1 << (longest - lengths[order].astype(np.int64))
    out = np.ones(1 << longest, np.uint32)
    if len(order):
        assert codes[order[0]] == 0
        out[:share.sum()] = np.repeat((order << 5) + lengths[order], share)
    return longest, out


def pack(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, codes: np.ndarray):
    """Bits of ids; the run that begins at each of `first` starts at a whole byte. Gives the bytes, the bit offset of
    each id and the first byte of each run, with the end."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    before = ends - size
    of = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(ids)]))
    bits = np.diff(np.r_[before[first], ends[-1:]])
    byte = np.r_[0, np.cumsum((bits + 7) // 8)]
    at = before + (byte[:-1] * 8 - before[first])[of]
    word, into = at >> 6, at & 63
    code, over = codes[ids].astype(np.uint64), into + size - 64
    high = np.where(over <= 0, code << np.maximum(-over, 0).astype(np.uint64), code >> np.maximum(over, 0).astype(np.uint64))
    words = np.zeros(int((byte[-1] + 7) // 8) + 2, np.uint64)
    begin = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[begin]] = np.bitwise_or.reduceat(high, begin)
    cross = np.flatnonzero(over > 0)
    words[word[cross] + 1] |= code[cross] << (64 - over[cross]).astype(np.uint64)
    return words.astype(">u8").tobytes()[:int(byte[-1])], at, byte


def unpack(data: bytes, at: np.ndarray, counts: np.ndarray, longest: int, symbols: np.ndarray) -> np.ndarray:
    """counts[k] ids from bit at[k] on, for all k in step; laid end to end."""
    if not len(at):
        return np.zeros(0, np.uint32)
    steps = int(counts.max())
    raw = np.frombuffer(data + bytes(16), np.uint8).astype(np.uint32)
    ahead = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]  # the 32 bits from each byte on
    last = len(ahead) - 1
    order = np.argsort(-counts, kind="stable")  # long runs first, so that ended ones fall off the end
    place, left = at[order].astype(np.int64), counts[order]
    out = np.zeros((steps, len(at)), np.uint32)
    for i in range(steps):
        if left[len(place) - 1] <= i:
            place = place[:np.searchsorted(-left, -i, "left")]
        key = (ahead[np.minimum(place >> 3, last)] << (place & 7).astype(np.uint32)) >> np.uint32(32 - longest)
        out[i, :len(place)] = found = symbols[key]
        place = place + (found & 31)
    out >>= 5
    rows = np.empty_like(out.T)
    rows[order] = out.T
    return rows[np.arange(steps) < counts[:, None]]
