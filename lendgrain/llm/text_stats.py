"""Numbers that describe a text's form: how its bytes, words and lines are spread. No number depends on a vocabulary."""

from collections import Counter

import numpy as np

CHUNK = 1 << 20


def _bytes(test):
    return np.array([test(i) for i in range(256)], np.float64)


UPPER, LOWER = _bytes(lambda i: 65 <= i <= 90), _bytes(lambda i: 97 <= i <= 122)
DIGIT, BLANK = _bytes(lambda i: 48 <= i <= 57), _bytes(lambda i: i in b" \t")
BREAK, STOP = _bytes(lambda i: i in b"\n\r"), _bytes(lambda i: i in b".!?")
COMMA, SIGN = _bytes(lambda i: i in b",;:"), _bytes(lambda i: i in b"|#*<>{}[]()=+-_/\\@$%^&~`\"'")
OTHER, CONTROL = _bytes(lambda i: i >= 128), _bytes(lambda i: i < 32 and i not in b"\t\n\r")
SHARES = np.stack([UPPER, LOWER, DIGIT, BLANK, BREAK, STOP, COMMA, SIGN, OTHER, CONTROL], axis=1)
NAMES = ["bytes", "upper", "lower", "digits", "blanks", "breaks", "stops", "commas", "signs", "beyond_ascii", "control", "entropy", "upper_of_letters",
         "words", "word_length", "word_spread", "distinct_words", "top_word", "short_words", "no_letter", "capital_words", "repeated_pairs", "lines", "distinct_lines",
         "line_length", "words_a_stop"]


def words_of(text: bytes):
    """Lists of words, a chunk at a time."""
    at = 0
    while at < len(text):
        to = text.find(b" ", at + CHUNK)
        to = len(text) if to < 0 else to
        yield text[at:to].split()
        at = to


def described(text: bytes) -> list[float]:
    """The numbers of NAMES; all 0 for an empty text."""
    size = len(text)
    if not size:
        return [0.0] * len(NAMES)
    counts = np.zeros(256)
    for at in range(0, size, CHUNK):
        counts += np.bincount(np.frombuffer(text, np.uint8, min(CHUNK, size - at), at), minlength=256)
    shares = (counts @ SHARES) / size
    p = counts[counts > 0] / size
    upper, lower = shares[0], shares[1]
    words, pairs = Counter(), Counter()
    for some in words_of(text):
        words.update(some)
        pairs.update(map(hash, zip(some, some[1:])))
    n, m = sum(words.values()), sum(pairs.values())
    many = np.fromiter(words.values(), np.float64, len(words))
    length = np.fromiter(map(len, words), np.float64, len(words))
    total = max(n, 1)
    mean = many @ length / total
    lines = text.split(b"\n")
    return [np.log1p(size), *shares, -(p * np.log2(p)).sum(), upper / (upper + lower) if upper + lower else 0.0,
            np.log1p(n), mean, np.sqrt(max(many @ length ** 2 / total - mean ** 2, 0)), len(words) / total, many.max(initial=0) / total,
            many[length < 3].sum() / total, sum(c for w, c in words.items() if not w.lower().islower() and w.isascii()) / total,
            sum(c for w, c in words.items() if len(w) > 1 and w.isupper()) / total, 1 - len(pairs) / max(m, 1),
            np.log1p(len(lines)), len(set(lines)) / len(lines), np.log1p(size / len(lines)), np.log1p(n / (1 + counts @ STOP))]
