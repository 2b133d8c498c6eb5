"""Benchmark decontamination: the word windows of benchmark items as a broadcast hash set, scanned by every document.

A window is 13 consecutive words of an item, or all words of a shorter item. Words are runs of bytes other than
blanks, ASCII punctuation and controls, with A-Z lower-cased. Hash hits are verified word by word.

The benchmark travels in blocks of at most block_words words (about 30 bytes each), which the driver and every
worker hold one at a time; all blocks together lie on each executor's disk, so the benchmark must fit there. The
documents are read once and never shuffled.

Defined cases: null, empty or wordless texts have no words and are clean; an item without words has no window; an
item without an id still marks words but is not counted or named; items that repeat an id count once; texts are
taken whole; an empty benchmark leaves everything clean; columns beyond those named are passed through.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.words import WORD_BASES, Block, joined, run_hashes

WINDOW = 13
BLOCK_WORDS = 500_000
SHARE = 20  # contaminated: one word in 20, or more, is hit
ROWS = 500  # documents scanned at a time; more where several blocks have to be read anew for them
MANY_ROWS = 5000


def normal_table() -> bytes:
    """Byte by byte: A-Z to lower case, what is no word byte to a blank."""
    keep = [*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]
    table = bytearray(b" " * 256)
    for b in keep:
        table[b] = b
    for b in range(0x41, 0x5B):
        table[b] = b + 32
    return bytes(table)


NORMAL = normal_table()
NOT_BLANK = np.arange(256) != 32


class Windows:
    """The windows of some items by length: sorted hashes with the item and the place of each."""

    def __init__(self, items: list[tuple[str | None, str]], window: int):
        self.ids = [i for i, _ in items]
        block = Block([t.encode().translate(NORMAL) for _, t in items], NOT_BLANK)
        self.data, self.starts, self.ends = block.data, block.starts, block.ends
        hashes, self.by_length = block.hashes(), {}
        size = np.minimum(block.count, window)
        for n in sorted(set(size.tolist()) - {0}):
            at = np.flatnonzero(block.whole(n))
            at = at[size[block.of[at]] == n]
            h = run_hashes(hashes, n)[at]
            order = np.argsort(h, kind="stable")
            some = np.zeros(1 << 20, bool)
            some[h >> np.uint64(44)] = True
            self.by_length[n] = (h[order], at[order], block.of[at[order]], some)

    def words(self, at: int, n: int) -> bytes:
        return b" ".join(self.data[self.starts[at]:self.ends[at + n - 1]].split())


def mark(block: Block, hashes: np.ndarray, windows: Windows, change: np.ndarray, found: list[set]) -> None:
    """Adds +1 and -1 to change where hit runs begin and end, and the items to each text's set."""
    for n, (known, place, item, some) in windows.by_length.items():
        runs = run_hashes(hashes, n)
        maybe = np.flatnonzero(some[runs >> np.uint64(44)] & block.whole(n)) if len(runs) else []
        if not len(maybe):
            continue
        low, high = np.searchsorted(known, runs[maybe], "left"), np.searchsorted(known, runs[maybe], "right")
        for i, a, b in zip(maybe[high > low].tolist(), low[high > low].tolist(), high[high > low].tolist()):
            words = b" ".join(block.data[block.starts[i]:block.ends[i + n - 1]].split())
            hit = [int(item[k]) for k in range(a, b) if windows.words(place[k], n) == words]
            if hit:
                change[i] += 1
                change[i + n] -= 1
                found[block.of[i]].update(windows.ids[k] for k in hit)


def scan(texts: list[str | None], blocks):
    """(n_words, hit flags of the words, item ids, byte spans of the words) of each text. blocks: callables that give Windows."""
    held = []
    for _, raw in joined(texts):
        block = Block([t.translate(NORMAL) for t in raw], NOT_BLANK)
        held.append((block, block.hashes(), np.zeros(len(block.starts) + 1, np.int64), [set() for _ in raw]))
    for load in blocks:
        windows = load()
        for part in held:
            mark(part[0], part[1], windows, *part[2:])
    for block, _, change, found in held:
        hit = np.cumsum(change[:-1]) > 0
        for k in range(len(block.texts)):
            a, b = block.first[k], block.first[k + 1]
            yield int(b - a), hit[a:b], {str(i) for i in found[k] if i is not None}, block.starts[a:b] - block.at[k], block.ends[a:b] - block.at[k]


def window_blocks(benchmark: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> list:
    """Broadcasts of Windows, each over items with about block_words words in all."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // (block_words * 4)))  # a word and its blank have some 4 bytes at least
    block = F.pmod(F.xxhash64("id", "text"), F.lit(n))
    return [spark.sparkContext.broadcast(Windows([tuple(r) for r in items.where(block == k).collect()], window)) for k in range(n)]


def parts(batches, broadcasts):
    """The batches in pieces of some documents, whose words and hashes are held together."""
    rows = ROWS if len(broadcasts) == 1 else MANY_ROWS
    return (b.slice(at, rows) for b in batches for at in range(0, b.num_rows, rows))


def loaders(broadcasts):
    """One block is kept by its broadcast; several are read anew for each piece, so that one is held at a time."""
    if len(broadcasts) == 1:
        return [lambda: broadcasts[0].value]
    return [lambda b=b: b.load_from_path(b._path) for b in broadcasts]


def contamination(docs: DataFrame, benchmark: DataFrame, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
                  window=WINDOW, block_words=BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated, item_ids."""
    broadcasts = window_blocks(benchmark, item_col, item_text, window, block_words)

    def run(batches):
        blocks = loaders(broadcasts)
        for b in parts(batches, broadcasts):
            rows = [(n, int(hit.sum()), sorted(items)) for n, hit, items, *_ in scan(b.column(1).to_pylist(), blocks)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64()),
                 pa.array([len(r[2]) for r in rows], pa.int64()), pa.array([hashlib.sha256(",".join(r[2]).encode()).hexdigest() for r in rows], pa.string()),
                 pa.array([contaminated(r[0], r[1]) for r in rows], pa.bool_()), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "item_ids"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.dtypes[0][1]}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>")


def contaminated(n_words: int, n_hit: int) -> bool:
    return n_hit > 0 and SHARE * n_hit >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, text_col="text", item_col="item_id", item_text="text", window=WINDOW,
          block_words=BLOCK_WORDS, remove="documents") -> DataFrame:
    """The documents, all columns as they were, without contaminated ones; or, with remove="spans", all documents with
    every run of hit words cut out of the text."""
    assert remove in ("documents", "spans")
    broadcasts = window_blocks(benchmark, item_col, item_text, window, block_words)
    place = docs.columns.index(text_col)

    def run(batches):
        blocks = loaders(broadcasts)
        for b in parts(batches, broadcasts):
            texts = b.column(place).to_pylist()
            if remove == "documents":
                keep = [not contaminated(n, int(hit.sum())) for n, hit, *_ in scan(texts, blocks)]
                yield b.filter(pa.array(keep, pa.bool_()))
            else:
                out = [t if not hit.any() else cut_out(t, hit, starts, ends) for t, (_, hit, _, starts, ends) in zip(texts, scan(texts, blocks))]
                yield b.set_column(place, b.schema.field(place), pa.array(out, b.schema.field(place).type))

    return docs.mapInArrow(run, docs.schema)


def cut_out(text: str, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the bytes from the first to the last word of each run of hit words."""
    raw, out, at = text.encode(), [], 0
    edge = np.flatnonzero(np.diff(np.r_[False, hit, False].view(np.int8)))
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(raw[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*out, raw[at:]]).decode()
