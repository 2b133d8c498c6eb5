"""Substring dedup: windows of 50 words that also occur in a document with a smaller id are cut out.

Every window of every document is judged by its Rabin-Karp hash. To keep the shuffle small, equal windows are first
narrowed down by anchors: a window's anchor is the 12-word run in it with the smallest hash, so equal windows have
equal anchors (about one word in twenty starts one). Anchors that only one document has are dropped, with their
windows; nothing is lost by that. The hashes (96 bits) of all windows that are left are counted in Spark, those of a
window's first document stay, the others are removed, and overlapping and adjoining windows merge into intervals.

A document whose words are, all of them, those of one with a smaller id loses all of them and takes no further part:
it starts no window that the other does not start.

Anchors are aggregated before their shuffle, and joined with one row each of a written table, so that the adaptive
skew join can split a common one; the same holds for whole documents. Windows whose anchor occurs more than hot times
are salted by document: each salt settles its own rows, and only the first row of each salt is then held against the
others' (at most salts rows a window). The texts are dealt out by document once, for the windows and for the cuts.

Defined cases: null and blank texts have no words; documents under 50 words lose none; texts are taken whole; a row
without an id has no place in the order: it loses nothing and nothing is removed for it; rows that repeat an id
never remove each other's words; an empty table gives an empty result; other columns are not looked at.
"""

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import new_folder, staged
from lendgrain.llm.words import BYTE_BASES, WORD_BASES, Block, blank_words, joined, run_hashes

WINDOW = 50
RUN = 12
HOT = 100_000
SALTS = 64
HALF = 1 << 32


def running(x: np.ndarray, n: int, best) -> np.ndarray:
    """best (np.minimum or np.maximum) of each n neighbours, by doubling."""
    size = 1
    while size * 2 <= n:
        x = best(x[:-size], x[size:])
        size *= 2
    more = n - size
    return best(x[:-more], x[more:]) if more else x


def window_anchors(block: Block, window: int, run: int):
    """Hashes of all runs; for each place whether a window starts there, and the hash of that window's anchor."""
    runs, whole = run_hashes(block.hashes(), run), block.whole(window)
    return runs, whole, running(runs, window - run + 1, np.minimum) if len(whole) else np.zeros(0, np.uint64)


def anchors(block: Block, window: int, run: int):
    """The words where an anchor starts, and the hashes of all runs. A run is one if it is the smallest of a window,
    that is, equal to the largest anchor of the windows that hold it."""
    runs, whole, smallest = window_anchors(block, window, run)
    if not whole.any():
        return np.zeros(0, np.int64), runs
    inner = window - run + 1
    around = lambda x: running(np.r_[np.zeros(inner - 1, x.dtype), x, np.zeros(inner - 1, x.dtype)], inner, np.maximum)
    return np.flatnonzero((around(np.where(whole, smallest, np.uint64(0))) == runs) & around(whole)), runs


def text_blocks(batch):
    """(rows of the batch, Block) pieces."""
    for first, raw in joined(batch.column("text").to_pylist()):
        yield slice(first, first + len(raw)), Block(raw, BLANKS)


BLANKS = blank_words()


def removed_words(docs: DataFrame, window=WINDOW, run=RUN, hot=HOT, salts=SALTS, folder=None) -> DataFrame:
    """docs: doc_id, text, mark. Gives, for each document that loses words, (doc_id, mark, starts, copy): starts has
    (word, bits), a bit for each of the 64 words from word * 64 on where a removed window starts; copy: all go."""
    spark = docs.sparkSession
    folder = folder or new_folder(spark, "substrings")

    def look(batches):
        for b in batches:
            for rows, block in text_blocks(b):
                at, runs = anchors(block, window, run)
                cuts = np.searchsorted(block.of[at], np.arange(len(block.texts) + 1)).astype(np.int32)
                whole = [hashlib.blake2b(b" ".join(t.split()), digest_size=16).digest() for t in block.texts]
                columns = [pa.array(block.count, pa.int64()), pa.array(whole, pa.binary()), pa.ListArray.from_arrays(cuts, pa.array(runs[at].view(np.int64))),
                           pa.ListArray.from_arrays(cuts, pa.array((at - block.first[block.of[at]]).astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(rows.start, len(block.texts)), b.column("mark").slice(rows.start, len(block.texts)), *columns], ["doc_id", "mark", "n_words", "whole", "runs", "at"])

    seen = staged(docs.where("doc_id is not null").select("doc_id", "mark", "text").mapInArrow(look, "doc_id long, mark long, n_words long, whole binary, runs array<long>, at array<int>"), f"{folder}/seen")
    same = seen.where(F.col("n_words") >= window).groupBy("whole").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("whole", "first")
    seen = seen.join(staged(same, f"{folder}/same"), "whole", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    copies = seen.where("copy").select("doc_id", "mark").distinct()
    found = staged(seen.where("not copy").select("doc_id", "mark", F.explode(F.arrays_zip("runs", "at")).alias("a")).select("a.runs", "doc_id", "mark", "a.at").withColumnRenamed("runs", "run"), f"{folder}/anchors")
    shared = found.groupBy("run").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count("*").alias("n")).where("a < b")
    shared = staged(shared.select("run", (F.col("n") > hot).cast("int").alias("hot")), f"{folder}/shared")
    # the anchors each document shares with another; bounded by the document's length
    here = found.join(shared, "run").groupBy("doc_id", "mark").agg(F.collect_list(F.col("at") * F.lit(2).cast("long") + F.col("hot")).alias("at"))

    def find_windows(batches):
        for b in batches:
            at = b.column("at")
            for rows, block in text_blocks(b):
                some = at.slice(rows.start, len(block.texts))
                if some.null_count == len(some):
                    continue
                runs, whole, smallest = window_anchors(block, window, run)
                flagged = np.asarray(some.flatten())
                anchor = runs[(flagged >> 1) + np.repeat(block.first[:-1], np.asarray(some.value_lengths().fill_null(0)))]
                of_hot = np.unique(anchor[flagged & 1 == 1])
                known = some.is_valid().to_numpy(zero_copy_only=False)  # rows without an id have none
                i = np.flatnonzero(among(smallest, np.unique(anchor)) & whole & known[block.of[:len(whole)]])
                words, others = block.hashes(), block.hashes(BYTE_BASES[1])
                one, two = run_hashes(words, window)[i].view(np.int64), (run_hashes(others, window, WORD_BASES[1])[i] >> np.uint64(33)).astype(np.int32)
                of = block.of[i]
                ids, marks = b.column("doc_id").fill_null(0).to_numpy()[rows], b.column("mark").to_numpy()[rows]
                salt = np.where(among(smallest[i], of_hot), 1 + ids[of] % salts, 0).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), pa.array(salt), pa.array(ids[of]), pa.array(marks[of] * HALF + i - block.first[of])], ["one", "two", "salt", "doc_id", "place"])

    # One shuffle of the windows serves the firsts and the join with them, and one of the texts serves both joins on
    # documents. For that the conditions below are put so that no filter moves beneath those shuffles.
    keys = ["one", "two", "salt"]
    windows = docs.join(here, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "at").mapInArrow(find_windows, "one long not null, two int not null, salt int not null, doc_id long not null, place long not null").repartition(*keys)
    # the keys get new names, else the join would see two different readings of the windows
    firsts = windows.groupBy(*keys).agg(F.min(F.struct("doc_id", "place")).alias("first")).select(*[F.col(k).alias(f"of_{k}") for k in keys], F.col("first.doc_id").alias("first"))
    held = windows.join(firsts, [F.col(k) == F.col(f"of_{k}") for k in keys])
    later = held.where("doc_id > first")
    before = firsts.where("if(first is null, 0, of_salt) > 0").groupBy("of_one", "of_two").agg(F.min("first").alias("before")).select(F.col("of_one").alias("any_one"), F.col("of_two").alias("any_two"), "before")
    opened = held.where("if(doc_id = first, salt, 0) > 0").join(before, [F.col("one") == F.col("any_one"), F.col("two") == F.col("any_two")]).where("first > before")
    # the first word of each removed window, 64 to a row
    gone = later.select("doc_id", "place").unionAll(opened.select("doc_id", "place"))
    gone = gone.select("doc_id", F.shiftright("place", 32).alias("mark"), F.col("place").bitwiseAND(F.lit(HALF - 1)).alias("at")).groupBy(
        "doc_id", "mark", F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits"))
    gone = gone.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("word", "bits")).alias("starts"))
    return gone.withColumn("copy", F.lit(False)).unionByName(copies.select("doc_id", "mark", F.lit(None).cast("array<struct<word:long,bits:long>>").alias("starts"), F.lit(True).alias("copy")))


def among(x: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Is each value one of the sorted known ones."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def intervals(words: np.ndarray, bits: np.ndarray, n: int, window: int) -> np.ndarray:
    """Flags of the n words that the windows starting at the given bits cover."""
    change = np.zeros(n + 1, np.int64)
    flags = np.unpackbits(bits.astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(flags)
    at = words[row] * 64 + bit
    np.add.at(change, at, 1)
    np.add.at(change, np.minimum(at + window, n), -1)
    return np.cumsum(change[:n]) > 0


def without_copies(docs: DataFrame, id_col="doc_id", text_col="text", window=WINDOW, run=RUN, hot=HOT, salts=SALTS, folder=None) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept (the words that stay, joined by a blank), kept_sha256,
    spans (begin and end of each removed interval, in words)."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = rows.withColumn("mark", F.xxhash64(F.coalesce("text", F.lit(""))).bitwiseAND(F.lit(HALF // 2 - 1)))
    starts = removed_words(rows, window, run, hot, salts, folder)

    def cut(batches):
        for b in batches:
            out = []
            for text, starts, copy in zip(b.column("text"), b.column("starts"), b.column("copy")):
                words = (text.as_py() or "").encode().split()
                n, spans = len(words), []
                if copy.as_py():
                    words, spans = [], [[0, n]]
                elif starts.is_valid:
                    at = starts.values
                    gone = intervals(at.field("word").to_numpy(), at.field("bits").to_numpy(), n, window)
                    spans = np.flatnonzero(np.diff(np.r_[False, gone, False].view(np.int8))).reshape(-1, 2).tolist()
                    words = [w for w, g in zip(words, gone.tolist()) if not g]
                kept = b" ".join(words)
                out.append((n, n - len(words), kept.decode(), hashlib.sha256(kept).hexdigest(), spans))
            n, gone, kept, sha, spans = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(sha, pa.string()), pa.array(spans, pa.list_(pa.list_(pa.int64())))],
                                             ["doc_id", "n_words", "n_removed", "kept", "kept_sha256", "spans"])

    return rows.join(starts, ["doc_id", "mark"], "left").select("doc_id", "mark", "text", "starts", "copy").mapInArrow(
        cut, "doc_id long, n_words long, n_removed long, kept string, kept_sha256 string, spans array<array<long>>")
