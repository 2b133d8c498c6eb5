"""Phrases of several words that occur together more often than their parts would: mined with an FM-index per shard.

Each task numbers the words of its documents, language by language, into shards of some four million words. Words are
counted over all shards and the rare ones fall out; an FM-index of each shard then gives its pairs of words, and once
those are counted over all shards and the rare ones are out too, an index of what is left gives the phrases of three,
and one of what is left then the longer ones. A phrase can only be frequent if all shorter ones in it are, so that
nothing frequent is lost. Counts are sums over the shards. Every step's table goes by key; none is sent to all tasks.

A word is known by the number of one shard that holds it and its place there, so that ids need no table of their own.
A piece of text that is longer than a shard goes on in the next one: the last words are repeated there, and what lies
wholly in the repeated words is taken off the first shard's counts.

Defined cases: a null text has no words, a null language is `und`; empty and blank texts count for nothing; texts are
taken whole; repeated rows count as often as they occur; an empty table, or one without frequent phrases, gives an
empty result; ties go by count, then by phrase in the order of its bytes; other columns are not looked at.
"""

import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.llm.fm_index import WordIndex
from lendgrain.llm.shared import new_folder, staged

SHARD = 1 << 22
HELD = 1 << 23
CHUNK = 1 << 20
PLACES = 24  # bits for the place of a word in its shard
STOP = b"\xff"  # in no UTF-8 text
ENDS = b".,;:!?\n\x0b\x0c\r"
TABLE = bytes(0xFF if i in ENDS else 32 if i == 9 else i + 32 if 65 <= i <= 90 else i for i in range(256))
GAP = re.compile(b"[ \xff]")
NONE = -1
ROWS = 1 << 16

ENTRIES = "shard long, lang string, place int, word binary, n long, ids binary, tail int"


class Numbers(dict):
    """Numbers words in the order they come; 0 is the end of a piece."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class Shard:
    def __init__(self, lang: str, first=()):
        """first: the last words of the shard before, if the piece goes on here."""
        self.lang, self.numbers, self.parts, self.size = lang, Numbers({STOP: 0}), [np.zeros(1, np.int32)], 0
        if first:
            self.add(first)

    def add(self, words):
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.size += len(words)

    def rows(self, shard: int, tail: int):
        """One row for each word, and one with the ids. tail: how many of the last words the next shard has again."""
        ids = np.concatenate([*self.parts, np.zeros(1, np.int32)])
        counts = np.bincount(ids[:len(ids) - 1 - tail], minlength=len(self.numbers))[1:]
        words = list(self.numbers)[1:]
        for at in range(0, len(words), ROWS):
            some = words[at:at + ROWS]
            yield record(len(some), shard, self.lang, place=np.arange(at, at + len(some)), word=some, n=counts[at:at + ROWS])
        yield record(1, shard, self.lang, ids=[pa.compress(ids.tobytes(), codec="zstd", asbytes=True)], tail=[tail], n=[ids.nbytes])


def record(size, shard, lang, **columns):
    kinds = {"shard": pa.int64(), "lang": pa.string(), "place": pa.int32(), "word": pa.binary(), "n": pa.int64(), "ids": pa.binary(), "tail": pa.int32()}
    values = {"shard": np.full(size, shard), "lang": [lang] * size} | columns
    return pa.RecordBatch.from_arrays([pa.array(values[c], k) if c in values else pa.nulls(size, k) for c, k in kinds.items()], list(kinds))


def chunks(text: bytes):
    """Lists of words, with STOP between pieces."""
    data, at = text.translate(TABLE), 0
    while at < len(data):
        to = len(data)
        if at + CHUNK < to and (gap := GAP.search(data, at + CHUNK)):
            to = gap.start()
        yield data[at:to].replace(STOP, b" \xff ").split()
        at = to


def last_words(words: list, n: int) -> list:
    """The words of the piece that is not at its end yet, n at most."""
    some = words[-n:] if n else []
    return some[len(some) - some[::-1].index(STOP):] if STOP in some else some


def shard_rows(batches, longest, limit, held):
    """(language, text) -> ENTRIES."""
    first, serial, open_shards = TaskContext.get().partitionId() << 20, 0, {}

    def closed(lang, tail=0):
        nonlocal serial
        yield from open_shards.pop(lang).rows(first + serial, tail)
        serial += 1

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1)):
            before, inside = [], False
            for words in chunks(text.as_py() or b""):
                shard = open_shards.get(lang)
                if shard is not None and shard.size >= limit:
                    again = last_words(before, longest - 1)
                    yield from closed(lang, len(again))
                    shard = open_shards[lang] = Shard(lang, again)
                elif shard is None:
                    shard = open_shards[lang] = Shard(lang)
                shard.add(words)
                before = [*before[1 - longest:], *words] if len(words) < longest else words
                inside = True
            if inside:
                open_shards[lang].add([STOP])
            if sum(s.size for s in open_shards.values()) > held:
                yield from closed(max(open_shards, key=lambda k: open_shards[k].size))
    for lang in list(open_shards):
        yield from closed(lang)


def frequent_sequence(entry: pa.Table, places: np.ndarray):
    """A shard's ids, numbered from 1 in the order of the places given, 0 for all else; and those of the words repeated at its end."""
    row = entry.to_pylist()[0]
    ids = np.frombuffer(pa.decompress(row["ids"], decompressed_size=row["n"], codec="zstd", asbytes=True), np.int32)
    number = np.zeros(max(int(ids.max()), int(places[-1]) + 1) + 1, np.int64)
    number[places + 1] = np.arange(1, len(places) + 1)
    ids = number[ids]
    tail = ids[len(ids) - 1 - row["tail"]:-1]
    return ids[np.r_[True, (ids[1:] != 0) | (ids[:-1] != 0)]], tail


def glued(ids: np.ndarray, pairs: np.ndarray) -> np.ndarray:
    """The sequence with a 0 between any two words that are not one of the pairs (sorted, first * 2**32 + second); words in no pair are left out."""
    key = (ids[:-1] << 32) + ids[1:]
    at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
    after = np.r_[pairs[at] == key, False]
    some = after | np.r_[False, after[:-1]]
    ids, after = ids[some], after[some]
    size = 2 - after
    out = np.zeros(1 + size.sum(), np.int64)
    out[1 + np.cumsum(size) - size] = ids
    return out


def found_in(keys: np.ndarray, known: np.ndarray):
    """The place of each key among the known ones (sorted), and whether it is one of them."""
    at = np.minimum(np.searchsorted(known, keys), max(len(known) - 1, 0))
    return at, known[at] == keys if len(known) else np.zeros(len(keys), bool)


def in_threes(ids: np.ndarray, threes: np.ndarray) -> np.ndarray:
    """The stretches of four words and more in which any three neighbours are one of the threes (a row each), with a 0
    around each. Stretches that overlap stand apart, so that a run of four lies in one of them or in none."""
    pairs, first = np.unique((threes[:, 0] << 32) + threes[:, 1], return_inverse=True)
    known = np.unique((first << 32) + threes[:, 2])
    if len(ids) < 4 or not len(known):
        return np.zeros(1, np.int64)
    at, is_pair = found_in((ids[:-2] << 32) + ids[1:-1], pairs)
    start = np.flatnonzero(is_pair)
    start = start[found_in((at[start] << 32) + ids[start + 2], known)[1]]  # where one of the threes begins
    begin = np.flatnonzero(np.diff(start, prepend=-2) != 1)
    size = np.diff(np.r_[begin, len(start)])  # threes in each stretch
    begin, size = start[begin[size > 1]], size[size > 1] + 2
    ends = np.cumsum(size + 1)
    out = np.zeros(1 + size.sum() + len(size), np.int64)
    inside = np.ones(len(out), bool)
    inside[np.r_[0, ends]] = False
    out[inside] = ids[np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    return out


def own_counts(grams, tail: np.ndarray) -> np.ndarray:
    """How often each run occurs, without what lies in the words that the next shard has again."""
    count, size = grams.count.copy(), grams.words.shape[1]
    for at in range(len(tail) - size + 1):
        count[(grams.words == tail[at:at + size]).all(axis=1)] -= 1
    return count


def pieces_of(columns: dict, rows: int = ROWS) -> pa.Table:
    """A table in batches of some rows."""
    n = len(next(iter(columns.values())))
    cuts = range(0, n, rows) if n else [0]
    return pa.Table.from_batches([pa.RecordBatch.from_arrays([pa.array(v[at:at + rows]) for v in columns.values()], list(columns)) for at in cuts])


def sorted_places(known: pa.Table):
    """Places and ids of the frequent words of a shard, by place."""
    place, word = known.column("place").to_numpy(), known.column("word_id").to_numpy()
    order = np.argsort(place)
    return place[order], word[order]


def gram_counts(entry: pa.Table, known: pa.Table, first: int, last: int) -> pa.Table:
    """The phrases of `first` to `last` words of a shard, of frequent words, and from three words on of the pairs given,
    from four on of the threes given. Those without a count of their own too, as longer ones may hold them."""
    names = ["shard", *[f"w{i}" for i in range(last)], "n"]
    is_word = known.column("place").is_valid().to_numpy() if len(known) else np.zeros(0, bool)
    if not is_word.any() or first > 2 and is_word.all():
        return pieces_of({c: np.zeros(0, np.int64) for c in names})
    place, word = sorted_places(known.filter(pa.array(is_word)))
    ids, tail = frequent_sequence(entry, place)
    if first > 2:
        runs, by_id = known.filter(pa.array(~is_word)), np.argsort(word)
        parts = [by_id[np.searchsorted(word, runs.column(c).to_numpy(), sorter=by_id)] + 1 for c in ("one", "two", "three")[:min(first, 4) - 1]]
        ids = glued(ids, np.unique((parts[0] << 32) + parts[1])) if first == 3 else in_threes(ids, np.stack(parts, axis=1))
    shard, found = known.column("shard")[0].as_py(), []
    for grams in WordIndex(ids, last).grams(last):
        size, many = grams.words.shape[1], len(grams.count)
        if size >= first:
            words = [word[w - 1] for w in grams.words.T] + [np.full(many, NONE)] * (last - size)
            found.append(pieces_of(dict(zip(names, [np.full(many, shard), *words, own_counts(grams, tail)]))))
    return pa.concat_tables(found)


class Mined:
    """words: word_id, lang, word, n; phrases: ids (of two words and more), n; totals: lang, total."""

    def __init__(self, words: DataFrame, phrases: DataFrame, totals: DataFrame):
        self.words, self.phrases, self.totals = words, phrases, totals


def mined(docs: DataFrame, folder: str, text_col="text", lang_col="lang", longest=5, at_least=100, shard=SHARD, held=HELD) -> Mined:
    """Counts of all phrases of up to `longest` words that occur `at_least` times; stages go to the folder."""
    rows = docs.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")), F.col(f"`{text_col}`").cast("binary"))
    entries = staged(rows.mapInArrow(lambda batches: shard_rows(batches, longest, shard, held), ENTRIES), f"{folder}/shards")
    ids = entries.where("ids is not null").select("shard", "ids", "tail", "n")
    of_words = entries.where("word is not null")
    totals = of_words.groupBy("lang").agg(F.sum("n").alias("total"))

    same = Window.partitionBy("lang", "word")
    mark = F.shiftleft("shard", PLACES) + F.col("place")
    words = of_words.select("shard", "place", "lang", "word", F.sum("n").over(same).alias("n"), F.min(mark).over(same).alias("word_id"), mark.alias("mark"))
    words = staged(words.where(F.col("n") >= at_least), f"{folder}/words")
    places = words.select("shard", "place", "word_id")

    names = lambda n: [f"w{i}" for i in range(n)]

    def grams(known, first, last):
        sides = ids.groupBy("shard").cogroup(known.groupBy("shard"))
        kind = ", ".join(f"{c} long" for c in ("shard", *names(last), "n"))
        return sides.applyInArrow(lambda entry, some: gram_counts(entry, some, first, last), kind)

    def frequent(rows, size, name):
        """The rows of the shards whose phrase is frequent over all of them, with its whole count."""
        rows = rows.withColumn("n", F.sum("n").over(Window.partitionBy(*names(size))))
        return staged(rows.where(F.col("n") >= at_least), f"{folder}/{name}")

    def with_runs(runs=None, size=0):
        """The frequent words of each shard, and its frequent pairs or threes, by the ids of their words."""
        columns = ["one", "two", "three"][:size]
        no = lambda kind: F.lit(None).cast(kind)
        rows = places.select("*", *[no("long").alias(c) for c in columns])
        if runs is None:
            return rows
        return rows.unionByName(runs.select("shard", no("int").alias("place"), no("long").alias("word_id"), *[F.col(w).alias(c) for w, c in zip(names(size), columns)]))

    def spelled(rows, size):
        return rows.select(F.filter(F.array(*names(size)), lambda x: x != NONE).alias("ids"), "n")

    # pairs first, then what is made of frequent pairs, then what is made of frequent threes
    pairs = frequent(grams(with_runs(), 2, 2), 2, "pairs")
    phrases = spelled(pairs.drop("shard").distinct(), 2)
    if longest > 2:
        threes = frequent(grams(with_runs(pairs, 2), 3, 3), 3, "threes")
        phrases = phrases.unionByName(spelled(threes.drop("shard").distinct(), 3))
    if longest > 3:
        rest = grams(with_runs(threes, 3), 4, longest)
        phrases = phrases.unionByName(spelled(rest.groupBy(*names(longest)).agg(F.sum("n").alias("n")).where(F.col("n") >= at_least), longest))
    words = words.where(F.col("mark") == F.col("word_id")).select("word_id", "lang", "word", "n")
    return Mined(words, staged(phrases, f"{folder}/phrases"), totals)


def scored(found: Mined) -> DataFrame:
    """Every phrase with its worst cut: ids, a, l, r, n, score. Whole numbers of 128 bits, as products pass 64."""
    parts = found.phrases.unionByName(found.words.select(F.array("word_id").alias("ids"), "n"))
    cuts = found.phrases.select("ids", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.size("ids") - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, F.size("ids")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
    cuts = cuts.join(parts.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    langs = found.words.select(F.col("word_id").alias("head"), "lang").join(F.broadcast(found.totals), "lang")  # a row per language
    cuts = cuts.withColumn("head", F.col("ids")[0]).join(langs, "head")
    score = F.expr("(cast(a as decimal(16,0)) * 1000 * cast(total as decimal(18,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))")
    worst = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")
    return cuts.groupBy("ids").agg(F.first("lang").alias("lang"), F.first("a").alias("a"), F.first("total").alias("n"), worst).select("ids", "lang", "a", "cut.l", "cut.r", "n", "cut.score")


def contained(phrases: DataFrame, share: int) -> DataFrame:
    """The phrases that lie inside a longer one with `share` hundredths of their own count."""
    long = phrases.where(F.size("ids") > 2).select("ids", "n", F.explode(F.sequence(F.lit(2), F.size("ids") - 1)).alias("size"))
    long = long.select("ids", "n", "size", F.explode(F.sequence(F.lit(1), F.size("ids") - F.col("size") + 1)).alias("at"))
    inner = long.groupBy(F.slice("ids", F.col("at"), F.col("size")).alias("ids")).agg(F.max("n").alias("longer"))
    return inner.join(phrases, "ids").where(F.col("longer") * 100 >= F.col("n") * share).select("ids")


def collocations(docs: DataFrame, folder: str | None = None, text_col="text", lang_col="lang", longest=5, at_least=100, share=100, best=2000, shard=SHARD, held=HELD) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    a, l, r: counts of the phrase and of the two parts of its worst cut; n: all words of the language. The score is
    floor(1000 * a * n / (l * r)). A phrase inside a longer one that occurs (nearly) as often is left out.
    """
    own = folder or new_folder(docs.sparkSession, "phrases")
    found = mined(docs, own, text_col, lang_col, longest, at_least, shard, held)
    rows = staged(scored(found).join(contained(found.phrases, share), "ids", "left_anti"), f"{own}/scored")
    spelled = rows.select("ids", F.posexplode("ids").alias("at", "word_id")).join(found.words.select("word_id", "word"), "word_id")
    spelled = spelled.groupBy("ids").agg(F.sort_array(F.collect_list(F.struct("at", F.col("word").cast("string").alias("word")))).alias("words"))
    rows = rows.join(spelled.select("ids", F.array_join("words.word", " ").alias("phrase")), "ids")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    return rows.withColumn("place", place).where(F.col("place") <= best).select("lang", F.col("place").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
