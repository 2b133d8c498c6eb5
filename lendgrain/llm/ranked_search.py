"""Ranked lexical search: the best documents of each item of a query set, over a tree of documents per task.

Every document is reduced to the query terms it has, with their frequencies, and to its number of terms; these rows
are written once. The documents' counts N and L and the document frequencies are sums in Spark. Each task then lays
its documents into trees (fp_tree.py) of some thousand each and searches every tree for every item by branch and
bound; the score to beat of an item carries over from tree to tree. Of the tasks' best, Spark takes the best.

The items go in blocks of bounded size, and a block's terms are sent to all tasks; an item larger than a block is a
block that size. Scores are 64-bit whole numbers; the weight of a term comes from a logarithm in doubles.

Defined cases: a null text has no terms; a document without terms, or with none of an item's, is not returned for it;
texts are taken whole; repeated rows are ranked one by one; an item without hits has no rows; each row of the items
is an item of its own, even if it repeats an id; ties go by ascending id, null ids last; ids keep their type; an
empty table gives an empty result; other columns are not looked at.
"""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from lendgrain.llm.fp_tree import Tree
from lendgrain.llm.shared import new_folder, staged

TABLE = bytes(i + 32 if 65 <= i <= 90 else i if i >= 128 or 48 <= i <= 57 or 97 <= i <= 122 else 32 for i in range(256))
CHUNK = 1 << 20
TREE = 4096
TREE_TERMS = 1 << 21
BLOCK_BYTES = 64 << 20
BEST = 20


def term_counts(text: bytes | None):
    """(number of terms, frequency of each)."""
    data, at, n, counts = (text or b"").translate(TABLE), 0, 0, Counter()
    while at < len(data):
        to = data.find(b" ", at + CHUNK)
        to = len(data) if to < 0 else to
        words = data[at:to].split()
        counts.update(words)
        n, at = n + len(words), to
    return n, counts


def restricted(docs: DataFrame, number: dict[bytes, int], id_col: str, text_col: str) -> DataFrame:
    """doc_id, n, terms, tf: of each document its number of terms, and the query terms in it."""
    def run(batches):
        for b in batches:
            sizes, terms, tf, ends = [], [], [], [0]
            for text in b.column(1):
                n, counts = term_counts(text.as_py())
                sizes.append(n)
                some = number.keys() & counts.keys()
                terms.extend(number[t] for t in some)
                tf.extend(counts[t] for t in some)
                ends.append(len(terms))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32())) for x in (terms, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), *lists], ["doc_id", "n", "terms", "tf"])

    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    return rows.mapInArrow(run, StructType([rows.schema["doc_id"]]).add("n", "long").add("terms", ArrayType(IntegerType())).add("tf", ArrayType(IntegerType())))


def id_places(ids: list) -> np.ndarray:
    """The rank of each id, nulls last."""
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, 0 if ids[i] is None else ids[i]))
    out = np.empty(len(ids), np.int64)
    out[order] = np.arange(len(ids))
    return out


class Search:
    """What a task keeps: for each item, its best documents so far as (-score, id is null, id)."""

    def __init__(self, items, weights, rank, total, length, k):
        self.items = [(rank[t], n * weights[t]) for t, n in items]
        self.rank, self.total, self.length, self.k = rank, total, length, k
        self.best = [[] for _ in items]

    def add(self, ids, n, terms, tf, sizes):
        m = np.array([75 + 25 * x * self.total // self.length for x in n.tolist()], np.int64)
        tree = Tree(self.rank[terms], tf.astype(np.int64), sizes, m, id_places(ids), len(self.rank))
        for (some, weights), best in zip(self.items, self.best):
            found = tree.search(some, weights, self.k, self.to_beat(best))
            try:
                docs, score = next(found)
                while True:
                    best.extend((-s, ids[d] is None, ids[d]) for d, s in zip(docs.tolist(), score.tolist()))
                    best.sort(key=lambda x: x[:2] if x[1] else x)
                    del best[self.k:]
                    docs, score = found.send(self.to_beat(best))
            except StopIteration:
                pass

    def to_beat(self, best):
        return -best[-1][0] if len(best) == self.k else 1


def block_search(rows: DataFrame, items: list, k: int, tree: int) -> DataFrame:
    """item, doc_id, score: for each item the k best of each task. rows: as from restricted(); items: (terms, frequencies) by number."""
    kinds = 1 + max((int(t.max()) for t, _ in items if len(t)), default=0)
    counts = rows.agg(F.count(F.when(F.col("n") > 0, 1)).alias("total"), F.sum("n").alias("length")).first()
    total, length = counts.total, counts.length or 0
    df = np.zeros(kinds, np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per query term of the block at most
        df[r.t] = r["count"]
    weights = np.array([math.floor(1000 * math.log((2 * total + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
    rank = np.empty(kinds, np.int64)
    rank[np.lexsort((np.arange(kinds), -df))] = np.arange(kinds)

    def run(batches):
        search, held, held_terms, kind = Search(items, weights, rank, total, length, k), [], 0, None

        def done():
            b = pa.Table.from_batches(held).combine_chunks()
            lists = [b.column(c).chunk(0) for c in ("terms", "tf")]
            sizes = lists[0].value_lengths().to_numpy().astype(np.int64)
            search.add(b.column("doc_id").to_pylist(), b.column("n").to_numpy(), *(x.flatten().to_numpy() for x in lists), sizes)

        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                held.append(some)
                held_terms += len(some.column(2).flatten())
                if 256 * len(held) >= tree or held_terms >= TREE_TERMS:
                    done()
                    held, held_terms = [], 0
            kind = b.column(0).type
        if held:
            done()
        for i, best in enumerate(search.best):
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(best), pa.int64()), pa.array([x[2] for x in best], kind), pa.array([-x[0] for x in best], pa.int64())], ["item", "doc_id", "score"])

    some = rows.where(F.size("terms") > 0)
    return some.mapInArrow(run, StructType([StructField("item", LongType()), rows.schema["doc_id"]]).add("score", "long"))


def item_blocks(items: DataFrame, folder: str, id_col: str, text_col: str, block_bytes: int):
    """The items with a number each, and lists of (number, terms) in blocks of about so many bytes."""
    rows = items.select(F.col(f"`{id_col}`").alias("item_id"), F.col(f"`{text_col}`").cast("binary").alias("text"), F.monotonically_increasing_id().alias("item"))
    rows = staged(rows, f"{folder}/items")
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = size // block_bytes + 1
    for i in range(blocks):
        some = rows.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == i)
        yield some.select("item", "item_id"), [(r.item, term_counts(r.text)[1]) for r in some.select("item", "text").toLocalIterator()]


def ranked(docs: DataFrame, items: DataFrame, folder: str | None = None, k=BEST, id_col="doc_id", text_col="text", item_col="item_id", item_text="text",
           tree=TREE, block_bytes=BLOCK_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of each item. Stages go to the folder."""
    folder = folder or new_folder(docs.sparkSession, "search")
    found = None
    for i, (names, block) in enumerate(item_blocks(items, folder, item_col, item_text, block_bytes)):
        number = {t: j for j, t in enumerate(sorted({t for _, c in block for t in c}))}
        rows = staged(restricted(docs, number, id_col, text_col), f"{folder}/docs-{i}")
        queries = [(np.array([number[t] for t in c], np.int64), np.array(list(c.values()), np.int64)) for _, c in block]
        best = block_search(rows, queries, k, tree)
        place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
        best = best.withColumn("rank", place).where(F.col("rank") <= k)
        of = docs.sparkSession.createDataFrame([(j, n) for j, (n, _) in enumerate(block)], "item long, number long")  # the block's items
        best = best.join(F.broadcast(of), "item").drop("item").join(names.withColumnRenamed("item", "number"), "number").select("item_id", "rank", "doc_id", "score")
        found = best if found is None else found.unionByName(best)
    return found
