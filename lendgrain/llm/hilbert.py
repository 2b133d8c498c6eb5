"""Sharding along a Hilbert curve over several metadata columns.

Every dimension is quantised at its own quantiles (strings by their first bytes, in order), the cells are numbered
along the Hilbert curve, and rows are sorted by that number. The sorted run is cut into shards that differ by one
row at most. Rows near each other on the curve are near in every dimension, so a shard's files have narrow ranges in
all of them, and readers can skip files by their minimum and maximum whatever dimension they filter on.

The sort is a range shuffle with the text's checksum and the id as further keys, so that a cell which holds very
many rows is dealt over several tasks and equal texts lie together. The position of a row is its place within its
task plus the rows of the tasks before it (one number per task goes through the driver).

Defined cases: a null in a dimension is its own lowest step; a null text has no bytes; rows that repeat all keys
follow each other in any order, being equal; rows without an id come first among equals; an empty table gives an
empty result; further columns stay as they are in write_shards and are not looked at by shards().
"""

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import cut, new_folder, own_name, staged

BITS = 6
SHARDS = 24
IN_TASK = (1 << 33) - 1


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """Number along the curve of each row of cells (n x dimensions, values below 2**bits)."""
    x = cells.T.astype(np.uint64).copy()
    dims = len(x)
    if dims * bits > 62:
        raise ValueError("dimensions times bits must not exceed 62")
    for level in range(bits - 1, 0, -1):
        q, low = np.uint64(1 << level), np.uint64((1 << level) - 1)
        for d in range(dims):
            on = (x[d] & q) != 0
            swap = np.where(on, np.uint64(0), (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    for level in range(bits - 1, 0, -1):
        turn ^= np.where((x[-1] & np.uint64(1 << level)) != 0, np.uint64((1 << level) - 1), np.uint64(0))
    x ^= turn
    out = np.zeros_like(x[0])
    for level in range(bits - 1, -1, -1):
        for d in range(dims):
            out = out << np.uint64(1) | (x[d] >> np.uint64(level)) & np.uint64(1)
    return out.astype(np.int64)


def as_number(df: DataFrame, column: str):
    """A dimension as a number in its own order: strings by their first six bytes, others by their value."""
    c, kind = F.col(f"`{column}`"), dict(df.dtypes)[column]
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    return c.cast("double") if kind not in ("date", "timestamp") else c.cast("timestamp").cast("double")


def steps(df: DataFrame, columns: list[str], bits: int) -> list[list[float]]:
    """Quantiles that cut each dimension into at most 2**bits - 1 steps."""
    share = [i / (2**bits - 1) for i in range(1, 2**bits - 1)]
    row = df.agg(*[F.percentile_approx(c, share, 10_000).alias(c) for c in columns]).first()
    return [sorted(set(row[c] or [])) for c in columns]


def curve(columns: list[str], limits: list[list[float]], bits: int):
    """The curve index of number columns, as a column."""
    def index(*values: pd.Series) -> pd.Series:
        found = [np.where(v.isna(), 0, 1 + np.searchsorted(s, v.fillna(0), "right")) for v, s in zip(values, limits)]
        # dimensions with few steps are spread over the whole side, so that each counts alike on the curve
        cells = [c * (2**bits - 1) // (len(s) + 1) for c, s in zip(found, limits)]
        return pd.Series(hilbert_index(np.stack(cells, axis=1), bits))

    return F.pandas_udf(index, "long")(*[F.col(f"`{c}`") for c in columns])


def in_order(rows: DataFrame, keys: list[str], folder: str, position: str) -> DataFrame:
    """The rows with their position in the order of the keys, from 0; written, as positions must not change."""
    spark, mark = rows.sparkSession, own_name(rows, "mark")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn(mark, F.monotonically_increasing_id())
    rows = staged(rows, folder)
    task = F.shiftright(F.col(mark), 33)
    counts = sorted(map(tuple, rows.groupBy(task.alias("task")).count().collect()))  # one row per task
    before, total = [], 0
    for t, n in counts:
        before.append((t, total))
        total += n
    side = F.broadcast(spark.createDataFrame(before, "task long, before long"))  # as many rows as tasks
    return rows.join(side, task == F.col("task")).withColumn(position, F.col("before") + F.col(mark).bitwiseAND(F.lit(IN_TASK))).drop(mark, "task", "before")


def cut_runs(position: str, n: int, shards: int):
    """(shard, slot) of a position: runs that differ by one row at most, the longer ones first. Whole numbers only."""
    size, longer = divmod(n, shards)
    edge = longer * (size + 1)  # up to here runs have one row more
    shard = F.expr(f"if(`{position}` < {edge}L, `{position}` div {size + 1}L, {longer}L + (`{position}` - {edge}L) div {max(size, 1)}L)")
    return shard, F.expr(f"if(`{position}` < {edge}L, `{position}` % {size + 1}L, (`{position}` - {edge}L) % {max(size, 1)}L)")


def shards(docs: DataFrame, dimensions=("lang", "source", "size"), id_col="doc_id", text_col="text", n_shards=SHARDS, bits=BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: the law is `rows`), curve_index."""
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    sized = docs.withColumn("size", F.octet_length(text).cast("long") + 8)
    names = [f"d{i}" for i in range(len(dimensions))]
    rows = cut(sized.select(F.col(f"`{id_col}`").alias("doc_id"), "size", F.crc32(text).alias("text_crc32"), *[as_number(sized, c).alias(n) for c, n in zip(dimensions, names)]))
    rows = rows.withColumn("curve_index", curve(names, steps(rows, names, bits), bits)).drop(*names)
    n = rows.count()
    placed = in_order(rows, ["curve_index", "text_crc32", "doc_id"], new_folder(docs.sparkSession, "shards"), "position")
    shard, slot = cut_runs("position", n, n_shards)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), shard.cast("int").alias("shard"), slot.cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve_index")


def write_shards(df: DataFrame, folder: str, dimensions: list[str], key: str, n_shards=SHARDS, bits=BITS) -> DataFrame:
    """Writes the rows, whole, to folder/shards in curve order, one folder per shard, and reads them back with `shard`."""
    names = []
    for c in dimensions:
        names.append(own_name(df.select(*df.columns, *[F.lit(0).alias(n) for n in names]), "dim"))
    index, position, shard = (own_name(df, x) for x in ("curve_index", "position", "shard"))
    numbers = df.select("*", *[as_number(df, c).alias(n) for c, n in zip(dimensions, names)])
    rows = numbers.withColumn(index, curve(names, steps(numbers, names, bits), bits)).drop(*names)
    placed = in_order(rows, [index, key], f"{folder}/sorted", position)
    run, _ = cut_runs(position, placed.count(), n_shards)
    placed.withColumn(shard, run.cast("int")).drop(position, index).write.partitionBy(shard).parquet(f"{folder}/shards")
    return df.sparkSession.read.parquet(f"{folder}/shards")
