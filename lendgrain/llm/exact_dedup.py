"""Exact duplicates by two-pass Bloom filtering, in DataFrame functions only.

Pass 1 sets, for each text hash, one slot in each of two Bloom regions and keeps the slots that were set twice.
Pass 2 tests every row against that filter: a row whose slots were not both set twice has no equal and passes
straight through; only the others shuffle, and are settled by their SHA-256.

The filter is broadcast, so its size is bounded: at most 2 * max_bits bits, in words of 64 (2**26 bits make at
most 2**21 rows of two longs). Where the rows need more bits than that, they are written in slices by another hash of
their text, without a shuffle, and each slice gets a filter of its own, one after the other; equal texts share a slice.

Defined cases: a null text counts as empty; rows without an id never name a group, and a group without any id
keeps all its rows; rows that repeat an id and a text are one document listed again and share its decision
(drop_exact_copies keeps one of them); an empty table gives an empty result; other columns are not looked at.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import cut, drop_folder, new_folder, own_name, staged

BITS_PER_ROW = 16
MAX_BITS = 1 << 26
BLANKS = r"[\x20\x09-\x0D]+"


def text_digest(text):
    """SHA-256 of the text with each run of blanks made one space, as 32 bytes."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), BLANKS, " "), 256))


def slots(digest, bits):
    """One slot in each of the two regions, from the halves of a 64-bit hash."""
    h = F.xxhash64(digest)
    low, high = h.bitwiseAND(F.lit(bits - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(bits - 1))
    return [low, high + F.lit(bits)]


def repeated_filter(digests: DataFrame, bits: int) -> DataFrame:
    """Pass 1: the words (of 64 slots) of the filter that have slots set by two rows or more."""
    seen = digests.select(F.explode(F.array(*slots(F.col("digest"), bits))).alias("slot")).groupBy("slot").agg(F.count("*").alias("n"))
    return (seen.where("n > 1")
            .groupBy(F.shiftright("slot", 6).alias("word"))
            .agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("mask")))


def with_flag(rows: DataFrame, digest: str, repeated: DataFrame, bits: int, flag: str) -> DataFrame:
    """Pass 2: the rows with a flag that is false only if no other row has the same digest."""
    out, hit = rows, F.lit(True)
    for i, slot in enumerate(slots(F.col(digest), bits)):
        word, mask = own_name(rows, f"word{i}"), own_name(rows, f"mask{i}")
        side = F.broadcast(repeated.select(F.col("word").alias(word), F.col("mask").alias(mask)))
        out = out.join(side, F.shiftright(slot, 6) == F.col(word), "left")
        place = F.pmod(slot, F.lit(64)).cast("int")
        hit = hit & F.coalesce(F.call_function("getbit", F.col(mask), place) == 1, F.lit(False))
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], hit.alias(flag))


def filter_size(n: int, bits_per_row: int, max_bits: int) -> int:
    return min(max_bits, 1 << max(10, (n * bits_per_row - 1).bit_length()))


def slice_count(n: int, bits_per_row: int, max_bits: int) -> int:
    return max(1, -(-n * bits_per_row // max_bits))


def by_slice(rows: DataFrame, digest: str, n: int, bits_per_row: int, max_bits: int, settle) -> DataFrame:
    """settle(rows, bits) of all rows at once, or slice by slice where one filter would fill up."""
    slices, bits = slice_count(n, bits_per_row, max_bits), filter_size(n, bits_per_row, max_bits)
    if slices == 1:
        return settle(rows, bits)
    spark, folder, part = rows.sparkSession, new_folder(rows.sparkSession, "slices"), own_name(rows, "slice")
    hashed = F.pmod(F.xxhash64(F.col(f"`{digest}`"), F.lit("slice")), F.lit(slices))
    rows.withColumn(part, hashed).write.partitionBy(part).parquet(f"{folder}/in")
    whole, done = spark.read.schema(rows.schema.add(part, "long")).parquet(f"{folder}/in"), []
    for i in range(slices):
        some = settle(whole.where(F.col(part) == i).drop(part), bits)
        done.append(staged(some, f"{folder}/out/{i}").schema)
    out = spark.read.schema(done[0]).parquet(*[f"{folder}/out/{i}" for i in range(slices)])
    drop_folder(spark, f"{folder}/in")
    return out


def settled(rows: DataFrame, bits: int) -> DataFrame:
    """rows: doc_id, digest -> doc_id, digest, keep_id, group_size."""
    repeated = cut(repeated_filter(rows, bits))
    tested = with_flag(rows, "digest", repeated, bits, "maybe")
    maybe = tested.where("maybe")
    # cut, so that the join deals out both sides and a very large group can be split
    groups = cut(maybe.groupBy("digest").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    met = maybe.join(groups, "digest").select("doc_id", "digest", "keep_id", "group_size")
    straight = tested.where("not maybe").select("doc_id", "digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    return straight.unionByName(met)


def exact_dedup(docs: DataFrame, id_col="doc_id", text_col="text", bits_per_row=BITS_PER_ROW, max_bits=MAX_BITS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = cut(docs.select(F.col(f"`{id_col}`").alias("doc_id"), text_digest(F.col(f"`{text_col}`")).alias("digest")))
    found = by_slice(rows, "digest", rows.count(), bits_per_row, max_bits, settled)
    return found.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def drop_exact_copies(docs: DataFrame, id_col="doc_id", text_col="text", bits_per_row=BITS_PER_ROW, max_bits=MAX_BITS) -> DataFrame:
    """The documents without those that equal one with a smaller id; whole rows that pass the filter never shuffle."""
    digest, flag, keep = own_name(docs, "digest"), own_name(docs, "maybe"), own_name(docs, "keep_id")
    columns = [F.col(f"`{c}`") for c in docs.columns]

    def kept_rows(hashed, bits):
        digests = cut(hashed.select(F.col(f"`{digest}`").alias("digest"), F.col(f"`{id_col}`").alias("doc_id")))
        repeated = cut(repeated_filter(digests, bits))
        maybe = with_flag(digests, "digest", repeated, bits, "maybe").where("maybe")
        groups = cut(maybe.groupBy(F.col("digest").alias("group")).agg(F.min("doc_id").alias(keep)))
        tested = with_flag(hashed, digest, repeated, bits, flag)
        copies = tested.where(F.col(flag)).join(groups, F.col(f"`{digest}`") == F.col("group")).where(F.col(f"`{id_col}`").eqNullSafe(F.col(keep)))
        named = copies.where(F.col(keep).isNotNull()).dropDuplicates([digest]).select(*columns)
        nameless = copies.where(F.col(keep).isNull()).select(*columns)
        return tested.where(~F.col(flag)).select(*columns).unionAll(named).unionAll(nameless)

    return by_slice(docs.withColumn(digest, text_digest(F.col(f"`{text_col}`"))), digest, docs.count(), bits_per_row, max_bits, kept_rows)
