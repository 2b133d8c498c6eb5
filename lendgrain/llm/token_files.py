"""Token ids in binary files: canonical length-limited Huffman codes from global counts, decoded in blocks.

The ids of all documents are counted in Spark; the counts (one row per id of the vocabulary) give one code for all
files. Documents are dealt into ranges of doc_id, so that the files, taken by name, hold them in ascending order.

A file has a head (magic, the vocabulary's code lengths) and blocks of whole documents. Each block stands alone:
its numbers of documents and ids, the documents' ids and lengths, a bit offset for every run of 1024 ids (no run
spans two documents), then the bits, every document at a whole byte. A decoder starts at any run's offset.

Files get names of their own for each attempt of a task, and only the names that finished tasks return are read. A
task holds a block at a time; a block ends with the document that brings it to block_ids ids.

Defined cases: a null text has the end id alone; rows without an id come first; rows that repeat an id follow each
other, in order of their ids; an empty table has no files; texts are taken whole; other columns are not looked at.
"""

import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lendgrain.llm.byte_bpe import worker_encoder
from lendgrain.llm.huffman import LONGEST, RUN, canonical, code_lengths, pack, table, unpack
from lendgrain.llm.shared import new_folder, staged

MAGIC = b"LGTOK1\n"
BLOCK_IDS = 1 << 20
PACKED_IDS = 1 << 17  # at a time; the tables of more do not stay in a core's cache
FILE_BYTES = 128 << 20
END_ID = 0


def token_ids(docs: DataFrame, vocabulary: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n and the ids (little-endian, 16 bits if the vocabulary has no more than 65536 ids) with the end id; and,
    once for each task, a row with nothing but `counts`: how often it has put out each id (64 bits each)."""
    encoder = worker_encoder(vocabulary)
    kind, size = id_type(vocabulary), vocabulary_size(vocabulary)
    end = np.array([end_id], kind)

    def run(batches):
        e, total = encoder(), np.zeros(size, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                ids = e.encode_bytes(part.column(1).to_pylist(), end.tobytes())
                n, column = np.fromiter(map(len, ids), np.int64, len(ids)) // end.itemsize, pa.array(ids, pa.binary())
                total += np.bincount(laid_out(column, kind), minlength=size)
                yield put(part.column(0), pa.array(n), column, pa.nulls(len(n), pa.binary()))
        yield put(pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([total.tobytes()], pa.binary()))

    def put(*columns):
        return pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n", "ids", "counts"])

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, ids binary, counts binary")


def vocabulary_size(path: str) -> int:
    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    return 1 + max([*kind["model"]["vocab"].values(), *(a["id"] for a in kind["added_tokens"])])


def id_type(path: str) -> str:
    return "<u2" if vocabulary_size(path) <= 1 << 16 else "<u4"


def id_counts(tokens: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs in all documents, from the tasks' counts."""
    def run(batches):
        total = np.zeros(size, np.int64)
        for b in batches:
            for x in b.column(0):
                total += np.frombuffer(x.as_py(), np.int64)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int64()), pa.array(total[met], pa.int64())], ["id", "n"])

    counts = np.zeros(size, np.int64)
    rows = tokens.select("counts").where("counts is not null").mapInArrow(run, "id long, n long")
    for r in rows.groupBy("id").agg(F.sum("n").alias("n")).collect():  # one row per id
        counts[r.id] = r.n
    return counts


def laid_out(column: pa.Array, kind: str) -> np.ndarray:
    """The numbers of all rows of a binary column, end to end, without a copy."""
    wide = pa.types.is_large_binary(column.type)
    ends = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2][int(ends[0]):int(ends[-1])], kind) if len(column) and ends[-1] > ends[0] else np.zeros(0, kind)


def runs_of(n: np.ndarray) -> np.ndarray:
    """Lengths of the runs that documents of n ids fall into."""
    many = -(-n // RUN)
    out = np.full(many.sum(), RUN, np.int64)
    out[np.cumsum(many) - 1] = n - (many - 1) * RUN
    return out


def coded(tokens: DataFrame, lengths: np.ndarray, kind: str, limits: list) -> DataFrame:
    """doc_id, n, the Huffman bits of each document, the bit offsets of its runs (little-endian 64-bit), and the range
    that its doc_id falls into."""
    def run(batches):
        codes = canonical(lengths)
        for b in batches:
            n = b.column(1).to_numpy()
            ends = np.cumsum(n)
            of = np.searchsorted(limits, b.column(0).fill_null(0).to_numpy(), "left") + 1 if limits else np.ones(len(n), np.int64)
            of = np.where(b.column(0).is_null().to_numpy(zero_copy_only=False), 0, of).astype(np.int32)
            at = 0
            while at < len(n):
                to = max(at + 1, int(np.searchsorted(ends, ends[at] - n[at] + PACKED_IDS, "right")))
                ids = laid_out(b.column(2).slice(at, to - at), kind)
                first = np.cumsum(n[at:to]) - n[at:to]
                data, place, byte = pack(ids, first, lengths, codes)
                bits, offsets = [], []
                for k, m in enumerate(n[at:to].tolist()):
                    bits.append(data[byte[k]:byte[k + 1]])
                    offsets.append((place[first[k]:first[k] + m:RUN] - byte[k] * 8).astype("<u8").tobytes())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, to - at), b.column(1).slice(at, to - at), pa.array(bits, pa.binary()), pa.array(offsets, pa.binary()), pa.array(of[at:to])], ["doc_id", "n", "bits", "offsets", "part"])
                at = to

    return tokens.mapInArrow(run, "doc_id long, n long, bits binary, offsets binary, part int")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, end_id=END_ID, id_col="doc_id", text_col="text", longest=LONGEST,
                 block_ids=BLOCK_IDS, file_bytes=FILE_BYTES) -> DataFrame:
    """Writes the files; gives (part, number, file, ids) of each, in whose order (part, number) they follow (a written table)."""
    kind, size = id_type(vocabulary), vocabulary_size(vocabulary)
    tokens = staged(token_ids(docs, vocabulary, end_id, id_col, text_col), f"{folder}/ids")
    lengths = code_lengths(id_counts(tokens, size), longest)
    tokens = tokens.where("counts is null").drop("counts")
    head = MAGIC + struct.pack("<I", len(packed := zlib.compress(lengths.tobytes()))) + packed

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        part, number, out, held, total = None, 0, None, [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if out is not None and row[4] != part:
                    yield close(out, part, number, name, ids + total, held)
                    out, held, total, number = None, [], 0, 0
                if out is None:
                    part, name, ids = row[4], f"{uuid.uuid4().hex}.tok", 0
                    out = system.open_output_stream(f"{root}/files/{name}", compression=None)
                    out.write(head)
                held.append(row)
                total += row[1]
                if total >= block_ids:
                    out.write(block(held))
                    ids, held, total = ids + total, [], 0
                    if out.tell() >= file_bytes:
                        yield close(out, part, number, name, ids, held)
                        out, number = None, number + 1
        if out is not None:
            yield close(out, part, number, name, ids + total, held)

    def close(out, part, number, name, ids, held):
        if held:
            out.write(block(held))
        out.close()
        return named(part, number, name, ids)

    def named(part, number, name, ids):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([number], pa.int32()), pa.array([name]), pa.array([ids], pa.int64())], ["part", "number", "file", "ids"])

    system, root = fs.FileSystem.from_uri(folder)
    system.create_dir(f"{root}/files", recursive=True)
    # each range of ids goes to one task and to files of its own, which are numbered by the range
    limits = range_limits(tokens)
    rows = coded(tokens, lengths, kind, limits).repartition(len(limits) + 1, "part").sortWithinPartitions("part", "doc_id", "n", "bits")
    return staged(rows.mapInArrow(run, "part int, number int, file string, ids long"), f"{folder}/names")


def range_limits(tokens: DataFrame) -> list[int]:
    """Ids that cut the documents into ranges of about equal size, two for each shuffle partition; from the id column
    alone, as sampling coded rows would code them twice."""
    parts = 2 * int(tokens.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return sorted(set(tokens.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10_000)).first()[0] or []))


def block(rows: list[tuple]) -> bytes:
    """rows: (doc_id, n, bits, offsets)."""
    ids = np.array([0 if r[0] is None else r[0] for r in rows], "<i8")
    none = np.array([r[0] is None for r in rows], "u1")
    n = np.array([r[1] for r in rows], "<u8")
    size = np.array([len(r[2]) for r in rows], np.int64)
    runs = -(-n.astype(np.int64) // RUN)
    offsets = np.frombuffer(b"".join(r[3] for r in rows), "<u8") + np.repeat((np.cumsum(size) - size) * 8, runs).astype(np.uint64)
    return b"".join([struct.pack("<QQQ", len(rows), len(offsets), int(size.sum())), ids.tobytes(), none.tobytes(), n.tobytes(), offsets.astype("<u8").tobytes(), *(r[2] for r in rows)])


def read_blocks(source):
    """(doc ids, flags of missing ones, numbers of ids, all ids) of each block of a file."""
    def exactly(n):
        data = source.read(n)
        if len(data) != n:
            raise ValueError("a token file breaks off")
        return data

    if exactly(len(MAGIC)) != MAGIC:
        raise ValueError("not a token file")
    tables = table(np.frombuffer(zlib.decompress(exactly(struct.unpack("<I", exactly(4))[0])), np.uint8))
    while head := source.read(24):
        docs, runs, size = struct.unpack("<QQQ", head)
        ids, none, n = np.frombuffer(exactly(8 * docs), "<i8"), np.frombuffer(exactly(docs), "u1"), np.frombuffer(exactly(8 * docs), "<u8").astype(np.int64)
        at = np.frombuffer(exactly(8 * runs), "<u8").astype(np.int64)
        yield ids, none.astype(bool), n, unpack(exactly(size), at, runs_of(n), *tables)


def read_tokens(files: DataFrame, folder: str, with_ids=True) -> DataFrame:
    """One row per document: doc_id, start (ids before it), n_tokens, ids_crc32 and, if asked for, ids (32 bits each)."""
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    placed = files.select("file", F.coalesce(F.sum("ids").over(before), F.lit(0)).alias("start"))
    spread = placed.repartition(max(1, min(files.count(), 10_000)), "file")

    def run(batches):
        system, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with system.open_input_stream(f"{root}/files/{name}", compression=None) as source:
                    for ids, none, n, found in read_blocks(source):
                        ends = np.cumsum(n)
                        pieces = [found[e - k:e].astype("<u4").tobytes() for k, e in zip(n.tolist(), ends.tolist())]
                        columns = [pa.array(ids, pa.int64(), mask=none), pa.array(start + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in pieces], pa.int64())]
                        yield pa.RecordBatch.from_arrays(columns + [pa.array(pieces, pa.binary())] * with_ids, names)
                        start += int(n.sum())

    names = ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids
    return spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids)


def round_trip(docs: DataFrame, vocabulary: str, end_id=END_ID, id_col="doc_id", text_col="text", longest=LONGEST, block_ids=BLOCK_IDS,
               file_bytes=FILE_BYTES, folder=None, with_ids=True) -> DataFrame:
    """Writes and reads back; the files stay in folder."""
    folder = folder or new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, vocabulary, end_id, id_col, text_col, longest, block_ids, file_bytes), folder, with_ids)
