"""SentencePiece encoding and decoding for merge-type vocabularies.

The text's blanks become the meta symbol, one is put in front, and an agenda of adjacent symbol pairs, ordered by
the score of the piece they would make (the leftmost of equal scores first), is worked off until no pair makes a
piece. As no piece of such a vocabulary has a meta symbol after another character (this is checked when the model
is loaded), no merge crosses the start of a run of meta symbols, and the text falls into chunks there. The agendas
of all short chunks of an Arrow batch that the task has not met yet are worked off in step, one merge for each chunk
at a time, in numpy arrays; a long chunk has a heap of its own, to which a merge adds its two new pairs only. A
bounded memory holds the ids of chunks met before. Every newly encoded chunk is checked
against the sentencepiece library before it is used, and a difference stops the job.

Characters without a piece become byte pieces, or the unknown id if the vocabulary has none. Decoding is the
library's decode(ids).

Defined cases: a null text counts as empty and gives the begin and end ids alone; texts are taken whole, a chunk
of any length included; repeated rows and rows without an id are encoded like any other; other columns are not
looked at.
"""

import hashlib
import heapq
import re
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendgrain.llm.shared import kept

META = "▁"
CHUNK = re.compile(f"{META}+[^{META}]*|[^{META}]+")
KEPT_CHUNKS = 400_000
TEXT_BLOCK = 1 << 21
ROWS = 1000
LONG = 128


class Vocabulary:
    """Merge table, character table and byte pieces of a model, and the library's processor to check against."""

    def __init__(self, model_bytes: bytes):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.library = SentencePieceProcessor(model_proto=model_bytes)
        model = pb.ModelProto.FromString(model_bytes)
        spec, kinds = model.normalizer_spec, pb.ModelProto.SentencePiece
        plain = spec.name == "identity" and spec.add_dummy_prefix and spec.escape_whitespaces and not spec.remove_extra_whitespaces
        if model.trainer_spec.model_type != pb.TrainerSpec.BPE or not plain:
            raise ValueError("a merge-type model with an identity normaliser and a dummy prefix is asked for")
        if any(p.type == kinds.USER_DEFINED for p in model.pieces):
            raise ValueError("user-defined pieces are not supported")
        pieces = {p.piece: i for i, p in enumerate(model.pieces) if p.type in (kinds.NORMAL, kinds.UNUSED)}
        if any(p.type == kinds.UNUSED for p in model.pieces):
            raise ValueError("unused pieces are not supported")
        if any(META in p.lstrip(META) for p in pieces):
            raise ValueError("a piece has a meta symbol after another character")
        self.bos, self.eos, self.unk = self.library.bos_id(), self.library.eos_id(), self.library.unk_id()
        self.byte_ids = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == kinds.BYTE}
        # symbols: the ids, and above them characters that only occur inside pieces
        symbol = dict(pieces)
        for c in sorted({c for p in pieces for c in p} - set(pieces)):
            symbol[c] = len(model.pieces) + len(symbol)
        self.of_char = np.full(0x110000, -1, np.int64)
        for s, i in symbol.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.n_pieces = len(model.pieces)
        self.width = max(symbol.values()) + 2
        # the order of the agenda: higher score first, equal scores alike
        order = {v: k for k, v in enumerate(sorted({-model.pieces[i].score for i in pieces.values()}))}
        merges = {}
        for p, i in pieces.items():
            for k in range(1, len(p)):
                if p[:k] in symbol and p[k:] in symbol:
                    merges[symbol[p[:k]] * self.width + symbol[p[k:]]] = (order[-model.pieces[i].score], i)
        self.keys = np.array(sorted(merges), np.int64)
        self.rank = np.array([merges[k][0] for k in self.keys], np.int64)
        self.made = np.array([merges[k][1] for k in self.keys], np.int64)
        self.none = len(order) + 1

    @cached_property
    def merges(self) -> dict:
        """(rank, piece made) by pair; only long chunks ask for it."""
        return dict(zip(self.keys.tolist(), zip(self.rank.tolist(), self.made.tolist())))

    def agenda(self, chunks: list[str]) -> list[bytes]:
        """The ids (little-endian unsigned 32-bit) of each chunk."""
        short = [c for c in chunks if len(c) <= LONG]
        found = iter(self.in_step(short) if short else [])
        return [next(found) if len(c) <= LONG else self.by_heap(c) for c in chunks]

    def symbols(self, text: str) -> np.ndarray:
        """The symbol of each character; those that no piece has are kept as they are, below 0, and never merged."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        symbol = self.of_char[points]
        return np.where(symbol < 0, -1 - points, symbol)

    def by_heap(self, chunk: str) -> bytes:
        """The ids of one chunk: a linked list of symbols and a heap of (rank, place) of the pairs."""
        first = self.symbols(chunk)
        n, pair = len(first), np.where((first[1:] >= 0) & (first[:-1] >= 0), first[:-1] * self.width + first[1:], -1)
        at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
        fits = np.flatnonzero(self.keys[at] == pair)
        heap = (self.rank[at[fits]] * n + fits).tolist()
        heapq.heapify(heap)
        symbol, after, before = first.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        merges, width, none = self.merges, self.width, (None, None)
        while heap:
            rank, left = divmod(heapq.heappop(heap), n)
            right = after[left]
            if right == n or symbol[left] is None:
                continue
            # an entry whose pair is gone counts if the pair now there has its rank: then it is that pair's turn
            now, made = merges.get(symbol[left] * width + symbol[right], none) if symbol[left] >= 0 <= symbol[right] else none
            if now != rank:
                continue
            symbol[left], symbol[right] = made, None
            after[left] = far = after[right]
            if far < n:
                before[far] = left
                new = merges.get(made * width + symbol[far], none)[0] if symbol[far] >= 0 else None
                if new is not None:
                    heapq.heappush(heap, new * n + left)
            near = before[left]
            if near >= 0 and symbol[near] >= 0:
                new = merges.get(symbol[near] * width + made, none)[0]
                if new is not None:
                    heapq.heappush(heap, new * n + near)
        found = np.array([s for s in symbol if s is not None], np.int64)
        odd = (found < 0) | (found >= self.n_pieces)
        return self.with_bytes(found) if odd.any() else found.astype("<u4").tobytes()

    def in_step(self, chunks: list[str]) -> list[bytes]:
        """The ids of some chunks, one merge for each at a time."""
        length = np.fromiter(map(len, chunks), np.int64, len(chunks))
        symbol = self.symbols("".join(chunks))
        chunk = np.repeat(np.arange(len(chunks)), length)
        done_symbol, done_chunk = [], []
        while len(symbol):
            beside = (chunk[1:] == chunk[:-1]) & (symbol[1:] >= 0) & (symbol[:-1] >= 0)
            pair = np.where(beside, symbol[:-1] * self.width + symbol[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            fits = self.keys[at] == pair
            rank = np.r_[np.where(fits, self.rank[at], self.none), self.none]
            starts = np.flatnonzero(np.r_[True, chunk[1:] != chunk[:-1]])
            place = rank * len(rank) + np.arange(len(rank))  # rank first, then the leftmost
            best = np.minimum.reduceat(place, starts)
            merged = best // len(rank) < self.none
            size = np.diff(np.r_[starts, len(symbol)])
            ended = np.repeat(~merged, size)
            done_symbol.append(symbol[ended])
            done_chunk.append(chunk[ended])
            left = best[merged] % len(rank)
            symbol[left] = self.made[at[left]]
            stay = ~ended
            stay[left + 1] = False
            symbol, chunk = symbol[stay], chunk[stay]
        symbol, chunk = np.concatenate(done_symbol), np.concatenate(done_chunk)
        order = np.argsort(chunk, kind="stable")
        symbol, chunk = symbol[order], chunk[order]
        bad = np.flatnonzero((symbol < 0) | (symbol >= self.n_pieces))
        ids, cuts = symbol.astype("<u4"), np.searchsorted(chunk, np.arange(len(chunks) + 1))
        odd = set(chunk[bad].tolist())
        out = []
        for k in range(len(chunks)):
            part = ids[cuts[k]:cuts[k + 1]]
            out.append(self.with_bytes(symbol[cuts[k]:cuts[k + 1]]) if k in odd else part.tobytes())
        return out

    def with_bytes(self, symbols) -> bytes:
        """Symbols of one chunk some of which are no pieces."""
        chars = {i: chr(c) for c, i in enumerate(self.of_char[:0x110000].tolist()) if i >= self.n_pieces} if (symbols >= self.n_pieces).any() else {}
        ids, unknown = [], False
        for s in symbols.tolist():
            if 0 <= s < self.n_pieces:
                ids.append(s)
                unknown = False
                continue
            if self.byte_ids:
                ids.extend(self.byte_ids[b] for b in (chars[s] if s >= 0 else chr(-1 - s)).encode())
            elif not unknown:  # neighbours without a piece make one unknown
                ids.append(self.unk)
                unknown = True
        return np.array(ids, "<u4").tobytes()

    def checked(self, chunks: list[str]) -> list[bytes]:
        """agenda() of chunks, each held against the library."""
        out = self.agenda(chunks)
        # the library puts the leading meta symbol itself, but none for an empty text: a lone one is read after a letter
        want = self.library.encode([c[1:].replace(META, " ") for c in chunks], num_threads=1)
        if META in chunks:
            want[chunks.index(META)] = self.library.encode("a ")[len(self.library.encode("a")):]
        for c, got, ids in zip(chunks, out, want):
            if got != np.array(ids, "<u4").tobytes():
                raise AssertionError(f"differs from the library: {c[:80]!r}")
        return out


class Encoder:
    def __init__(self, vocabulary: Vocabulary, most=KEPT_CHUNKS):
        self.vocabulary, self.most, self.known = vocabulary, most, {}

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """All ids of each text, begin and end included."""
        v = self.vocabulary
        out = []
        for block in blocks(texts):
            cut = [CHUNK.findall((META + t.replace(" ", META)) if t else "") for t in block]
            used = set().union(*cut)
            new = list(used.difference(self.known))
            if len(self.known) + len(new) > self.most:  # keep what this block needs
                self.known = {c: self.known[c] for c in used if c in self.known}
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                self.known.update(zip(part, v.checked(part)))
            first, last = np.array([v.bos], "<u4").tobytes(), np.array([v.eos], "<u4").tobytes()
            out += [np.frombuffer(first + b"".join(map(self.known.__getitem__, c)) + last, "<u4") for c in cut]
        return out

    def forget(self) -> None:
        self.known = {}
        self.vocabulary.__dict__.pop("merges", None)

    def decode(self, ids: list[np.ndarray]) -> list[str]:
        return self.vocabulary.library.decode([x.tolist() for x in ids], num_threads=1)


def blocks(texts):
    """Runs of texts of some MB each, so that the lists of chunks stay small."""
    block, size = [], 0
    for t in texts:
        block.append(t)
        size += len(t or "")
        if size > TEXT_BLOCK:
            yield block
            block, size = [], 0
    if block:
        yield block


def encoded(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit, begin and end included) and the text decoded from them."""
    encoder = worker_encoder(model_path)

    def run(batches):
        e = encoder()
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            at = 0
            for block in blocks(b.column(1).to_pylist()):
                ids = e.encode(block)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(block)), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(e.decode(ids), pa.string())],
                    ["doc_id", "ids", "decoded"])
                at += len(block)
        e.forget()  # the worker goes on to other work

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.select(f'`{id_col}`').dtypes[0][1]}, ids binary, decoded string")


def digests(docs: DataFrame, model_path: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; ids and texts stay in the worker."""
    encoder = worker_encoder(model_path)

    def run(batches):
        e = encoder()
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in (b.slice(at, ROWS) for b in batches for at in range(0, b.num_rows, ROWS)):
            counts, ids_sha, text_sha = [], [], []
            for block in blocks(b.column(1).to_pylist()):
                ids = e.encode(block)
                counts += map(len, ids)
                ids_sha += [sha(x.tobytes()) for x in ids]
                text_sha += [sha(t.encode()) for t in e.decode(ids)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                                             ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        e.forget()  # the worker goes on to other work

    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(
        run, f"doc_id {docs.select(f'`{id_col}`').dtypes[0][1]}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def worker_encoder(model_path: str):
    """The model travels with the function; each Python worker builds its tables once."""
    with open(model_path, "rb") as f:
        model = f.read()
    name = "pieces_" + hashlib.sha256(model).hexdigest()
    return lambda: kept(name, lambda: Encoder(Vocabulary(model)))
